"""Byte-level BPE: a backtracking encoder and a decoder over an offset table.

Encoding. An Aho-Corasick automaton over the vocabulary gives the longest token at every byte of a pre-token. The
encoder takes it if it may stand beside the token before it; else it tries the token's next shorter prefix; else it
goes one token back. Two tokens may stand side by side if the merges, applied to both together, leave that boundary:
this is looked up in the table of merges by undoing the later of the two tokens' merges, one at a time. Each end
position is refused once at most, so time is linear in the text, and the result is exactly that of the merge rules.

Decoding. All tokens' bytes lie in one blob; ids are turned into bytes by gathering blob[offset[id] : offset[id + 1]].

A tokenizer is a JSON file of the tokenizers library with a BPE model, ByteLevel pre-tokenizer and decoder. The driver
reads it; executors get its tables in a broadcast (a vocabulary's size, not the corpus's).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import Remembered, read, small_batches, strings

#: White space as Unicode has it; Python's own class has four control characters more.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
#: The byte-level pre-tokenizer's pattern.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
#: Tokens that are decoded at once.
DECODE_SLICE = 1 << 16
#: Pieces between spaces and pairs of tokens that a worker remembers, in two generations of so many each: about 75 MB.
REMEMBER = 200_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def load(path: str) -> dict:
    """The tables of a tokenizer file. Raises ValueError for kinds of tokenizers that this encoder doesn't reproduce."""
    with open(path, "rb") as file:
        data = file.read()
    spec = json.loads(data)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    odd = spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)
    odd = odd or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if odd or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")
    symbols = byte_symbols()
    plain = lambda token: bytes(symbols[c] for c in token)
    ids = {plain(t): i for t, i in model["vocab"].items()}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    return {"ids": ids, "merges": [(plain(a), plain(b)) for a, b in merges], "added": added, "digest": hashlib.sha256(data).hexdigest()}


class Codec:
    """Encoder and decoder over load()'s tables."""

    def __init__(self, tables: dict, remember: int = REMEMBER):
        ids: dict[bytes, int] = tables["ids"]
        # Ranks: single bytes, then what the merges make, in their order.
        rank: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.left, self.right = list(range(256)), list(range(256))
        self.pairs: dict[tuple[int, int], int] = {}
        for a, b in tables["merges"]:
            if a + b not in rank:
                rank[a + b] = len(rank)
                self.left.append(rank[a])
                self.right.append(rank[b])
            self.pairs[rank[a], rank[b]] = rank[a + b]
        self.token = list(rank)
        self.ids = [np.int32(ids[t]).tobytes() for t in self.token]
        self.size = [len(t) for t in self.token]
        self.back = [n - 1 for n in self.size]  # from a match's last byte to its first
        self.shorter = [next((rank[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in rank), -1) for t in self.token]
        self.automaton = ahocorasick.Automaton()
        for t, r in rank.items():
            self.automaton.add_word(t.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = Remembered(lambda pair: self._fits(*pair), remember)
        self.pattern = regex.compile(PATTERN)
        self.chunks = Remembered(self._piece, remember)
        self.between = re.compile(rf"(?<=[^{SPACES}]) (?=[^{SPACES}])")
        self.added = {text: np.int32(i).tobytes() for text, i in tables["added"].items()}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        by_id = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in tables["added"].items()}
        self.blob = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(max(by_id) + 1)), np.uint8)
        self.offset = np.array([0, *accumulate(len(by_id.get(i, b"")) for i in range(max(by_id) + 1))], np.int64)

    def _fits(self, a: int, b: int) -> bool:
        """Whether the merge rules leave the boundary between these two tokens alone."""
        before = len(self.token)  # merges from this rank on can't happen any more
        while True:
            if self.pairs.get((a, b), before) < before:
                return False
            # Undo the later merge of the two, on the side of the boundary. Of equal ones the right one was made later.
            if a >= 256 and a > b:
                before, a = a, self.right[a]
            elif b >= 256:
                before, b = b + 1, self.left[b]
            else:
                return True

    def _piece(self, piece: str) -> bytes:
        """The ids of a space and the piece behind it, which holds none. Letters alone are one pre-token."""
        return self._word(" " + piece) if piece.isalpha() else b"".join(map(self._word, self.pattern.findall(" " + piece)))

    def _word(self, word: str) -> bytes:
        """The ids of a pre-token as 32-bit integers."""
        data = word if word.isascii() else word.encode("utf-8").decode("latin-1")
        size, back, fits, shorter, ids, n = self.size, self.back, self.fits, self.shorter, self.ids, len(data)
        longest: list[int] = [-1] * (n + 1)
        for end, r in self.automaton.iter(data):
            longest[end - back[r]] = r  # ends come in order: the last match from a place is its longest
        last = longest[0]
        at = size[last]
        if at == n:
            return ids[last]
        out, refused, token = [last], None, longest[at]  # refused: places that no token may end at; mostly there are none
        while at < n:
            if refused is None:
                while token >= 0 and not fits[last, token]:
                    token = shorter[token]
            else:
                while token >= 0 and (refused[at + size[token]] or last >= 0 and not fits[last, token]):
                    token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                last, token = token, longest[at]
            else:
                refused = refused or bytearray(n + 1)
                refused[at] = 1
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1
        return b"".join([ids[r] for r in out])

    def _segment(self, text: str) -> bytes:
        """A text without added tokens. It is cut at each single space between two other characters: there a pre-token always begins."""
        if text[0] == " " or text[-1] == " " or any(c in text and (c + " " in text or " " + c in text) for c in SPACES):
            pieces = self.between.split(text)
        else:
            pieces = text.split(" ")
        first = b"".join(map(self._word, self.pattern.findall(pieces[0])))
        pieces[0] = ""
        ids = list(map(self.chunks.__getitem__, pieces[1:]))
        return first + b"".join(ids)

    def encode(self, text: str) -> np.ndarray:
        parts = self.split_added.split(text) if self.split_added and any(t in text for t in self.added) else [text]
        return np.frombuffer(b"".join(self.added.get(p) or self._segment(p) for p in parts if p), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The bytes of all ids as UTF-8; what isn't valid becomes U+FFFD. Ids without a token give nothing."""
        out = []
        for k in range(0, len(ids), DECODE_SLICE):
            part = ids[k : k + DECODE_SLICE].astype(np.int64)
            part = part[(part >= 0) & (part < len(self.offset) - 1)]
            start = self.offset[part]
            n = self.offset[part + 1] - start
            ends = np.cumsum(n)
            out.append(self.blob[np.repeat(start - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes())
        return b"".join(out).decode("utf-8", "replace")


def _broadcast(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(load(path))


_codecs: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    """One codec for each worker process, known by the digest of its tables: its memory of frequent words outlives a task."""
    tables = shared.value
    if tables["digest"] not in _codecs:
        _codecs.clear()
        _codecs[tables["digest"]] = Codec(tables)
    return _codecs[tables["digest"]]


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_decoded: bool = False) -> DataFrame:
    """doc_id, ids array<int> and, if asked for, decoded (the text that the ids decode to), one row for each row of docs.

    Special tokens' strings in a text become their ids, as the library does by default; nothing is added or cut.
    Null or empty text: no ids. Null doc_id stays null, repeated rows stay. Empty table: no rows. Other columns aren't read.
    """
    shared = _broadcast(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in small_batches(batches):
            ids = [codec.encode(t) for t in strings(batch.column(1))]
            flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
            column = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), flat)
            out = [batch.column(0), column] + ([pa.array([codec.decode(x) for x in ids], pa.string())] if with_decoded else [])
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "decoded"][: len(out)])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * with_decoded)


def decode_documents(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text. Null or empty ids: the empty text; a null among the ids and ids without a token give nothing."""
    shared = _broadcast(encoded.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in small_batches(batches):
            texts = [codec.decode(np.array([-1 if i is None else i for i in x or []], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def with_length(encoded: DataFrame) -> DataFrame:
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_documents(read(spark, sf_dir, "documents"), default_tokenizer(), with_decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
