"""The registered queries as they return their rows, on a small table, against plain recomputation."""

import hashlib
import random
import re
import zlib

import pytest
import xxhash
from tokenizers import Tokenizer

from strandline.llm import bpe, queries

R = random.Random(21)
WORDS = [f"{a}{b}" for a in ("re", "un", "The", "é", "of") for b in ("ing", "ly", "", "ton", "漢", "'s")]
BASE = [" ".join(R.choice(WORDS) for _ in range(R.randint(0, 120))) for _ in range(40)]
TEXTS = [None, "", " \n", *BASE, *BASE[:12], *(t + " x" for t in BASE[:20]), *(t.replace("re", "RE", 1) for t in BASE[:20]), "<|endoftext|> a\r\nb  c", "MIT License\n" * 30]
DOCS = list(enumerate(TEXTS))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in DOCS], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, int("ing" in (t or "")), int("ton" in (t or ""))) for k, t in DOCS], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def run(spark, sf_dir, name):
    rows = queries.queries()[name](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(DOCS)))
    return {r.doc_id: r for r in rows}


@pytest.mark.parametrize("name, modulus, held", [("op1_toxicity", 4, 2), ("op5_quality", 5, 0)])
def test_classifier_queries(spark, sf_dir, name, modulus, held):
    out = run(spark, sf_dir, name)
    again = run(spark, sf_dir, name)
    for k, r in out.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % modulus == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and again[k].score == r.score
    same = {}
    for k, t in DOCS:
        assert same.setdefault(t or "", out[k].score) == out[k].score


def test_op2(spark, sf_dir):
    for k, r in run(spark, sf_dir, "op2_exact_dedup").items():
        group = [d for d, t in DOCS if (t or "") == (TEXTS[k] or "")]
        assert (r.keep_id, r.group_size, r.kept) == (max(group), len(group), k == max(group))
        assert r.text_sha256 == hashlib.sha256((TEXTS[k] or "").encode()).hexdigest()


def test_op4(spark, sf_dir):
    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        h = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fingerprint(t) for t in TEXTS]
    root = list(range(len(fps)))
    for b in range(len(fps)):
        for a in range(b):
            if (fps[a] ^ fps[b]).bit_count() <= 3 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    out = run(spark, sf_dir, "op4_simhash")
    assert {k: (r.fingerprint, r.component_id) for k, r in out.items()} == {k: (f"{fps[k]:016x}", root[k]) for k in out}


def test_op6(spark, sf_dir):
    out = run(spark, sf_dir, "op6_sharding")
    slots = {s: sorted(r.slot for r in out.values() if r.shard == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    for k, r in out.items():
        data = (TEXTS[k] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)


def test_op9(spark, sf_dir):
    library = Tokenizer.from_file(bpe.default_tokenizer())
    library.no_padding()
    library.no_truncation()
    for k, r in run(spark, sf_dir, "op9_bpe").items():
        ids = library.encode(TEXTS[k] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), decoded)))
