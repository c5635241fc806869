"""Near copies by the Jaccard similarity of their sets of five-word shingles, 0.8 or more, each link verified exactly.

Candidates come from SimHash and deletion variants, as in simhash.py, but with a fingerprint of WORDS * 64 bits: at this
similarity some 15 % of its bits differ, which is beyond the radius that segments of 64 bits can look up whole. Bits that
differ are nearly always bits that the shingles voted on almost evenly. So the fingerprint is dealt into segments of SEGMENT
bits, in DEALS different orders, and a segment's signature is its STRONGEST bits of clearest vote, places and values. A
variant is a signature with one of its bits taken out; texts whose signatures share all bits but one meet under a variant by
an equality join. At 0.8 they do in a segment with a probability of some 0.18, so they miss each other in all 48 with
one of some 1e-4. What meets is verified by counting the bits that differ among the first 128, of which
more than RADIUS differ at 0.8 with a probability below 1e-6, 1e-5 for sets of five; then by the sets themselves.

Each text is first compared with the one that its keys share with most other texts, in a cluster of copies the text that
was copied; only those that this leaves in different components are then compared pair by pair. In keys of at most FEW texts
these are the pairs whose fingerprints are near enough. In larger keys, where that would be too many, fingerprints don't
count, and pairs are ruled out before they are made by what no match can lack: two similar sets share one of their rarest
shingles, and the first one they share, in the order of rarity, bounds what they have in common (prefix and position
filter). So texts that were copied and then edited too much meet seldom.

A set of shingles is known by 128 bits: its node is the lower half, unless another set has the same one; of such sets all
but one are known by their upper half. Some N * N / 2^65 of N texts are concerned. Texts with one set are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import simhash
from strandline.llm.common import LOWER, mix64, raw, small_batches
from strandline.scratch import drop, table

WIDTH, SIMILARITY = 5, 0.8
#: Words of 64 bits of a fingerprint, bits of a segment, orders in which all bits are dealt into segments, bits of a signature.
WORDS, SEGMENT, DEALS, STRONGEST = 32, 128, 3, 5
SEGMENTS = DEALS * WORDS * simhash.BITS // SEGMENT
#: Bits of a signature's entry: the place in its segment and the value.
ENTRY = 8
#: Most bits that may differ of the fingerprint's first 128.
RADIUS = 46
#: Texts of a key up to which all its pairs are candidates.
FEW = 8
SEED = 43
#: Bits for each node that has a key in common with others, and at least and most bits of the table that tells which these
#: are; beyond the most it lets more texts through to the shuffle, and no node is lost.
NODE_BITS, LEAST_BITS, MOST_BITS = 8, 1 << 20, 1 << 30
#: Shingles whose bits are counted at once, so that a long text needs little memory.
SLICE = 1 << 12

_random = np.random.default_rng(SEED)
_SEEDS = _random.integers(0, 1 << 63, WORDS, np.uint64)
_DEALT = np.concatenate([_random.permutation(WORDS * simhash.BITS) for _ in range(DEALS)]).reshape(SEGMENTS, SEGMENT)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; words as in simhash.fingerprint. Fewer words than `width` are one shingle, also none."""
    words = text.translate(LOWER).split()
    parts = [b" ".join(words)] if len(words) <= width else list(map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts)))


def halves(hashes: np.ndarray) -> tuple[int, int]:
    """The set's 128 bits, lower half first, as signed longs."""
    both = xxhash.xxh3_128_intdigest(hashes.tobytes(), SEED)
    return simhash._signed(both & (1 << 64) - 1), simhash._signed(both >> 64)


def node_of(hashes: np.ndarray, shared: dict[int, int]) -> int:
    """The set's number. shared: lower halves that several sets have, with the upper half of the one that keeps it."""
    low, high = halves(hashes)
    return high if shared.get(low, high) != high else low


def votes(hashes: np.ndarray) -> np.ndarray:
    """For each bit of the fingerprint how many more shingles have it than not; the fingerprint has those above zero."""
    ones = np.zeros(WORDS * simhash.BITS, np.int64)
    for k in range(0, len(hashes), SLICE):
        ones += simhash.bit_counts(mix64(hashes[k : k + SLICE, None] ^ _SEEDS))
    return 2 * ones - len(hashes)


def signatures(v: np.ndarray) -> np.ndarray:
    """A number for each segment: its bits of clearest vote by place, ENTRY bits each; of equal votes the later places."""
    dealt = v[_DEALT]
    clear = np.abs(dealt) * SEGMENT + np.arange(SEGMENT)
    top = np.sort(np.argpartition(clear, -STRONGEST, axis=1)[:, -STRONGEST:], axis=1)
    entries = 2 * top + (np.take_along_axis(dealt, top, 1) > 0)
    return (entries << ENTRY * np.arange(STRONGEST)).sum(axis=1)


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """doc_id, node (the lower half), high, n (shingles), f and g (the fingerprint's first 128 bits), signatures. texts: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [shingles(t, width) for t in raw(batch.column(1))]
            both = np.array([halves(h) for h in found], np.int64).reshape(-1, 2)
            counts = [votes(h) for h in found]
            bits = np.packbits(np.array([v[:128] > 0 for v in counts], bool).reshape(-1, 128), axis=1).view(np.int64)
            signed = np.array([signatures(v) for v in counts], np.int64).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * SEGMENTS, pa.int32()), pa.array(signed))
            numbers = [pa.array(np.ascontiguousarray(x)) for x in (both[:, 0], both[:, 1], np.array(list(map(len, found)), np.int64), bits[:, 0], bits[:, 1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, lists], ["doc_id", "node", "high", "n", "f", "g", "signatures"])

    return texts.mapInArrow(run, "doc_id long, node long, high long, n long, f long, g long, signatures array<long>")


def variants(signed: DataFrame) -> DataFrame:
    """node, key: for each of its signatures one key for each bit that is taken out. signed: node, signatures."""
    rows = signed.select("node", F.posexplode("signatures").alias("segment", "s"))
    rest = STRONGEST * ENTRY - ENTRY
    taken = [F.shiftright(F.col("s"), ENTRY * (k + 1)) for k in range(STRONGEST)]
    left = [F.shiftleft(t, ENTRY * k).bitwiseOR(F.col("s").bitwiseAND(F.lit((1 << ENTRY * k) - 1).cast("long"))) for k, t in enumerate(taken)]
    at = F.shiftleft(F.col("segment").cast("long"), rest)
    return rows.select("node", F.explode(F.array(*(at.bitwiseOR(x) for x in left))).alias("key"))


def shared_halves(sets: DataFrame) -> dict[int, int]:
    """Lower halves that different sets have: a chance event, so there are few of them however many texts there are."""
    return dict(sets.groupBy("node").agg(F.min("high").alias("kept"), F.max("high").alias("other")).where("kept <> other").select("node", "kept").toLocalIterator())


def numbered(sets: DataFrame, shared: dict[int, int]) -> DataFrame:
    """sets with the numbers of node_of in place of the halves."""
    for low, kept in shared.items():
        sets = sets.withColumn("node", F.when((F.col("node") == low) & (F.col("high") != kept), F.col("high")).otherwise(F.col("node")))
    return sets.drop("high")


def _hashes(texts: DataFrame, met: DataFrame, width: int, shared: dict[int, int]) -> DataFrame:
    """node, h (its shingles' hashes): each node of met once, some others too."""
    n = met.agg(F.count_distinct("node")).first()[0]
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (NODE_BITS * n).bit_length()))
    words = met.select(F.col("node").bitwiseAND(F.lit(size - 1)).alias("bit")).groupBy(F.shiftright("bit", 5).alias("word"))
    bits = np.zeros(size // 32, np.uint32)
    for word, value in words.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))"))).toLocalIterator():
        bits[word] = value
    known = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value
        for batch in small_batches(batches):
            found = [(node_of(h, shared), h) for h in (shingles(t, width) for t in raw(batch.column(1)))]
            found = [(x, h.tobytes()) for x, h in found if bits[(x & size - 1) >> 5] >> (x & 31) & 1]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([h for _, h in found], pa.binary())], ["node", "h"])

    return texts.mapInArrow(run, "node long, h binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, hashes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            left, right = ([np.frombuffer(h, np.uint64) for h in batch.column(k).to_pylist()] for k in (2, 3))
            keep = [similar(a, b, similarity) for a, b in zip(left, right, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(hashes.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a").join(hashes.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b")
    return both.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def _each(hashes: DataFrame) -> DataFrame:
    """node, x: a row for each shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [np.frombuffer(h, np.uint64) for h in batch.column(1).to_pylist()]
            if found:
                nodes = np.repeat(batch.column(0).to_numpy(), list(map(len, found)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate(found).view(np.int64))], ["node", "x"])

    return hashes.mapInArrow(run, "node long, x long")


def _rarest(near: DataFrame, hashes: DataFrame, similarity: float) -> DataFrame:
    """near (node, n and others), x and pos: its rarest shingles, so many that any two similar sets share one; those that are its own alone left out, but counted in pos."""
    every = _each(hashes.join(near.select("node"), "node", "left_semi").select("node", "h"))
    shared = every.groupBy("x").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    ranked = every.join(shared, "x").withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("c", "x")))
    ranked = ranked.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("node"))).select("node", "x", "rank", "m").join(near, "node")
    ranked = ranked.withColumn("pos", F.col("n") - F.col("m") + F.col("rank"))  # the place among all its shingles, rarest first
    return ranked.where(F.col("pos") <= F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1).drop("rank", "m")


def _possible(left: Column, right: Column, similarity: float) -> Column:
    """Whether l and r can be similar if they have no more in common than these numbers of shingles."""
    most = F.least(left, right)
    return most >= similarity * (F.col("l.n") + F.col("r.n") - most) - 1e-9


def _close(similarity: float) -> Column:
    """Whether the numbers of shingles and the fingerprints of l and r let them be similar."""
    apart = F.bit_count(F.col("l.f").bitwiseXOR(F.col("r.f"))) + F.bit_count(F.col("l.g").bitwiseXOR(F.col("r.g")))
    return _possible(F.col("l.n"), F.col("r.n"), similarity) & (apart <= RADIUS)


def _pairs(left: DataFrame, right: DataFrame, by: str, where: Column) -> DataFrame:
    """a, b: the distinct pairs of nodes that share `by`. The join is one by a shuffle: its rows grow with the corpus."""
    both = left.alias("l").join(right.hint("merge").alias("r"), (F.col(f"l.{by}") == F.col(f"r.{by}")) & where)
    return both.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()


def links(sets: DataFrame, texts: DataFrame, width: int, similarity: float, shared: dict[int, int], held: list[DataFrame]) -> DataFrame:
    """a, b: links between nodes that join exactly those whose similarity is high enough, directly or over others.

    held: gets the tables that the links are read from, which may go afterwards.
    """
    distinct = sets.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "f", "g")))
    rows = variants(sets.groupBy("node").agg(F.first("signatures").alias("signatures")))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = table(rows.join(sizes.hint("merge"), "key").join(distinct.hint("merge"), "node"), "near-met")
    cold, hot = met.where(F.col("size") <= FEW), met.where(F.col("size") > FEW)
    # The text that was copied shares keys with most of its copies; the degree tells it from them. One pair for each text.
    degree = met.groupBy("node").agg(F.sum("size").alias("degree"))
    ranked = met.join(degree.hint("merge"), "node")
    centre = ranked.groupBy("key").agg(F.max(F.struct("degree", "node", "n", "f", "g")).alias("r"))
    best = met.alias("l").join(centre.hint("merge"), "key").groupBy(F.col("l.node").alias("a")).agg(F.max(F.struct(_close(similarity) & (F.col("l.node") != F.col("r.node")), "r.degree", F.col("r.node").alias("b"))).alias("best"))
    star = table(best.where("best.col1").select("a", "best.b"), "near-star")
    others = table(_pairs(cold, cold, "key", (F.col("l.node") < F.col("r.node")) & _close(similarity)), "near-others")
    nodes = star.unionByName(others).select(F.explode(F.array("a", "b")).alias("node")).unionByName(hot.select("node")).distinct()
    hashes = table(_hashes(texts, nodes, width, shared), "near-hashes")
    first = table(_verified(star, hashes, similarity), "near-first")
    roots = table(simhash.components(first), "near-roots")
    for end in ("a", "b"):
        others = others.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")).hint("merge"), end, "left")
    others = others.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    second = table(_verified(others, hashes, similarity), "near-second")
    rest = hot.join(roots.hint("merge"), "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    several = lambda df, by: df.join(df.groupBy(by).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select(by), by)
    near = table(several(rest, "key").select("node", "n", "root").distinct(), "near-rest")
    drop(met, star)
    rare = several(table(_rarest(near, hashes, similarity), "near-rare"), "x")
    held += [hashes, first, second, near, rare]
    # Of two similar sets the smaller one has 2 s / (1 + s) of its shingles in common, more than the larger need have, so
    # fewer of its rarest ones suffice. Pages of one template that differ enough share none of these.
    few = F.col("pos") <= F.col("n") - F.ceil(2 * similarity / (1 + similarity) * F.col("n") - 1e-9) + 1
    smaller = (F.col("l.n") < F.col("r.n")) | ((F.col("l.n") == F.col("r.n")) & (F.col("l.node") < F.col("r.node")))
    # Before the first shingle that two sets share there is none in common: the pair is made there, if anywhere.
    reach = _possible(F.col("l.n") - F.col("l.pos") + 1, F.col("r.n") - F.col("r.pos") + 1, similarity)
    pairs = _pairs(rare.where(few), rare, "x", smaller & (F.col("l.root") != F.col("r.root")) & reach)
    return first.unionByName(second).unionByName(_verified(pairs, hashes, similarity))


def drop_near_copies(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly one row of each component of near copies, with all its columns: the one that simhash.keep_one names.

    Null and empty texts are copies of each other. Texts of fewer words than a shingle are one shingle.
    """
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    sets = table(_sets(texts, width), "near-sets")
    shared = shared_halves(sets)
    sets = numbered(sets, shared)
    rows = sets.select("doc_id", F.col("node").alias("fp"))
    held: list[DataFrame] = []
    named = table(simhash.name_components(rows, links(sets, texts, width, similarity, shared, held)), "components")
    drop(*held)
    return simhash.keep_one(docs, rows, named, lambda t: node_of(shingles(t, width), shared), id_col, text_col)
