"""SimHash near-dedup with deletion-variant signatures.

A fingerprint of 64 bits is cut into (radius + 1) / 2 segments, two for radius 3, so two fingerprints that differ by at
most the radius have a segment that differs by at most one bit. For each segment the index holds the segment itself and
one variant for each of its bits, with that bit taken out. Two fingerprints meet under the segment itself if it is equal,
and under exactly one variant, on its two sides, if it differs in one bit; so no pair is met over and over. Meetings are
equality joins on distinct fingerprints, and each is verified by counting the bits that differ.

Copies share a fingerprint and are one node. A key that would meet in many pairs (hot_pairs) isn't expanded into them:
its fingerprints are put under every value that lies within reach of them in the bits outside the segment, and all
that share such a value are linked to one of them (a star). What shares a value is within the radius by the triangle
inequality, and every pair within the radius shares one, so the links' components are the same and their number is
linear in the key's size.

Components come from alternating large-star and small-star steps over written tables, with no link on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import LOWER, raw, read, small_batches
from strandline.scratch import drop, table

SEED = 42
BITS, SEGMENT, RADIUS = 64, 32, 3
#: Pairs of one key beyond which stars take the place of pairs.
HOT_PAIRS = 2048
#: Links up to which a round of components broadcasts smallest neighbours; more of them stay off the driver.
FEW_LINKS = 50_000
#: Shingles that are hashed and counted at once, so that a long text needs no more memory.
SLICE = 1 << 16


def fingerprint(text: bytes, width: int = 3, seed: int = SEED) -> int:
    """The fingerprint of a UTF-8 text: A-Z lower-cased, words between ASCII white space, shingles of `width` words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)))
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(shingles), SLICE):
        part = shingles[k : k + SLICE]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(seed)), np.uint64, len(part))
        ones += bit_counts(h)
    return int.from_bytes(np.packbits(ones * 2 > len(shingles)).tobytes(), "big")


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, from the highest to the lowest; of rows of hashes, one after the other."""
    out = np.zeros(BITS * (h.shape[1] if h.ndim > 1 else 1), np.int64)
    for k in range(0, len(h), 255):  # a byte's counters hold 255 at most
        out += np.unpackbits(h[k : k + 255].astype(">u8").view(np.uint8).reshape(-1, len(out) // 8), axis=1).sum(0, dtype=np.uint8)
    return out


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps = np.array([fingerprint(t, width) for t in raw(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _variants(fps: DataFrame) -> DataFrame:
    """fp, key, side: under key SEGMENT + 1 times the segment plus the variant. side: the bit that was taken out; null for whole segments."""
    low = F.col("fp").bitwiseAND(F.lit((1 << SEGMENT) - 1))
    high = F.shiftrightunsigned("fp", SEGMENT)
    out = fps.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("seg"), low.alias("v")), F.struct(F.lit(1).alias("seg"), high.alias("v")))).alias("s"))
    out = out.select("fp", "s.seg", "s.v", F.explode(F.sequence(F.lit(0), F.lit(SEGMENT))).alias("bit"))  # the last one stands for the whole segment
    mask = F.when(F.col("bit") < SEGMENT, F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0).cast("long"))
    key = F.expr(f"shiftleft(cast(seg * 64 + bit as bigint), {SEGMENT})") + F.col("v").bitwiseAND(F.bitwise_not(mask))
    return out.select("fp", key.alias("key"), F.when(F.col("bit") < SEGMENT, F.col("v").bitwiseAND(mask) != 0).alias("side"))


def _near(a: Column, b: Column, radius: int = RADIUS) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def _apart(rows: DataFrame, n: int | None = None) -> DataFrame:
    """rows for a join by a shuffle: they grow with the corpus, and a broadcast would gather them on the driver first. n: their known bound."""
    return rows.hint("merge") if n is None or n > FEW_LINKS else F.broadcast(rows)


def _stars(members: DataFrame) -> DataFrame:
    """Links of hot keys. members: fp, key, side (null: the segment is equal)."""
    at = F.shiftrightunsigned("key", SEGMENT + 6)  # the segment the key is about; the other one may differ
    flips = F.when(at == 0, F.lit(SEGMENT)).otherwise(F.lit(0))
    one = F.transform(F.sequence(F.lit(0), F.lit(SEGMENT - 1)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k + flips))
    two = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SEGMENT - 2)), lambda i: F.transform(F.sequence(i + 1, F.lit(SEGMENT - 1)), lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), i + flips).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), j + flips)))))
    zero = F.array(F.lit(0).cast("long"))
    other = F.when(at == 0, F.col("fp").bitwiseAND(F.lit(_signed(((1 << 64) - 1) ^ ((1 << SEGMENT) - 1))))).otherwise(F.col("fp").bitwiseAND(F.lit((1 << SEGMENT) - 1)))
    rows = members.withColumn("other", other)
    reached = lambda df, flipped, far: df.select("fp", "key", F.explode(flipped).alias("x"), "other").select("fp", "key", F.col("other").bitwiseXOR(F.col("x")).alias("z"), F.lit(far).alias("far"))
    # One bit in the segment and two outside, or fewer: both within one bit of a value. Equal segment: one within 1, the other within 2.
    near = reached(rows, F.concat(zero, one), False)
    far = reached(rows.where("side is null"), two, True)
    centre = near.groupBy("key", "z").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n"))
    both = near.unionByName(far).join(_apart(centre), ["key", "z"])
    return both.where("fp <> b").select(F.col("fp").alias("a"), "b").where(_near(F.col("a"), F.col("b"))).distinct()


def links(fps: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """a, b: links between distinct fingerprints that join exactly those within RADIUS, directly or over others."""
    # Fingerprints are small and each becomes 66 rows: spread before, as few large tasks would be made of them.
    rows = _variants(fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # Sizes by partial aggregates; a key that very many fingerprints share is split in the join, not gathered in a window.
    size, ones = F.count(F.lit(1)), F.count_if("side")
    pairs = F.when(F.bool_and(F.col("side").isNull()), size * (size - 1) / 2).otherwise(ones * (size - ones))
    sizes = rows.groupBy("key").agg(size.alias("n"), pairs.cast("long").alias("pairs")).where("n > 1 and pairs > 0").select("key", "pairs")
    met = table(rows.join(_apart(sizes), "key").select("fp", "key", "side", "pairs"), "simhash-met")
    cold = met.where(F.col("pairs") <= hot_pairs).drop("pairs")
    left, right = cold.alias("l"), _apart(cold).alias("r")
    sides = F.coalesce(F.col("l.side") < F.col("r.side"), F.col("l.fp") < F.col("r.fp"))
    out = left.join(right, (F.col("l.key") == F.col("r.key")) & sides & _near(F.col("l.fp"), F.col("r.fp"))).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    hot = met.where(F.col("pairs") > hot_pairs).drop("pairs")
    if hot.limit(1).count():
        out = out.unionByName(_stars(hot))
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node that each linked node reaches. Large-star and small-star in turn until nothing changes."""
    # A large-star step links larger neighbours to the smallest one, a small-star step the smaller ones and the node itself.
    mark = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    e = table(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    before = mark(e)
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(_apart(least, before[0]), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(_apart(least, before[0]), "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        used, e = e, table(small, "links")
        drop(used)
        after = mark(e)
        if after == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after


def near_groups(docs: DataFrame, width: int = 3, hot_pairs: int = HOT_PAIRS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, fp, root (its component's smallest fingerprint), component_id (its smallest doc_id).

    Null or empty text: fingerprint 0, linked like any other. Texts of fewer words than a shingle are one shingle. Null
    doc_id stays null and names no component; a component without any doc_id has a null component_id. Repeated rows stay
    and share a component. Empty table: no rows. Other columns are not read.
    """
    rows = table(fingerprints(docs, width, id_col, text_col), "fingerprints")
    return rows.join(_apart(_named(rows, hot_pairs)), "fp").select("doc_id", "fp", "root", "component_id")


def _named(rows: DataFrame, hot_pairs: int) -> DataFrame:
    """fp, root, component_id for the distinct fingerprints of rows (doc_id, fp)."""
    return name_components(rows, links(rows.select("fp").distinct(), hot_pairs))


def name_components(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """fp, root, component_id for the distinct fp of rows (doc_id, fp), of which edges (a, b) link some."""
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(edges)
    named = table(fps.join(_apart(roots), fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(_apart(smallest), "root").select("fp", "root", "component_id")


def drop_near_copies(docs: DataFrame, width: int = 3, hot_pairs: int = HOT_PAIRS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly one row of each component, with all its columns: the one with the smallest doc_id.

    Of rows that share that doc_id, or of a component without any, the one with the smallest SHA-256 of its text stays.
    """
    rows = table(fingerprints(docs, width, id_col, text_col), "fingerprints")
    named = table(_named(rows, hot_pairs), "components")
    return keep_one(docs, rows, named, lambda t: _signed(fingerprint(t, width)), id_col, text_col)


def keep_one(docs: DataFrame, rows: DataFrame, named: DataFrame, value: Callable[[bytes], int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The one row of each component that drop_near_copies describes. rows: doc_id, fp of docs; named: as of name_components; value: a text's fp."""
    id_, fp_, root_ = "__strandline_id", "__strandline_fp", "__strandline_root"
    if rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count() == 0:
        keep = named.select(F.col("component_id").alias(id_))
        return docs.join(keep, docs[id_col].cast("long") == keep[id_], "left_semi")

    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = batch.column(names.index(text_col)).cast(pa.string())
            fps = np.array([value(t) for t in raw(texts)], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps, pa.int64())], [*names, fp_])

    whole = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(fp_, T.LongType())]))
    whole = whole.join(named.select(F.col("fp").alias(fp_), F.col("root").alias(root_)), fp_)
    order = F.struct(whole[id_col].isNull(), whole[id_col].cast("long"), F.sha2(F.coalesce(whole[text_col].cast("string"), F.lit("")), 256))
    one = whole.groupBy(root_).agg(F.min_by(F.struct(*[whole[c] for c in names]), order).alias("row"))
    return one.select("row.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
