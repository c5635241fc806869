"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations.

Every shard owns `vnodes` points of a 64-bit ring; a row's point is the hash of its doc_id, and it belongs to
the next virtual node clockwise. A shard holds at most its share of the rows (N // shards, the first N % shards
shards one more). A shard's own rows come first: in ring order, as many as it has room for stay. The others continue
clockwise to the next virtual node of a shard that still has room when all own rows are placed. So row counts differ by
one at most, no row leaves its shard for the sake of a stranger, and no more rows move than any placement with these
counts must move.

What is decided one after another is only how many rows of each arc (the stretch of one virtual node) go to which
shard: shards x vnodes counts, whatever the input's size. A row's place in its arc comes from counts of fine ring
cells plus a row_number inside a cell. A cell with very many rows (one doc_id, or no doc_id and one text, may hold a
third of them) is cut into parts by the rows' own numbers, so no task ranks many more than PART_ROWS rows of one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.scratch import table

#: The ring is cut into so many cells; a part of a cell is the unit that one window ranks.
CELL_BITS = 16
PART_ROWS = 200_000
VNODES = 256
ALLOT = "arc int, own int, parts array<struct<lo:long,hi:long,shard:int,base:long>>"


def ring(spark: SparkSession, shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(point, shard), clockwise. A shard's points don't depend on how many shards there are."""
    points = spark.range(shards * vnodes).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("replica"))
    rows = points.select(F.xxhash64(F.lit("vnode"), "shard", "replica").alias("point"), "shard").collect()
    return sorted((r.point, r.shard) for r in rows)


def allot(nodes: list[tuple[int, int]], counts: dict[int, int], shards: int) -> list[tuple[int, int, list[tuple[int, int, int, int]]]]:
    """For each arc: its own shard, and which ranks go to which shard with the slot of the first of them."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    parts: dict[int, list[tuple[int, int, int, int]]] = {}

    def place(arc: int, rank: int, n: int, shard: int) -> int:
        take = min(n, room[shard] - used[shard])
        if take:
            parts.setdefault(arc, []).append((rank, rank + take, shard, used[shard]))
            used[shard] += take
        return take

    stay = {arc: place(arc, 0, n, nodes[arc][1]) for arc, n in sorted(counts.items())}
    for arc, n in sorted(counts.items()):
        rank, at = stay[arc], arc + 1
        while rank < n:
            rank += place(arc, rank, n - rank, nodes[at % len(nodes)][1])
            at += 1
    return [(arc, nodes[arc][1], found) for arc, found in sorted(parts.items())]


def shard_documents(docs: DataFrame, shards: int = 8, vnodes: int = VNODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (from 0 without gaps in each shard), own_shard (the ring's first choice).

    Null text: size 1 and the checksum of nothing. Null doc_id: the text's hash places the row. Repeated rows are rows
    of their own and take neighbouring places on the ring. Empty table: no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    nodes = ring(spark, shards, vnodes)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("point", F.xxhash64(F.coalesce("doc_id", "text_crc32")))
    rows = rows.withColumn("cell", F.shiftright("point", 64 - CELL_BITS).cast("int"))

    # Nodes below a row's point: those of lower slices of the ring, then those of its own. A fixed, small table.
    coarse = 8
    below = [sum(1 for p, _ in nodes if p < (b << (64 - coarse))) for b in range(-(1 << (coarse - 1)), 1 << (coarse - 1))]
    near: list[list[int]] = [[] for _ in below]
    for point, _ in nodes:
        near[(point >> (64 - coarse)) + (1 << (coarse - 1))].append(point)
    guide = spark.createDataFrame([(b - (1 << (coarse - 1)), n, p) for b, (n, p) in enumerate(zip(below, near, strict=True))], "slice int, below int, near array<long>")
    rows = rows.withColumn("slice", F.shiftright("point", 64 - coarse).cast("int")).join(F.broadcast(guide), "slice")
    arc = F.col("below") + F.size(F.filter("near", lambda p: p < F.col("point")))
    rows = rows.select("doc_id", "size", "text_crc32", "point", "cell", F.pmod(arc, F.lit(len(nodes))).cast("int").alias("arc"))

    # The last arc wraps around: its rows beyond the last node come before those below the first, in ring order from the top.
    order = F.when((F.col("arc") == 0) & (F.col("point") > F.lit(nodes[-1][0])), F.col("cell") - (1 << CELL_BITS)).otherwise(F.col("cell"))
    # Written once: a row's own number, and so its part, is the same for the counts and for the ranks.
    rows = table(rows.withColumn("cell", order).withColumn("number", F.monotonically_increasing_id()), "ring")
    cells = rows.groupBy("arc", "cell").agg(F.count(F.lit(1)).alias("n"))
    large = cells.where(F.col("n") > PART_ROWS).select("arc", "cell", F.ceil(F.col("n") / PART_ROWS).alias("n_parts"))  # 65 536 and an arc's ends at most
    rows = rows.join(F.broadcast(large), ["arc", "cell"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("number"), F.col("n_parts")), F.lit(0).cast("long"))).drop("n_parts")
    counts = rows.groupBy("arc", "cell", "part").agg(F.count(F.lit(1)).alias("n"))
    per_arc = {r.arc: r.n for r in cells.groupBy("arc").agg(F.sum("n").alias("n")).collect()}  # shards x vnodes at most
    goes = spark.createDataFrame(allot(nodes, per_arc, shards), ALLOT)

    before = counts.select("arc", "cell", "part", (F.sum("n").over(Window.partitionBy("arc").orderBy("cell", "part")) - F.col("n")).alias("before"))
    place = Window.partitionBy("arc", "cell", "part").orderBy("point", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("place", F.row_number().over(place) - 1).join(before, ["arc", "cell", "part"])
    ranked = ranked.withColumn("rank", F.col("place") + F.col("before")).join(F.broadcast(goes), "arc")
    ranked = ranked.withColumn("to", F.filter("parts", lambda p: (p.lo <= F.col("rank")) & (F.col("rank") < p.hi))[0])
    return ranked.select("doc_id", "size", "text_crc32", F.col("to.shard").alias("shard"), (F.col("to.base") + F.col("rank") - F.col("to.lo")).alias("slot"), F.col("own").alias("own_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "own_shard")
