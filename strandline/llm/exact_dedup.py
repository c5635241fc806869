"""Exact dedup through a minimal perfect hash over historical distinct digests.

History is a table of distinct SHA-256 digests with, for each, the locator of the row that won and how many rows it
stands for. It is cut by digest into shards of bounded size; each shard is a minimal perfect hash (levels of bit
arrays: a key lies at its first level without a collision, its slot is the rank of its bit) plus slots that hold the
full digest and the winner. A lookup computes one slot and compares all 32 bytes. Rows whose digest is found are
repeats of a winner; rows whose digest isn't are grouped among themselves.

Without an earlier corpus the table is taken in two parts (`exact_groups_in_parts`): the digests of half its rows are the
history, the other half is looked up in it. Members are repeats and may bring a larger doc_id; nonmembers are grouped
separately. Both make the table of all winners, which every row is then looked up in, so no row meets its group by a join.

`exact_groups` without a history takes the digests that occur more than once as the history, as only those can remove a
row; the rest are nonmembers and form groups of their own.

Nothing is gathered by group: winners come from partial aggregates, lookups meet their shard by (shard, salt), where
a shard with many rows (one digest may hold a third of them) is copied to as many salts as it needs.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import mix64, read
from strandline.scratch import drop, table

#: Digests in one shard and rows that one lookup task takes of it, about.
SHARD_KEYS = 50_000
LOOKUP_ROWS = 100_000
#: Digests in one shard where whole tables are the history: more and smaller shards, so that all tasks have some.
PART_KEYS = 4_000
#: Bits of a level for each key that reaches it, and the levels at most; what is left then is compared one by one.
GAMMA, LEVELS = 2.0, 40


class PerfectHash:
    """Minimal perfect hash over distinct 32-byte digests."""

    def __init__(self, digests: np.ndarray):
        """digests: uint8 (n, 32), distinct."""
        self.levels: list[np.ndarray] = []  # packed bits
        self.sizes: list[int] = []
        self.ranks: list[np.ndarray] = []  # set bits before each byte, those of earlier levels included
        keys, left, seen = self.fold(digests), np.arange(len(digests)), 0
        while len(left) and len(self.levels) < LEVELS:
            m = max(8, int(GAMMA * len(left)))
            at = self.place(keys[left], len(self.levels), m)
            alone = np.bincount(at, minlength=m) == 1
            bits = np.packbits(alone)
            counts = np.bitwise_count(bits).astype(np.int64)
            self.levels.append(bits)
            self.sizes.append(m)
            self.ranks.append(seen + np.cumsum(counts) - counts)
            seen += int(counts.sum())
            left = left[~alone[at]]
        self.rest = {bytes(digests[k]): seen + i for i, k in enumerate(left)}

    @staticmethod
    def fold(digests: np.ndarray) -> np.ndarray:
        w = np.ascontiguousarray(digests).view("<u8")
        return mix64(w[:, 0] ^ mix64(w[:, 1] ^ mix64(w[:, 2] ^ mix64(w[:, 3]))))

    @staticmethod
    def place(keys: np.ndarray, level: int, m: int) -> np.ndarray:
        return (mix64(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(m)).astype(np.int64)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """A slot for each digest; for a digest outside the set any slot, or -1."""
        out = np.full(len(digests), -1, np.int64)
        keys, left = self.fold(digests), np.arange(len(digests))
        for level, (bits, m, ranks) in enumerate(zip(self.levels, self.sizes, self.ranks, strict=True)):
            at = self.place(keys[left], level, m)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            here = (bits[byte] >> (np.uint8(7) - bit)) & 1 == 1
            head = bits[byte] >> (np.uint8(7) - bit) >> 1
            out[left[here]] = (ranks[byte] + np.bitwise_count(head))[here]
            left = left[~here]
        for k in left if self.rest else ():
            out[k] = self.rest.get(bytes(digests[k]), -1)
        return out


def pack(digests: np.ndarray, winner: np.ndarray, doc_id: np.ndarray, no_id: np.ndarray, size: np.ndarray) -> bytes:
    """A shard as bytes: the hash and, by slot, digest, winner's locator, winner's doc_id and rows."""
    mph = PerfectHash(digests)
    slot = mph.slots(digests)
    by_slot = np.empty(len(slot), np.int64)
    by_slot[slot] = np.arange(len(slot))
    out = io.BytesIO()
    rest = np.frombuffer(b"".join(mph.rest), np.uint8)
    np.savez(out, digests=digests[by_slot], winner=winner[by_slot], doc_id=doc_id[by_slot], no_id=no_id[by_slot], size=size[by_slot], sizes=np.array(mph.sizes, np.int64), rest=rest, rest_slots=np.array(list(mph.rest.values()), np.int64), bits=np.concatenate(mph.levels), ranks=np.concatenate(mph.ranks))
    return out.getvalue()


def unpack(blob: bytes) -> tuple[PerfectHash, dict[str, np.ndarray]]:
    z = dict(np.load(io.BytesIO(blob)))
    mph = PerfectHash(np.empty((0, 32), np.uint8))
    cuts = np.cumsum([0, *((z["sizes"] + 7) // 8)])
    mph.sizes = [int(m) for m in z["sizes"]]
    mph.levels = [z["bits"][a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    mph.ranks = [z["ranks"][a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    mph.rest = {bytes(d): int(s) for d, s in zip(z["rest"].reshape(-1, 32), z["rest_slots"], strict=True)}
    return mph, z


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, locator (the row's own number), digest (32 bytes), written once: locators hold for all later steps."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return table(docs.select(docs[id_col].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("locator"), F.unhex(F.sha2(text, 256)).alias("digest")), "digests")


def winners(rows: DataFrame) -> DataFrame:
    """digest, winner (locator), doc_id, size: of equal texts the row with the largest doc_id; of its repeats the last row."""
    best = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("best"), F.count(F.lit(1)).alias("size"))
    return best.select("digest", F.col("best.locator").alias("winner"), F.col("best.doc_id").alias("doc_id"), "size")


def _shard_of(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """shard, blob: the packed shards of winners()-like rows with distinct digests."""

    def build(group: pa.Table) -> pa.Table:
        t = group.combine_chunks()
        doc_id, no_id = t["doc_id"].fill_null(0).to_numpy(), t["doc_id"].is_null().to_numpy()
        blob = pack(_matrix(t["digest"]), t["winner"].to_numpy(), doc_id, no_id, t["size"].to_numpy())
        return pa.table({"shard": pa.array([t["shard"][0].as_py()], pa.int32()), "blob": pa.array([blob], pa.binary())})

    return history.withColumn("shard", _shard_of(shards)).groupBy("shard").applyInArrow(build, "shard int, blob binary")


def look_up(rows: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """rows plus member boolean, winner, winner_id, size (null for nonmembers)."""
    schema = "doc_id long, locator long, digest binary, member boolean, winner long, winner_id long, size long"
    rows = rows.withColumn("shard", _shard_of(shards))
    salts = rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / LOOKUP_ROWS).cast("int").alias("salts"))
    copies = salts.join(index, "shard", "left").select(F.col("shard").alias("of"), "blob", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("copy"))
    rows = rows.join(salts.withColumnRenamed("shard", "of"), F.col("shard") == F.col("of")).drop("of").withColumn("salt", F.pmod(F.xxhash64("locator"), F.col("salts")).cast("int"))

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        t, blobs = left.combine_chunks(), right["blob"].to_pylist()
        n = t.num_rows
        digests = _matrix(t["digest"])
        member, slot, z = np.zeros(n, bool), np.zeros(n, np.int64), None
        if n and blobs and blobs[0] is not None:
            mph, z = unpack(blobs[0])
            slot = mph.slots(digests)
            inside = slot >= 0
            member[inside] = (z["digests"][slot[inside]] == digests[inside]).all(1)
        got = lambda k: pa.array(z[k][slot] if z is not None else np.zeros(n, np.int64), pa.int64(), mask=~member)
        winner_id = pa.array(z["doc_id"][slot], pa.int64(), mask=~member | z["no_id"][slot]) if z is not None else pa.nulls(n, pa.int64())
        return pa.table({"doc_id": t["doc_id"], "locator": t["locator"], "digest": t["digest"], "member": pa.array(member), "winner": got("winner"), "winner_id": winner_id, "size": got("size")})

    return rows.groupBy("shard", "salt").cogroup(copies.groupBy("of", "copy")).applyInArrow(find, schema)


def exact_groups(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, locator, digest, keep_id, winner, group_size, kept, member.

    history: winners() of earlier rows (digest, winner, doc_id, size); rows found there are repeats of its winners and
    none of them is kept. Without it, equal texts of docs form a group and its row with the largest doc_id is kept (null
    is smallest; of repeated rows of one doc_id exactly one is kept). Null text counts as empty, and empty texts are equal.
    Empty table: no rows. Other columns are not read.
    """
    rows = digest_rows(docs, id_col, text_col)
    given = history is not None
    if not given:
        history = table(winners(rows).where("size > 1"), "history")
    shards = max(1, -(-history.count() // SHARD_KEYS))
    found = table(look_up(rows, build_index(history, shards), shards), "found")
    drop(rows)
    if not given:
        drop(history)
    members = found.where("member")
    alone = found.where("not member").drop("winner", "winner_id", "size")
    own = winners(alone.select("doc_id", "locator", "digest")).withColumnRenamed("doc_id", "winner_id")
    columns = ["doc_id", "locator", "digest", F.col("winner_id").alias("keep_id"), "winner", F.col("size").alias("group_size")]
    kept = F.lit(False) if given else F.col("locator") == F.col("winner")
    members = members.select(*columns, kept.alias("kept"), "member")
    alone = alone.join(own, "digest").select(*columns, (F.col("locator") == F.col("winner")).alias("kept"), "member")
    return members.unionByName(alone)


def exact_groups_in_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_keys: int = PART_KEYS) -> DataFrame:
    """doc_id, locator, digest, keep_id, winner, group_size, kept: exact_groups() of a table that is half its own history.

    Nulls, repeats and ties as there; which rows are the history doesn't matter to the result.
    """
    rows = digest_rows(docs, id_col, text_col)
    earlier = F.pmod(F.xxhash64("locator"), F.lit(2)) == 0

    def meet(some: DataFrame, known: DataFrame) -> DataFrame:
        shards = max(1, -(-known.count() // part_keys))
        return look_up(some, build_index(known, shards), shards)

    history = table(winners(rows.where(earlier)), "history")
    found = table(meet(rows.where(~earlier), history), "found")
    repeats = found.where("member").groupBy(F.col("winner").alias("of")).agg(F.max(F.struct("doc_id", F.col("locator").alias("winner"))).alias("later"), F.count(F.lit(1)).alias("n"))
    settled = history.join(repeats, F.col("winner") == F.col("of"), "left").withColumn("best", F.greatest(F.struct("doc_id", "winner"), "later"))
    settled = settled.select("digest", F.col("best.winner").alias("winner"), F.col("best.doc_id").alias("doc_id"), (F.col("size") + F.coalesce("n", F.lit(0))).alias("size"))
    known = table(settled.unionByName(winners(found.where("not member").select("doc_id", "locator", "digest"))), "winners")
    drop(history, found)
    out = meet(rows, known)
    return out.select("doc_id", "locator", "digest", F.col("winner_id").alias("keep_id"), "winner", F.col("size").alias("group_size"), (F.col("locator") == F.col("winner")).alias("kept"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_groups() keeps, with all columns as they are."""
    mark, digest = "__strandline_id", "__strandline_digest"
    groups = table(exact_groups(docs, None, id_col, text_col).select(F.col("doc_id").alias(mark), F.hex("digest").alias(digest), "kept"), "groups")
    text = F.upper(F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256))
    same = lambda rows: (rows[digest] == text) & rows[mark].eqNullSafe(docs[id_col].cast("long"))
    kept = groups.where("kept").select(mark, digest)
    # Rows that repeat both doc_id and text can't be told apart by them: of these one stays. Mostly there are none.
    again = groups.groupBy(mark, digest).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(mark, digest)
    if again.limit(1).count() == 0:
        return docs.join(kept, same(kept), "left_semi")
    once = kept.join(again, kept[mark].eqNullSafe(again[mark]) & (kept[digest] == again[digest]), "left_anti")
    several = docs.join(again, same(again), "left_semi").withColumn(mark, docs[id_col].cast("long")).withColumn(digest, text)
    several = several.join(kept, several[mark].eqNullSafe(kept[mark]) & (several[digest] == kept[digest]), "left_semi")
    one = several.groupBy(mark, digest).agg(F.first(F.struct(*docs.columns)).alias("row")).select("row.*")
    return docs.join(once, same(once), "left_semi").unionByName(one)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_groups_in_parts(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
