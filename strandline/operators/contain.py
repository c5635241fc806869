"""The containment verdict: a file is redundant if another one has all its keys and more, or the same keys and a smaller name.

A set-containment self-join without comparing all pairs of files, and for the verdict without making all pairs of sets:

1. Files with equal key sets are members of one set, known by the number of its keys and four hashes of them combined by
   xor. Files without keys are members of the empty set, which every other set contains.
2. The verdict (`redundancy`) sweeps the sets in rounds against an index that shrinks to the maximal ones. The index says
   of each key which of its sets is the largest. If that is no larger than a set for one of the set's keys, nothing holds
   the set; else the smallest of these largest sets is compared with it. A set that is held leaves the index: what it
   holds is held by its holder too. A thousand nested exports of one mailbox are a thousand comparisons, not half a million.
3. What no round settles is compared with all sets of the index that have its rarest key and are in size between it and
   its bound; they must also hold two other keys of it before any key is counted.
4. Pairs stand between sets and only where they are asked for: `links` for all, `lists` for what a person reads, whose
   pairs lead to kept sets alone unless all names are wanted. Files are told by `members`.

Keys, sets and pairs are written as tables: what computes the keys is planned and run once.
Files of one name are never compared with each other, so a set whose only name is the other's doesn't make it redundant.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.scratch import drop, table

WORDS = 4
#: Keys of a set that a candidate must hold before it is compared with the whole set.
PROBES = 3
#: Another round is worth its jobs if the last one settled this share of its sets.
PROGRESS = 0.2


@dataclass
class Containment:
    """members: file_id, name, n_keys, set_id. sets: set_id, n_keys, n_files, low and high (its smallest and largest name).
    set_keys: set_id, n_keys, key."""

    members: DataFrame
    sets: DataFrame
    set_keys: DataFrame

    @functools.cached_property
    def pairs(self) -> DataFrame:
        """a, b: each set and every set that properly contains it. As many rows as there are such pairs."""
        return table(supersets(self.set_keys).unionByName(_over_nothing(self.sets, self.sets)), "supersets")


def _over_nothing(sets: DataFrame, holders: DataFrame) -> DataFrame:
    nothing = sets.where("n_keys = 0").select(F.col("set_id").alias("a"))  # one row at most
    return holders.where("n_keys > 0").select(F.col("set_id").alias("b")).crossJoin(F.broadcast(nothing)).select("a", "b")


def containment(keys: DataFrame, files: DataFrame) -> Containment:
    """keys: file_id, key (distinct); files: file_id, name. A file without keys has the empty set."""
    keys = table(keys.select("file_id", "key"), "keys")
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "key")).alias(f"x{k}") for k in range(WORDS)]
    by_file = keys.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_keys"), *marks)
    named = files.select("file_id", "name").join(by_file, "file_id", "left").na.fill(0)
    set_id = F.md5(F.concat_ws(",", "n_keys", *[f"x{k}" for k in range(WORDS)]))
    members = table(named.select("file_id", "name", "n_keys", set_id.alias("set_id")), "members")
    sets = members.groupBy("set_id").agg(F.first("n_keys").alias("n_keys"), F.count(F.lit(1)).alias("n_files"), F.min("name").alias("low"), F.max("name").alias("high"), F.min("file_id").alias("first"))
    sets = table(sets, "sets")
    set_keys = table(keys.join(sets.select(F.col("first").alias("file_id"), "set_id", "n_keys"), "file_id").select("set_id", "n_keys", "key"), "set-keys")
    drop(keys)
    return Containment(members, sets.drop("first"), set_keys)


def _holding(set_keys: DataFrame, near: DataFrame) -> DataFrame:
    """a, b of the candidates (a, b, n_a) whose b has all keys of a: each key is looked up once and counted."""
    of_a = set_keys.select(F.col("set_id").alias("a"), "key")
    held = set_keys.select(F.col("set_id").alias("b"), "key")
    return near.join(of_a, "a").join(held, ["b", "key"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.first("n_a").alias("n_a")).where("n = n_a").select("a", "b")


def _probes(set_keys: DataFrame, common: DataFrame) -> DataFrame:
    """a, n_a, key (its rarest), k0, k1, ..: the rarest key of each third of its keys. common: key, df.

    The rarest of all is among them, and no set's keys are gathered.
    """
    third = F.pmod(F.xxhash64(F.lit(WORDS), "key"), F.lit(PROBES))
    rare = [F.min(F.when(third == k, F.struct("df", "key"))).alias(f"p{k}") for k in range(PROBES)]
    probes = set_keys.join(common, "key").groupBy("set_id").agg(F.first("n_keys").alias("n_a"), *rare)
    found = [F.col(f"p{k}") for k in range(PROBES)]
    return probes.select(F.col("set_id").alias("a"), "n_a", F.least(*found)["key"].alias("key"), *[p["key"].alias(f"k{k}") for k, p in enumerate(found)])


def _probed(near: DataFrame, held: DataFrame) -> DataFrame:
    """Candidates (a, b, key, k0, ..) whose b has the probe keys. Without a key of a third the rarest one stands in, which b has."""
    for k in range(PROBES):
        asked = near.withColumn("asked", F.coalesce(f"k{k}", "key"))
        near = asked.join(held.select(F.col("set_id").alias("b_"), F.col("key").alias("key_")), (F.col("b") == F.col("b_")) & (F.col("asked") == F.col("key_")), "left_semi").drop("asked")
    return near


def supersets(set_keys: DataFrame, holders: DataFrame | None = None) -> DataFrame:
    """a, b: each set and every set that properly contains it; of `holders` (set_id) alone, if given. set_keys: set_id, n_keys, key; empty sets have no row."""
    of_holders = set_keys if holders is None else set_keys.join(holders, "set_id", "left_semi")
    # Where a key has no holder, nothing holds the set.
    common = set_keys.select("key").distinct().join(of_holders.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("df"))
    near = _probes(set_keys, common).join(of_holders.select(F.col("set_id").alias("b"), F.col("n_keys").alias("n_b"), "key"), "key").where("n_b > n_a")
    near = _probed(near, of_holders)
    probed = sum((F.col(f"k{k}").isNotNull().cast("long") for k in range(PROBES)), F.lit(0).cast("long"))
    near = table(near.select("a", "b", "n_a", probed.alias("probed")), "candidates")
    return near.where("probed = n_a").select("a", "b").unionByName(_holding(set_keys, near.where("probed < n_a")))


def _names(sets: DataFrame, alias: str) -> DataFrame:
    return sets.select(F.col("set_id").alias(alias), F.col("low").alias(f"low_{alias}"), F.col("high").alias(f"high_{alias}"), F.col("stands").alias(f"stands_{alias}"))


def superseded(parts: Containment) -> DataFrame:
    """set_id of the sets whose smallest name is made redundant by a set that properly contains theirs and has another name.

    Rounds against the index of sets that nothing known holds. A holder b takes a out of the index if it can stand for a
    wherever a would be looked up: it has two names, or its one name is a's only name, or no other set's smallest.
    """
    same_low = parts.sets.groupBy("low").agg(F.count(F.lit(1)).alias("n_low"))
    sets = table(parts.sets.join(same_low, "low").withColumn("stands", (F.col("low") != F.col("high")) | (F.col("n_low") == 1)).select("set_id", "n_keys", "low", "high", "stands"), "named-sets")
    set_keys = parts.set_keys
    other_name = (F.col("low_b") != F.col("low_a")) | (F.col("high_b") != F.col("low_a"))
    represents = F.col("stands_b") | ((F.col("low_a") == F.col("high_a")) & (F.col("low_a") == F.col("low_b")))
    a_names, b_names = _names(sets, "a"), _names(sets, "b")

    # The empty set is held by any other.
    most = sets.where("n_keys > 0").agg(F.min("low").alias("low_b"), F.max("high").alias("high_b"))
    empty = sets.where("n_keys = 0").select("set_id", F.col("low").alias("low_a")).crossJoin(F.broadcast(most)).where(other_name)  # one row each
    results = [empty.select("set_id")]

    index, keys_left, later = set_keys, set_keys, []
    while True:
        largest = index.groupBy("key").agg(F.count(F.lit(1)).alias("df"), F.max(F.struct(F.col("n_keys").alias("n_b"), F.col("set_id").alias("b"))).alias("most"))
        bound = F.min(F.struct(F.col("most.n_b").alias("n_b"), "df", F.col("most.b").alias("b")))
        asked = keys_left.join(largest, "key").groupBy(F.col("set_id").alias("a")).agg(F.first("n_keys").alias("n_a"), bound.alias("bound")).select("a", "n_a", "bound.*")
        asked = table(asked, "sweep-asked")
        held = _holding(set_keys, asked.where("n_b > n_a").select("a", "b", "n_a")).select(F.col("a").alias("h"))
        seen = asked.join(held, F.col("a") == F.col("h"), "left").withColumn("held", F.col("h").isNotNull()).drop("h").join(a_names, "a").join(b_names, "b")
        redundant = F.col("held") & other_name
        seen = table(seen.select("a", "n_b", redundant.alias("redundant"), (F.col("held") & represents).alias("gone"), (redundant | (F.col("n_b") <= F.col("n_a")) | (~F.col("held") & (F.col("df") == 1))).alias("settled")), "sweep-round")
        results.append(seen.where("redundant").select(F.col("a").alias("set_id")))
        n, left, out = seen.agg(F.count(F.lit(1)), F.count_if(~F.col("settled") & ~F.col("gone")), F.count_if(~F.col("settled") & F.col("gone"))).first()
        drop(asked)
        if out:  # held by one of its own name: another round would find the same
            later.append(seen.where("gone AND NOT settled").select("a", "n_b"))
        index = index.join(seen.where("gone").select(F.col("a").alias("set_id")), "set_id", "left_anti")
        if left > (1 - PROGRESS) * n:
            later.append(seen.where("NOT gone AND NOT settled").select("a", "n_b"))
            break
        if not left:
            break
        keys_left = keys_left.join(seen.where("NOT settled AND NOT gone").select(F.col("a").alias("set_id")), "set_id", "left_semi")

    if not later:
        return functools.reduce(DataFrame.unionByName, results)
    open_ = functools.reduce(DataFrame.unionByName, later).select("a", F.col("n_b").alias("most_b"))
    index = table(index, "sweep-index")
    common = index.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    keys_left = set_keys.join(open_.select(F.col("a").alias("set_id")), "set_id", "left_semi")
    open_ = _probes(keys_left, common).join(open_, "a")
    near = open_.join(index.select(F.col("set_id").alias("b"), F.col("n_keys").alias("n_b"), "key"), "key").where("n_b > n_a AND n_b <= most_b")
    near = near.join(a_names, "a").join(b_names, "b").where(other_name)
    near = table(_probed(near, index).select("a", "b", "n_a"), "candidates")
    results.append(_holding(set_keys, near).select(F.col("a").alias("set_id")).distinct())
    return functools.reduce(DataFrame.unionByName, results)


def verdicts(parts: Containment) -> DataFrame:
    """file_id, name, n_keys, redundant, set_id: no pairs of sets are made but those that the sweep compares."""
    found = superseded(parts).select("set_id").withColumn("above", F.lit(True))
    rows = parts.members.join(parts.sets.select("set_id", "low"), "set_id").join(found, "set_id", "left")
    # Of files with equal sets the one with the smallest name is asked for; the others are redundant by it.
    redundant = (F.col("low") < F.col("name")) | F.coalesce("above", F.lit(False))
    return rows.select("file_id", "name", "n_keys", redundant.alias("redundant"), "set_id")


def states(parts: Containment) -> DataFrame:
    """verdicts with n_supersets, the number of distinct sets that properly contain the file's: counts all pairs of sets."""
    names = parts.sets.select(F.col("set_id").alias("b"), "low", "high")
    above = parts.pairs.join(names, "b").groupBy("a").agg(F.min("low").alias("up_low"), F.max("high").alias("up_high"), F.count(F.lit(1)).alias("n_supersets"))
    per_set = parts.sets.select("set_id", "low").join(above, F.col("set_id") == F.col("a"), "left").drop("a")
    rows = parts.members.join(per_set, "set_id")
    bigger = F.coalesce((F.col("up_low") != F.col("name")) | (F.col("up_high") != F.col("name")), F.lit(False))
    redundant = (F.col("low") < F.col("name")) | bigger
    return rows.select("file_id", "name", "n_keys", redundant.alias("redundant"), "set_id", F.coalesce("n_supersets", F.lit(0)).alias("n_supersets"))


def counted(parts: Containment, found: DataFrame) -> DataFrame:
    """found (verdicts) with n_supersets as in states."""
    above = parts.pairs.groupBy(F.col("a").alias("set_id")).agg(F.count(F.lit(1)).alias("n_supersets"))
    return found.join(above, "set_id", "left").select("file_id", "name", "n_keys", "redundant", "set_id", F.coalesce("n_supersets", F.lit(0)).alias("n_supersets"))


def redundancy(keys: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, name, n_keys, redundant: the verdict alone."""
    return verdicts(containment(keys, files)).drop("set_id")


def links(parts: Containment) -> DataFrame:
    """name, by_name: each set and each set that properly contains it, both told by the smallest name among their files.

    With `members` (set_id) this says everything that `lists` does, in as many rows as there are set pairs.
    """
    named = parts.sets.select("set_id", "low")
    left, right = named.select(F.col("set_id").alias("a"), F.col("low").alias("name")), named.select(F.col("set_id").alias("b"), F.col("low").alias("by_name"))
    return parts.pairs.join(left, "a").join(right, "b").select(F.col("a").alias("set_id"), "name", F.col("b").alias("by_set_id"), "by_name")


def _names_above(parts: Containment, found: DataFrame, pairs: DataFrame) -> DataFrame:
    """set_id, up: the names in the sets above, put together once for each set."""
    names = found.groupBy(F.col("set_id").alias("b")).agg(F.collect_list("name").alias("own"))
    return pairs.join(names, "b").groupBy(F.col("a").alias("set_id")).agg(F.flatten(F.collect_list("own")).alias("up"))


def covers(parts: Containment, found: DataFrame) -> DataFrame:
    """file_id, name, n_keys, redundant, covered_by: the kept files that make it redundant, in order; all files, if none of them is kept.

    found: verdicts(parts), written. Pairs lead to kept sets, so a chain of exports has one for each of them.
    """
    kept = found.where(~F.col("redundant"))
    holders = kept.select("set_id").distinct()
    pairs = supersets(parts.set_keys, holders).unionByName(_over_nothing(parts.sets, parts.sets.join(holders, "set_id", "left_semi")))
    rows = _listed(found, _names_above(parts, kept, pairs), kept)
    lost = table(rows.where(F.col("redundant") & (F.size("names") == 0)), "not-covered")
    rows = rows.withColumnRenamed("names", "covered_by")
    if lost.limit(1).count():  # only files of one name may make each other redundant in a circle of names
        every = _listed(found.join(lost.select("file_id"), "file_id", "left_semi"), _names_above(parts, found, parts.pairs), found)
        rows = rows.join(lost.select("file_id"), "file_id", "left_anti").unionByName(every.withColumnRenamed("names", "covered_by"))
    return rows


def _listed(files: DataFrame, above: DataFrame, of: DataFrame) -> DataFrame:
    """files with names: those above a file's set and the smaller ones of its own set, among the files `of`."""
    none: Column = F.array().cast("array<string>")
    own = of.groupBy("set_id").agg(F.collect_list("name").alias("own"))
    rows = files.join(above, "set_id", "left").join(own, "set_id", "left")
    up = F.filter(F.coalesce("up", none), lambda x: x != F.col("name"))
    same = F.filter(F.coalesce("own", none), lambda x: x < F.col("name"))
    return rows.select("file_id", "name", "n_keys", "redundant", F.array_sort(F.concat(up, same)).alias("names"))


def lists(parts: Containment, found: DataFrame) -> DataFrame:
    """file_id, name, n_keys, redundant, superseded_by (names in order), covered_by (the kept ones of them, else all).

    found: verdicts(parts), written. For what a person reads: every file gets the names of all files that make it redundant, so a
    corpus with a million equal files has answers of a million names. The names of a set are put together once.
    """
    every = _listed(found, _names_above(parts, found, parts.pairs), found).withColumnRenamed("names", "superseded_by")
    kept = found.where(~F.col("redundant"))
    kept_by = _listed(found, _names_above(parts, kept, parts.pairs), kept).select("file_id", F.col("names").alias("kept_by"))
    rows = every.join(kept_by, "file_id")
    return rows.withColumn("covered_by", F.when(F.size("kept_by") > 0, F.col("kept_by")).otherwise(F.col("superseded_by"))).drop("kept_by")


def verdict(keys: DataFrame, files: DataFrame) -> DataFrame:
    """The verdict with its lists: see lists()."""
    parts = containment(keys, files)
    return lists(parts, table(verdicts(parts), "verdicts"))


def covered(keys: DataFrame, files: DataFrame) -> DataFrame:
    """The verdict with the kept files that cover each redundant one: see covers()."""
    parts = containment(keys, files)
    return covers(parts, table(verdicts(parts), "verdicts"))


def keep(states: DataFrame) -> DataFrame:
    return states.where(~F.col("redundant"))


def delete(states: DataFrame) -> DataFrame:
    return states.where("redundant")


def uncovered(keys: DataFrame, states: DataFrame) -> DataFrame:
    """Keys that no kept file has: none, if the verdict loses nothing."""
    kept = keys.join(keep(states).select("file_id"), "file_id", "left_semi")
    return keys.select("key").distinct().join(kept.select("key").distinct(), "key", "left_anti")


def only_here(rows: DataFrame, keeper: str | int, other: str | int, by: str = "file_id") -> DataFrame:
    """The keeper's rows (with `key`) plus only_here: whether the other file lacks them."""
    theirs = rows.where(F.col(by) == F.lit(other)).select("key").distinct().withColumn("shared", F.lit(True))
    return rows.where(F.col(by) == F.lit(keeper)).join(theirs, "key", "left").withColumn("only_here", F.col("shared").isNull()).drop("shared")
