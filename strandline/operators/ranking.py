"""Order without a single task: of a whole table, and within groups of which one may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.scratch import table


def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows plus ordinal, their place in the order of `by`, from 1: ranges are sorted apart and offset by their counts.

    The ranges are written once, so a row's range is the same for the counts and for the ranks, whatever is recomputed.
    `by` should be unique: equal rows lie in one range.
    """
    spread = table(rows.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = spread.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # a row for each range
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*by))
    return spread.withColumn("__local", local).join(F.broadcast(offsets), "__part").withColumn("ordinal", (F.col("__local") + F.col("__before")).cast("long")).drop("__local", "__before", "__part")


#: Pairs of group and range whose offsets are broadcast; those of more are joined by a shuffle.
FEW_OFFSETS = 100_000


def placed(rows: DataFrame, group: str, by: list[str], name: str = "place") -> DataFrame:
    """rows plus their place in their group in the order of `by`, from 1.

    As ranked(), with an offset for each group and range: a group over many ranges is numbered in all of them at once.
    """
    spread = table(rows.repartitionByRange(group, *by).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = spread.groupBy(F.col(group).alias("__group"), F.col("__part").alias("__of")).agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("__group").orderBy("__of")  # a row for each range that the group lies in
    offsets = table(counts.select("__group", "__of", (F.sum("n").over(along) - F.col("n")).alias("__before")), "offsets")
    offsets = F.broadcast(offsets) if offsets.count() <= FEW_OFFSETS else offsets
    local = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*by))
    out = spread.withColumn("__local", local).join(offsets, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__of")))
    return out.withColumn(name, (F.col("__local") + F.col("__before")).cast("long")).drop("__group", "__of", "__before", "__local", "__part")
