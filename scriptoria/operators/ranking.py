"""Ranks without a group in one task.

A window over a label or over everything sends a group, or all rows, to one task. Here
rows are ordered by a digest, whose first characters part every group into buckets;
bucket counts, a small table, give each bucket its offset, and only buckets are
ranked. The numbers are those that row_number over the whole group would give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.session import cut


def seeded(id_: str, seed: int) -> Column:
    """The digest rows are ordered by: md5 of id and seed."""
    return F.md5(F.concat(F.col(id_).cast("string"), F.lit(f":{seed}")))


def group_rank(df: DataFrame, group: str, id_: str, seed: int, width: int = 3) -> DataFrame:
    """``df`` with __rank, 1-based in the order of (digest, id) per group; ``width`` hex
    digits give 16^width buckets a group. Null groups are a group, repeated ids are
    ranked one after the other, an empty table stays empty. Helper columns start with
    two underscores, so that no column of ``df`` is hidden."""
    x = df.withColumn("__h", seeded(id_, seed)).withColumn("__b", F.substring("__h", 1, width))
    counts = x.groupBy(group, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__off", F.sum("__n").over(Window.partitionBy(group).orderBy("__b")) - F.col("__n"))
    before = before.select(F.col(group).alias("__g"), F.col("__b").alias("__c"), "__off")
    y = x.join(before, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__b") == F.col("__c")))
    local = F.row_number().over(Window.partitionBy(group, "__b").orderBy("__h", id_))
    return y.withColumn("__rank", (F.col("__off") + local).cast("bigint")).drop("__h", "__b", "__c", "__g", "__off")


def total_rank(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with pos, 1-based in the given total order, from a range partitioning:
    counts of the partitions, as many rows as there are tasks, give the offsets."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = cut(df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()))
    counts = x.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__off"))
    local = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return x.join(F.broadcast(before), "__p").withColumn("pos", (F.col("__off") + local).cast("bigint")).drop("__p", "__off")
