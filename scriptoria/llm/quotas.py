"""A sample whose categories meet target shares and minima, exactly.

Plan. One aggregation counts the usable rows of each category; the targets follow
from the counts. Every row then draws one number a campaign, the md5 of salt, campaign
and id, and is taken independently with the category's acceptance probability,
oversampled by a few standard deviations. To correct the counts exactly without
gathering a category anywhere, the draws are counted in a fixed number of bins; bins
under the one where the target falls are taken whole, that bin is parted into as many
again, and only what is left of it, a row in some sixteen million of the category, is
ranked. Deficits are what the corrected sample lacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.llm.common import small

BINS = 4096
SIGMAS = 6.0
SALT = "quote"


def quota_targets(rows: DataFrame, label: str, targets: DataFrame) -> DataFrame:
    """The targets (campagna_id, golden_label, quota_pct, minimo, frazione_pct) with
    usable, size, needed and target (what can be drawn) of each category.

    ``rows`` are the usable rows, each counted; nulls in ``label`` are no category but
    count nowhere. Sample size = usable rows x frazione_pct / 100 rounded down, needed
    = the larger of minimo and size x quota_pct / 100 rounded down. A category without
    rows has usable 0; without any rows every size is 0 and minima alone count.
    """
    counts = rows.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("golden_label")).agg(F.count(F.lit(1)).alias("usable"))
    counts = small(counts)  # a row a category
    total = counts.agg(F.coalesce(F.sum("usable"), F.lit(0))).first()[0]
    size = F.floor(F.lit(total) * F.col("frazione_pct") / 100)
    return (
        targets.select("campagna_id", "golden_label", "quota_pct", "minimo", "frazione_pct")
        .join(counts, "golden_label", "left")
        .withColumn("usable", F.coalesce("usable", F.lit(0)).cast("bigint"))
        .withColumn("size", size.cast("bigint"))
        .withColumn("needed", F.greatest(F.col("minimo").cast("bigint"), F.floor(F.col("size") * F.col("quota_pct") / 100)))
        .withColumn("target", F.least("needed", "usable"))
    )


def draw(salt: str, *seed: Column) -> Column:
    """A number in [0, 1) that depends on the salt and the seed columns alone: the first
    52 bits of their md5, joined by colons, nulls as nothing."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in seed]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), *parts)), 1, 13), 16, 10).cast("bigint") * F.lit(2.0**-52)


def _edges(rows: DataFrame, group: list[str], bin_: str, want: str) -> DataFrame:
    """(group, bin_, rest): of each group the bin in which its ``want``-th row falls, and
    how many rows of that bin are wanted. The window sees a row a bin, never rows."""
    per = rows.groupBy(*group, bin_, want).agg(F.count(F.lit(1)).alias("n"))
    below = F.sum("n").over(Window.partitionBy(*group).orderBy(bin_)) - F.col("n")
    inside = (F.col("below") < F.col(want)) & (F.col("below") + F.col("n") >= F.col(want))
    return per.withColumn("below", below).filter(inside).select(*group, F.col(bin_).alias(f"{bin_}_edge"), (F.col(want) - F.col("below")).alias(f"{bin_}_rest"))


def quota_sample(rows: DataFrame, id_col: str, label: str, quotas: DataFrame) -> DataFrame:
    """(campagna_id, golden_label, id): exactly ``target`` rows of each campaign and
    category of ``quotas`` (see quota_targets): those of the least draws.

    Repeated ids are separate rows; equal draws are parted by the id. Null ids draw
    like any other. Only the two named columns of ``rows`` are read.
    """
    p = F.col("target") / F.col("usable")
    want = quotas.filter("target > 0").select(
        "campagna_id",
        "golden_label",
        "target",
        F.least(F.lit(1.0), p + F.lit(SIGMAS) * F.sqrt(p * (1 - p) / F.col("usable")) + 1.0 / F.col("usable")).alias("accept"),
    )
    group = ["campagna_id", "golden_label"]
    src = rows.select(F.col(id_col).alias("id"), F.col(label).alias("golden_label"))
    want = small(want)
    drawn = src.join(want, "golden_label").withColumn("u", draw(SALT, F.col("campagna_id"), F.col("id")))
    taken = F.col("u") < F.col("accept")  # the rest is drawn on only where too few were taken, by chance
    place = F.when(taken, F.col("u") / F.col("accept")).otherwise(1 + (F.col("u") - F.col("accept")) / F.greatest(1 - F.col("accept"), F.lit(1e-9))) * BINS
    drawn = drawn.withColumn("place", place).withColumn("bin", F.floor("place"))
    edge = F.broadcast(_edges(drawn, group, "bin", "target"))  # no more rows than ``want``
    placed = drawn.join(edge, group).filter("bin <= bin_edge")
    whole = placed.filter("bin < bin_edge")
    split = placed.filter("bin = bin_edge").withColumn("sub", F.floor((F.col("place") - F.col("bin")) * BINS))
    inner = split.join(F.broadcast(_edges(split, group, "sub", "bin_rest")), group).filter("sub <= sub_edge")
    ranked = inner.filter("sub = sub_edge").withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy("u", "id"))).filter("r <= sub_rest")
    pick = lambda x: x.select(*group, "id")
    return pick(whole).unionByName(pick(inner.filter("sub < sub_edge"))).unionByName(pick(ranked))


def quota_report(rows: DataFrame, id_col: str, label: str, quotas: DataFrame) -> DataFrame:
    """``quotas`` with drawn, the rows that the sampler really drew of each category, and
    deficit, what these lack of ``needed``. Categories without any rows draw none."""
    drawn = quota_sample(rows, id_col, label, quotas).groupBy("campagna_id", "golden_label").agg(F.count(F.lit(1)).alias("drawn"))
    return (
        quotas.join(F.broadcast(drawn), ["campagna_id", "golden_label"], "left")
        .withColumn("drawn", F.coalesce("drawn", F.lit(0)).cast("bigint"))
        .withColumn("deficit", F.col("needed") - F.col("drawn"))
    )
