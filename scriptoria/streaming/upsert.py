"""New documents as a stream: every micro-batch is upserted into the dataset and
appended to the audit. An extension: the batch operators, driven by readStream."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scriptoria.operators.relational import latest


def stream_of(spark: SparkSession, folder: str, schema: StructType, max_files: int = 64) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def merge(existing: DataFrame | None, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key over both, by the order columns."""
    both = new if existing is None else existing.unionByName(new, allowMissingColumns=True)
    return latest(both, key, order)


def _versions(path: str) -> list[int]:
    return sorted(int(v) for v in os.listdir(path) if v.isdigit()) if os.path.isdir(path) else []


def upsert_stream(stream: DataFrame, dataset: str, audit: str, checkpoint: str, key: list[str], order: list[str]):
    """Start the stream: the dataset is a folder of versions, each written whole before
    the next batch; a batch that is run again writes its own version again, so that
    a restart repeats nothing. The audit gets each batch's rows in a folder of its own."""
    spark = stream.sparkSession

    def batch(df: DataFrame, n: int) -> None:
        before = [v for v in _versions(dataset) if v < n]
        old = spark.read.parquet(f"{dataset}/{before[-1]}") if before else None
        merge(old, df, key, order).write.mode("overwrite").parquet(f"{dataset}/{n}")
        df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{audit}/{n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, dataset: str) -> DataFrame:
    """The dataset's newest version."""
    return spark.read.parquet(f"{dataset}/{_versions(dataset)[-1]}")
