"""Session defaults, table access and lineage cuts shared by every plan."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def session(master: str = "local[8]", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SCRIPTORIA_DRIVER_MEMORY", "6g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once an application: as an archive in
    the shared checkpoint folder. Without it they must have it on their own path, as
    they do where that folder is no plain directory and nothing is shipped."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    folder = checkpoint_dir(spark).removeprefix("file://")
    if not folder.startswith("/"):
        return
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"scriptoria-{app}.zip")
    with zipfile.PyZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:  # compiled, so that workers need not
        z.writepy(os.path.dirname(os.path.abspath(__file__)))
    spark.sparkContext.addPyFile(path)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``; only where
    that is unset and the master local (tests, a laptop) a temporary one is made."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not given.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        given = given.get() if given.isDefined() else tempfile.mkdtemp(prefix="scriptoria_")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(given)
    return given


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder, which outlives any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Repartition a scan that has fewer splits than there are cores, so that a stage
    heavy in Python uses them all; larger inputs are left as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
