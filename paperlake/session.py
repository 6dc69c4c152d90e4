"""Session helpers, table access and lineage cuts that survive executor loss."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; ``conf`` overrides them."""
    builder = SparkSession.builder.appName("paperlake")
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``; zone-less times read as they are."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application below ``spark.checkpoint.dir``, which all executors must share.

    Unset, it is an error on a cluster; a local master, which has one machine only, gets a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="paperlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/paperlake/{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Used where several branches or rounds start from one costly result. The
    columnar file is smaller than a checkpoint of rows and, unlike a cache or
    a local checkpoint, outlives the executors that made it. ``clean`` deletes
    all of them; it is also called when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    if not _cleaned:
        atexit.register(_at_exit)
        _cleaned.append(True)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_cleaned: list[bool] = []


def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the session may be gone by now
        if spark := SparkSession.getActiveSession():
            clean(spark)


def clean(spark: SparkSession) -> None:
    """Delete what ``cut`` wrote for this application; results not yet computed can no longer be."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` on all cores where its files give fewer than half as many partitions.

    Files of one row group are one task whatever is done with their rows; a
    table of many files, as any large one, is left as it is. ``keys`` lets
    later aggregations by them (and more columns) do without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores, *keys) if parts * 2 <= cores else df
