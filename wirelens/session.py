"""Session settings shared by jobs, the bench and the tests."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "wirelens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    On a cluster ``master`` stays unset and sizing comes from the submitter;
    AQE then picks partition counts from the advisory size and splits skewed
    join partitions.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        cores = master.strip("local[]") or "*"
        parts = os.cpu_count() if cores == "*" else int(cores)
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.sql.shuffle.partitions", str(parts))
            # Small inputs are CPU-bound here: keep all cores busy below 1 MB per task.
            .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
            .config("spark.sql.files.openCostInBytes", "262144")
        )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_ready(spark: SparkSession) -> None:
    """Make sure checkpoints have a folder.

    On a cluster it is the shared folder named by ``spark.checkpoint.dir``; only
    local sessions that name none get a temporary one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="wirelens-")
    context.setCheckpointDir(folder)


_KEPT: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder; ``release`` removes it."""
    checkpoint_ready(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"
    _KEPT.append(path)
    return path


@contextlib.contextmanager
def whole_variants(spark: SparkSession):
    """VARIANT columns written as they are; guessing their fields and putting these back together costs more than parsing them."""
    key = "spark.sql.variant.inferShreddingSchema"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    That cuts the lineage, and later plans have the table's size and columns to prune.
    """
    spark = df.sparkSession
    checkpoint_ready(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    with whole_variants(spark):
        df.write.parquet(path)
    _KEPT.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove the tables of ``materialise`` once no result reads them any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _KEPT:
        path = jvm.org.apache.hadoop.fs.Path(_KEPT.pop())
        path.getFileSystem(conf).delete(path, True)
