"""A Spark session with the settings that the plans rely on; cluster settings are never overridden."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "tidemark", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes of a small table that is dealt to all cores: below, tasks cost more than they save; above, files are enough.
SPREAD_FROM, SPREAD_BELOW = 4 << 20, 256 << 20


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; a small one in fewer files than there are cores is dealt out, as one row group is one task."""
    df = spark.read.parquet(path)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = spark.sparkContext.defaultParallelism
    if SPREAD_FROM <= size < SPREAD_BELOW and len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df


def ensure_checkpoints(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset, local mode gets a temporary one and a cluster
    an error, as a folder of one host is lost with it."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return context._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage: a table in the shared checkpoint folder, so lost executors don't lose it.

    A checkpoint would compute its last stage twice, once to count and once to write.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoints(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give a worker's free memory back; workers outlive their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
