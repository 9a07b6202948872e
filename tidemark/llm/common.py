"""What the training-data operators share: lineage cuts and table access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table

#: Java regular expression for what separates words (space, tab to carriage return).
GAP = r"[ \t\n\x0B\f\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Point Spark at the shared folder of ``spark.checkpoint.dir``; where it is unset, local mode gets a temporary one
    and a cluster an error, as a folder of one host is lost with it."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))


def carried(docs: DataFrame, **columns) -> DataFrame:
    """``row`` (all columns of ``docs`` as one struct) and the given columns, so no name of ``docs`` can clash."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in columns.items()])


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores after it where ``columns`` has it already (in either case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def text_keys(text) -> dict:
    """96 bits of hashes that tell whole texts apart; null as empty."""
    whole = F.coalesce(text, F.lit(""))
    return {"k1": F.xxhash64(whole), "k2": F.hash(whole)}


#: Spark's setting that shuffle files go when a query ends, not when the driver happens to collect its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Tables that a ``without_steps`` drops when it is done.
_STEPS: ContextVar[list | None] = ContextVar("steps", default=None)


def settle(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage: a table in the shared checkpoint folder, so lost executors don't lose it.

    A checkpoint would compute its last stage twice, once to count and once to write.  The shuffle files of the query go
    with it, as nothing reads them again.
    """
    spark = df.sparkSession
    ensure_checkpoints(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANED, before) if before is not None else spark.conf.unset(CLEANED)
    if (steps := _STEPS.get()) is not None:
        steps.append(path)
    return spark.read.schema(df.schema).parquet(path)


def without_steps(make: Callable[[], DataFrame]) -> DataFrame:
    """Settle what ``make`` gives, then drop the tables that were settled on the way to it."""
    steps: list[str] = []
    token = _STEPS.set(steps)
    try:
        out = make()
    finally:
        _STEPS.reset(token)
    final = settle(out)
    jvm, conf = out.sparkSession._jvm, out.sparkSession._jsc.hadoopConfiguration()
    for step in steps:
        path = jvm.org.apache.hadoop.fs.Path(step)
        path.getFileSystem(conf).delete(path, True)
    return final


def settle_as_dealt(df: DataFrame) -> DataFrame:
    """The same by a checkpoint, which keeps partitions and their order."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def release() -> None:
    """Give a worker's free memory back; workers outlive their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def map_slices(df: DataFrame, work: Callable, schema, rows: int = 256, after: Callable | None = None) -> DataFrame:
    """mapInArrow in slices of few rows, so a worker holds few texts at once; ``after`` ends each task."""

    def run(batches: Iterator) -> Iterator:
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, rows):
                    yield work(whole.slice(at, rows))
        finally:
            if after:
                after()
            release()

    return df.mapInArrow(run, schema)


def text_bytes(column) -> list:
    """The UTF-8 bytes of an Arrow string column; null as empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def words_of(text) -> "F.Column":
    """The words of a text column as an array, null as none (JVM side)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def merged_in_a_tree(df: DataFrame, work: Callable, merge: Callable) -> dict:
    """What the partitions of ``df`` say together: ``work`` turns a partition's Arrow batches into a dict, and executors
    merge the values of equal keys in a tree, so the driver gets few dicts, however many partitions there are."""
    import pickle

    def both(a: dict, b: dict) -> dict:
        for key, value in b.items():
            a[key] = merge(a[key], value) if key in a else value
        return a

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(work(batches))], pa.binary())], ["part"])

    parts = df.mapInArrow(run, "part binary").rdd
    return parts.treeAggregate({}, lambda a, row: both(a, pickle.loads(row.part)), both)


def list_rows(column) -> Iterator[tuple]:
    """(length, places, rows) of an Arrow column of lists of numbers, for each length above 0; nulls inside come as NaN."""
    import numpy as np
    import pyarrow.compute as pc

    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes[sizes > 0]):
        at = np.nonzero(sizes == d)[0]
        yield int(d), at, flat[starts[at][:, None] + np.arange(d)[None, :]]
