"""What the operators share around Spark: tables, durable intermediate results and Arrow maps."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows of a file of numbers, where a bound of its rows is known.
FILE_ROWS = 50_000


def durable(df: DataFrame, most: int | None = None) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder (see ``shared_folder``).

    ``most`` bounds the rows of a table of a few numbers a row, so that a small one is not written as many tiny files.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return (df if most is None else df.coalesce(max(1, -(-most // FILE_ROWS)))).checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.  Where it is unset, a temporary one if all of Spark is one process,
    and an error on a cluster, whose machines would not see each other's files."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="siftline-")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of whichever store its path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Rows of an Arrow batch; Spark's own default of 10,000 holds tens of megabytes of text in each Python worker.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Have the session hand texts to Python in batches of ``BATCH_ROWS`` at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def give_back() -> None:
    """Return freed memory to the system: Python workers live on from task to task and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, start: Callable | None = None) -> DataFrame:
    """``mapInArrow`` with a function of one batch; ``start()`` is called once in each task and its result handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (start(),) if start else ()
        for batch in batches:
            if batch.num_rows:
                out = function(batch, *state)
                if out is not None and out.num_rows:
                    yield out
                del batch, out
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, column: str, verdict: Callable[..., object], start: Callable | None = None) -> DataFrame:
    """The rows of ``df``, with all their columns, for whose ``column`` the function of an Arrow column is true; nothing
    is shuffled.  Null and empty texts are handed to the function like others, texts of any length whole; repeated rows
    stand or fall alike; columns may have any names; no rows in, none out."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (start(),) if start else ()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(verdict(batch.column(at), *state), pa.bool_()))
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)


def arrays(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))
