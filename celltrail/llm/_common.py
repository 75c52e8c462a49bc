"""What every operator of the subpackage shares: reading tables, batches, scratch tables."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Spark puts into one Arrow batch. With texts of several kB a batch stays at a few MB.
BATCH_ROWS = 1000
#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Session settings that bound the memory of Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def give_back() -> None:
    """Return memory that this process has freed to the system, where its allocators can."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` without what tasks before it left behind: workers are used again, and keep what was freed in them."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return lean_run


def column(name: str) -> Column:
    """A column by its name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_``, ``name__`` and so on that ``df`` has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` but those of ``names``: a result's column takes the place of a caller's of the same name."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    On one machine without such a setting it is a temporary folder; on a cluster its absence is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top:
        return top
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _local_dir()


@lru_cache(maxsize=1)
def _local_dir() -> str:
    path = tempfile.mkdtemp(prefix="scratch-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Cuts the lineage: executors lost later cost a re-read, not a re-run, and what
    a task decided by its place in a partition stays decided. What is read of it may be needed as
    long as the application runs, so the folder of an application goes at its end (:func:`cleaned`).
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """The application's own folder in the shared one, removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}"
    if path not in _SCRATCH:
        _SCRATCH.add(path)
        atexit.register(cleaned, spark, path)
    return path


_SCRATCH: set[str] = set()


def cleaned(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder, as long as the application still answers."""
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except (Py4JError, OSError):  # the application has ended: its folder is the cluster's to clear
        return


def crc_bucket(column: str, modulus: int):
    """crc32 of a number's decimal text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def steps(sizes: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes sum to at most ``most``; a larger row stands alone."""
    begin, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if len(sizes) > begin:
        yield begin, len(sizes)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end and the offsets of each; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]
