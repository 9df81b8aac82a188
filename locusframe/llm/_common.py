"""What the operators of this subpackage share: shared storage, words, checks."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words, as a regular expression class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_RE = r"[^\x20\x09-\x0D]+"

#: Folders named so far, by application.
_made: dict[str, list[str]] = {}

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset and Spark runs in one process, a temporary folder is
    set; on a cluster without the setting this raises, because a machine-local
    folder would lose files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return str(own.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="locusframe-"))
    return str(spark.sparkContext._jsc.sc().getCheckpointDir().get()).rstrip("/")


def work_dir(spark: SparkSession, label: str) -> str:
    """A new, unique folder name under the shared folder."""
    path = f"{shared_dir(spark)}/locusframe-{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clean_scratch(spark: SparkSession) -> int:
    """Deletes all folders that ``work_dir`` named in this application; results that were not written elsewhere are gone then."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    remove_shared(spark, *paths)
    return len(paths)


def write_shared(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` as Parquet and reads it back.

    Cuts the lineage in storage that outlives an executor, frees the shuffle
    files of the job at once, and gives the planner the true size of the
    result, so that a later join broadcasts it only when it is small.
    """
    spark = df.sparkSession
    schema = df.schema
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 64 << 20):
    """Jobs in this context send so many rows, and about so many bytes, to a Python worker at a time: texts of a batch are in memory at once."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": f"{size}b"}
    before = {name: spark.conf.get(name) for name in limits}
    for name, value in limits.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[pa.Array]:
    """An array of strings in slices of about ``most`` bytes, one text at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(texts):
        before = int(size[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(size, before + most)))
        yield texts.slice(i, j - i)
        i = j


def give_back() -> None:
    """Returns memory that a task of this worker has freed to the system; workers live on for later tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def give_back_heaps(spark: SparkSession) -> None:
    """Has each executor collect its garbage, so that a heap which one stage has grown is small again when the next one begins.

    One short task for each executor; where explicit collections are switched off nothing happens.
    """
    count = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)  # the driver is among them
    spark.range(0, count, 1, count).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def remove_shared(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch folders that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD_RE))).cast("long")


def ascii_lower_sql(column: str) -> str:
    """SQL text (Spark and DuckDB) that lower-cases A-Z only."""
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def local_path(uri: str) -> str | None:
    """The path behind a file: URI or a bare path; None for another store."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return parts.path
    return None


def open_store(uri: str):
    """(filesystem, path) for reading and writing files at ``uri`` from a task."""
    from pyarrow import fs

    path = local_path(uri)
    if path is not None:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(uri)


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """(row, keys): all columns of ``docs`` in one struct, so that no name of theirs meets an operator's."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in keys.items()])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
