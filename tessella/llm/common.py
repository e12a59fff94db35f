"""Helpers shared by the training-data operators: shared-folder tables, byte-level text rules, column names."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z on UTF-8 bytes; no other letter changes.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: Stands in for a null doc_id where ids are compared: later than every real id.
NO_ID = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); only where the session names none and all tasks run in one process, as in tests, a new local one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage and survives the loss of an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(array) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string array; a null is the empty text."""
    import pyarrow as pa

    return [x or b"" for x in array.cast(pa.large_binary()).to_pylist()]


def lean(f):
    """``f`` (of one or two tables) for a Python worker whose memory is bounded: large arrays go back to the system as soon as they are freed, and so does the rest after each call."""

    def run(*args):
        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())
        libc = ctypes.CDLL(None)
        trim = getattr(libc, "malloc_trim", None)  # of glibc
        if trim:
            libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        try:
            return f(*args)
        finally:
            if trim:
                trim(0)

    # Spark counts the arguments
    return (lambda left, right: run(left, right)) if f.__code__.co_argcount == 2 else (lambda table: run(table))


def parts(spark: SparkSession, size: int, each: int) -> int:
    """Partitions for ``size`` bytes or rows at about ``each`` in one, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def documents(docs: DataFrame) -> DataFrame:
    """Just doc_id and text, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
