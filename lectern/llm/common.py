"""What the training-data operators share: tables, shared storage and fixed expressions."""

from __future__ import annotations

import ctypes
import gc
import re
import time
from functools import wraps

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import spread
from ..sources.shared import materialize, shared_dir, written  # noqa: F401

#: Bytes that separate words: space and \t \n \v \f \r. ``bytes.split()`` splits on exactly these.
SPACES = b" \t\n\x0b\x0c\r"
_RUNS = re.compile(r"[^\W\d_]+")  # letters, and numbers such as fractions
_LETTERS = regex.compile(r"\p{L}+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def letter_runs(text: str) -> list[str]:
    """The runs of letters of a text."""
    found = _RUNS.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in ([run] if run.isalpha() else _LETTERS.findall(run))]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return spread(df) if name == "documents" else df


def _shrink(spark: SparkSession) -> None:
    """Has executors collect all their garbage: a heap that one stage has filled stays as large beside the Python workers of the next ones until a whole collection gives it back."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def sweep(spark: SparkSession) -> None:
    """Deletes what ``materialize`` wrote and no plan reads any more; Spark's own cleaner does so with shuffles. Both learn of it when garbage is collected, on the executors as well."""
    spark.sql("SELECT 1").collect()  # Spark's listener queues hold the last query that ended
    gc.collect()
    time.sleep(1.2)  # Py4J tells the JVM once a second what Python has let go of
    spark._jvm.System.gc()
    for own in [x for x in written if x[1].refersTo(None)]:
        path = spark._jvm.org.apache.hadoop.fs.Path(own[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        written.remove(own)
    _shrink(spark)


def _give_back() -> None:
    """Hands memory that Arrow and the C library keep for later back to the system: Python workers stay, idle, beside the stages that follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(f):
    """A batch function that leaves no more memory behind than it must."""

    @wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            _give_back()

    return run


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id gives 0's remainder (the crc of an empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def keyed(docs: DataFrame, tag: str) -> DataFrame:
    """__row, __doc: a key for each row, whatever its id, and the row; written once, so the keys stay."""
    return materialize(docs.select(F.monotonically_increasing_id().alias("__row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc")), tag)


def drop_rows(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents of ``rows`` (keyed) without those whose key is in ``gone`` (one column)."""
    gone = gone.toDF("__gone").distinct()
    return rows.join(gone, rows["__row"] == gone["__gone"], "left_anti").select("__doc.*")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
