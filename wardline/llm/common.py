"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space of every contract here: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a key that go to one salt; most keys beyond that which are broadcast (16 bytes each).
SPLIT, MOST_HOT = 512, 1 << 18
#: Stands for a null id inside the operators.
NO_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where the session names none and has no other machine, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    path = path or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="wardline-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def saved(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there and lost executors cost nothing.

    The table stays until the innermost scratch() around the call ends; for good without one or with ``keep``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(path)
    # what operators save on the way are hashes and sketches, which do not get smaller; a codec would only hold memory outside the heap
    df.write.option("compression", "snappy" if keep else "none").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SCRATCH: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what saved() wrote inside it. A result that reads such tables must have been written by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def split_join(rows: DataFrame, other: DataFrame, key: str, spread: str, counted: DataFrame | None = None) -> DataFrame:
    """Inner join on ``key`` where a few keys may own a large part of ``rows``; ``other`` has few rows a key.

    A key with more than SPLIT rows is dealt over as many salts as it takes, by the hash of ``spread``, and the other side's rows of that key
    are copied to each. Keys like that are broadcast up to MOST_HOT of them, else joined. Keys are counted in ``counted``, which has the
    keys of ``rows`` as often, or in ``rows``; that is read twice then, so it should be a table.
    """
    hot = (rows if counted is None else counted).groupBy(key).count().filter(F.col("count") > SPLIT).select(key, F.ceil(F.col("count") / SPLIT).cast("int").alias("_parts"))
    some = hot.limit(MOST_HOT + 1).collect()
    if not some:
        return rows.join(other, key)
    parts = F.coalesce("_parts", F.lit(1))
    small = F.broadcast(rows.sparkSession.createDataFrame(some, hot.schema)) if len(some) <= MOST_HOT else hot
    left = rows.join(small, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("_parts")
    right = other.join(small, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [key, "_salt"]).drop("_salt")


def smallest(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The n rows with the smallest values of ``order``, 64-bit hashes that are as good as random. Each task sends on only what is under a
    value that about n rows are under, so the driver gets little more than n rows from however many tasks. Ties may fall either way."""
    total = rows.count()
    share = (n + 8 * n**0.5 + 64) / max(1, total)
    few = rows if share >= 1 else rows.filter(F.col(order) < F.lit(int(2**64 * share) - 2**63))
    return few.orderBy(order).limit(n)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, which also keeps the rows' partitions and order."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_az(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null: 0."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "[ \t-\r]+"))).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release_memory() -> None:
    """Hands a task's freed memory back to the system: Python workers outlive their tasks and share a machine with the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
