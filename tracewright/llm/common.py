"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpointed, importable, shared_folder  # noqa: F401  (part of this module's surface)

#: Rows of a few dozen bytes that may be broadcast after they were counted.
BROADCAST_ROWS = 1_000_000


#: A key with more rows than this is dealt over several tasks.
HOT = 500


def sized(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the counted ``rows`` are within ``limit``; else the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def heavy_of(counts: DataFrame, n: str, key: list[str]) -> DataFrame:
    """(key, parts) of the keys with more than HOT rows, from a table of counts.

    The limit rises with the rows counted, so that there are at most
    BROADCAST_ROWS such keys whatever the input.
    """
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    most = max(HOT, -(-total // BROADCAST_ROWS))
    return checkpointed(counts.where(F.col(n) > most).select(*key, F.ceil(F.col(n) / most).cast("int").alias("parts")))


def heavy(rows: DataFrame, key: list[str]) -> DataFrame:
    """``heavy_of`` the counted ``rows``."""
    return heavy_of(checkpointed(rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > HOT)), "n", key)


def spread(left: DataFrame, right: DataFrame, key: list[str], hot: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """The join of ``left`` and ``right`` on ``key``; rows of ``left`` with a key of ``hot`` are dealt over its parts by the column ``by``, and those of ``right`` are copied to each part."""
    if hot.isEmpty():
        return left.join(right, key, how)
    salt = F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1))).cast("int")
    left = left.join(F.broadcast(hot), key, "left").withColumn("salt", salt).drop("parts")
    right = right.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return left.join(right, [*key, "salt"], how).drop("salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of a column's text, modulo ``modulus`` (null ids count as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give a Python worker's free memory back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mapped(df: DataFrame, function, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow``."""
    importable(df.sparkSession)

    def run(batches):
        yield from function(batches)
        release()

    return df.mapInArrow(run, schema)


def grouped(df: DataFrame, keys: str | list[str], function, schema: str) -> DataFrame:
    """``df.groupBy(keys).applyInArrow``."""
    importable(df.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        out = function(table)
        release()
        return out

    return df.groupBy(keys).applyInArrow(run, schema)
