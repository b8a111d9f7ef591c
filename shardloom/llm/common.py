"""Shared folders, written intermediate tables and small helpers of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.driver import scratch
from ..sources.files import spread


def work_root(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which driver and executors share; removed when the program ends.

    Only where the session has no such setting (tests, one machine) a folder of
    this machine is used.
    """
    return scratch(spark, "llm")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage, and survives lost executors."""
    path = f"{work_root(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A narrow table of at most so many rows (a few longs each) is broadcast.
BROADCAST_ROWS = 200_000


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most so many rows, else df, to be joined by shuffle.

    For written narrow tables that meet wide ones: below the bound the texts stay where they are.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bounded(df: DataFrame, rows: int, name: str) -> DataFrame:
    """A written sample, or those of its rows with the smallest hashes if it has more than so many."""
    if df.count() <= rows:
        return df
    return materialise(df.orderBy(F.xxhash64(*df.columns), *df.columns).limit(rows), name)


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, however often body uses it (also inside lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def crc_sql(text: str) -> str:
    """DuckDB SQL of the crc32 of a text of ASCII characters."""
    byte = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)), lambda c, b: {byte}), 4294967295::BIGINT)"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, read by all cores also where they are one row group."""
    return spread(read_table(spark, sf_dir, "documents"))


def split_fs(url: str):
    """(pyarrow file system, path in it) of a folder URL; works on every worker."""
    from pyarrow import fs

    if "://" not in url and not url.startswith("file:"):
        return fs.LocalFileSystem(), url
    if url.startswith("file:"):
        return fs.LocalFileSystem(), "/" + url[5:].lstrip("/")
    return fs.FileSystem.from_uri(url)
