"""Keyed tables fed by streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.table import KeyedTable, TableSpec
from ..plans.driver import ShardedState, scratch


def file_stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Stream of the Parquet files of a folder or pattern, with the columns of like."""
    return spark.readStream.schema(like.schema).parquet(path)


def accumulate(stream: DataFrame, spec: TableSpec, folder: str | None = None) -> DataFrame:
    """All that is there now, merged by key; the table when the stream is caught up. The state stays in the shared folder."""
    empty = KeyedTable.of(spec, stream.sparkSession.createDataFrame([], stream.schema))
    return merge_into(stream, empty, folder or scratch(stream.sparkSession, "state")).df


def merge_into(stream: DataFrame, table: KeyedTable, folder: str, checkpoint: str | None = None) -> KeyedTable:
    """Merge each micro-batch into the table; returns the last version.

    A batch rewrites the shards that it touches, and one that is run again is not merged twice.
    """
    state = ShardedState(stream.sparkSession, folder, table)
    at = checkpoint or scratch(stream.sparkSession, "stream")
    stream.writeStream.foreachBatch(state.merge).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return KeyedTable(table.spec, state.read())
