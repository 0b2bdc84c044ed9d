"""Resumable work: batches that skip what is done, and the same as a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from ringloom.operators.joins import remaining


def done_table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def run_remaining(todo: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, key: Sequence[str]) -> None:
    """Append ``work``'s rows for the keys of ``todo`` that the table at ``path`` lacks. ``work`` keeps the key."""
    done = done_table(todo.sparkSession, path)
    left = todo if done is None else remaining(todo, done, key)
    work(left).write.mode("append").parquet(path)


def stream_remaining(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, key: Sequence[str], checkpoint: str, once: bool = True):
    """The same for a stream of files: a micro-batch that runs again finds its keys done."""
    query = stream.writeStream.foreachBatch(lambda batch, _: run_remaining(batch.dropDuplicates(list(key)), work, path, key)).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()
