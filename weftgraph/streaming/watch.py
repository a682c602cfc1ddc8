"""Keeping stored files up to date from a folder that new versions arrive in, batch by batch."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.upserts import latest


def watch(spark: SparkSession, arrivals: str, stored: str, checkpoint: str, schema) -> StreamingQuery:
    """A query that merges the Parquet files arriving in ``arrivals`` into versions of the table in ``stored``.

    Each batch writes a new version ``v=<batch>`` with the newest row of each (repo_id, path), and
    only then is it the current one, so a batch that is run again after a failure does no harm.
    """

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = current(session, stored, below=number)
        rows = batch if before is None else before.unionByName(batch)
        latest(rows, ["repo_id", "path"], ["indexed_at"]).write.mode("overwrite").parquet(f"{stored}/v={number:08d}")

    stream = spark.readStream.schema(schema).parquet(arrivals)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, stored: str, below: int | None = None) -> DataFrame | None:
    """The newest complete version of a watched table, or of those below a number; None if there is none."""
    done = sorted(p.parent for p in Path(stored).glob("v=*/_SUCCESS"))
    done = [p for p in done if below is None or int(p.name[2:]) < below]
    return spark.read.parquet(str(done[-1])) if done else None
