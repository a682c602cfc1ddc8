"""Merging changes into stored tables: upserts, deltas, and the difference of two versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last by ``order``; rows equal in it are settled by all other columns, so the result is the same on every run."""
    rest = [c for c in sorted(df.columns) if c not in keys and c not in order]
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order), *(F.col(c).desc_nulls_last() for c in rest))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with the rows of ``batch`` in place of those of the same keys; the batch wins. Both have the same columns."""
    return stored.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(batch)


def apply_delta(edges: DataFrame, delta: DataFrame) -> DataFrame:
    """Edges after an oracle's answers: ``delta`` has (id, op, resolution, confidence), op one of promote and prune.

    Promoted edges take the new resolution and confidence, pruned ones stay with ``pruned`` true, others stay as they are.
    """
    d = delta.select("id", "op", F.col("resolution").alias("_r"), F.col("confidence").alias("_c"))
    merged = edges.join(d, "id", "left")
    promoted = F.coalesce(F.col("op") == "promote", F.lit(False))
    return merged.select(
        *(c for c in edges.columns if c not in ("resolution", "confidence", "pruned")),
        F.when(promoted, F.col("_r")).otherwise(F.col("resolution")).alias("resolution"),
        F.when(promoted, F.col("_c")).otherwise(F.col("confidence")).alias("confidence"),
        (F.col("pruned") | F.coalesce(F.col("op") == "prune", F.lit(False))).alias("pruned"),
    )


def content_diff(old: DataFrame, new: DataFrame, keys: list[str], hash_column: str = "content_hash") -> DataFrame:
    """(keys, change): *new*, *deleted*, *changed* or *unchanged* for each key of two versions, by a hash of the content; a null hash equals a null hash."""
    a = old.select(*keys, F.col(hash_column).alias("_a"), F.lit(True).alias("_in_a"))
    b = new.select(*keys, F.col(hash_column).alias("_b"), F.lit(True).alias("_in_b"))
    change = F.when(F.col("_in_a").isNull(), "new").when(F.col("_in_b").isNull(), "deleted").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("changed")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change"))
