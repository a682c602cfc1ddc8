"""Scores of answers against golden ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def set_f1(found: DataFrame, golden: DataFrame, group: str, item: str) -> DataFrame:
    """(group, found, expected, hits, f1) of each group: how a set of answers agrees with the expected one; repeats count once, null groups not at all."""
    a = found.where(F.col(group).isNotNull()).select(group, item).distinct().withColumn("_a", F.lit(1))
    b = golden.where(F.col(group).isNotNull()).select(group, item).distinct().withColumn("_b", F.lit(1))
    n = a.join(b, [group, item], "full_outer").groupBy(group).agg(F.count("_a").alias("found"), F.count("_b").alias("expected"), F.count(F.col("_a") + F.col("_b")).alias("hits"))
    both = F.col("found") + F.col("expected")
    return n.withColumn("f1", F.round(F.when(both > 0, 2 * F.col("hits") / both).otherwise(0.0), 6))


def mean_reciprocal_rank(ranked: DataFrame, golden: DataFrame, group: str, item: str) -> DataFrame:
    """(group, first_rank, reciprocal_rank): the first golden item of each group in the order of ``score``, ties by item; groups without one are left out.

    The rank is one more than the number of items before it, so only the best golden item of a
    group is compared with the group, and no group is sorted.
    """
    order = F.struct((-F.col("score")).alias("s"), F.col(item))
    hits = ranked.join(golden.select(group, item).distinct(), [group, item]).groupBy(group).agg(F.min(order).alias("best"))
    before = ranked.join(hits, group).where(order < F.col("best")).groupBy(group).agg(F.count("*").alias("n"))
    r = hits.join(before, group, "left").select(group, (F.coalesce("n", F.lit(0)) + 1).alias("first_rank"))
    return r.withColumn("reciprocal_rank", F.round(1 / F.col("first_rank"), 6))


def recall_at(found: DataFrame, golden: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """(group, recall): the share of the golden items of each group among its ``k`` best found by ``score``."""
    order = Window.partitionBy(group).orderBy(F.desc("score"), item)
    top = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select(group, item).withColumn("_hit", F.lit(1))
    return golden.select(group, item).distinct().join(top, [group, item], "left").groupBy(group).agg((F.count("_hit") / F.count("*")).alias("recall"))
