"""Per-key results when a few keys hold most rows.

A sample finds the heavy keys: those that hold more than a part of what one task should. Rows of
heavy keys get the key's number by a broadcast join and are spread over the whole cluster by what
they are counted by; all other rows go through one ordinary shuffle on the key. The two results are
united.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: A key is heavy from this part of the rows that one shuffle partition has on average.
PART_OF_TASK = 0.25
#: Rows of the sample that a key at that bound has, on average; half of them make it heavy, so that none is overlooked by chance.
SAMPLED = 200
#: Greatest share of all rows that a key may hold without being heavy, however few the partitions.
SHARE = 0.002


def heavy_share(df: DataFrame) -> float:
    """The share of all rows from which a key is heavy, by the number of shuffle partitions."""
    return min(SHARE, PART_OF_TASK / max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def heavy_keys(df: DataFrame, key: str, share: float | None = None) -> DataFrame:
    """(key, heavy_no, weight) of the string keys that may hold ``share`` of the rows or more; ``weight`` is about their share.

    At most 2 / ``share`` rows, as each has SAMPLED / 2 of the SAMPLED / ``share`` rows of the sample.
    Null keys are no keys. A key that is taken for heavy by chance is harmless, as heavy and light
    keys get the same results by different routes. The empty table has no heavy keys.
    """
    share = share or heavy_share(df)
    rows = df.count()
    fraction = min(1.0, SAMPLED / share / max(1, rows))
    sampled = df.select(key).sample(fraction, 7) if fraction < 1 else df.select(key)
    counted = sampled.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= max(1.0, fraction * rows * share * (0.5 if fraction < 1 else 1.0)))
    numbered = counted.select(key, F.row_number().over(Window.orderBy(key)).alias("heavy_no"), (F.col("n") / (fraction * max(1, rows))).alias("weight"))  # over the heavy keys only
    return cut_lineage(numbered)


def count_by_key(df: DataFrame, key: str, counts: dict[str, list[str]], share: float | None = None) -> DataFrame:
    """Distinct counts per key, without the tasks of a few heavy keys holding up the rest.

    ``counts`` names each result column and the columns of ``df`` whose distinct non-null
    combinations it counts (a combination with a null in its first column does not count).
    Returns key, the counts and ``heavy``. Rows with a null key are left out; an empty table
    gives no rows.
    """
    columns = list(dict.fromkeys(c for cols in counts.values() for c in cols))
    df = df.select(key, *columns).where(F.col(key).isNotNull())
    heavy = F.broadcast(heavy_keys(df, key, share).drop("weight"))  # at most 2 / share rows

    # Heavy keys: one int instead of the key is shuffled, spread by the counted columns.
    hot = df.join(heavy, key, "inner").drop(key)
    result = heavy
    for name, cols in counts.items():
        distinct = hot.where(F.col(cols[0]).isNotNull()).select("heavy_no", *cols).distinct()
        one = distinct.groupBy("heavy_no").agg(F.count("*").alias(name))
        result = result.join(F.broadcast(one), "heavy_no", "left").fillna(0, [name])  # a row for each heavy key

    # Light keys: one shuffle brings all rows of a key together, every distinct count is local to it.
    light = df.join(heavy, key, "left_anti").repartition(key)
    rest = light.groupBy(key).agg(*(F.count_distinct(*map(F.col, cols)).alias(name) for name, cols in counts.items()))
    return result.select(key, *counts, F.lit(True).alias("heavy")).unionByName(rest.select(key, *counts, F.lit(False).alias("heavy")))
