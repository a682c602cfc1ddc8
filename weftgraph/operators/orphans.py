"""References to records that do not exist at the time of the reference.

References and the life spans of their parents are brought together by key, sorted by time, and
merged in one pass: a running sum of span starts and ends says at each reference whether a parent
is alive. Keys with very many references are split; their few spans go to every part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import clean_id, fingerprint
from .skew import heavy_keys, heavy_share


def life_spans(entities: DataFrame) -> DataFrame:
    """(key, start, stop) of the spans that count as parents: stubs marked missing do not."""
    missing = F.coalesce(F.get_json_object("attributes", "$.missing") == "true", F.lit(False))
    return entities.where(~missing).select(clean_id("id").alias("key"), F.col("indexed_at").alias("start"), F.col("deleted_at").alias("stop"))


def references(relationships: DataFrame, columns: tuple[str, ...] = ("src_id", "dst_id")) -> DataFrame:
    """(ref_id, ref_column, key, t): one row per referring column of each relationship row."""
    pairs = F.array(*(F.struct(F.lit(c).alias("ref_column"), clean_id(c).alias("key")) for c in columns))
    return relationships.select(clean_id("id").alias("ref_id"), F.col("indexed_at").alias("t"), F.explode(pairs).alias("p")).select("ref_id", "t", "p.ref_column", "p.key").where("key is not null")


def orphans(refs: DataFrame, spans: DataFrame) -> DataFrame:
    """(ref_id, ref_column, key, t, status) of every reference without a living parent.

    ``status``: *missing* when no span of the key exists, *late* when the first one starts after
    the reference, *deleted* when an earlier one has ended, *undated* when the reference has no
    time but its key has spans. A span holds its start and not its end; a span with a null start or
    no length never lives. Null keys are no references. Repeated references come out once.
    """
    share = heavy_share(refs)
    # A heavy key has as many parts as it takes for each to hold no more than a key that is not heavy.
    hot = heavy_keys(refs.select("key"), "key", share).select("key", F.ceil(F.col("weight") / share).cast("int").alias("parts"))
    hot = F.broadcast(hot)  # at most 2 / share rows
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("ref_id"), F.col("parts")).cast("int")).otherwise(F.lit(0))
    r = refs.join(hot, "key", "left").select(
        *fingerprint("key", "k"), part.alias("part"), "t", F.lit(2).alias("event"), F.lit(0).alias("step"), "ref_id", "ref_column", "key"
    )
    parts = F.when(F.col("parts") > 1, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(0)))
    s = spans.join(hot, "key", "left").where("start is not null").select(*fingerprint("key", "k"), F.explode(parts).alias("part"), "start", "stop").distinct()
    real = F.col("stop").isNull() | (F.col("stop") > F.col("start"))
    # Event 0: a span without length, known but never alive; 1: a start or an end; 2: a reference. Ends and starts precede references of the same time.
    moves = F.array_compact(F.array(
        F.struct(F.col("start").alias("t"), F.when(real, 1).otherwise(0).alias("event"), F.when(real, 1).otherwise(0).alias("step")),
        F.when(real & F.col("stop").isNotNull(), F.struct(F.col("stop").alias("t"), F.lit(1).alias("event"), F.lit(-1).alias("step"))),
    ))
    s = s.select("k1", "k2", "part", F.explode(moves).alias("m")).select("k1", "k2", "part", "m.t", "m.event", "m.step")
    s = s.withColumns({c: F.lit(None).cast("string") for c in ("ref_id", "ref_column", "key")})

    merge = Window.partitionBy("k1", "k2", "part").orderBy(F.col("t").asc_nulls_first(), "event").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("k1", "k2", "part")
    is_span = F.col("event") < 2
    merged = r.unionByName(s).select(
        "ref_id", "ref_column", "key", "t", "event",
        F.sum("step").over(merge).alias("alive"),
        F.count(F.when(is_span, 1)).over(merge).alias("before"),
        F.count(F.when(is_span, 1)).over(whole).alias("known"),
    )
    status = (
        F.when(F.col("known") == 0, "missing").when(F.col("t").isNull(), "undated").when(F.col("before") == 0, "late").otherwise("deleted")
    )
    return merged.where("event = 2 and alive <= 0").select("ref_id", "ref_column", "key", "t", status.alias("status")).distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """(ref_column, month, status, n): orphan references per referring column and month of the reference."""
    return found.groupBy("ref_column", F.date_format("t", "yyyy-MM").alias("month"), "status").agg(F.count("*").alias("n"))
