"""What a change of a symbol reaches: callers and callees, tests, data, risk, and how complete the answer is.

Everything is computed for all symbols at once, as joins and aggregates; one symbol is a filter on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.graph import is_resolved
from ..tables import CALLABLE_KINDS, SYMBOL_KINDS


def call_counts(rels: DataFrame) -> DataFrame:
    """(id, callers, candidates, callees, tests): distinct resolved and speculative callers, callees, and covering tests of each symbol with any."""
    calls = rels.where("type = 'calls' and not pruned").withColumn("resolved", is_resolved())
    pairs = calls.groupBy("src_id", "dst_id").agg(F.max("resolved").alias("resolved"))  # a hot target is combined before it is counted
    into = pairs.groupBy(F.col("dst_id").alias("id")).agg(F.count_if("resolved").alias("callers"), F.count_if(~F.col("resolved")).alias("candidates"))
    out = pairs.where("resolved").groupBy(F.col("src_id").alias("id")).agg(F.count("*").alias("callees"))
    tests = rels.where("type = 'tests'").select("src_id", "dst_id").distinct().groupBy(F.col("dst_id").alias("id")).agg(F.count("*").alias("tests"))
    counts = into.join(out, "id", "full_outer").join(tests, "id", "full_outer")
    return counts.fillna(0, ["callers", "candidates", "callees", "tests"])


def tests_named(entities: DataFrame) -> DataFrame:
    """(id, test_id): tests of the same repository whose name contains the simple name of a symbol, without case.

    Every part of a test's name is a row, which makes it an equality join; equal names are joined once.
    """
    tests = entities.where("kind = 'test'").select("repo_id", F.lower("name").alias("test"), F.col("id").alias("test_id"))
    at = F.explode(F.sequence(F.lit(1), F.length("test"))).alias("at")
    starts = tests.where("test <> ''").select("repo_id", "test").distinct().select("repo_id", "test", at)
    ends = starts.select("repo_id", "test", "at", F.explode(F.sequence(F.lit(1), F.length("test") - F.col("at") + 1)).alias("n"))
    parts = ends.select("repo_id", "test", F.substring("test", F.col("at"), F.col("n")).alias("name")).distinct()
    symbols = entities.where(F.col("kind").isin(*SYMBOL_KINDS)).select("repo_id", F.lower(tx.simple_name("qualified_name")).alias("name"), "id")
    pairs = parts.join(symbols.select("repo_id", "name").distinct(), ["repo_id", "name"])
    return pairs.join(symbols, ["repo_id", "name"]).join(tests, ["repo_id", "test"]).select("id", "test_id")


def test_callers(entities: DataFrame, rels: DataFrame, by_name: bool = True) -> DataFrame:
    """(id, test_id, confidence, via): tests of each symbol: a tests edge 1.0, a calling test 0.9, a test whose name contains the symbol's 0.6; the best of several."""
    edges = rels.where("type = 'tests'").select(F.col("dst_id").alias("id"), F.col("src_id").alias("test_id"), F.lit(1.0).alias("confidence"), F.lit("edge").alias("via"))
    tests = entities.where("kind = 'test'").select(F.col("id").alias("test_id"))
    calls = rels.where("type = 'calls' and not pruned").select(F.col("dst_id").alias("id"), F.col("src_id").alias("test_id")).join(tests, "test_id")
    calls = calls.select("id", "test_id", F.lit(0.9).alias("confidence"), F.lit("call").alias("via"))
    found = edges.unionByName(calls)
    if by_name:
        found = found.unionByName(tests_named(entities).withColumns({"confidence": F.lit(0.6), "via": F.lit("name")}))
    both = found.groupBy("id", "test_id").agg(F.max(F.struct("confidence", "via")).alias("b"))
    return both.select("id", "test_id", "b.confidence", "b.via")


def lineage(rels: DataFrame) -> DataFrame:
    """(id, type, data_id): data that each symbol reads, writes or maps to."""
    return rels.where(F.col("type").isin("reads", "writes", "maps_to")).select(F.col("src_id").alias("id"), "type", F.col("dst_id").alias("data_id")).distinct()


def _class_methods(entities: DataFrame) -> DataFrame:
    """(id, name, class_id): methods with their class, which has the method's qualified name without its last part."""
    classes = entities.where("kind in ('class', 'interface')").select(F.col("id").alias("class_id"), "repo_id", "qualified_name")
    methods = entities.where("kind = 'method'").select("id", "name", "repo_id", F.regexp_replace("qualified_name", r"\.[^.]*$", "").alias("qualified_name"))
    return methods.join(classes, ["repo_id", "qualified_name"]).select("id", "name", "class_id")


def overrides(entities: DataFrame, rels: DataFrame) -> DataFrame:
    """(id, other_id, relation): methods of the same name in a base class or a subclass; those of siblings are in ``override_groups``."""
    up = rels.where("type in ('extends', 'implements')").select(F.col("src_id").alias("sub"), F.col("dst_id").alias("base")).distinct()
    pairs = up.select(F.col("sub").alias("c1"), F.col("base").alias("c2"), F.lit("base").alias("relation")).unionByName(up.select(F.col("base").alias("c1"), F.col("sub").alias("c2"), F.lit("subclass").alias("relation")))
    own = _class_methods(entities)
    a = pairs.join(own.select(F.col("id"), "name", F.col("class_id").alias("c1")), "c1")
    return a.join(own.select(F.col("id").alias("other_id"), "name", F.col("class_id").alias("c2")), ["c2", "name"]).where("id <> other_id").select("id", "other_id", "relation").distinct()


def override_groups(entities: DataFrame, rels: DataFrame) -> DataFrame:
    """(base_id, name, id, class_id): methods that two or more classes with the same base have under one name.

    The siblings of a method are the other members of its groups. Members instead of pairs, as a
    base with many subclasses has as many pairs as the square of them.
    """
    up = rels.where("type in ('extends', 'implements')").select(F.col("src_id").alias("class_id"), F.col("dst_id").alias("base_id")).distinct()
    up = up.join(entities.select(F.col("id").alias("base_id")), "base_id", "left_semi")
    members = up.join(_class_methods(entities), "class_id").select("base_id", "name", "id", "class_id").distinct()
    groups = members.groupBy("base_id", "name").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a <> b")
    return members.join(groups.select("base_id", "name"), ["base_id", "name"], "left_semi").select("base_id", "name", "id", "class_id")


def completeness(counts: DataFrame) -> DataFrame:
    """(id, level): *exact* without speculative callers, *heuristic* with nothing else, else *partial*."""
    level = F.when(F.col("candidates") == 0, "exact").when(F.col("callers") == 0, "heuristic").otherwise("partial")
    return counts.select("id", level.alias("level"))


def risk(entities: DataFrame, rels: DataFrame, churn: DataFrame) -> DataFrame:
    """(id, score, level) of each callable: callers, changes of its file, callees, and the lack of tests.

    Speculative callers count as callers; score and thresholds are those of the model in SURVEY A13.
    """
    counts = call_counts(rels)
    own = entities.where(F.col("kind").isin(*CALLABLE_KINDS) & ~F.col("missing") & ~F.col("external")).select("id", "repo_id", "path")
    j = own.join(counts, "id", "left").join(churn.select("repo_id", "path", "commits"), ["repo_id", "path"], "left").fillna(0, ["callers", "candidates", "callees", "tests", "commits"])
    raw = (
        F.least(F.lit(0.5), (F.col("callers") + F.col("candidates")) * 0.06)
        + F.least(F.lit(0.25), F.col("commits") * 0.03)
        + F.least(F.lit(0.1), F.col("callees") * 0.01)
        + F.when(F.col("tests") == 0, 0.25).otherwise(0.0)
    )
    # Rounded to 10 places first, so that the sum of floats cannot fall to either side of a threshold.
    raw = F.round(raw, 10)
    level = F.when(raw >= 0.66, "high").when(raw >= 0.33, "medium").otherwise("low")
    return j.select("id", F.round(F.least(raw, F.lit(1.0)), 2).alias("score"), level.alias("level"))
