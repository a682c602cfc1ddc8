"""Neighbours, frontiers and closures over the edge table.

Edges are one row per id (see ``tables.canonical``): id, type, src_id, dst_id, resolution, pruned
and more; as a stored table, each hop reads two columns of the edges of the wanted types. Every
expansion is a join of a frontier with the edges; a visited set, kept as a table, ends it. Lineage
is cut after each hop in the shared checkpoint folder. A frontier is broadcast, so that hubs are not
gathered in one task, as long as a count of its stored rows finds it small; a larger one is joined
by a shuffle. An empty frontier, an empty edge table or an unknown start gives the start alone or
no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, if_small
from ..tables import RESOLVED_LEVELS


def of_types(rels: DataFrame, types: tuple[str, ...] | None) -> DataFrame:
    """The edges of some types; no types means no filter."""
    return rels.where(F.col("type").isin(*types)) if types else rels


def is_resolved() -> Column:
    return F.coalesce(F.col("resolution").isin(*RESOLVED_LEVELS), F.lit(False))


def directed(rels: DataFrame, direction: str) -> DataFrame:
    """(a, b, edge_id, type, direction): edges as steps from a to b; *both* has each edge twice."""
    out = rels.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"), F.col("id").alias("edge_id"), "type", F.lit("out").alias("direction"))
    back = rels.select(F.col("dst_id").alias("a"), F.col("src_id").alias("b"), F.col("id").alias("edge_id"), "type", F.lit("in").alias("direction"))
    return {"out": out, "in": back}.get(direction) if direction != "both" else out.unionByName(back)


def neighbours(entities: DataFrame, rels: DataFrame, starts: DataFrame, direction: str = "out", types: tuple[str, ...] | None = None) -> DataFrame:
    """(id, direction, type, edge_id, neighbour, neighbour_kind) of every start (a table with ``id``); edges to no entity are left out."""
    steps = directed(of_types(rels, types), direction)
    ends = entities.select(F.col("id").alias("neighbour"), F.col("kind").alias("neighbour_kind"))
    few = if_small(cut_lineage(starts.select(F.col("id").alias("a")).distinct()))
    hop = steps.join(few, "a").join(ends, F.col("b") == F.col("neighbour"))
    return hop.select(F.col("a").alias("id"), "direction", "type", "edge_id", "neighbour", "neighbour_kind")


def reach(rels: DataFrame, starts: DataFrame, direction: str = "out", types: tuple[str, ...] | None = None, max_depth: int = 2) -> DataFrame:
    """(root, id, depth): everything within ``max_depth`` steps of each start (a table with ``id``), with its least depth; the start has depth 0."""
    steps = directed(of_types(rels, types), direction).select("a", "b")
    seen = cut_lineage(starts.select(F.col("id").alias("root"), "id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, max_depth + 1):
        new = steps.join(if_small(frontier.select("root", F.col("id").alias("a"))), "a").select("root", F.col("b").alias("id")).distinct()
        frontier = cut_lineage(new.join(if_small(seen), ["root", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def call_graph(rels: DataFrame, starts: DataFrame, direction: str = "in", max_depth: int = 2) -> DataFrame:
    """(root, id, depth, resolved): callers (*in*) or callees (*out*) of each start up to ``max_depth``.

    Calls that were not resolved to their target appear one step from the start and are never
    followed; pruned ones do not appear. ``resolved`` says whether a resolved call reaches the
    symbol at that depth.
    """
    calls = rels.where("type = 'calls' and not pruned").withColumn("resolved", is_resolved())
    a, b = ("dst_id", "src_id") if direction == "in" else ("src_id", "dst_id")
    steps = calls.select(F.col(a).alias("a"), F.col(b).alias("b"), "resolved")
    seen = cut_lineage(starts.select(F.col("id").alias("root"), "id").distinct().withColumns({"depth": F.lit(0), "resolved": F.lit(True)}))
    frontier, found = seen, None
    for depth in range(1, max_depth + 1):
        follow = steps if depth == 1 else steps.where("resolved")
        hop = follow.join(if_small(frontier.where("resolved").select("root", F.col("id").alias("a"))), "a")
        hop = hop.groupBy("root", F.col("b").alias("id")).agg(F.max("resolved").alias("resolved"))
        frontier = cut_lineage(hop.join(if_small(seen), ["root", "id"], "left_anti").withColumn("depth", F.lit(depth)).select("root", "id", "depth", "resolved"))
        found = frontier if found is None else found.unionByName(frontier)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return found


def ancestors(rels: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, ancestor, depth): the transitive closure of extends and implements, with the least depth; cycles are cut.

    Edges whose resolution is stated and speculative are left out.
    """
    sure = F.col("resolution").isNull() | is_resolved()
    up = rels.where(F.col("type").isin("extends", "implements") & sure).select(F.col("src_id").alias("id"), F.col("dst_id").alias("ancestor")).distinct()
    up = cut_lineage(up)
    closure = up.withColumn("depth", F.lit(1))
    frontier = closure
    for depth in range(2, max_rounds + 1):
        hop = frontier.select("id", F.col("ancestor").alias("via")).join(up.select(F.col("id").alias("via"), "ancestor"), "via").select("id", "ancestor").distinct()
        frontier = cut_lineage(hop.where("id <> ancestor").join(closure, ["id", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        closure = closure.unionByName(frontier)
    return closure


def tree_edges(rels: DataFrame, starts: DataFrame, max_depth: int = 2) -> DataFrame:
    """(root, id, parent, edge_id, depth): the edge over which each neighbour is first reached, both ways; of several the least edge id counts."""
    near = reach(rels, starts, "both", None, max_depth)
    steps = directed(rels, "both")
    inner = near.select("root", F.col("id").alias("a"), F.col("depth").alias("before"))
    hop = steps.join(if_small(near.where("depth > 0")), F.col("id") == F.col("b")).join(if_small(inner), ["root", "a"]).where("before = depth - 1")
    return hop.groupBy("root", "id", "depth").agg(F.min(F.struct("edge_id", "a")).alias("e")).select("root", "id", F.col("e.a").alias("parent"), "e.edge_id", "depth")


def flow(rels: DataFrame, starts: DataFrame, max_depth: int = 3) -> DataFrame:
    """(root, src_id, dst_id, type, depth): calls, runs and invokes from each start, and the data and screens that the reached programs touch."""
    control = ("invokes", "runs", "calls")
    near = reach(rels, starts, "out", control, max_depth)
    edges = of_types(rels, (*control, "reads", "writes", "uses")).where("not pruned").select("src_id", "dst_id", "type")
    hop = edges.join(if_small(near.select("root", F.col("id").alias("src_id"), "depth")), "src_id")
    inside = F.col("type").isin("reads", "writes", "uses") | (F.col("depth") < max_depth)
    return hop.where(inside).select("root", "src_id", "dst_id", "type", "depth").distinct()


def triggers(rels: DataFrame, entities: DataFrame, starts: DataFrame, max_depth: int = 4) -> DataFrame:
    """(root, trigger, kind, depth): transactions, jobs and entry files from which each start is reached by calls, runs and invokes."""
    near = reach(rels, starts, "in", ("invokes", "runs", "calls"), max_depth)
    kinds = entities.where(F.col("kind").isin("transaction_code", "jcl_job")).select(F.col("id").alias("trigger"), "kind")
    return kinds.join(if_small(near.where("depth > 0")), F.col("id") == F.col("trigger")).select("root", "trigger", "kind", "depth")


def fan_in(rels: DataFrame, types: tuple[str, ...] = ("calls",)) -> DataFrame:
    """(id, n_edges, n_sources, n_files): edges into each target, distinct sources and distinct files of the edges."""
    edges = of_types(rels, types).where("not pruned")
    per_source = edges.groupBy("dst_id", "src_id", "path").agg(F.count("*").alias("n"))  # combined before any distinct count meets a hot target
    per_file = per_source.groupBy("dst_id", "path").agg(F.sum("n").alias("n"))
    sources = per_source.select("dst_id", "src_id").distinct().groupBy("dst_id").agg(F.count("*").alias("n_sources"))
    files = per_file.groupBy("dst_id").agg(F.sum("n").alias("n_edges"), F.count("path").alias("n_files"))
    return files.join(sources, "dst_id").select(F.col("dst_id").alias("id"), "n_edges", "n_sources", "n_files")


def dead_code(entities: DataFrame, rels: DataFrame) -> DataFrame:
    """(id, name, path): functions and methods that nothing calls or references, without conventional entry names, private dunders and tests."""
    named = F.lower("name").rlike(r"^(main|run|start|handler|app|setup|teardown|constructor|__\w+__|test_?\w*)$") | F.lower(F.coalesce("path", F.lit(""))).rlike(r"(^|/)(tests?|specs?)/|(^|/)test_[^/]*$|[._](test|spec)\.\w+$")
    used = of_types(rels, ("calls", "references")).where("not pruned").select(F.col("dst_id").alias("id")).distinct()
    own = entities.where("kind in ('function', 'method') and not missing and not external and deleted_at is null").where(~F.coalesce(named, F.lit(False)))
    return own.join(used, "id", "left_anti").select("id", "name", "path")


def shallow_modules(entities: DataFrame, rels: DataFrame) -> DataFrame:
    """(id, path): modules in which nothing is defined."""
    defined = rels.where("type = 'defines'").select(F.col("src_id").alias("id")).distinct()
    return entities.where("kind = 'module' and not missing and not external").join(defined, "id", "left_anti").select("id", "path")


def entry_points(entities: DataFrame) -> DataFrame:
    """(id, kind, name, path): callables whose name or file is conventionally where a program begins."""
    by_name = F.lower("name").isin("main", "run", "start", "handler", "app")
    by_path = F.coalesce(F.lower("path").rlike(r"(^|/)(__main__\.py|main\.\w+|index\.(js|ts)|app\.\w+|server\.\w+)$"), F.lit(False))
    return entities.where(F.col("kind").isin("function", "method", "jcl_job", "transaction_code", "module") & (by_name | by_path | F.col("kind").isin("jcl_job", "transaction_code"))).select("id", "kind", "name", "path")


def edge_ordinals(rels: DataFrame) -> DataFrame:
    """(id, ordinal): the running number, from 0, of each edge among those of the same type and ends, by line and id."""
    order = Window.partitionBy("type", "src_id", "dst_id").orderBy(F.col("start_line").asc_nulls_first(), "id")
    return rels.select("id", (F.row_number().over(order) - 1).alias("ordinal"))


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)
