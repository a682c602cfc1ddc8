"""Summaries and views of the whole graph: totals, entry points, perspectives, one hop from an entry, modules, capabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import CALLABLE_KINDS, DATA_TYPES
from .graph import entry_points, fan_in, union_all

MAIN_GUARD = r"(?m)^if\s+__name__\s*==\s*['\"]__main__['\"]"


def entry_counts(entities: DataFrame, rels: DataFrame, files: DataFrame) -> DataFrame:
    """(kind, n): jobs, transactions, programs that nothing calls, runs or invokes, and Python files with a main guard."""
    used = rels.where("type in ('calls', 'runs', 'invokes') and not pruned").select(F.col("dst_id").alias("id")).distinct()
    here = entities.where("not missing and not external")
    jobs = here.where("kind = 'jcl_job' and not lower(coalesce(path, '')) rlike '[.]pro?c$'").select(F.lit("jobs").alias("kind"))
    transactions = here.where("kind = 'transaction_code'").select(F.lit("transactions").alias("kind"))
    programs = here.where("kind = 'legacy_program'").join(used, "id", "left_anti").select(F.lit("uncalled_programs").alias("kind"))
    guards = files.where(F.col("path").rlike(r"\.py\s*$") & F.col("content").rlike(MAIN_GUARD)).select("repo_id", "path").distinct().select(F.lit("main_guards").alias("kind"))
    return union_all([jobs, transactions, programs, guards]).groupBy("kind").agg(F.count("*").alias("n"))


def totals(entities: DataFrame) -> DataFrame:
    """(repo_id, files, modules, functions, methods, classes, tests, externals) of each repository; externals are distinct names."""
    here = F.col("missing") | F.col("external")
    n = lambda kind, name: F.count_if((F.col("kind") == kind) & ~here).alias(name)
    counted = entities.groupBy("repo_id").agg(n("file", "files"), n("module", "modules"), n("function", "functions"), n("method", "methods"), n("class", "classes"), n("test", "tests"))
    outside = entities.where("external").select("repo_id", "qualified_name").distinct().groupBy("repo_id").agg(F.count("*").alias("externals"))
    return counted.join(outside, "repo_id", "left").fillna(0, ["externals"])


def documented(entities: DataFrame) -> DataFrame:
    """(kind, eligible, covered, average_length): how many symbols of each kind have documentation, and how long it is."""
    own = entities.where(F.col("kind").isin(*CALLABLE_KINDS, "class", "interface") & ~F.col("missing") & ~F.col("external"))
    has = F.trim("docstring") != ""
    return own.groupBy("kind").agg(F.count("*").alias("eligible"), F.count_if(has).alias("covered"), F.round(F.avg(F.when(has, F.length("docstring"))), 4).alias("average_length"))


def perspectives(entities: DataFrame, rels: DataFrame, limit: int = 12) -> DataFrame:
    """(perspective, id, rank): where to begin looking: entry points, the most called symbols, the modules with the most definitions; ``limit`` of each."""
    known = entities.where("not missing and not external").select("id")
    entries = entry_points(entities.where("not missing and not external")).select("id", F.lit(0).cast("long").alias("n"), F.lit("entry_points").alias("perspective"))
    hubs = fan_in(rels).join(known, "id", "left_semi").select("id", F.col("n_edges").alias("n"), F.lit("hubs").alias("perspective"))
    modules = rels.where("type = 'defines'").groupBy(F.col("src_id").alias("id")).agg(F.count("*").alias("n"))
    modules = modules.join(entities.where("kind = 'module' and not missing").select("id"), "id", "left_semi").select("id", "n", F.lit("modules").alias("perspective"))
    order = Window.partitionBy("perspective").orderBy(F.desc("n"), "id")
    return union_all([entries, hubs, modules]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("perspective", "id", "rank")


def downstream(entities: DataFrame, rels: DataFrame) -> DataFrame:
    """(id, n_calls, n_data): what each entry point reaches in one step: symbols it calls, runs or invokes, and data it touches, distinct."""
    entries = entry_points(entities.where("not missing and not external")).select(F.col("id").alias("src_id"))
    step = rels.where(F.col("type").isin("calls", "runs", "invokes", *DATA_TYPES) & ~F.col("pruned")).join(entries, "src_id", "left_semi")
    data = F.col("type").isin(*DATA_TYPES)
    once = step.select("src_id", "dst_id", data.alias("data")).distinct()
    return once.groupBy(F.col("src_id").alias("id")).agg(F.count_if(~F.col("data")).alias("n_calls"), F.count_if("data").alias("n_data"))


def walkthrough_starts(entities: DataFrame, rels: DataFrame) -> DataFrame:
    """(repo_id, id, size): of each repository the entry point with the most calls and data one step away, ties to the lesser id."""
    sized = downstream(entities, rels).withColumn("size", F.col("n_calls") + F.col("n_data")).join(entities.select("id", "repo_id"), "id")
    best = sized.groupBy("repo_id").agg(F.min(F.struct((-F.col("size")).alias("s"), "id", "size")).alias("b"))
    return best.select("repo_id", "b.id", "b.size")


def modules(entities: DataFrame, rels: DataFrame) -> DataFrame:
    """(id, symbols, imports, importers, callers_outside): each module with what it defines, what it imports, who imports it, and calls into it from other files."""
    known = entities.where("kind = 'module' and not missing and not external").select("id", "repo_id", "path")
    defined = rels.where("type = 'defines'").select("src_id", "dst_id").distinct().groupBy(F.col("src_id").alias("id")).agg(F.count("*").alias("symbols"))
    edges = rels.where("type = 'imports'").select("src_id", "dst_id").distinct()
    out = edges.groupBy(F.col("src_id").alias("id")).agg(F.count("*").alias("imports"))
    into = edges.groupBy(F.col("dst_id").alias("id")).agg(F.count("*").alias("importers"))
    place = entities.where("path is not null").select("id", "repo_id", "path")
    calls = rels.where("type = 'calls' and not pruned").groupBy("src_id", "dst_id").agg(F.count("*").alias("n"))
    a = place.select(F.col("id").alias("src_id"), F.col("repo_id").alias("r1"), F.col("path").alias("p1"))
    b = place.select(F.col("id").alias("dst_id"), "repo_id", "path")
    across = calls.join(a, "src_id").join(b, "dst_id").where("not (r1 <=> repo_id and p1 <=> path)").groupBy("repo_id", "path").agg(F.sum("n").alias("callers_outside"))
    j = known.join(defined, "id", "left").join(out, "id", "left").join(into, "id", "left").join(across, ["repo_id", "path"], "left")
    counts = ["symbols", "imports", "importers", "callers_outside"]
    return j.fillna(0, counts).select("id", *counts)


def capabilities(flows: DataFrame) -> DataFrame:
    """(root, programs, data, read_data, written_data): of each flow (root, src_id, dst_id, type, depth) the symbols that run in it, and the data it touches."""
    programs = flows.where("type in ('calls', 'runs', 'invokes')").select("root", F.col("dst_id").alias("id")).distinct().groupBy("root").agg(F.count("*").alias("programs"))
    data = flows.where("type in ('reads', 'writes')").select("root", "dst_id", "type").distinct()
    by = data.groupBy("root", "dst_id").agg(F.max(F.col("type") == "reads").alias("r"), F.max(F.col("type") == "writes").alias("w"))
    touched = by.groupBy("root").agg(F.count("*").alias("data"), F.count_if("r").alias("read_data"), F.count_if("w").alias("written_data"))
    return programs.join(touched, "root", "full_outer").fillna(0, ["programs", "data", "read_data", "written_data"])


def kinds_of_flow(flows: DataFrame, entities: DataFrame) -> DataFrame:
    """(root, kind, n): the nodes of each flow by kind; ends that no entity stands for are *unknown*."""
    nodes = flows.select("root", F.col("src_id").alias("id")).unionByName(flows.select("root", F.col("dst_id").alias("id"))).distinct()
    j = nodes.join(entities.select("id", "kind"), "id", "left")
    return j.groupBy("root", F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n"))


def abilities(entities: DataFrame, rels: DataFrame, vectors: DataFrame) -> DataFrame:
    """(ability, present): what can be asked of this graph, as some fact for it is stored."""
    some = lambda df, name: df.limit(1).agg(F.lit(name).alias("ability"), (F.count("*") > 0).alias("present"))
    return union_all([
        some(rels.where("type = 'calls'"), "call_graph"), some(rels.where("type in ('reads', 'writes')"), "lineage"), some(rels.where("type = 'tests'"), "tests"),
        some(entities.where("kind in ('jcl_job', 'transaction_code')"), "triggers"), some(entities.where("kind = 'business_capability'"), "capabilities"), some(vectors.where("vector is not null"), "semantic"),
    ])


def neighbourhoods(rels: DataFrame, near: DataFrame) -> DataFrame:
    """(id, src_id, dst_id, type): the edges between nodes of one neighbourhood or several, given as (root, id), each edge once."""
    nodes = near.select("id").distinct()
    inside = rels.join(nodes.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(nodes.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
    return inside.select("id", "src_id", "dst_id", "type")
