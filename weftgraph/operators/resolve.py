"""From parsed references to edges: definers, imports, types, links between programs, and what stays unresolved.

Every resolution is one join per scope, against candidates that were reduced to a count and a least
id for each scope first; the first rung that holds wins. A reference is never multiplied by its
candidates, so a name that half of all files use costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from .ladder import FAN_OUT_CAP

CLASS_KINDS = ("class", "interface")
#: Which kinds a member name may stand for, the earlier the better (fixed values).
MEMBER_KINDS = ("legacy_program", "copybook", "jcl_job", "transaction_code", "function")


def _rungs(*tests: tuple[Column, Column, str]) -> Column:
    """The target and resolution of the first test that holds, as a struct; *missing* if none does."""
    made = None
    for test, target, resolution in tests:
        value = F.struct(target.alias("target_id"), F.lit(resolution).alias("resolution"))
        made = F.when(test, value) if made is None else made.when(test, value)
    return made.otherwise(F.struct(F.lit(None).cast("string").alias("target_id"), F.lit("missing").alias("resolution")))


def definers(symbols: DataFrame, entities: DataFrame) -> DataFrame:
    """(repo_id, path, qualified_name, definer_id, via): what defines each parsed symbol: the class or module of its parent's name, else its file's module.

    ``symbols`` has parent_qname. Of several entities of a name a class comes before a module, then the least id.
    """
    rank = F.when(F.col("kind").isin(*CLASS_KINDS), 0).when(F.col("kind") == "module", 1).otherwise(2)
    owners = entities.where("kind in ('class', 'interface', 'module', 'legacy_program', 'file') and not missing")
    by_name = owners.groupBy("repo_id", F.col("qualified_name").alias("parent_qname")).agg(F.min(F.struct(rank.alias("r"), "id")).alias("p"))
    by_file = entities.where("kind = 'module' and not missing").groupBy("repo_id", "path").agg(F.min("id").alias("m"))
    s = symbols.select("repo_id", "path", "qualified_name", "parent_qname").distinct()
    j = s.join(by_name, ["repo_id", "parent_qname"], "left").join(by_file, ["repo_id", "path"], "left")
    via = F.when(F.col("p").isNotNull(), "parent").when(F.col("m").isNotNull(), "file").otherwise("missing")
    return j.select("repo_id", "path", "qualified_name", F.coalesce("p.id", "m").alias("definer_id"), via.alias("via"))


def imports(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """(repo_id, path, name, target_id, resolution): what each import (repo_id, path, name) means.

    A program or copybook of that member name, a module of that qualified name, else *external* if the
    first part of the name is no top-level package of the repository, else *missing*. Members compare
    without case. The target of the last two is null.
    """
    here = entities.where("not missing and not external")
    members = here.where(F.col("kind").isin("legacy_program", "copybook")).groupBy("repo_id", F.upper("name").alias("member")).agg(F.min("id").alias("t_member"))
    modules = here.where("kind = 'module'").groupBy("repo_id", F.col("qualified_name").alias("name")).agg(F.min("id").alias("t_module"))
    tops = here.where("kind = 'module'").select("repo_id", F.substring_index("qualified_name", ".", 1).alias("top"), F.lit(True).alias("inside")).distinct()
    j = refs.select("repo_id", "path", "name").distinct().withColumns({"member": F.upper("name"), "top": F.substring_index("name", ".", 1)})
    j = j.join(members, ["repo_id", "member"], "left").join(modules, ["repo_id", "name"], "left").join(tops, ["repo_id", "top"], "left")
    none = F.lit(None).cast("string")
    outside = F.col("inside").isNull() | F.col("top").isin(*names.STANDARD)
    made = _rungs((F.col("t_member").isNotNull(), F.col("t_member"), "member"), (F.col("t_module").isNotNull(), F.col("t_module"), "module"), (outside, none, "external"))
    return j.withColumn("m", made).select("repo_id", "path", "name", "m.target_id", "m.resolution")


def types(refs: DataFrame, entities: DataFrame, imported: DataFrame) -> DataFrame:
    """(repo_id, module, owner, name, target_id, target_kind, resolution): the class that each named type means.

    ``refs``: repo_id, module, owner, name; ``imported``: repo_id, module, imported. The only class of
    that name in the module (*same-module*), in the imported modules (*imported*), in the repository
    (*unique*), else the least of up to FAN_OUT_CAP (*candidate*), else *missing*. Dotted names
    count by their last part.
    """
    c = entities.where(F.col("kind").isin(*CLASS_KINDS) & ~F.col("missing")).select("repo_id", "name", "module", F.struct("id", "kind").alias("c"))
    overall = c.groupBy("repo_id", "name").agg(F.count("*").alias("n_all"), F.min("c").alias("t_all"))
    inside = c.groupBy("repo_id", "name", "module").agg(F.count("*").alias("n_module"), F.min("c").alias("t_module"))
    r = refs.select("repo_id", "module", "owner", F.element_at(F.split("name", r"\."), -1).alias("name")).where("name <> ''").distinct()
    # Only names that are referred to meet the imports, so a module that everything imports is not multiplied by all of its names.
    asked = r.select("repo_id", "module", "name").distinct().join(imported.select("repo_id", "module", "imported").distinct(), ["repo_id", "module"])
    through = asked.join(inside.select("repo_id", "name", F.col("module").alias("imported"), "n_module", "t_module"), ["repo_id", "name", "imported"])
    through = through.groupBy("repo_id", "module", "name").agg(F.sum("n_module").alias("n_imported"), F.min("t_module").alias("t_imported"))
    key = ["repo_id", "module", "name"]
    j = r.join(overall, ["repo_id", "name"], "left").join(inside, key, "left").join(through, key, "left")
    made = None
    for test, target, resolution in (
        (F.col("n_module") == 1, "t_module", "same-module"), (F.col("n_imported") == 1, "t_imported", "imported"),
        (F.col("n_all") == 1, "t_all", "unique"), (F.col("n_all") <= FAN_OUT_CAP, "t_all", "candidate"),
    ):
        value = F.struct(F.col(f"{target}.id").alias("target_id"), F.col(f"{target}.kind").alias("target_kind"), F.lit(resolution).alias("resolution"))
        made = F.when(test, value) if made is None else made.when(test, value)
    made = made.otherwise(F.struct(F.lit(None).cast("string").alias("target_id"), F.lit(None).cast("string").alias("target_kind"), F.lit("missing").alias("resolution")))
    return j.withColumn("m", made).select("repo_id", "module", "owner", "name", "m.target_id", "m.target_kind", "m.resolution")


def inheritance(resolved: DataFrame) -> DataFrame:
    """(repo_id, owner, target_id, type): edges of resolved bases: *implements* an interface, *extends* a class; an uncertain one is only *references*."""
    kind = F.when(F.col("resolution") == "candidate", "references").when(F.col("target_kind") == "interface", "implements").otherwise("extends")
    return resolved.where("target_id is not null").select("repo_id", "owner", "target_id", kind.alias("type")).distinct()


def bound_calls(calls: DataFrame, binds: DataFrame, entities: DataFrame) -> DataFrame:
    """(call_id, target_id, resolution): calls of names that an import has bound.

    ``calls``: call_id, repo_id, module, name, perhaps dotted; ``binds``: repo_id, module, local,
    target, the qualified name behind a local one. The bound name with the rest of the call must be
    the qualified name of a callable (*import-traced*) or a class (*constructor*, no call edge); else
    *missing*. Calls whose first part is not bound are left out.
    """
    local = F.substring_index("name", ".", 1)
    c = calls.select("call_id", "repo_id", "module", local.alias("local"), F.expr("substr(name, length(substring_index(name, '.', 1)) + 1)").alias("rest"))
    b = binds.groupBy("repo_id", "module", "local").agg(F.max("target").alias("target"))
    own = entities.where("not missing and kind in ('function', 'method', 'test', 'class', 'interface')").groupBy("repo_id", "qualified_name").agg(F.min(F.struct("id", "kind")).alias("e"))
    j = c.join(b, ["repo_id", "module", "local"]).withColumn("qualified_name", F.concat("target", "rest")).join(own, ["repo_id", "qualified_name"], "left")
    made = F.when(F.col("e").isNull(), "missing").when(F.col("e.kind").isin(*CLASS_KINDS), "constructor").otherwise("import-traced")
    return j.select("call_id", F.col("e.id").alias("target_id"), made.alias("resolution"))


def members(refs: DataFrame, entities: DataFrame, kinds: tuple[str, ...] = MEMBER_KINDS) -> DataFrame:
    """(repo_id, path, fact, name, target_id, target_kind, resolution): programs and copybooks by member name, in the order of ``kinds``; *external* names of systems, else *missing*.

    ``refs``: repo_id, path, fact, name. A target in the file that refers to it comes first, then the kind, then the least id.
    """
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    own = entities.where(F.col("kind").isin(*kinds) & ~F.col("missing") & ~F.col("external"))
    best = lambda *by: own.groupBy("repo_id", F.upper("name").alias("member"), *by).agg(F.min(F.struct(rank.alias("r"), "id", "kind")).alias("b"))
    r = refs.select("repo_id", "path", "fact", "name", F.upper("name").alias("member")).distinct()
    j = r.join(best("path").withColumnRenamed("b", "near"), ["repo_id", "member", "path"], "left").join(best().withColumnRenamed("b", "far"), ["repo_id", "member"], "left")
    b = F.coalesce("near", "far")
    made = F.when(b.isNotNull(), "member").when(names.is_external_name("name"), "external").otherwise("missing")
    return j.select("repo_id", "path", "fact", "name", b["id"].alias("target_id"), b["kind"].alias("target_kind"), made.alias("resolution"))


def materialised(refs: DataFrame, entities: DataFrame, kind: str) -> DataFrame:
    """(repo_id, name, id, made): one entity for each name that is referred to: the stored one of that kind without regard to case, else a new one with a derived id."""
    own = entities.where(F.col("kind") == kind).groupBy("repo_id", F.upper("name").alias("key")).agg(F.min("id").alias("id"))
    r = refs.where("name is not null and name <> ''").groupBy("repo_id", F.upper("name").alias("key")).agg(F.min("name").alias("name"))
    j = r.join(own, ["repo_id", "key"], "left")
    return j.select("repo_id", "name", F.coalesce("id", F.concat(F.lit(f"{kind}:"), "repo_id", F.lit("::"), "name")).alias("id"), F.col("id").isNull().alias("made"))


def gap_sites(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """(stub_id, repo_id, path, n): the files from which references go to what no entity stands for."""
    known = entities.where("not missing").select(F.col("id").alias("dst_id"))
    sites = rels.groupBy("dst_id", "repo_id", "path").agg(F.count("*").alias("n"))  # a hot target is combined before the join
    return sites.join(known, "dst_id", "left_anti").withColumnRenamed("dst_id", "stub_id")


def gaps_of_files(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, gaps, refs): symbols in whose file there are gaps, with their number and that of the references to them."""
    per_file = gap_sites(rels, entities).where("path is not null").groupBy("repo_id", "path").agg(F.count("*").alias("gaps"), F.sum("n").alias("refs"))
    own = entities.where("not missing and kind in ('function', 'method', 'class', 'legacy_program', 'paragraph')").select("id", "repo_id", "path")
    return own.join(per_file, ["repo_id", "path"]).select("id", "gaps", "refs")


def gap_reasons(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """(stub_id, ref_count, n_files, reasons): gaps with the relation types that need them, sorted."""
    known = entities.where("not missing").select(F.col("id").alias("dst_id"))
    by = rels.groupBy("dst_id", "type", "path").agg(F.count("*").alias("n")).join(known, "dst_id", "left_anti")
    per_type = by.groupBy("dst_id", "type").agg(F.sum("n").alias("n"))
    reasons = per_type.groupBy("dst_id").agg(F.sum("n").alias("ref_count"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("reasons"))  # a row for each relation type
    files = by.where("path is not null").select("dst_id", "path").distinct().groupBy("dst_id").agg(F.count("*").alias("n_files"))
    return reasons.join(files, "dst_id", "left").select(F.col("dst_id").alias("stub_id"), "ref_count", F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"), "reasons")


def unresolved_calls(rels: DataFrame) -> DataFrame:
    """(name, n_calls, n_callers): calls that led nowhere for certain, by the lower-case simple name of their target."""
    open_ = rels.where("type = 'calls' and not pruned and coalesce(resolution, 'missing') in ('missing', 'candidate', 'fan-out-capped', 'dynamic', 'name-match')")
    name = F.lower(F.regexp_extract("dst_id", r"([^.:]+)$", 1)).alias("name")
    each = open_.groupBy(name, "src_id").agg(F.count("*").alias("n"))
    return each.groupBy("name").agg(F.sum("n").alias("n_calls"), F.count("*").alias("n_callers"))


def unresolved_from(rels: DataFrame) -> DataFrame:
    """(id, n_open, n_calls): of each caller the calls that led nowhere for certain, and all of its calls."""
    calls = rels.where("type = 'calls' and not pruned")
    open_ = F.coalesce("resolution", F.lit("missing")).isin("missing", "candidate", "fan-out-capped", "dynamic", "name-match")
    return calls.groupBy(F.col("src_id").alias("id")).agg(F.count_if(open_).alias("n_open"), F.count("*").alias("n_calls")).where("n_open > 0")
