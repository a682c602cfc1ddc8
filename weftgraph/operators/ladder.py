"""Resolving references to their targets by a ladder of evidence, one candidate join and windows.

Ambiguity is counted per scope over all candidates of a reference; the first rung that holds wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A name with more candidates than this is not guessed at.
FAN_OUT_CAP = 5


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """(call_id, target_id, resolution, confidence, fan_out) of every call.

    ``calls``: call_id, repo_id, name, module, class_name (the caller's class or null), receiver, receiver_type.
    ``symbols``: id, repo_id, name, module, class_name. ``imports``: repo_id, module, imported.
    ``closure``: repo_id, class_name, ancestor of classes, by qualified name.

    The rungs: a method of the receiver's inferred class (*inferred* 0.9), of the caller's own class
    through self (*syntactic* 1.0), the only one of the module (*syntactic* 1.0), the only one of an
    imported module (*import-traced* 0.95), one of an ancestor class (*inherited* 0.9), the only one
    at all (*name-match* 0.6), else a *candidate* at min(0.4, 1 / n) for up to FAN_OUT_CAP; beyond
    it, and without candidates, the target is null and ``resolution`` is *fan-out-capped* or
    *missing*. Names are compared without case. Ties go to the least id.

    A name with very many candidates multiplies its calls in the join, so per repository and name
    the candidates are first reduced to counts and least ids of each scope, which is one row per
    module or class in which the name occurs.
    """
    name = F.lower("name").alias("name")
    s = symbols.select("repo_id", name, "id", "module", "class_name")
    by = ["repo_id", "name"]
    overall = s.groupBy(*by).agg(F.count("*").alias("n_all"), F.min("id").alias("t_all"))
    module = s.groupBy(*by, "module").agg(F.count("*").alias("n_module"), F.min("id").alias("t_module"))
    classes = s.where("class_name is not null").groupBy(*by, "class_name").agg(F.min("id").alias("t_class"))
    c = calls.select("call_id", "repo_id", name, "module", "class_name", "receiver", "receiver_type").withColumn("own", F.col("receiver").isin("self", "this", "cls"))

    # Only names that are called in a module meet its imports, so a module that everything imports is not multiplied by all of its names.
    asked = c.select("repo_id", "module", "name").distinct().join(imports.select("repo_id", "module", "imported").distinct(), ["repo_id", "module"])
    imported = asked.join(module.select("repo_id", "name", F.col("module").alias("imported"), "n_module", "t_module"), ["repo_id", "name", "imported"])
    imported = imported.groupBy("repo_id", "module", "name").agg(F.sum("n_module").alias("n_imported"), F.min("t_module").alias("t_imported"))
    r = c.join(overall, by, "left").join(module, [*by, "module"], "left").join(imported, [*by, "module"], "left")
    inferred = classes.select(*by, F.col("class_name").alias("receiver_type"), F.col("t_class").alias("t_inferred"))
    r = r.join(inferred, [*by, "receiver_type"], "left").join(classes.withColumnRenamed("t_class", "t_own"), [*by, "class_name"], "left")
    if closure is not None:
        up = closure.select("repo_id", "class_name", F.col("ancestor")).join(classes.select(*by, F.col("class_name").alias("ancestor"), "t_class"), ["repo_id", "ancestor"])
        r = r.join(up.groupBy("repo_id", "class_name", "name").agg(F.min("t_class").alias("t_up")), ["repo_id", "class_name", "name"], "left")
    else:
        r = r.withColumn("t_up", F.lit(None).cast("string"))
    rungs = [
        (F.col("t_inferred").isNotNull(), "t_inferred", "inferred", F.lit(0.9), F.lit(1)),
        (F.col("own") & F.col("t_own").isNotNull(), "t_own", "syntactic", F.lit(1.0), F.lit(1)),
        (F.col("own") & F.col("t_up").isNotNull(), "t_up", "syntactic", F.lit(1.0), F.lit(1)),
        (F.col("n_module") == 1, "t_module", "syntactic", F.lit(1.0), F.lit(1)),
        (F.col("n_imported") == 1, "t_imported", "import-traced", F.lit(0.95), F.lit(1)),
        (F.col("t_up").isNotNull(), "t_up", "inherited", F.lit(0.9), F.lit(1)),
        (F.col("n_all") == 1, "t_all", "name-match", F.lit(0.6), F.lit(1)),
        (F.col("n_imported") > 1, "t_imported", "candidate", F.least(F.lit(0.4), 1 / F.col("n_imported")), F.col("n_imported")),
        (F.col("n_all") <= FAN_OUT_CAP, "t_all", "candidate", F.least(F.lit(0.4), 1 / F.col("n_all")), F.col("n_all")),
        (F.col("n_all") > FAN_OUT_CAP, None, "fan-out-capped", F.lit(0.0), F.col("n_all")),
    ]
    made = None
    for test, target, resolution, confidence, fan_out in rungs:
        value = F.struct((F.col(target) if target else F.lit(None).cast("string")).alias("target_id"), F.lit(resolution).alias("resolution"), confidence.alias("confidence"), fan_out.cast("int").alias("fan_out"))
        made = F.when(test, value) if made is None else made.when(test, value)
    made = made.otherwise(F.struct(F.lit(None).cast("string").alias("target_id"), F.lit("missing").alias("resolution"), F.lit(0.0).alias("confidence"), F.lit(0).alias("fan_out")))
    return r.withColumn("m", made).select("call_id", "m.target_id", "m.resolution", "m.confidence", "m.fan_out")


def gaps(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """(stub_id, ref_count, n_files): targets of edges that no entity stands for, with the edges and files that refer to them."""
    known = entities.where("not missing").select(F.col("id").alias("dst_id"))
    per_file = rels.groupBy("dst_id", "path").agg(F.count("*").alias("n")).join(known, "dst_id", "left_anti")
    return per_file.groupBy(F.col("dst_id").alias("stub_id")).agg(F.sum("n").alias("ref_count"), F.count("path").alias("n_files"))
