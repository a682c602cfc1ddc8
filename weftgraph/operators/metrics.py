"""Counts and distributions over files, entities and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import layer

#: Edge types that bind one file to another (fixed values).
BINDING_TYPES = ("calls", "imports", "references", "extends", "implements", "depends_on", "reads", "writes", "maps_to", "runs", "invokes", "uses")

# How a comment line begins, by language.
COMMENT_MARKS = {"python": r"^\s*#", "javascript": r"^\s*(//|/\*|\*)", "cobol": r"^(.{6}\*|\s*\*>)", "jcl": r"^//\*", "hlasm": r"^\.?\*", "config": r"^\s*[#;]", "text": r"^$a"}

# Languages by file suffix.
SUFFIXES = {
    "py pyi": "python", "js jsx mjs cjs ts tsx": "javascript", "cbl cob cpy": "cobol", "jcl prc proc": "jcl", "asm hlasm mac": "hlasm", "bms": "bms", "csd": "csd",
    "env ini cfg properties yaml yml toml json": "config", "md rst txt": "text",
}


def language_of(path: Column | str) -> Column:
    """The language of a path by its suffix, null if there is none for it."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    pairs = [x for suffixes, name in SUFFIXES.items() for s in suffixes.split() for x in (F.lit(s), F.lit(name))]
    return F.create_map(*pairs)[suffix]


def lines(content: Column | str) -> Column:
    return F.split(content, r"\r\n|\r|\n")


def line_stats(files: DataFrame) -> DataFrame:
    """(repo_id, path, language, code, comment, blank): lines of each file by what they are; block comments by their usual first characters.

    A file stored twice counts once (its newest content); null contents have no lines.
    """
    newest = files.groupBy("repo_id", "path").agg(F.max_by("content", "indexed_at").alias("content")).where("content is not null")
    each = newest.withColumn("language", F.coalesce(language_of("path"), F.lit("text")))
    mark = F.create_map(*(x for k, v in COMMENT_MARKS.items() for x in (F.lit(k), F.lit(v))))[F.col("language")]
    mark = F.coalesce(mark, F.lit(COMMENT_MARKS["text"]))
    every = lines("content")
    count = lambda test: F.size(F.filter(every, test))
    blank = count(lambda x: F.trim(F.translate(x, "\t", " ")) == "")
    comment = count(lambda x: (F.trim(F.translate(x, "\t", " ")) != "") & F.regexp_like(x, mark))
    return each.select("repo_id", "path", "language", (F.size(every) - blank - comment).alias("code"), comment.alias("comment"), blank.alias("blank"))


def lines_by_language(files: DataFrame) -> DataFrame:
    """(language, files, code, comment, blank, comment_ratio) of each language, and of all in the row *total*."""
    rolled = line_stats(files).rollup("language").agg(F.count("*").alias("files"), *(F.sum(c).alias(c) for c in ("code", "comment", "blank")))
    ratio = F.when(F.col("code") + F.col("comment") > 0, F.round(F.col("comment") / (F.col("code") + F.col("comment")), 3)).otherwise(F.lit(0.0))
    return rolled.withColumn("comment_ratio", ratio).withColumn("language", F.coalesce("language", F.lit("total")))


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def resolution_distribution(rels: DataFrame) -> DataFrame:
    """(resolution, n) of calls; *unlabeled* for none."""
    return rels.where("type = 'calls'").groupBy(F.coalesce("resolution", F.lit("unlabeled")).alias("resolution")).agg(F.count("*").alias("n"))


def cross_edges(entities: DataFrame, rels: DataFrame) -> DataFrame:
    """(type, edges, cross_file, cross_directory): binding edges whose ends lie in different files or folders; ends without a path are neither."""
    e = entities.where("path is not null and path <> ''").select("id", F.concat_ws(":", "repo_id", "path").alias("file"))
    e = e.withColumn("folder", F.regexp_replace("file", "/?[^/]*$", ""))
    bound = rels.where(F.col("type").isin(*BINDING_TYPES)).select("type", "src_id", "dst_id")
    both = bound.join(e.select(F.col("id").alias("src_id"), F.col("file").alias("a"), F.col("folder").alias("fa")), "src_id").join(e.select(F.col("id").alias("dst_id"), F.col("file").alias("b"), F.col("folder").alias("fb")), "dst_id")
    return both.groupBy("type").agg(F.count("*").alias("edges"), F.count_if(F.col("a") != F.col("b")).alias("cross_file"), F.count_if(F.col("fa") != F.col("fb")).alias("cross_directory"))


def layers(entities: DataFrame, rels: DataFrame) -> DataFrame:
    """(layer, modules, symbols) of the modules by their path, with what they define."""
    modules = entities.where("kind = 'module' and not missing and not external").select("id", layer("path").alias("layer"))
    defined = rels.where("type = 'defines'").groupBy(F.col("src_id").alias("id")).agg(F.count("*").alias("n"))
    return modules.join(defined, "id", "left").groupBy("layer").agg(F.count("*").alias("modules"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols"))


def layer_edges(entities: DataFrame, rels: DataFrame) -> DataFrame:
    """(source, target, weight): imports between modules of different layers."""
    modules = entities.where("kind = 'module'").select("id", layer("path").alias("layer"))
    imports = rels.where("type = 'imports'").select("src_id", "dst_id")
    ends = imports.join(modules.select(F.col("id").alias("src_id"), F.col("layer").alias("source")), "src_id").join(modules.select(F.col("id").alias("dst_id"), F.col("layer").alias("target")), "dst_id")
    return ends.where("source <> target").groupBy("source", "target").agg(F.count("*").alias("weight"))


def readers_writers(rels: DataFrame, limit: int = 6) -> DataFrame:
    """(table_id, n_readers, n_writers, readers, writers): who reads and writes each table or dataset, the first ``limit`` by id."""
    pairs = rels.where(F.col("type").isin("reads", "writes")).select("dst_id", "type", "src_id").distinct()
    counts = pairs.groupBy("dst_id").agg(F.count_if(F.col("type") == "reads").alias("n_readers"), F.count_if(F.col("type") == "writes").alias("n_writers"))
    order = Window.partitionBy("dst_id", "type").orderBy("src_id")
    few = pairs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)  # bounded before any list is made
    names = lambda t: F.array_join(F.array_sort(F.collect_list(F.when(F.col("type") == t, F.col("src_id")))), "|")
    lists = few.groupBy("dst_id").agg(names("reads").alias("readers"), names("writes").alias("writers"))
    return counts.join(lists, "dst_id").withColumnRenamed("dst_id", "table_id")


def access_modes(rels: DataFrame) -> DataFrame:
    """(src_id, dst_id, access): *read*, *write* or *read/write* for each program and data set."""
    short = F.when(F.col("type") == "reads", "read").otherwise("write")
    modes = rels.where(F.col("type").isin("reads", "writes")).groupBy("src_id", "dst_id")
    return modes.agg(F.concat_ws("/", F.array_sort(F.collect_set(short))).alias("access"))


def churn(commits: DataFrame, path: str, author: str, ts: str) -> DataFrame:
    """(path, commits, authors, last_ts): changes of each path, distinct authors, and the newest."""
    each = commits.groupBy(path, author).agg(F.count("*").alias("n"), F.max(ts).alias("ts"))
    return each.groupBy(path).agg(F.sum("n").alias("commits"), F.count("*").alias("authors"), F.max("ts").alias("last_ts"))
