"""The stored tables: loading, and the canonical spelling of ids and types."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import shared_folder

#: Every character that Python's ``\s`` matches; Java's and RE2's ``\s`` know fewer.
WHITE_SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]+"

#: Kinds that act as sets in the graph queries (fixed values of the data model).
SYMBOL_KINDS = (
    "symbol", "function", "method", "class", "interface", "enum", "variable", "type", "test",
    "legacy_program", "copybook", "paragraph", "jcl_job", "transaction_code",
)
CALLABLE_KINDS = ("function", "method", "test", "legacy_program", "paragraph")
DEPENDENCY_TYPES = ("calls", "imports", "depends_on", "references")
DATA_TYPES = ("reads", "writes", "maps_to")
RESOLVED_LEVELS = ("syntactic", "import-traced", "inherited", "inferred", "lsp-verified", "scip")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The stored table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_id(col: Column | str) -> Column:
    """An id as ids are compared: outer white space removed, inner runs collapsed, case kept."""
    return F.trim(F.regexp_replace(col, WHITE_SPACE, " "))


def clean_type(col: Column | str) -> Column:
    """A relation type as types are compared: trimmed and lower-cased."""
    return F.lower(clean_id(col))


def fingerprint(col: Column | str, prefix: str) -> list[Column]:
    """128 bits of a string in two bigint columns; null stays null.

    Two independently seeded 64-bit hashes: over 10^12 distinct values a single collision has
    probability 10^-15, while a shuffle carries 16 bytes instead of a whole id.
    """
    col = F.col(col) if isinstance(col, str) else col
    return [
        F.when(col.isNotNull(), F.xxhash64(F.lit(seed), col)).alias(f"{prefix}{n}")
        for n, seed in ((1, 7), (2, 1_000_003))
    ]


#: Canonical tables that this process has written: (application, folder, table, stored files) -> path.
_written: dict[tuple, str] = {}


def canonical(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The canonical ``entities`` or ``relationships`` of a data folder, written once for each set of stored files.

    Deduplication sorts and shuffles the largest table; so its result is stored in the shared folder,
    sorted by kind or type within each file, and every query after the first reads only the columns
    and row groups that it needs.
    """
    make, order = {"entities": (entities, ("kind", "repo_id")), "relationships": (relationships, ("type", "src_id"))}[name]
    stored = load(spark, sf_dir, name)
    key = (spark.sparkContext.applicationId, sf_dir, name, tuple(sorted(stored.inputFiles())))
    if key not in _written:
        path = f"{shared_folder(spark)}/canonical/{uuid.uuid4().hex}/{name}"
        make(spark, sf_dir).sortWithinPartitions(*order).write.parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest span of each entity id, with the hot attribute keys as columns.

    Of repeated rows one counts; ties of ``indexed_at`` go to the span that ends last.
    """
    e = load(spark, sf_dir, "entities").withColumn("id", clean_id("id"))
    order = F.struct("indexed_at", F.coalesce("deleted_at", F.to_timestamp_ntz(F.lit("9999-01-01 00:00:00"))), "attributes")
    kept = ("kind", "name", "qualified_name", "repo_id", "path", "start_line", "end_line", "attributes", "indexed_at", "deleted_at")
    newest = e.groupBy("id").agg(F.max_by(F.struct(*kept), order).alias("e"))
    attr = lambda key: F.get_json_object("e.attributes", f"$.{key}")
    return newest.select(
        "id",
        *(F.col(f"e.{c}").alias(c) for c in kept if c != "attributes"),
        F.coalesce(attr("missing") == "true", F.lit(False)).alias("missing"),
        F.coalesce(attr("external") == "true", F.lit(False)).alias("external"),
        attr("module").alias("module"),
        F.coalesce(attr("docstring"), F.lit("")).alias("docstring"),
    )


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per edge id in canonical spelling, newest delivery first; null ends are dropped.

    ``resolution``, ``fan_out`` and ``pruned`` come out of the attributes; self-loops are no edges.
    """
    r = load(spark, sf_dir, "relationships").where("src_id is not null and dst_id is not null and type is not null")
    r = r.select(
        clean_id("id").alias("id"), clean_type("type").alias("type"), clean_id("src_id").alias("src_id"), clean_id("dst_id").alias("dst_id"),
        "repo_id", "path", "start_line", "confidence", "attributes", "indexed_at", "received_at",
    ).where("src_id <> dst_id")
    kept = ("type", "src_id", "dst_id", "repo_id", "path", "start_line", "confidence", "attributes")
    newest = r.groupBy("id").agg(F.max_by(F.struct(*kept), F.struct("indexed_at", "received_at", "confidence")).alias("r"))
    attr = lambda key: F.get_json_object("r.attributes", f"$.{key}")
    return newest.select(
        "id",
        *(F.col(f"r.{c}").alias(c) for c in kept if c != "attributes"),
        attr("resolution").alias("resolution"),
        attr("fan_out").cast("int").alias("fan_out"),
        F.coalesce(attr("pruned") == "true", F.lit(False)).alias("pruned"),
    )
