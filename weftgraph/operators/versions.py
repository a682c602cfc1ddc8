"""Deletes, versions and snapshots of stored tables, as DataFrames; writing the result back is the caller's ``write``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_keys(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` without the rows of the keys in ``gone``; null keys are never deleted."""
    return stored.join(gone.select(*keys).distinct(), keys, "left_anti")


def without_repository(tables: dict[str, DataFrame], repo_id: str | None, kept: tuple[str, ...] = ("commits", "churn")) -> dict[str, DataFrame]:
    """Every table without the rows of one repository, or of all for None; ``kept`` tables stay as they are. To be written by dynamic partition overwrite of repo_id."""
    drop = lambda t: t.where("false") if repo_id is None else t.where(F.coalesce(F.col("repo_id") != repo_id, F.lit(True)))
    return {name: t if name in kept else drop(t) for name, t in tables.items()}


def refreshed_postings(postings: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Postings (key, term, tf, length) in which those of the keys in ``fresh`` are replaced; a key of a text without terms is in ``fresh`` with a null term and loses its postings."""
    return without_keys(postings, fresh, [key]).unionByName(fresh.where("term is not null"))


def next_version(versions: DataFrame, name: str, content: DataFrame) -> DataFrame:
    """(name, version, content) rows to append: ``content`` (one column) as the version after the last of ``name``, the first being 1."""
    last = versions.where(F.col("name") == name).agg(F.coalesce(F.max("version"), F.lit(0)).alias("last"))  # one row
    return content.join(F.broadcast(last)).select(F.lit(name).alias("name"), (F.col("last") + 1).alias("version"), "content")


def current(versions: DataFrame) -> DataFrame:
    """The rows of the last version of each name."""
    last = versions.groupBy("name").agg(F.max("version").alias("version"))
    return versions.join(last, ["name", "version"])


def within_budget(requests: DataFrame, group: str, order: list[str], budget: int) -> DataFrame:
    """The first ``budget`` requests of each group in that order, of the rest none: what an oracle may be asked."""
    from pyspark.sql import Window

    return requests.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= budget).drop("_n")
