"""Commits of a repository, from the text of its log, which Spark parses."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Between fields and between commits of the log.
FIELD, RECORD = "\x1f", "\x1e"


def log_text(root: str, limit: int = 400) -> str:
    """The last ``limit`` commits without merges, with the paths that each touched; empty where there is no repository."""
    command = ["git", "-C", root, "log", f"-n{limit}", "--no-merges", "--name-only", f"--pretty=format:{RECORD}%H{FIELD}%an{FIELD}%ae{FIELD}%aI{FIELD}%s{FIELD}"]
    try:
        return subprocess.run(command, capture_output=True, text=True, errors="replace", timeout=60, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        return ""


def commits(spark: SparkSession, logs: DataFrame) -> DataFrame:
    """(repo_id, sha, author_name, author_email, ts, message, files) of logs (repo_id, log); records without all fields are left out."""
    record = logs.select("repo_id", F.explode(F.split("log", RECORD)).alias("record")).select("repo_id", F.split("record", FIELD).alias("f")).where(F.size("f") == 6)
    files = F.filter(F.transform(F.split(F.col("f")[5], r"\r?\n"), F.trim), lambda p: p != "")
    names = ("sha", "author_name", "author_email", "ts", "message")
    return record.select("repo_id", *(F.col("f")[n].alias(c) for n, c in enumerate(names)), files.alias("files")).withColumn("ts", F.try_to_timestamp("ts"))


def churn(commits: DataFrame) -> DataFrame:
    """(repo_id, path, commits, authors, last_ts) of every path that commits touch; authors are distinct, sorted addresses."""
    each = commits.select("repo_id", "sha", "author_email", "ts", F.explode(F.array_distinct("files")).alias("path")).dropDuplicates(["repo_id", "sha", "path"])
    return each.groupBy("repo_id", "path").agg(F.count("*").alias("commits"), F.array_sort(F.collect_set("author_email")).alias("authors"), F.max("ts").alias("last_ts"))
