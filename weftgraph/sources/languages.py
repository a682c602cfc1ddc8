"""The language of a file: by its content where that speaks clearly, else by its suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import language_of
from ..tables import clean_id

# Patterns in the first 8192 characters of a file that speak for a language, with their weights.
SIGNATURES: dict[str, list[tuple[str, int]]] = {
    "cobol": [
        (r"(?im)^[\s\d]*IDENTIFICATION\s+DIVISION", 5), (r"(?im)^[\s\d]*PROGRAM-ID\b", 4), (r"(?im)^[\s\d]*(ENVIRONMENT|DATA|PROCEDURE)\s+DIVISION", 4),
        (r"(?im)^[\s\d]*WORKING-STORAGE\s+SECTION", 3), (r"(?i)\bPIC(TURE)?\s+[X9SVAZ()]+", 2), (r"(?im)^[\s\d]*\d{2}\s+[A-Z0-9-]+.*\b(PIC|OCCURS|VALUE|REDEFINES)\b", 2),
        (r"(?im)^[\s\d]*(PERFORM|COMPUTE|EVALUATE|MOVE)\b", 1), (r"(?i)\bEXEC\s+(CICS|SQL)\b", 2), (r"(?im)^[\s\d]*COPY\s+[A-Z0-9-]+", 2),
    ],
    "jcl": [(r"(?m)^//\S*\s+JOB\b", 5), (r"(?m)^//\S*\s+EXEC\s+(PGM=|PROC=|\S)", 4), (r"(?m)^//\S+\s+DD\b", 3), (r"(?m)^//\S+\s+(PROC|PEND)\b", 3), (r"(?m)^//\*", 1), (r"(?m)^/\*", 1)],
    "hlasm": [
        (r"(?m)^\S+\s+(CSECT|DSECT|RSECT|START)\b", 5), (r"(?m)^\S*\s+(DC|DS)\s+[FHCXPZAVBTDE]", 3), (r"(?m)^\s+(USING|DROP|BALR|BASR|STM|LM|LTORG)\b", 2),
        (r"(?m)^\S+\s+EQU\b", 2), (r"(?m)^\s+(END|SVC|BR)\b", 1),
    ],
    "bms": [(r"\bDFHMSD\b", 5), (r"\bDFHMDI\b", 4), (r"\bDFHMDF\b", 4)],
    "csd": [(r"(?im)^\s*DEFINE\s+", 3), (r"(?i)\bGROUP\(", 3), (r"(?i)\b(PROGRAM|TRANSACTION|MAPSET|TDQUEUE|FILE)\(", 2)],
    "python": [
        (r"(?m)^#!.*\bpython", 4), (r"(?m)^\s*(def|class)\s+\w+", 3), (r"(?m)^\s*(import\s+\w|from\s+[\w.]+\s+import)\b", 3),
        (r"""if\s+__name__\s*==\s*['"]__main__['"]""", 3), (r"(?m)^\s*@\w[\w.]*\s*$", 1),
    ],
    "javascript": [
        (r"(?m)^\s*import\s+.*\bfrom\b", 3), (r"(?m)^\s*export\s+(default\s+|const\s+|function\b|class\b)", 3), (r"(?m)\b(const|let)\s+\w+\s*=", 2),
        (r"(?m)\b(function\s+\w+|require\s*\()", 2), (r"(?m)\b(interface|type)\s+\w+\s*[={]", 2), (r"=>", 1),
    ],
}
HEAD = 8192
LEAST_TOTAL, LEAST_MATCHED = 4, 2


def language(path: Column, content: Column) -> Column:
    """A language needs a total weight of 4 from 2 patterns; the suffix wins if its own weight is at most one less than the best. Ties go to the earlier language."""
    head = F.substring(F.coalesce(content, F.lit("")), 1, HEAD)
    by_suffix = language_of(path)
    scores = []
    for n, (name, patterns) in enumerate(SIGNATURES.items()):
        hits = [head.rlike(p) for p, _ in patterns]
        total = sum((F.when(h, w).otherwise(0) for h, (_, w) in zip(hits, patterns)), F.lit(0))
        matched = sum((h.cast("int") for h in hits), F.lit(0))
        scores.append(F.struct(total.alias("total"), F.lit(-n).alias("order"), F.lit(name).alias("name"), matched.alias("matched")))
    every = F.array(*scores)
    best = F.array_max(every)
    own = F.coalesce(F.array_max(F.transform(F.filter(every, lambda s: s["name"] == by_suffix), lambda s: s["total"])), F.lit(0))
    sure = (best["total"] >= LEAST_TOTAL) & (best["matched"] >= LEAST_MATCHED)
    return F.when(sure & (own > 0) & (own >= best["total"] - 1), by_suffix).when(sure, best["name"]).otherwise(by_suffix)


def classify(files: DataFrame) -> DataFrame:
    """(repo_id, path, language) of every stored path by its newest content; null for files of no known language."""
    newest = files.select(clean_id("repo_id").alias("repo_id"), clean_id("path").alias("path"), "indexed_at", F.substring("content", 1, HEAD).alias("head"))
    newest = newest.groupBy("repo_id", "path").agg(F.max_by("head", "indexed_at").alias("head"))
    return newest.select("repo_id", "path", language(F.col("path"), F.col("head")).alias("language"))
