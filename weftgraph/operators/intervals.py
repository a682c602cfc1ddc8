"""Joins on positions: the nearest start before a line, a band of lines, the innermost range.

All have an equality on the file, so that Spark partitions by it; a file is never spread over
tasks and never larger than what one file can hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILE = ["repo_id", "path"]


def enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """As-of join: each point (repo_id, path, line, point_id) with the span (repo_id, path, start_line, span_id) that starts last at or before its line.

    Both streams are merged in the order of their lines, so the cost is that of one sort. Of spans
    with the same start the greatest id counts. Points without a span before them have a null
    span_id; null lines come before all spans.
    """
    p = points.select(*FILE, F.col("line").alias("at"), F.lit(1).alias("kind"), "point_id", F.lit(None).cast("string").alias("span_id"))
    s = spans.where("start_line is not null").select(*FILE, F.col("start_line").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("point_id"), "span_id")
    order = Window.partitionBy(*FILE).orderBy(F.col("at").asc_nulls_first(), "kind", F.col("span_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = p.unionByName(s).withColumn("found", F.last("span_id", ignorenulls=True).over(order))
    return merged.where("kind = 1").select(*FILE, F.col("at").alias("line"), "point_id", F.col("found").alias("span_id"))


def band(points: DataFrame, spans: DataFrame, width: int = 1) -> DataFrame:
    """Each point with the spans of its file whose start is at most ``width`` lines away: (repo_id, path, line, point_id, span_id, distance).

    The points are repeated for each line of the band, which makes it an equality join.
    """
    near = points.withColumn("start_line", F.explode(F.sequence(F.col("line") - width, F.col("line") + width))).where("line is not null")
    return near.join(spans.select(*FILE, "start_line", "span_id"), [*FILE, "start_line"]).select(*FILE, "line", "point_id", "span_id", F.abs(F.col("line") - F.col("start_line")).alias("distance"))


def innermost(points: DataFrame, spans: DataFrame, keep_line: bool = False) -> DataFrame:
    """Each point with the narrowest span of its file that covers its line, ties to the later start, then the least id: (repo_id, path, point_id, span_id). Uncovered points are left out.

    Each line has one owner, so points and spans of a file meet by line and never all with all.
    """
    owners = line_owners(spans.join(points.select(*FILE).distinct(), FILE, "left_semi"))
    return points.select(*FILE, "line", "point_id").join(owners, [*FILE, "line"]).select(*FILE, *(["line"] if keep_line else []), "point_id", "span_id")


def line_owners(spans: DataFrame) -> DataFrame:
    """(repo_id, path, line, span_id): every covered line of a file with the smallest span that covers it, ties to the later start, then the least id."""
    lines = spans.where("start_line <= end_line").select(*FILE, "span_id", "start_line", "end_line", F.explode(F.sequence("start_line", "end_line")).alias("line"))
    best = F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("w"), (-F.col("start_line")).alias("s"), "span_id")).alias("b")
    return lines.groupBy(*FILE, "line").agg(best).select(*FILE, "line", F.col("b.span_id").alias("span_id"))


def runs(owners: DataFrame) -> DataFrame:
    """(repo_id, path, span_id, first_line, last_line): maximal runs of lines with the same owner."""
    island = F.col("line") - F.row_number().over(Window.partitionBy(*FILE, "span_id").orderBy("line"))
    return owners.withColumn("island", island).groupBy(*FILE, "span_id", "island").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line")).drop("island")


def line_windows(runs: DataFrame, size: int = 60, overlap: int = 10) -> DataFrame:
    """(…, start_line, end_line): runs cut into windows of ``size`` lines that overlap; the last one ends with the run."""
    step = size - overlap
    last = F.greatest(F.col("first_line"), F.col("last_line") - overlap)
    starts = F.when(F.col("last_line") - F.col("first_line") + 1 <= size, F.array("first_line")).otherwise(F.sequence(F.col("first_line"), last, F.lit(step)))
    return runs.withColumn("start_line", F.explode(starts)).withColumn("end_line", F.least(F.col("start_line") + size - 1, F.col("last_line")))
