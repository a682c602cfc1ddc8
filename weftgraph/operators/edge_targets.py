"""Edges and distinct sources of every (type, target), whatever the skew of the targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import clean_id, clean_type, fingerprint
from .skew import count_by_key

#: Parts type and dst_id in a joint key; ids cannot hold it once they are cleaned.
SEP = "\x1f"


def target_counts(relationships: DataFrame) -> DataFrame:
    """(type, dst_id, n_edges, n_sources, heavy) of every target in canonical spelling.

    Rows with a null type or a null dst_id have no key. Repeated rows (same id) count once; a null
    id or a null src_id is no edge and no source, so a key whose ids are all null has 0 edges. Extra
    columns are ignored. An empty table gives no rows.
    """
    edges = relationships.select(
        F.concat(clean_type("type"), F.lit(SEP), clean_id("dst_id")).alias("target"),
        *fingerprint(clean_id("id"), "e"),
        *fingerprint(clean_id("src_id"), "s"),
    )
    counted = count_by_key(edges, "target", {"n_edges": ["e1", "e2"], "n_sources": ["s1", "s2"]})
    parts = F.split("target", SEP, 2)
    return counted.select(parts[0].alias("type"), parts[1].alias("dst_id"), "n_edges", "n_sources", "heavy")


def crowded_targets(relationships: DataFrame, share: float = 0.02) -> DataFrame:
    """(type, dst_id) of the targets that hold at least ``share`` of all distinct edge ids."""
    total = relationships.select(*fingerprint(clean_id("id"), "e")).where("e1 is not null").distinct().agg(F.count("*").alias("total"))
    counts = target_counts(relationships)
    return counts.join(F.broadcast(total), F.col("n_edges") >= F.col("total") * share).where("n_edges > 0").select("type", "dst_id")  # total: one row
