"""Drawing documents so that every source has its target share of all tokens.

Each source is put in a random order by a hash; prefix sums of its token counts, taken over ranges
of the hash, then over ranges of the one range that holds the cut, and so on, say which documents
are drawn once more than the whole epochs. No source is ever sorted or summed in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .abuse import canonical_source

#: Bits of the hash that tell the ranges of one level apart, and levels of ranges within the range that holds the cut.
#: What is broadcast is a row for each range, 2^RANGE_BITS a target; a last range holds one in 2^(RANGE_BITS * LEVELS) of a source.
RANGE_BITS, LEVELS = 12, 3


#: A total to ask for: the largest that can be mixed without missing a share.
FEASIBLE = "feasible"


def _targets(targets: DataFrame) -> DataFrame:
    rows = targets.where("source is not null and target_share > 0 and max_repeats > 0")
    return rows.groupBy(canonical_source("source").alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def _texts(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One document, the one with the least id, for each text of a source that has a target, so that repeats count by text."""
    known = sizes.where("n_tokens > 0").withColumn("source", canonical_source("source")).join(F.broadcast(targets), "source", "left_semi")
    one = known.groupBy("t1", "t2").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("d"))
    return one.select("d.doc_id", "d.source", "d.n_tokens", F.xxhash64(F.lit(11), "d.doc_id").alias("key"))


def _budgets(texts: DataFrame, targets: DataFrame, total: int | str | None) -> DataFrame:
    """(source, target_share, max_repeats, available, budget, epochs, rest): ``rest`` tokens beyond the whole epochs; a row for each target."""
    available = texts.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    b = targets.join(F.broadcast(available), "source", "left").fillna(0, ["available"])
    whole = Window.partitionBy()  # a row for each target
    if total == FEASIBLE:
        can = F.when(F.col("available") > 0, F.ceil(F.col("available") * F.col("max_repeats") / F.col("target_share")))
        everything = F.coalesce(F.min(can).over(whole), F.lit(0))
    else:
        everything = F.lit(total) if total is not None else F.sum("available").over(whole)
    b = b.withColumn("budget", F.floor(F.col("target_share") * everything).cast("long"))
    b = b.withColumn("epochs", F.when(F.col("available") > 0, F.least(F.expr("budget div available"), F.col("max_repeats").cast("long"))).otherwise(F.lit(0).cast("long")))
    return b.withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("available")).otherwise(F.lit(0)))


def mixture(sizes: DataFrame, targets: DataFrame, total: int | str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, copies): the documents that are drawn, and how often.

    ``total`` is the size of the mixture in tokens; by default that of one copy of every text of the
    sources that have a target. FEASIBLE is the largest that every source with any text can meet its
    share of, so that the shares of those sources are to each other as their targets. A source gives ``target_share * total`` tokens, or all that its
    ``max_repeats`` allow; it stays under its budget by less than one document. Texts of equal
    content count as one, whose least doc_id stands for all. Sources are compared in canonical
    spelling; documents without a source or a target are not drawn, nor those without tokens. Of
    targets given twice the larger holds. Empty tables give no rows.
    """
    return _draw(sizes, _targets(targets), total)[0]


def _draw(sizes: DataFrame, targets: DataFrame, total: int | str | None) -> tuple[DataFrame, DataFrame]:
    texts = _texts(sizes, targets)
    budgets = _budgets(texts, targets, total)
    # ``before``: tokens of the source in all ranges ahead of the ones that are looked at.
    open_ = texts.join(F.broadcast(budgets.select("source", "epochs", "rest")), "source").withColumn("before", F.lit(0).cast("long"))
    columns, drawn = ["doc_id", "source", "n_tokens", "key", "epochs", "rest", "before"], []
    for level in range(LEVELS):
        ranged = open_.withColumn("range", F.shiftrightunsigned("key", 64 - RANGE_BITS * (level + 1)).bitwiseAND((1 << RANGE_BITS) - 1))
        order = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = ranged.groupBy("source", "range").agg(F.sum("n_tokens").alias("n")).select("source", "range", "n", F.sum("n").over(order).alias("upto"))
        placed = ranged.join(F.broadcast(sums), ["source", "range"])  # at most 2^RANGE_BITS rows a target
        upto = F.col("before") + F.col("upto")
        cut = (upto > F.col("rest")) & (upto - F.col("n") < F.col("rest"))
        drawn.append(placed.where(~cut).withColumn("fits", upto <= F.col("rest")).select(*columns, "fits"))
        open_ = placed.where(cut).withColumn("before", upto - F.col("n")).select(*columns, "range")
    inside = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one last range of each source
    drawn.append(open_.withColumn("fits", F.col("before") + F.sum("n_tokens").over(inside) <= F.col("rest")).select(*columns, "fits"))
    copies = (F.col("epochs") + F.col("fits").cast("long")).alias("copies")
    return reduce(DataFrame.unionByName, drawn).select("doc_id", "source", "n_tokens", copies).where("copies > 0"), budgets


def shares(sizes: DataFrame, targets: DataFrame, total: int | str | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available_tokens, drawn_documents, drawn_tokens, reached_share) of every target, those without documents too."""
    drawn, budgets = _draw(sizes, _targets(targets), total)
    by = drawn.groupBy("source").agg(F.count("*").alias("drawn_documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("drawn_tokens"))
    r = budgets.select("source", "target_share", "max_repeats", F.col("available").alias("available_tokens")).join(F.broadcast(by), "source", "left")  # a row for each target
    r = r.fillna(0, ["drawn_documents", "drawn_tokens"])
    everything = F.sum("drawn_tokens").over(Window.partitionBy())
    return r.withColumn("reached_share", F.when(everything > 0, F.col("drawn_tokens") / everything).otherwise(F.lit(0.0)))
