"""Ranked search: symbol, keyword, BM25, vector, neighbourhood and change signals, fused by reciprocal rank.

A query is free text, given as a Python string; its tokens are constants in the plan. All signals
are tables (id, score or position); all but the neighbourhood end in a top-k, and none is collected.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import cosine
from ..operators.intervals import FILE, line_owners
from ..operators.metrics import lines
from ..session import cut_lineage
from ..tables import DEPENDENCY_TYPES, RESOLVED_LEVELS, SYMBOL_KINDS, clean_id

# Weights of the signals, the constant of reciprocal rank fusion, and BM25's parameters.
WEIGHTS = {"symbol": 1.4, "keyword": 1.0, "semantic": 1.0, "graph": 0.8, "proximity": 0.4, "churn": 0.3}
RRF_K = 60
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Kinds whose lines are chunks, and the signals that give seeds, each its first SEEDS, in the order of their say.
CHUNK_KINDS = ("function", "method", "class", "interface", "test", "legacy_program", "copybook", "jcl_job", "paragraph")
SEED_SIGNALS, SEEDS = ("symbol", "semantic", "keyword"), 5
CHUNK_ID = r"^chunk:([^:]+):(.*):(\d+)-(\d+)$"


def query_tokens(query: str) -> list[str]:
    """Distinct tokens of a query, in order, as ``tokenize`` makes them for stored text."""
    out: list[str] = []
    for t in re.findall(tx.TOKEN, query or ""):
        words = [w for w in re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", t.replace("_", " "))).lower().split() if w]
        out += [t.lower(), *(words if len(words) > 1 else [])]
    return list(dict.fromkeys(out))


def resolve_symbol(entities: DataFrame, query: str, limit: int = 25) -> DataFrame:
    """(id, name, kind, priority, rank): exact names first, then dotted suffixes, then names that contain the query.

    Within a priority, symbols come before other kinds, programs before their copybooks, shorter
    names before longer; ties go by id.
    """
    q = query.strip().lower()
    last = q.split(".")[-1]
    name, qname = F.lower("name"), F.lower("qualified_name")
    exact = (name == q) | (qname == q)
    suffix = F.lit("." in q) & ((name == last) | (qname == last)) & F.col("qualified_name").endswith("." + query.strip())
    fuzzy = name.contains(q) | qname.contains(q)
    priority = F.when(exact, 0).when(suffix, 1).when(fuzzy, 2)
    kind_rank = F.when(F.col("kind") == "copybook", 1).when(F.col("kind").isin(*SYMBOL_KINDS), 0).otherwise(2)
    order = ["priority", "tie", "id"]
    hits = entities.withColumn("priority", priority).where("priority is not null").withColumn("tie", kind_rank * 1000 + F.length("qualified_name"))
    top = hits.orderBy(*order).limit(limit) if q else hits.where("false")
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("id", "name", "kind", "priority", "rank")  # over at most `limit` rows


def postings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, tf, length): how often each term of two characters or more occurs in each text, and the text's terms in all."""
    terms = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9_]+)"), 1), lambda t: F.length(t) > 1)
    each = docs.select(key, terms.alias("terms")).withColumn("length", F.size("terms"))
    return each.select(key, "length", F.explode("terms").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


def _equals(word: str):
    return lambda t: t == F.lit(word)


def bm25(docs: DataFrame, key: str, text: Column, query: str, limit: int = 30) -> DataFrame:
    """(key, score): the best texts for the first twelve terms of the query, any of which may occur; ties go by key."""
    wanted = list(dict.fromkeys(t for t in re.findall(r"[a-z0-9_]+", query.lower()) if len(t) > 1))[:12]
    terms = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9_]+)"), 1), lambda t: F.length(t) > 1)
    each = docs.select(key, terms.alias("terms"))
    # One pass: the length, and the count of each wanted term; the terms themselves are never shuffled.
    counted = each.select(key, F.size("terms").alias("length"), *(F.size(F.filter("terms", _equals(w))).alias(f"tf{n}") for n, w in enumerate(wanted)))
    whole = counted.agg(F.count("*").alias("n"), F.avg("length").alias("average"), *(F.count_if(F.col(f"tf{n}") > 0).alias(f"df{n}") for n in range(len(wanted))))
    joined = counted.join(F.broadcast(whole))  # one row
    score = F.lit(0.0)
    for n in range(len(wanted)):
        idf = F.greatest(F.lit(IDF_FLOOR), F.log((F.col("n") - F.col(f"df{n}") + 0.5) / (F.col(f"df{n}") + 0.5)))
        tf = F.col(f"tf{n}").cast("double")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("average")))
    hit = F.lit(False)
    for n in range(len(wanted)):
        hit = hit | (F.col(f"tf{n}") > 0)
    return joined.where(hit).select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def keyword_overlap(entities: DataFrame, query: str, limit: int | None = 30) -> DataFrame:
    """(id, score): distinct query tokens among those of an entity's names and documentation, 2 more if its name is one; all without a limit."""
    wanted = F.array(*map(F.lit, query_tokens(query)))
    tokens = F.array_distinct(F.concat(tx.tokenize("name"), tx.tokenize("qualified_name"), tx.tokenize("docstring")))
    overlap = F.size(F.array_intersect(tokens, wanted))
    score = overlap + F.when(F.array_contains(wanted, F.lower("name")), 2).otherwise(0)
    found = entities.where(overlap > 0).select("id", score.cast("double").alias("score"))
    return found.orderBy(F.desc("score"), "id").limit(limit) if limit else found


def stored_chunks(vectors: DataFrame) -> DataFrame:
    """(chunk_id, repo_id, path, start_line, end_line, model, vector) of each chunk, its place as its id states it.

    The vector is null unless it has the stated length, no NaN and some length; of repeated rows the least usable one counts.
    """
    x = F.col("vector")
    usable = (F.size(x) == F.col("dim")) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v)) & F.exists(x, lambda v: v != 0)
    one = vectors.groupBy(F.trim("chunk_id").alias("chunk_id")).agg(F.min(F.when(usable, F.struct("model", "vector"))).alias("v"))
    part = lambda n: F.regexp_extract("chunk_id", CHUNK_ID, n)
    return one.where(F.col("chunk_id").rlike(CHUNK_ID)).select("chunk_id", clean_id(part(1)).alias("repo_id"), clean_id(part(2)).alias("path"), part(3).cast("int").alias("start_line"), part(4).cast("int").alias("end_line"), "v.model", "v.vector")


def chunk_texts(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(chunk_id, text): the chunks' lines in the newest content of their files, secrets masked; chunks of files that are not stored are left out."""
    newest = files.where("content is not null").groupBy(clean_id("repo_id").alias("repo_id"), clean_id("path").alias("path")).agg(F.max_by("content", "indexed_at").alias("content"))
    at = chunks.where("start_line > 0 and start_line <= end_line").select("chunk_id", *FILE, "start_line", "end_line")
    own = at.join(newest.select(*FILE, lines("content").alias("lines")), FILE)
    return own.select("chunk_id", tx.scrub_secrets(F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")).alias("text"))


def of_entities(hits: DataFrame, chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, chunk_id, score): some tens of scored chunks with the symbol that owns their first line; chunks between symbols are left out."""
    at = chunks.join(F.broadcast(hits), "chunk_id").select("chunk_id", "score", *FILE, F.col("start_line").alias("line"))
    at = cut_lineage(at)
    spans = entities.where(F.col("kind").isin(*CHUNK_KINDS) & F.col("start_line").isNotNull()).select(clean_id("repo_id").alias("repo_id"), clean_id("path").alias("path"), "start_line", "end_line", F.col("id").alias("span_id"))
    owners = line_owners(spans.join(F.broadcast(at.select(*FILE).distinct()), FILE, "left_semi"))
    return at.join(owners, [*FILE, "line"]).select(F.col("span_id").alias("id"), "chunk_id", "score")


def keyword_signal(entities: DataFrame, by_text: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """(id, score): the keyword overlap, and for each of an entity's chunks in ``by_text`` (id, score by BM25) twice its share of the best score."""
    best = F.broadcast(by_text.agg(F.max("score").alias("best")))  # one row
    body = by_text.join(best).select("id", F.when(F.col("best") > 0, 2 * F.col("score") / F.col("best")).otherwise(0.0).alias("score"))
    both = keyword_overlap(entities, query, None).unionByName(body)
    return both.groupBy("id").agg(F.round(F.sum("score"), 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def semantic_signal(entities: DataFrame, chunks: DataFrame, by_text: DataFrame, limit: int = 30) -> DataFrame:
    """(id, score): the owners of the chunks nearest to the stored vector of the best chunk in ``by_text`` (chunk_id, score) that has one, within its model.

    The models that made the vectors are not here, so the query itself has no vector. An entity has the score of its best chunk.
    """
    known = chunks.where("vector is not null")
    one = cut_lineage(known.join(F.broadcast(by_text), "chunk_id").orderBy(F.desc("score"), "chunk_id").limit(1).select("model", F.col("vector").alias("q")))
    near = nearest(known.join(F.broadcast(one.select("model")), "model", "left_semi"), "chunk_id", "vector", one.select("q"), limit)
    return of_entities(near, chunks, entities).groupBy("id").agg(F.max("score").alias("score"))


def nearest(vectors: DataFrame, key: str, vector: str, query: DataFrame, limit: int = 30) -> DataFrame:
    """(key, score): the rows most similar to the one vector of ``query`` (a table of one row, ``q``), by cosine; ties go by key."""
    one = F.broadcast(query.limit(1))
    scored = vectors.join(one).select(key, F.round(cosine(F.col(vector), F.col("q")), 6).alias("score"))
    return scored.where("score is not null").orderBy(F.desc("score"), key).limit(limit)


def nearest_each(vectors: DataFrame, key: str, vector: str, queries: DataFrame, limit: int = 30) -> DataFrame:
    """(query, key, score): for every query (a table of ``query`` and ``q``) the rows most similar to it, by cosine; ties go by key.

    Both tables meet block by block, and each block keeps no more than ``limit`` rows a query before any shuffle.
    """
    scored = vectors.select(key, vector).crossJoin(queries.select("query", "q").hint("shuffle_replicate_nl"))
    scored = scored.select("query", key, F.round(cosine(F.col(vector), F.col("q")), 6).alias("score")).where("score is not null")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))
    return scored.withColumn("place", place).where(F.col("place") <= limit).drop("place")


def ranked(signal: DataFrame, key: str, name: str) -> DataFrame:
    """(id, signal, position): a scored signal of at most some tens of rows as positions from 0."""
    return signal.select(F.col(key).alias("id"), F.lit(name).alias("signal"), (F.row_number().over(Window.orderBy(F.desc("score"), key)) - 1).alias("position"))


def placed(signal: DataFrame, name: str) -> DataFrame:
    """(id, signal, position): as ``ranked``, for a signal (id, score) of any size: sorted by ranges of score and id, each range numbered by itself."""
    numbered = signal.orderBy(F.desc("score"), "id").select("id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("n"))
    numbered = cut_lineage(numbered)
    sizes = numbered.groupBy("part").agg(F.count("*").alias("size"))  # one row a range
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return numbered.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").select("id", F.lit(name).alias("signal"), (F.col("before") + F.col("n")).alias("position"))


def fuse(signals: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """(id, score, signals): the sum of weight / (k + position + 1) over the signals an id is in; signals without weight count nothing."""
    weights = weights or WEIGHTS
    weight = F.create_map(*(x for n, w in weights.items() for x in (F.lit(n), F.lit(float(w)))))[F.col("signal")]
    scored = signals.withColumn("w", weight).where("w > 0")
    return scored.groupBy("id").agg(F.round(F.sum(F.col("w") / (k + F.col("position") + 1)), 8).alias("score"), F.array_sort(F.collect_set("signal")).alias("signals"))


def graph_signal(seeds: DataFrame, entities: DataFrame, rels: DataFrame, limit: int | None = 100) -> DataFrame:
    """(id, score): neighbours of the seeds (id, score) over dependencies and definitions; calls count only if resolved. The score is that of the best seed; without a limit all come, in no order."""
    steps = rels.where(F.col("type").isin(*DEPENDENCY_TYPES, "defines")).where("type <> 'calls' or coalesce(resolution in ({}), false)".format(", ".join(f"'{r}'" for r in RESOLVED_LEVELS)))
    both = steps.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b")).unionByName(steps.select(F.col("dst_id").alias("a"), F.col("src_id").alias("b")))
    hop = both.join(F.broadcast(seeds.select(F.col("id").alias("a"), "score")), "a").groupBy(F.col("b").alias("id")).agg(F.max("score").alias("score"))  # seeds: a few rows
    known = entities.select("id").where("not missing")
    found = hop.join(known, "id", "left_semi")
    return found.orderBy(F.desc("score"), "id").limit(limit) if limit else found


def proximity_signal(seeds: DataFrame, entities: DataFrame, limit: int = 30) -> DataFrame:
    """(id, score): other symbols in the files of the seeds."""
    few = F.broadcast(seeds.select("id"))
    paths = F.broadcast(entities.join(few, "id").where("path is not null and path <> ''").select("repo_id", "path").distinct())  # no more rows than seeds
    near = entities.where(F.col("kind").isin(*SYMBOL_KINDS) & ~F.col("missing")).join(paths, ["repo_id", "path"], "left_semi").join(few, "id", "left_anti")
    return near.select("id", F.lit(1.0).alias("score")).orderBy("id").limit(limit)


def churn_boost(fused: DataFrame, entities: DataFrame, churn: DataFrame, weight: float = WEIGHTS["churn"], k: int = RRF_K) -> DataFrame:
    """``fused`` with weight * min(1, commits / 10) / k added for the changes of each id's file."""
    paths = fused.join(entities.select("id", "repo_id", "path"), "id", "left").join(churn.select("repo_id", "path", "commits"), ["repo_id", "path"], "left")
    boost = weight * F.least(F.lit(1.0), F.coalesce("commits", F.lit(0)) / 10) / k
    return paths.select("id", F.round(F.col("score") + boost, 8).alias("score"), "signals")


def seeds_of(signals: DataFrame) -> DataFrame:
    """(id, score): the first SEEDS of each seed-giving signal (id, signal, position), in the order of the signals, each id once."""
    first = F.array_position(F.array(*map(F.lit, SEED_SIGNALS)), F.col("signal")) - 1
    few = signals.where((F.col("position") < SEEDS) & F.col("signal").isin(*SEED_SIGNALS))
    return few.groupBy("id").agg((-F.min(first * SEEDS + F.col("position"))).cast("double").alias("score"))


def hybrid(entities: DataFrame, rels: DataFrame, churn: DataFrame, vectors: DataFrame, files: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(id, name, kind, score, signals, confidence): the fused search over symbol, keyword, semantic, graph and proximity signals, boosted by churn; stubs are left out.

    Prose weighs keywords less, and vectors more, than a query that looks like an identifier.
    """
    chunks = stored_chunks(vectors)
    by_text = cut_lineage(bm25(chunk_texts(chunks, files), "chunk_id", F.col("text"), query, 30))
    symbol = resolve_symbol(entities, query, 20).select("id", (-F.col("rank")).cast("double").alias("score"))
    keyword = keyword_signal(entities, of_entities(by_text, chunks, entities).select("id", "score"), query)
    semantic = semantic_signal(entities, chunks, by_text)
    first = cut_lineage(ranked(symbol, "id", "symbol").unionByName(ranked(keyword, "id", "keyword")).unionByName(ranked(semantic, "id", "semantic")))
    seeds = seeds_of(first)
    signals = first.unionByName(placed(graph_signal(seeds, entities, rels, None), "graph")).unionByName(ranked(proximity_signal(seeds, entities), "id", "proximity"))
    weights = dict(WEIGHTS)
    if not re.search(tx.IDENTIFIER_HINT, query):
        weights |= {"keyword": WEIGHTS["keyword"] * 0.8, "semantic": WEIGHTS["semantic"] * 1.3}
    boosted = churn_boost(fuse(signals, weights), entities, churn)
    named = boosted.join(entities.where("not missing").select("id", "name", "kind"), "id")
    confidence = F.least(F.lit(0.99), F.round(0.5 + 0.12 * F.size("signals"), 2))
    return named.select("id", "name", "kind", "score", F.array_join("signals", ",").alias("signals"), confidence.alias("confidence")).orderBy(F.desc("score"), "id").limit(limit)
