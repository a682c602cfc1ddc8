"""Chunks of source text by the symbol that owns their lines, and their hash embeddings."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..tables import clean_id
from .intervals import FILE, line_owners, line_windows, runs
from .metrics import language_of, lines

#: Kinds whose lines are chunks of their own; windows of the lines between them, and of symbols longer than LONG lines (fixed values).
CHUNK_KINDS = ("function", "method", "class", "interface", "test", "legacy_program", "copybook", "jcl_job", "paragraph")
WINDOW, LONG, OVERLAP = 60, 200, 10


def build_chunks(files: DataFrame, entities: DataFrame) -> DataFrame:
    """(chunk_id, repo_id, path, span_id, start_line, end_line, text, tokens) of every file but configuration, whose values are never kept.

    Each line belongs to the smallest symbol around it; a run of lines of one symbol is a chunk, of
    up to LONG lines, else windows of LONG lines; lines of no symbol come in windows of WINDOW lines,
    blank ones left out. Windows overlap by OVERLAP lines. The newest content of a path counts;
    secrets are masked; span_id is null between symbols. ``tokens`` are the first 256 distinct ones.
    """
    path = clean_id("path")
    own = files.where("content is not null").select(clean_id("repo_id").alias("repo_id"), path.alias("path"), "content", "indexed_at").where(F.coalesce(language_of("path") != "config", F.lit(True)))
    newest = own.groupBy(*FILE).agg(F.max_by("content", "indexed_at").alias("content"))
    texts = newest.select(*FILE, lines("content").alias("lines"))
    spans = entities.where(F.col("kind").isin(*CHUNK_KINDS) & F.col("start_line").isNotNull() & F.col("end_line").isNotNull() & ~F.col("missing"))
    spans = spans.select(clean_id("repo_id").alias("repo_id"), clean_id("path").alias("path"), F.greatest(F.lit(1), F.col("start_line")).alias("start_line"), "end_line", F.col("id").alias("span_id"))
    # Only the lengths of files are shuffled to clip the spans; their texts meet no more than the finished windows.
    sizes = texts.select(*FILE, F.size("lines").alias("n"))
    owned = line_owners(spans.join(sizes, FILE).withColumn("end_line", F.least("end_line", "n")).drop("n"))
    every = sizes.select(*FILE, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("line"))
    placed = runs(every.join(owned, [*FILE, "line"], "left").withColumn("span_id", F.coalesce("span_id", F.lit(""))))
    gap = F.col("span_id") == ""
    windows = line_windows(placed.where(gap), WINDOW, OVERLAP).unionByName(line_windows(placed.where(~gap), LONG, OVERLAP))
    cut = windows.join(texts, FILE).withColumn("text", F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n"))
    kept = cut.where(~gap | F.col("text").rlike(r"\S")).withColumn("text", tx.scrub_secrets("text"))
    place = F.concat(F.lit("chunk:"), "repo_id", F.lit(":"), "path", F.lit(":"), "start_line", F.lit("-"), "end_line")
    return kept.select(place.alias("chunk_id"), *FILE, F.nullif("span_id", F.lit("")).alias("span_id"), "start_line", "end_line", "text", tx.chunk_tokens("text").alias("tokens"))


def hash_embedding(tokens: Column | str, dim: int = 64) -> Column:
    """The sum of a signed unit vector for each token, by its 64-bit hash, scaled to length 1; all zeros without tokens."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        out, known = [], {}
        for words in texts:
            v = np.zeros(dim)
            for t in words if words is not None else ():
                if t not in known:
                    known[t] = int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
                v[known[t] % dim] += 1.0 if known[t] >> 63 else -1.0
            length = np.linalg.norm(v)
            out.append((v / length if length else v).astype(np.float32))
        return pd.Series(out, dtype=object)

    return embed(tokens)


def embed_chunks(chunks: DataFrame, dim: int = 64) -> DataFrame:
    """(chunk_id, repo_id, dim, vector, model) of chunks, by the tokens of their text."""
    return chunks.select("chunk_id", "repo_id", F.lit(dim).alias("dim"), hash_embedding(tx.tokenize("text"), dim).alias("vector"), F.lit(f"hash-{dim}").alias("model"))


def semantic_hits(chunks: DataFrame, query: str, limit: int = 30, dim: int = 64) -> DataFrame:
    """(span_id, score): the symbols whose chunks are nearest to the query's own embedding, by their best chunk; chunks between symbols are left out."""
    own = embed_chunks(chunks, dim).join(chunks.where("span_id is not null").select("chunk_id", "span_id"), "chunk_id")
    asked = chunks.sparkSession.createDataFrame([(query,)], "text string").select(hash_embedding(tx.tokenize("text"), dim).alias("q"))  # one row
    score = F.aggregate(F.zip_with("vector", "q", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)  # both have length 1
    near = own.join(F.broadcast(asked)).select("span_id", "chunk_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(limit)
    return near.groupBy("span_id").agg(F.max("score").alias("score"))
