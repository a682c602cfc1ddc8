"""Abusive, hateful or sexual content: a character n-gram linear classifier with naive Bayes scaled features.

A document is abusive if one sentence of it is, so sentences are what is learned and scored; a
document has the score of its worst. Reviewers labelled whole documents, some wrongly, so in each
round only those sentences of a positive document are taken as positive which a model that never
saw them finds so; the bound between the two is set on the held-out scores of the labelled
documents. Training runs over a bounded sample of labelled documents, as Spark jobs over sparse
vectors; scoring is one Arrow pass over all documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import ElementwiseProduct
from pyspark.ml.linalg import DenseVector, VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from ..tables import clean_id
from .abuse_seeds import labelled

#: Labelled documents, chosen by hash, and sentences of documents without abuse, the frequent ones first, that are trained on at most.
MAX_DOCUMENTS = 20_000
MAX_NEGATIVES = 100_000
BUCKETS = 1 << 20
#: Sentences in which an n-gram occurs that is worth a weight of its own.
COMMON = 5
GRAMS = (3, 4, 5)
#: Strength of the prior of the log-count ratios, in sentences.
PRIOR = 5.0
#: Rounds of training, and parts of the sentences, each of which is scored by a model that did not see it.
ROUNDS = 2
FOLDS = 3
REGULARISATION = 2e-5
#: Least and greatest share of the positives in the weight of all sentences; in between it is their share in number. Low, as some of them are wrong.
POSITIVE_SHARE = (0.04, 0.3)
#: Documents that the examples of the seed text count as, all together, where the bound is set.
SEED_DOCUMENTS = 50
ITERATIONS = 12

# Letters of other scripts that look like Latin ones, and signs that stand for letters inside words.
_LOOKALIKES = str.maketrans("аеорсухіјѕԁһкмтвнԛԝɡцαορεικντυχβν", "aeopcyxijsdhkmtbhqwguaopeikvtuxbv")
_SIGNS = str.maketrans("013457$@!|€", "oieastsaile")
_INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_SPACED_HINT = re.compile(r"[ .\-_*]\w[ .\-_*]\w[ .\-_*]\w")
_SPACED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?![^\W\d_])")
# The sign comes first in each pattern, so that the search skips what is none; what stands before it is looked up afterwards.
_SIGN_IN_WORD = re.compile(r"[013457$@!|€](?:(?<=[a-z].)[013457$@!|€]*(?=[a-z])|(?<=\$)(?<!\w.)(?=[a-z]{2})|(?<=[$@])(?<=[a-z].)[$@]*(?!\w))")
_DIGITS = str.maketrans("123456789", "000000000")
# A line break within a sentence: after a long line, before a small letter.
_WRAPPED = re.compile(r"\n(?<=[^\n]{40}\n)(?<![.!?:;,{}()\[\]`\s]\n)[ \t]*(?=[^\W\d_A-ZÀ-ÖØ-Þ])")
_SENTENCE_END = re.compile(r"[.!?…:][\"'»”)]*\s+|[\n  \"“”«»]+")


def plain(text: str) -> str:
    """``text`` in lower case with disguises taken off: invisible and look-alike letters, signs for letters, spaced-out words, long repeats."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).lower().translate(_LOOKALIKES)
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    text = text.lower()
    if _SPACED_HINT.search(f" {text}"):
        text = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m[0]), text)
    text = _SIGN_IN_WORD.sub(lambda m: m[0].translate(_SIGNS), text)
    for c in "abcdefghijklmnopqrstuvwxyz":
        if c * 3 in text:
            text = re.sub(c + "{3,}", c, text)
    text = text.translate(_DIGITS)
    while "00" in text:
        text = text.replace("00", "0")
    return text


def sentences(text: str) -> list[str]:
    """The sentences of a text in plain spelling that have a letter or sign; a line wrapped within a sentence is joined, quoted text stands by itself."""
    text = _WRAPPED.sub(" ", text.replace("\r\n", "\n").replace("\r", "\n"))
    found = (" ".join(s.split()) for s in _SENTENCE_END.split(plain(text)))
    return [s for s in found if s] or [s for s in [" ".join(text.split())] if s]


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each length of n-grams: the bucket of the n-gram at every character of all texts, padded with a blank, and whether it lies in one text."""
    joined = " " + "  ".join(texts) + " "
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ends = np.cumsum([len(t) + 2 for t in texts])
    h = chars
    for n in range(2, max(GRAMS) + 1):
        h = (h[:-1] * np.uint64(1_000_003)) ^ chars[n - 1 :]
        if n in GRAMS:
            x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            inside = np.ones(len(x), bool)
            for k in range(1, n):
                at = ends[:-1] - k
                inside[at[at < len(x)]] = False
            yield ((x ^ (x >> np.uint64(32))) & np.uint64(BUCKETS - 1)).astype(np.int64), inside


@dataclass
class Model:
    """Weights of the known buckets, which stand in order, and the constant; a score over 0 means abuse."""

    known: np.ndarray
    weights: np.ndarray
    constant: float

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        table = np.zeros(BUCKETS, np.float32)
        table[self.known] = self.weights
        lengths = np.array([len(t) + 2 for t in texts])
        total = np.zeros(lengths.sum(), np.float32)
        for bucket, inside in grams(texts):
            w = table[bucket]
            w[~inside] = 0
            total[: len(w)] += w
        n = sum(np.maximum(lengths - g + 1, 0) for g in GRAMS)
        return np.add.reduceat(total, np.cumsum(lengths) - lengths) / np.sqrt(np.maximum(n, 1)) + self.constant


def _labelled_sentences(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, positive, sentence) of the labelled documents; documents whose reviewers are even have none."""
    votes = labels.where("abusive is not null and doc_id is not null").select("doc_id", "abusive", "reviewer").distinct()
    votes = votes.groupBy("doc_id").agg(F.avg("abusive").alias("share")).where("share <> 0.5")
    votes = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_DOCUMENTS)
    # The labelled documents are at most MAX_DOCUMENTS ids.
    texts = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(votes), "doc_id").select("doc_id", (F.col("share") > 0.5).alias("positive"), "text")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, bool(p), s) for d, t, p in zip(b["doc_id"], b["text"], b["positive"]) for s in dict.fromkeys(sentences(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "positive", "sentence"])

    return texts.mapInPandas(split, "doc_id long, positive boolean, sentence string").distinct()


def _known(used: DataFrame) -> np.ndarray:
    """The buckets, in order, that occur in two or more of the sentences that may hold abuse, or in COMMON of all that are trained on."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for may, rows in b.groupby("may"):
                bucket, n = np.unique(_keys(list(rows["sentence"]))[0] % BUCKETS, return_counts=True)
                yield pd.DataFrame({"bucket": bucket.astype(np.int32), "n": n, "may": may})

    counts = used.select("sentence", F.expr("own or seed = 1").alias("may")).mapInPandas(count, "bucket int, n long, may boolean")
    counts = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("may"), F.col("n"))).alias("n_may"))
    return np.sort(counts.where(f"n_may >= 2 or n >= {COMMON}").select("bucket").toPandas()["bucket"].to_numpy(np.int32))  # at most BUCKETS rows


def _keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number * BUCKETS + bucket, sorted; occurrences) of the n-grams of all texts."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    return np.unique(np.concatenate([owner[: len(x)][inside] * BUCKETS + x[inside] for x, inside in grams(texts)]), return_counts=True)


def _vectors(pool: DataFrame, known: np.ndarray) -> DataFrame:
    """``pool`` with a column base: how often each known bucket occurs in the sentence, over the square root of all n-grams."""
    schema = T.StructType([*pool.schema.fields, T.StructField("base", VectorUDT())])
    width = max(1, len(known))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot = np.full(BUCKETS, -1, np.int32)
        slot[known] = np.arange(len(known))
        for b in batches:
            texts = list(b["sentence"])
            keys, times = _keys(texts)
            owner = keys // BUCKETS
            values = times / np.sqrt(np.maximum(np.bincount(owner, times, len(texts)), 1))[owner]
            at = slot[keys % BUCKETS]
            owner, at, values = owner[at >= 0], at[at >= 0], values[at >= 0]
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
            yield b.assign(base=[{"type": 0, "size": width, "indices": at[i:j], "values": values[i:j]} for i, j in zip(cuts, cuts[1:])])

    return pool.mapInPandas(count, schema)


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """A model from the reviewers' labels and the seed text. Without labels it learns from the seed text alone.

    In each round the sentences are scored by models that did not see them. The last round's models,
    each of which left out one part of the sentences, are averaged: so unseen sentences score as
    those do on which the bound is set.
    """
    spark = documents.sparkSession
    seeds = spark.createDataFrame([(s, y) for t, y in labelled() for s in [" ".join(plain(t).split())]], "sentence string, seed int").dropDuplicates(["sentence"])
    each = cut_lineage(_labelled_sentences(documents, labels))
    pool = each.groupBy("sentence").agg(F.count_if("positive").alias("positive"), F.count_if(~F.col("positive")).alias("negative"))
    unlike = pool.where("negative >= positive").orderBy(F.desc("negative"), F.xxhash64("sentence"), "sentence").limit(MAX_NEGATIVES).select("sentence", F.lit(True).alias("drawn"))
    pool = pool.join(unlike, "sentence", "left").join(seeds, "sentence", "full_outer")
    own = F.coalesce(F.col("positive") > F.col("negative"), F.lit(False))
    fold = F.pmod(F.xxhash64("sentence"), F.lit(FOLDS)).cast("int")
    drawn = F.coalesce("drawn", F.lit(False))
    pool = pool.select("sentence", F.when(drawn, F.col("negative")).otherwise(0).alias("negative"), F.coalesce("seed", F.lit(0)).alias("seed"), own.alias("own"), fold.alias("fold"))
    pool = cut_lineage(pool.repartition(spark.sparkContext.defaultParallelism, "sentence"))
    known = _known(pool.where("own or seed <> 0 or negative > 0"))
    base = _vectors(pool, known).persist()
    scored, bound = base.withColumn("z", F.lit(0.0)), None
    for _ in range(ROUNDS):
        # A sentence of positive documents only is taken for abuse at first; later, if a model that did not see it finds it so.
        positive = (F.col("seed") == 1) | (F.col("own") if bound is None else F.col("own") & (F.col("z") > bound))
        negative = (F.col("seed") == -1) | (F.col("negative") > 0)
        marked = scored.withColumn("y", F.when(positive, 1.0).when(negative, 0.0)).where("y is not null")
        models = [_fit(marked.where(F.col("fold") != k), known) for k in range(FOLDS)]
        scored = _held_out(base, models)
        bound = _bound(scored, each)
    base.unpersist()
    return Model(known, np.mean([m.weights for m in models], axis=0), float(np.mean([m.constant for m in models])) - bound)


def _held_out(base: DataFrame, models: list[Model]) -> DataFrame:
    """``base`` with a column z: the score of each sentence by the model that left its part out."""
    shared = base.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("double")
    def score(sentence: pd.Series, fold: pd.Series) -> pd.Series:
        z = np.zeros(len(sentence))
        for k, model in enumerate(shared.value):
            at = np.flatnonzero(fold == k)
            z[at] = model.score(list(sentence.iloc[at]))
        return pd.Series(z)

    return base.withColumn("z", score("sentence", "fold"))


def _bound(scored: DataFrame, each: DataFrame) -> float:
    """The score that parts abusive documents from others, by the held-out scores of the labelled ones.

    Some labels are wrong whatever the score. So the share of positive labels runs from a low to a
    high level, and beyond the bound it is nearer to the high one.
    """
    docs = each.join(scored.select("sentence", "z"), "sentence").groupBy("doc_id").agg(F.max("z").alias("z"), F.max("positive").cast("double").alias("y"), F.lit(1.0).alias("w"))
    seeds = scored.where("seed <> 0").select("z", (F.col("seed") > 0).cast("double").alias("y"))
    rows = docs.select("z", "y", "w").toPandas()  # at most MAX_DOCUMENTS rows
    seeds = seeds.toPandas()
    rows = pd.concat([rows, seeds.assign(w=SEED_DOCUMENTS / max(1, len(seeds)))]).sort_values("z", ascending=False)
    z, y, w = (rows[c].to_numpy() for c in ("z", "y", "w"))
    cut = max(1, int((np.cumsum(w * y) < (w * y).sum() / 2).sum()))
    for _ in range(20):
        level = (np.average(y[:cut], weights=w[:cut]) + (np.average(y[cut:], weights=w[cut:]) if cut < len(y) else 0.0)) / 2
        best = int(np.argmax(np.cumsum(w * (y - level)))) + 1
        if best == cut:
            break
        cut = best
    return float((z[cut - 1] + z[min(cut, len(z) - 1)]) / 2)


def _fit(rows: DataFrame, known: np.ndarray) -> Model:
    """A model of the rows' labels ``y``, over the known buckets."""
    counts = {r["y"]: (r["n"], r["c"].toArray()) for r in rows.groupBy("y").agg(F.count("*").alias("n"), Summarizer.numNonZeros(F.col("base")).alias("c")).collect()}  # a vector over the known buckets for each label
    (n_pos, p), (n_neg, q) = (counts.get(y, (1, np.zeros(max(1, len(known))))) for y in (1.0, 0.0))
    share = n_pos / (n_pos + n_neg)
    ratio = np.log((p + PRIOR * share) / (q + PRIOR * (1 - share))) - np.log(n_pos / n_neg)
    scale = ElementwiseProduct(scalingVec=DenseVector(ratio), inputCol="base", outputCol="features")
    part = min(max(share, POSITIVE_SHARE[0]), POSITIVE_SHARE[1])
    # A sentence that stands in many documents without abuse counts more, by the square root.
    weight = F.when(F.col("y") == 1, part * (n_pos + n_neg) / n_pos).otherwise((1 - part) * (n_pos + n_neg) / n_neg * F.sqrt(F.greatest(F.lit(1.0), F.col("negative").cast("double"))))
    learner = LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", regParam=REGULARISATION, maxIter=ITERATIONS, standardization=False, aggregationDepth=2)
    fitted = learner.fit(scale.transform(rows).select("features", "y", weight.alias("weight")))
    return Model(known, (fitted.coefficients.toArray() * ratio)[: len(known)].astype(np.float32), float(fitted.intercept))


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, source, score, worst, abusive) of every document, each text read whole.

    ``worst`` is the sentence with the highest score, in plain spelling. Null, empty and blank texts
    score null and are not abusive; every other text has a score, abusive over 0. ``source`` is in
    canonical spelling: trimmed, lower case, with underscores. A null doc_id gives no row; rows
    stored twice come out once.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.where("doc_id is not null").select("doc_id", canonical_source("source").alias("source"), "text")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            for a in range(0, len(b), 1000):
                part = b.iloc[a : a + 1000]
                found = [sentences(t) if t else [] for t in part["text"]]
                number = {s: n for n, s in enumerate(dict.fromkeys(s for own in found for s in own))}
                texts = list(number)
                z = np.concatenate([m.score(texts[k : k + 20_000]) for k in range(0, len(texts), 20_000)] or [np.zeros(0)])
                best = [max((number[s] for s in own), key=z.__getitem__, default=None) for own in found]
                yield part[["doc_id", "source"]].assign(score=[None if k is None else float(z[k]) for k in best], worst=[None if k is None else texts[k] for k in best])

    scored = rows.mapInPandas(judge, "doc_id long, source string, score double, worst string")
    return scored.dropDuplicates(["doc_id"]).withColumn("abusive", F.coalesce(F.col("score") > 0, F.lit(False)))


def canonical_source(col: str):
    """A document source as sources are compared: trimmed, lower case, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(clean_id(col)), r"[\s-]+", "_")


def source_rates(scored: DataFrame) -> DataFrame:
    """(source, n_documents, n_abusive, rate) per source, a null source by itself."""
    by = scored.groupBy("source").agg(F.count("*").alias("n_documents"), F.count_if("abusive").alias("n_abusive"))
    return by.withColumn("rate", F.col("n_abusive") / F.col("n_documents"))
