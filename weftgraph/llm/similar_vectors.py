"""The most similar vectors of every vector, by randomly rotated one-bit codes.

Cells of a coarse index bound what is compared; within a cell, inner products are estimated from
packed bits and a few correction scalars of each vector, and the error bound of the estimate says
which vectors are worth an exact product. Equal vectors are one class throughout: a class is
searched once, and only the first k + 1 of its members can be anybody's neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..tables import clean_id

#: Vectors of each model that the cells are fitted on, about; chosen by hash. Beyond ONE_LEVEL cells there are SAMPLE_PER_CELL for each.
FIT_SAMPLE = 16_384
ONE_LEVEL, SAMPLE_PER_CELL = 1024, 16
#: Members of a class of equal vectors from which its queries are spread over several tasks, each of about so many.
BIG_CLASS = 100_000
#: Rows of a cell that one task compares at once with as many queries; larger cells are split.
BLOCK = 4096
#: Standard errors of the estimate within which a vector counts as possible: 3 lose about 1 vector in 10^3.
SURE = 3.0
QUERY_BITS = 4


@dataclass
class Cells:
    """Centroids of the cells of one model."""

    centroids: np.ndarray

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` cells nearest to each row, nearest first."""
        distance = (self.centroids**2).sum(1) - 2 * x @ self.centroids.T
        n = min(n, len(self.centroids))
        first = np.argpartition(distance, n - 1, axis=1)[:, :n]
        return np.take_along_axis(first, np.argsort(np.take_along_axis(distance, first, 1), axis=1, kind="stable"), 1)


def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation of ``dim`` padded to full 64-bit words: columns are the axes of the codes."""
    padded = -(-dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(dim).normal(size=(padded, padded)))
    return (q * np.sign(np.diag(r)))[:dim].astype(np.float64)


def _pack(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


def encode(x: np.ndarray, centroid: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One-bit codes of the directions from the centroid, with their scalars: length, own product with the code, product with the centroid."""
    rest = x - centroid
    length = np.linalg.norm(rest, axis=1)
    direction = rest / np.maximum(length, 1e-12)[:, None]
    turned = direction @ turn
    own = np.abs(turned).sum(1) / np.sqrt(turn.shape[1])
    return _pack(turned > 0), length, np.maximum(own, 1e-6), direction @ centroid


def estimate(q: np.ndarray, centroid: np.ndarray, turn: np.ndarray, code: tuple, epsilon: float = SURE) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of the inner products of the rows of ``q`` with encoded vectors, and their error bounds."""
    bits, length, own, with_centroid = code
    width = turn.shape[1]
    rest = q - centroid
    q_length = np.linalg.norm(rest, axis=1)
    turned = (rest / np.maximum(q_length, 1e-12)[:, None]) @ turn
    low = turned.min(1)
    step = np.maximum((turned.max(1) - low) / (2**QUERY_BITS - 1), 1e-12)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    ones = np.bitwise_count(bits).sum(1).astype(np.float32)
    # The levels of the query times the bits, summed: what popcounts over the query's bit planes give, as one product of small whole numbers.
    total = level.astype(np.float32) @ np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1, bitorder="little").astype(np.float32).T
    total *= (2 * step)[:, None].astype(np.float32)
    total += (2 * low)[:, None].astype(np.float32) * ones
    total -= turned.sum(1)[:, None].astype(np.float32)
    product = total / (np.sqrt(width) * own).astype(np.float32)
    scale = (q_length[:, None] * length).astype(np.float32)
    guess = (q @ centroid)[:, None].astype(np.float32) + scale * product + (length * with_centroid).astype(np.float32)
    bound = scale * (epsilon * np.sqrt((1 - np.minimum(own, 1) ** 2) / own**2) / np.sqrt(width - 1)).astype(np.float32)
    return guess, bound + np.float32(1e-5)


def usable(vectors: DataFrame) -> DataFrame:
    """(model, dim, chunk_id, v1, v2, vector): vectors of length ``dim``, finite and not all zero, one row for each chunk of a model.

    Null models, ids, vectors and elements are not usable. If rows of one chunk differ, the least vector counts.
    """
    good = F.col("vector").isNotNull() & (F.size("vector") == F.col("dim")) & (F.col("dim") > 0)
    good &= F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select("model", "dim", clean_id("chunk_id").alias("chunk_id"), "vector").where(F.coalesce(good, F.lit(False)) & F.col("chunk_id").isNotNull() & F.col("model").isNotNull())
    rows = rows.groupBy("model", "dim", "chunk_id").agg(F.min("vector").alias("vector"))
    return rows.withColumns({"v1": F.xxhash64(F.lit(7), "vector"), "v2": F.xxhash64(F.lit(1_000_003), "vector")})


def fit_cells(reps: DataFrame, rows_per_cell: int | None) -> dict[tuple[str, int], Cells]:
    """Cells of each model: about sqrt(n), or n / rows_per_cell, of them, by k-means over a sample chosen by hash.

    Models of at most BLOCK vectors have one cell and are not fitted, so there are no more fitted
    models than the number of vectors over BLOCK. Many cells are fitted in two levels, the second in tasks of
    which each has one part of the sample; what comes to the driver grows with the number of cells only.
    """
    sizes = {(r["model"], r["dim"]): r["count"] for r in reps.groupBy("model", "dim").count().where(F.col("count") > BLOCK).collect()}
    if not sizes:
        return {}
    wanted = {key: int(np.ceil(n / rows_per_cell if rows_per_cell else np.sqrt(n))) for key, n in sizes.items()}

    def sample(keys: list[tuple[str, int]], rows: dict[tuple[str, int], int]) -> DataFrame:
        shares = reps.sparkSession.createDataFrame([(*k, min(1.0, rows[k] / sizes[k])) for k in keys], "model string, dim int, share double")
        drawn = F.pmod(F.col("v1"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
        return reps.join(F.broadcast(shares), ["model", "dim"]).where(drawn).select("model", "dim", "vector")

    fitted = {}
    for key, rows in sample(list(sizes), dict.fromkeys(sizes, FIT_SAMPLE)).toPandas().groupby(["model", "dim"]):
        x = _unit(rows["vector"])
        k = wanted[key] if wanted[key] <= ONE_LEVEL else int(np.ceil(np.sqrt(wanted[key])))
        fitted[key] = Cells(_means(x, max(1, min(k, len(x) // 8))))
    many = {key: n for key, n in wanted.items() if n > ONE_LEVEL and key in fitted}
    if many:
        fitted |= _second_level(sample(list(many), {k: SAMPLE_PER_CELL * n for k, n in many.items()}), {k: fitted[k] for k in many})
    return fitted


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _second_level(sample: DataFrame, coarse: dict[tuple[str, int], Cells]) -> dict[tuple[str, int], Cells]:
    """Cells of the parts into which coarse cells divide a sample: one for every SAMPLE_PER_CELL vectors of a part."""
    shared = sample.sparkSession.sparkContext.broadcast(coarse)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, rows in b.groupby(["model", "dim"]):
                yield rows.assign(part=shared.value[key].nearest(_unit(rows["vector"]), 1)[:, 0].astype(np.int32))

    def divide(rows: pd.DataFrame) -> pd.DataFrame:
        centroids = _means(_unit(rows["vector"]), max(1, len(rows) // SAMPLE_PER_CELL))
        return pd.DataFrame({"model": rows["model"].iloc[0], "dim": rows["dim"].iloc[0], "centroid": list(centroids)})

    parts = sample.mapInPandas(part, "model string, dim int, vector array<float>, part int")
    rows = parts.groupBy("model", "dim", "part").applyInPandas(divide, "model string, dim int, centroid array<double>")
    return {key: Cells(np.stack(r["centroid"].to_numpy())) for key, r in rows.toPandas().groupby(["model", "dim"])}


def _means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(0)
    centroids = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(rounds if k > 1 else 1):
        cell = Cells(centroids).nearest(x, 1)[:, 0]
        n = np.bincount(cell, minlength=k)
        total = np.zeros_like(centroids)
        np.add.at(total, cell, x)
        centroids = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centroids)
    return centroids


def similar_classes(reps: DataFrame, k: int, floor: float, probes: int | float, rows_per_cell: int | None, epsilon: float = SURE) -> DataFrame:
    """(model, dim, q1, q2, x1, x2, similarity): up to ``k`` most similar other vectors of each distinct vector, by cosine.

    ``probes`` cells are searched for each, or that share of all cells if it is under 1.
    """
    spark = reps.sparkSession
    reps = cut_lineage(reps)
    cells = spark.sparkContext.broadcast(fit_cells(reps, rows_per_cell))  # a row for each cell

    def of(model: str, dim: int) -> Cells:
        return cells.value.get((model, dim)) or Cells(np.zeros((1, dim)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (model, dim), rows in b.groupby(["model", "dim"]):
                own, x = of(model, dim), _unit(rows["vector"])
                n = len(own.centroids)
                near = own.nearest(x, max(1, int(np.ceil(probes * n))) if probes < 1 else int(probes))
                unit = list(x.astype(np.float32))
                yield rows[["model", "dim", "v1", "v2"]].assign(cell=near[:, 0], probes=list(near.astype(np.int32)), unit=unit)

    assigned = cut_lineage(reps.mapInPandas(assign, "model string, dim int, v1 long, v2 long, cell int, probes array<int>, unit array<float>"))
    base = assigned.select("model", "dim", "v1", "v2", "cell", "unit")
    asked = assigned.select("model", "dim", "v1", "v2", F.explode("probes").alias("cell"), "unit")
    size = lambda t, name: t.groupBy("model", "dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    blocks = F.broadcast(size(base, "nb").join(F.broadcast(size(asked, "nq")), ["model", "dim", "cell"]))  # a row for each cell
    part = lambda n: F.pmod(F.xxhash64("v2"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["model", "dim", "cell", "b", "q"]
    base = base.join(blocks, ["model", "dim", "cell"]).select("*", part("nb").alias("b"), every("nq").alias("q")).drop("nb", "nq")
    asked = asked.join(blocks, ["model", "dim", "cell"]).select("*", part("nq").alias("q"), every("nb").alias("b")).drop("nb", "nq")

    def compare(group: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        model, dim, cell = group[0], int(group[1]), int(group[2])
        found = []
        if len(left) and len(right):
            centroid, turn = of(model, dim).centroids[cell], rotation(dim)
            x, q = np.stack(left["unit"].to_numpy()).astype(np.float64), np.stack(right["asked_unit"].to_numpy()).astype(np.float64)
            code = encode(x, centroid, turn)
            ids, asks = left[["v1", "v2"]].to_numpy(), right[["asked_v1", "asked_v2"]].to_numpy()
            rows, own = max(1, 1_000_000 // len(x)), _places(asks, ids)
            for a in range(0, len(q), rows):
                found.append(_best(q[a : a + rows], asks[a : a + rows], own[a : a + rows], x, ids, code, centroid, turn, k, floor, epsilon))
        columns = ["q1", "q2", "x1", "x2", "similarity"]
        out = pd.concat(found) if found else pd.DataFrame({c: pd.Series(dtype="float64" if c == "similarity" else "int64") for c in columns})
        return out.assign(model=model, dim=dim)[["model", "dim", *columns]]

    schema = "model string, dim int, q1 long, q2 long, x1 long, x2 long, similarity double"
    asked = asked.toDF(*(f"asked_{c}" for c in asked.columns))
    pairs = base.groupBy(*key).cogroup(asked.groupBy(*(f"asked_{c}" for c in key))).applyInPandas(compare, schema)
    best = Window.partitionBy("model", "dim", "q1", "q2").orderBy(F.desc("similarity"), "x1", "x2")
    return pairs.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")


def _places(asks: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Where each of ``asks`` stands among the rows ``ids``, or -1."""
    a, b = (pd.MultiIndex.from_arrays(t.T) for t in (asks, ids))
    return b.get_indexer(a)


def _best(q, asks, own, x, ids, code, centroid, turn, k, floor, epsilon) -> pd.DataFrame:
    """Exact similarities of the up to ``k`` best of ``x`` for each query; only what the bounds leave possible is computed."""
    guess, bound = estimate(q, centroid, turn, code, epsilon)
    at = np.flatnonzero(own >= 0)
    guess[at, own[at]] = -99.0
    bar = np.full(len(q), floor)
    if len(x) > k:
        # The k-th exact product of the most promising rows is a floor that the estimates of all others have to reach.
        first = min(len(x), 4 * k + 1)
        likely = np.argpartition(guess, len(x) - first, axis=1)[:, len(x) - first :]
        products = np.einsum("nd,nkd->nk", q, x[likely])
        products[likely == own[:, None]] = -99.0
        bar = np.maximum(bar, np.partition(products, first - k, axis=1)[:, first - k] - 1e-9)
    i, j = np.nonzero(guess + bound >= bar[:, None])
    # Where many rows are possible, one product of the block is cheaper than that of each pair.
    exact = (q @ x.T)[i, j] if len(i) > guess.size / 64 else np.einsum("nd,nd->n", q[i], x[j])
    keep = exact >= bar[i]
    i, j, exact = i[keep], j[keep], exact[keep]
    order = np.lexsort((ids[j, 0], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    first = np.searchsorted(i, i)
    top = np.arange(len(i)) - first < k
    i, j = i[top], j[top]
    return pd.DataFrame({"q1": asks[i, 0], "q2": asks[i, 1], "x1": ids[j, 0], "x2": ids[j, 1], "similarity": exact[top]})


def neighbours(vectors: DataFrame, k: int = 10, floor: float = -1.0, probes: int | float = 0.7, rows_per_cell: int | None = 4096, all_members: bool = True, epsilon: float = SURE) -> DataFrame:
    """(model, chunk_id, rank, neighbour, similarity): the ``k`` most similar other chunks of each usable vector, within its model.

    Rank 1 is the most similar; ties go by chunk_id. Vectors of unequal ``dim`` are not compared.
    Neighbours under ``floor`` are left out. The search is approximate: what lies in cells that are
    not searched is missed. With a high floor few cells suffice; without one, in data without
    clusters, most cells must be searched. ``all_members`` false leaves out the queries of members
    of a class of equal vectors that can be nobody's neighbours themselves.
    """
    rows = usable(vectors)
    group = Window.partitionBy("model", "dim", "v1", "v2").orderBy("chunk_id")
    ranked = rows.withColumn("member", F.row_number().over(group)).where(F.col("member") <= k + 1)  # the limit is pushed below the shuffle
    ranked = cut_lineage(ranked)
    classes = similar_classes(ranked.where("member = 1").select("model", "dim", "v1", "v2", "vector"), k, floor, probes, rows_per_cell, epsilon)
    members = ranked.select("model", "dim", F.col("v1").alias("x1"), F.col("v2").alias("x2"), F.col("chunk_id").alias("neighbour"))
    itself = ranked.where("member = 1").select("model", "dim", F.col("v1").alias("q1"), F.col("v2").alias("q2"), F.col("v1").alias("x1"), F.col("v2").alias("x2"), F.lit(1.0).alias("similarity"))
    lists = classes.unionByName(itself).join(members, ["model", "dim", "x1", "x2"])
    best = Window.partitionBy("model", "dim", "q1", "q2").orderBy(F.desc("similarity"), "neighbour")
    lists = lists.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("model", "dim", "q1", "q2", "neighbour", "similarity")
    asking = (rows if all_members else ranked).select("model", "dim", F.col("v1").alias("q1"), F.col("v2").alias("q2"), "chunk_id")
    # The queries of a big class are spread over parts, to each of which its list goes; there are no more big classes than rows over BIG_CLASS.
    key = ["model", "dim", "q1", "q2"]
    big = F.broadcast(asking.groupBy(*key).count().where(F.col("count") > BIG_CLASS).select(*key, F.ceil(F.col("count") / BIG_CLASS).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    asking = asking.join(big, key, "left").select(*key, "chunk_id", F.pmod(F.xxhash64("chunk_id"), parts).cast("int").alias("part"))
    lists = lists.join(big, key, "left").select(*key, "neighbour", "similarity", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    each = asking.join(lists, [*key, "part"]).where("chunk_id <> neighbour")
    order = Window.partitionBy("model", "dim", "chunk_id").orderBy(F.desc("similarity"), "neighbour")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("model", "chunk_id", "rank", "neighbour", "similarity")


def mutual_pairs(vectors: DataFrame, k: int = 10, floor: float = 0.9, probes: int = 6) -> DataFrame:
    """(chunk_id_a, chunk_id_b): pairs of at least ``floor`` similarity where each is among the ``k`` most similar of the other, smaller id first."""
    near = neighbours(vectors, k, floor, probes, None, False, SURE)
    a, b = F.least("chunk_id", "neighbour"), F.greatest("chunk_id", "neighbour")
    both = near.select("model", a.alias("chunk_id_a"), b.alias("chunk_id_b")).groupBy("model", "chunk_id_a", "chunk_id_b").count()
    return both.where("count = 2").select("chunk_id_a", "chunk_id_b").distinct()
