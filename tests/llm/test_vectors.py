"""Similar vectors against brute force: exact products, recall, classes of equal vectors, unusable rows."""

import numpy as np
import pytest

from weftgraph.llm import similar_vectors as sv
from weftgraph.tables import load

SCHEMA = "chunk_id string, repo_id string, dim int, vector array<float>, model string"


def brute(rows, k):
    """The k most similar of each (model, id), ties by id, of usable rows by id."""
    best = {}
    for model in {m for m, _ in rows}:
        ids = sorted(i for m, i in rows if m == model)
        x = np.array([rows[model, i] for i in ids], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = x @ x.T
        for n, i in enumerate(ids):
            order = sorted((j for j in range(len(ids)) if j != n), key=lambda j: (-round(s[n, j], 9), ids[j]))[:k]
            best[model, i] = [(ids[j], s[n, j]) for j in order]
    return best


def pairs_of(best, floor):
    near = {(m, i, j) for (m, i), js in best.items() for j, s in js if s >= floor}
    return {(min(i, j), max(i, j)) for m, i, j in near if (m, j, i) in near}


def table(spark, rows):
    return spark.createDataFrame([(i, "r", len(v), [float(x) for x in v], m) for (m, i), v in rows.items()], SCHEMA)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    rows = {}
    for n in range(600):
        v = rng.normal(size=48)
        for c in range(rng.integers(1, 4)):
            rows[f"m{n % 2}", f"c{n:04}-{c}"] = (v + rng.normal(size=48) * 0.15) * rng.uniform(0.5, 3)
    return rows


def test_error_bounds_hold():
    rng = np.random.default_rng(0)
    x, q, c = rng.normal(size=(500, 64)), rng.normal(size=(50, 64)), rng.normal(size=64) * 0.1
    turn = sv.rotation(64)
    guess, bound = sv.estimate(q, c, turn, sv.encode(x, c, turn))
    off = np.abs(guess - q @ x.T)
    assert (off <= bound).mean() > 0.98 and off.mean() < bound.mean() / 3


def test_rotation_is_orthogonal():
    for dim in (3, 48, 64, 100):
        r = sv.rotation(dim)
        assert r.shape == (dim, -(-dim // 64) * 64) and np.allclose(r @ r.T, np.eye(dim))


def test_mutual_pairs_equal_brute_force(spark, clustered):
    got = {tuple(r) for r in sv.mutual_pairs(table(spark, clustered)).collect()}
    want = pairs_of(brute(clustered, 10), 0.9)
    assert len(want) > 200 and len(got & want) >= 0.99 * len(want) and got <= want


def test_recall_of_neighbours(spark, clustered):
    best = brute(clustered, 10)
    got = {}
    for r in sv.neighbours(table(spark, clustered), rows_per_cell=128).collect():
        got.setdefault((r["model"], r["chunk_id"]), set()).add(r["neighbour"])
    hits = sum(len(got.get(key, set()) & {j for j, _ in js}) for key, js in best.items())
    assert hits >= 0.9 * sum(map(len, best.values()))


def test_stored_vectors_reach_the_recall(spark, data):
    v = load(spark, data, "vectors")
    rows = {(r["model"], r["chunk_id"]): r["vector"] for r in sv.usable(v).collect()}
    groups = {(m, len(x)) for (m, _), x in rows.items()}
    best = {k: b for m, d in groups for k, b in brute({(a, i): x for (a, i), x in rows.items() if a == m and len(x) == d}, 10).items()}
    assert {tuple(r) for r in sv.mutual_pairs(v).collect()} == pairs_of(best, 0.9)


def test_a_large_class_of_equal_vectors_is_not_expanded(spark):
    rng = np.random.default_rng(1)
    same = rng.normal(size=16)
    rows = {("m", f"same{n:03}"): same for n in range(60)} | {("m", f"other{n:03}"): rng.normal(size=16) for n in range(60)}
    best = brute(rows, 10)
    got = {}
    for r in sv.neighbours(table(spark, rows), probes=1.0 - 1e-9).collect():
        got.setdefault(r["chunk_id"], []).append(r["neighbour"])
    assert all(set(got["m" and i]) == {j for j, _ in js} for (_, i), js in best.items())
    assert {tuple(r) for r in sv.mutual_pairs(table(spark, rows)).collect()} == pairs_of(best, 0.9)


def test_unusable_rows_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", "r", 2, [1.0, 0.0], "m"), (" a ", "r", 2, [1.0, 0.0], "m"), ("b", "r", 2, [2.0, 0.0], "m"), ("c", "r", 2, None, "m"), ("d", "r", 2, [], "m"), ("e", "r", 2, [0.0, 0.0], "m"), ("f", "r", 2, [nan, 1.0], "m"),
            ("g", "r", 3, [1.0, 0.0], "m"), ("h", "r", None, [1.0, 0.0], "m"), (None, "r", 2, [1.0, 0.0], "m"), ("i", "r", 2, [1.0, None], "m"), ("j", "r", 2, [1.0, 0.0], None), ("k", "r", 2, [1.0, 0.0], "other"), ("l", "r", 2, [inf, 0.0], "m")]
    t = spark.createDataFrame(rows, SCHEMA)
    assert {r["chunk_id"] for r in sv.usable(t).collect()} == {"a", "b", "k"}
    assert [tuple(r) for r in sv.mutual_pairs(t).collect()] == [("a", "b")]
    assert sv.mutual_pairs(t.where("false")).count() == 0 and sv.neighbours(t.where("false")).count() == 0


def test_many_cells_are_fitted_in_two_levels(spark, clustered, monkeypatch):
    monkeypatch.setattr(sv, "BLOCK", 100)
    monkeypatch.setattr(sv, "ONE_LEVEL", 4)
    reps = sv.usable(table(spark, clustered))
    cells = sv.fit_cells(reps, None)
    assert set(cells) == {("m0", 48), ("m1", 48)} and all(len(c.centroids) > 4 for c in cells.values())
    got = {(r[0], r[1]) for r in sv.mutual_pairs(table(spark, clustered)).collect()}
    want = pairs_of(brute(clustered, 10), 0.9)
    assert len(got & want) >= 0.95 * len(want) and got <= want


def test_big_classes_are_spread(spark, monkeypatch):
    monkeypatch.setattr(sv, "BIG_CLASS", 10)
    rng = np.random.default_rng(2)
    same, rows = rng.normal(size=16), {}
    for n in range(80):
        rows["m", f"c{n:03}"] = same if n % 2 else rng.normal(size=16)
    got = {}
    for r in sv.neighbours(table(spark, rows), k=3).collect():
        got.setdefault(r["chunk_id"], {})[r["rank"]] = r["neighbour"]
    best = brute(rows, 3)
    assert all([got[i][n] for n in (1, 2, 3)] == [j for j, _ in best["m", i]] for _, i in rows)
