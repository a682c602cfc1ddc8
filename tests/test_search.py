"""The fused search: every signal, seeds of each of them, and all neighbours of a hot seed."""

from weftgraph.operators import graph as g
from weftgraph.plans import search

ENT = "id string, kind string, name string, qualified_name string, repo_id string, path string, start_line int, end_line int, missing boolean, docstring string"
REL = "type string, src_id string, dst_id string, resolution string"


def entity(name, path, start=1, end=2):
    return (name, "function", name, f"m.{name}", "r", path, start, end, False, "")


def found(spark, names, edges, vectors, files, query="ledger"):
    e = spark.createDataFrame(names, ENT)
    r = spark.createDataFrame(edges, REL)
    churn = spark.createDataFrame([], "repo_id string, path string, commits long")
    v = spark.createDataFrame(vectors, "chunk_id string, repo_id string, dim int, vector array<float>, model string")
    f = spark.createDataFrame(files, "repo_id string, path string, indexed_at string, content string")
    return {x["id"]: set(x["signals"].split(",")) for x in search.hybrid(e, r, churn, v, f, query, 1000).collect()}


def test_body_text_and_vectors_find_what_names_do_not(spark):
    names = [entity("alpha", "a.py"), entity("beta", "b.py"), entity("gamma", "c.py"), entity("delta", "d.py")]
    chunk = lambda path, vector, model="m": (f"chunk:r:{path}:1-2", "r", 2, vector, model)
    vectors = [chunk("a.py", [1.0, 0.0]), chunk("b.py", [0.9, 0.1]), chunk("c.py", [1.0, 0.0], "other"), chunk("d.py", [float("nan"), 0.0])]
    files = [("r", "a.py", "1", "x = 0\n# the ledger"), ("r", "b.py", "1", "y = 0\nz = 0"), ("r", "c.py", "1", "y\nz"), ("r", "d.py", "1", "y\nz")]
    got = found(spark, names, [("calls", "x", "y", "scip")], vectors, files)
    assert got == {"alpha": {"keyword", "semantic"}, "beta": {"semantic"}}


def test_every_signal_has_seeds_and_a_hot_seed_keeps_all_neighbours(spark):
    symbols = [entity(f"ledger{n}", f"s{n}.py") for n in range(6)]  # by name only
    body = [entity("body", "t.py"), entity("behind_body", "u.py")]
    many = [entity(f"n{n:03}", f"n{n:03}.py") for n in range(150)]
    edges = [("calls", "ledger0", f"n{n:03}", "scip") for n in range(150)] + [("calls", "body", "behind_body", "scip")]
    vectors = [("chunk:r:t.py:1-2", "r", 2, [1.0, 0.0], "m")]
    got = found(spark, symbols + body + many, edges, vectors, [("r", "t.py", "1", "ledger\nledger")])
    assert {f"n{n:03}" for n in range(150)} <= set(got) and got["n149"] == {"graph"}
    assert got["behind_body"] == {"graph"}  # its seed is first by text and vector, but no symbol


def test_positions_of_a_large_signal_are_whole(spark):
    signal = spark.range(1000).selectExpr("cast(id as string) as id", "cast(id % 7 as double) as score").repartition(5)
    got = {x["id"]: x["position"] for x in search.placed(signal, "graph").collect()}
    order = sorted(((str(n), float(n % 7)) for n in range(1000)), key=lambda x: (-x[1], x[0]))
    assert got == {i: p for p, (i, _) in enumerate(order)}


def test_every_query_vector_has_its_nearest_rows(spark):
    rows = [(n, [float(n % 5) + 1, float(n % 3)]) for n in range(40)]
    v = spark.createDataFrame(rows, "id long, x array<double>").repartition(3)
    got = search.nearest_each(v, "id", "x", v.where("id % 10 = 0").selectExpr("id as query", "x as q"), 4).collect()
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    cos = lambda a, b: round(dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5, 6)
    expected = {(k, i) for k, q in rows if k % 10 == 0 for _, i in sorted((-cos(x, q), i) for i, x in rows)[:4]}
    assert {(r["query"], r["id"]) for r in got} == expected and len(got) == 16


def test_trees_at_their_default_depth(spark):
    edges = [("e1", "a", "b"), ("e2", "b", "c"), ("e3", "d", "b"), ("e0", "b", "c"), ("e4", "c", "e"), ("e5", "a", "d")]
    r = spark.createDataFrame([(i, "calls", a, b) for i, a, b in edges], "id string, type string, src_id string, dst_id string")
    near, seen, expected = {"a"}, {"a"}, set()
    for depth in (1, 2):
        steps = [(b if a in near else a, i, a if a in near else b) for i, x, y in edges for a, b in ((x, y),) if (a in near) != (b in near) and (b if a in near else a) not in seen]
        new = {n for n, _, _ in steps}
        expected |= {("a", n, *min((i, p) for m, i, p in steps if m == n)[::-1], depth) for n in new}
        seen |= new
        near = new
    assert {(x["root"], x["id"], x["parent"], x["edge_id"], x["depth"]) for x in g.tree_edges(r, spark.createDataFrame([("a",)], "id string")).collect()} == expected
