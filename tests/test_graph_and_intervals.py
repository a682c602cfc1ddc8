"""Frontiers, policies of call expansion, merges and interval joins on hand-made graphs."""

from weftgraph.operators import graph as g
from weftgraph.operators import intervals, ladder, upserts
from weftgraph.plans import search

REL = "id string, type string, src_id string, dst_id string, resolution string, pruned boolean, path string, start_line int, confidence double"
ENT = "id string, kind string, name string, qualified_name string, repo_id string, path string, missing boolean, external boolean, docstring string"


def rels(spark, rows):
    return spark.createDataFrame([(f"{t}:{a}->{b}", t, a, b, r, False, f"{a}.py", 1, 0.9) for t, a, b, r in rows], REL)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_speculative_calls_show_once_and_are_not_followed(spark):
    r = rels(spark, [("calls", "a", "b", "syntactic"), ("calls", "b", "c", "name-match"), ("calls", "b", "d", "scip"), ("calls", "c", "e", "scip"), ("calls", "a", "x", "candidate"), ("calls", "x", "y", "scip")])
    got = {(x["id"], x["depth"], x["resolved"]) for x in g.call_graph(r, ids(spark, "a"), "out", 3).collect()}
    assert got == {("b", 1, True), ("x", 1, False), ("d", 2, True)}


def test_reach_has_least_depths_and_stops_on_cycles(spark):
    r = rels(spark, [("calls", "a", "b", None), ("calls", "b", "c", None), ("calls", "c", "a", None), ("calls", "a", "c", None)])
    assert {(x["id"], x["depth"]) for x in g.reach(r, ids(spark, "a"), "out", None, 10).collect()} == {("a", 0), ("b", 1), ("c", 1)}
    assert {x["id"] for x in g.reach(r, ids(spark, "nobody"), "out", None, 3).collect()} == {"nobody"}
    assert g.reach(r.where("false"), ids(spark, "a")).count() == 1


def test_ancestors(spark):
    r = rels(spark, [("extends", "a", "b", "syntactic"), ("implements", "b", "c", None), ("extends", "c", "a", "scip"), ("extends", "a", "z", "candidate")])
    assert {tuple(x) for x in g.ancestors(r).collect()} == {("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("a", "c", 2), ("b", "a", 2), ("c", "b", 2)}


def test_intervals(spark):
    spans = spark.createDataFrame([("r", "f", 1, 50, "module"), ("r", "f", 5, 9, "inner"), ("r", "f", 5, 20, "outer"), ("r", "g", 3, 4, "other")], "repo_id string, path string, start_line int, end_line int, span_id string")
    points = spark.createDataFrame([("r", "f", 6, "p"), ("r", "f", 15, "q"), ("r", "f", 60, "u"), ("r", "g", 1, "v"), ("r", "f", None, "n")], "repo_id string, path string, line int, point_id string")
    assert {(x["point_id"], x["span_id"]) for x in intervals.innermost(points, spans).collect()} == {("p", "inner"), ("q", "outer")}
    assert {(x["point_id"], x["span_id"]) for x in intervals.enclosing(points, spans).collect()} == {("p", "outer"), ("q", "outer"), ("u", "outer"), ("v", None), ("n", None)}
    assert {(x["point_id"], x["span_id"], x["distance"]) for x in intervals.band(points, spans).collect()} == {("p", "inner", 1), ("p", "outer", 1)}
    found = {tuple(x)[2:] for x in intervals.runs(intervals.line_owners(spans)).where("path = 'f'").collect()}
    assert found == {("module", 1, 4), ("inner", 5, 9), ("outer", 10, 20), ("module", 21, 50)}


def test_windows_of_lines(spark):
    run = spark.createDataFrame([("r", "f", "s", 1, 130), ("r", "f", "t", 200, 210)], "repo_id string, path string, span_id string, first_line int, last_line int")
    got = sorted((x["start_line"], x["end_line"]) for x in intervals.line_windows(run).collect())
    assert got == [(1, 60), (51, 110), (101, 130), (200, 210)]


def test_upserts_and_diff(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, content_hash string")
    new = spark.createDataFrame([(2, None), (3, "d"), (4, "e")], "id int, content_hash string")
    assert {tuple(r) for r in upserts.content_diff(old, new, ["id"]).collect()} == {(1, "deleted"), (2, "unchanged"), (3, "changed"), (4, "new")}
    assert {tuple(r) for r in upserts.upsert(old, new, ["id"]).collect()} == {(1, "a"), (2, None), (3, "d"), (4, "e")}
    rows = spark.createDataFrame([(1, 5, "x"), (1, 5, "y"), (1, 4, "z")], "id int, t int, v string")
    assert [tuple(r) for r in upserts.latest(rows, ["id"], ["t"]).collect()] == [(1, 5, "y")]


def test_ladder_has_one_rung_for_each_evidence(spark):
    calls = [("own", "run", "m1", "A", "self", None), ("typed", "run", "m9", None, "x", "B"), ("same", "solo", "m1", None, None, None), ("traced", "far", "m1", None, None, None), ("up", "base", "m3", "C", None, None),
             ("unique", "only", "m9", None, None, None), ("guess", "pair", "m9", None, None, None), ("capped", "many", "m9", None, None, None), ("none", "ghost", "m9", None, None, None)]
    symbols = [("A.run", "run", "m1", "A"), ("B.run", "run", "m2", "B"), ("m1.solo", "solo", "m1", None), ("m2.solo", "solo", "m2", None), ("m2.far", "far", "m2", None), ("m4.far", "far", "m4", None),
               ("P.base", "base", "m5", "P"), ("Q.base", "base", "m6", "Q"), ("m5.only", "Only", "m5", None), ("m5.pair", "pair", "m5", None), ("m6.pair", "pair", "m6", None), *((f"m{n}.many", "many", f"m{n}", None) for n in range(10, 16))]
    c = spark.createDataFrame([("r", *x) for x in calls], "repo_id string, call_id string, name string, module string, class_name string, receiver string, receiver_type string")
    s = spark.createDataFrame([("r", *x) for x in symbols], "repo_id string, id string, name string, module string, class_name string")
    i = spark.createDataFrame([("r", "m1", "m2")], "repo_id string, module string, imported string")
    up = spark.createDataFrame([("r", "C", "P")], "repo_id string, class_name string, ancestor string")
    got = {r["call_id"]: (r["target_id"], r["resolution"], r["confidence"], r["fan_out"]) for r in ladder.resolve_calls(c, s, i, up).collect()}
    assert got == {
        "own": ("A.run", "syntactic", 1.0, 1), "typed": ("B.run", "inferred", 0.9, 1), "same": ("m1.solo", "syntactic", 1.0, 1), "traced": ("m2.far", "import-traced", 0.95, 1), "up": ("P.base", "inherited", 0.9, 1),
        "unique": ("m5.only", "name-match", 0.6, 1), "guess": ("m5.pair", "candidate", 0.4, 2), "capped": (None, "fan-out-capped", 0.0, 6), "none": (None, "missing", 0.0, 0),
    }


def test_fusion_sums_reciprocal_ranks(spark):
    signals = spark.createDataFrame([("a", "symbol", 0), ("a", "keyword", 1), ("b", "keyword", 0), ("c", "unknown", 0)], "id string, signal string, position int")
    got = {r["id"]: r["score"] for r in search.fuse(signals, {"symbol": 1.4, "keyword": 1.0}).collect()}
    assert got == {"a": round(1.4 / 61 + 1 / 62, 8), "b": round(1 / 61, 8)}
