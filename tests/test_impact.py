"""Siblings that override a method, and tests that only their names link to a symbol."""

from weftgraph.plans import impact

ENT = "id string, kind string, name string, qualified_name string, repo_id string"
REL = "type string, src_id string, dst_id string, pruned boolean"


def test_siblings_are_members_of_one_group(spark):
    classes = [(c, "class", c, f"m.{c}", "r") for c in ("Base", "A", "B", "C")]
    methods = [(f"{c}.{n}", "method", n, f"m.{c}.{n}", "r") for c, n in (("A", "run"), ("B", "run"), ("C", "run"), ("A", "only"))]
    e = spark.createDataFrame(classes + methods, ENT)
    r = spark.createDataFrame([("extends", "A", "Base", False), ("implements", "B", "Base", False), ("extends", "C", "Elsewhere", False)], REL)
    assert {tuple(x) for x in impact.override_groups(e, r).collect()} == {("Base", "run", "A.run", "A"), ("Base", "run", "B.run", "B")}


def test_tests_are_found_by_part_of_their_name(spark):
    e = spark.createDataFrame([("f", "function", "PostLedger", "m.PostLedger", "r"), ("g", "function", "other", "m.other", "r"), ("far", "function", "PostLedger", "m.PostLedger", "q"), ("none", "function", "", "", "r"),
                               ("t", "test", "test_postledgers", "m.test_postledgers", "r"), ("u", "test", "test_other", "m.test_other", "r")], ENT)
    r = spark.createDataFrame([("calls", "u", "g", False), ("tests", "t", "g", False)], REL)
    got = {(x["id"], x["test_id"]): (x["confidence"], x["via"]) for x in impact.test_callers(e, r).collect()}
    assert got == {("f", "t"): (0.6, "name"), ("g", "u"): (0.9, "call"), ("g", "t"): (1.0, "edge"), ("t", "t"): (0.6, "name"), ("u", "u"): (0.6, "name")}
