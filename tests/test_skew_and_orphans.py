"""Crowded targets and orphan references on small tables with nulls, ties, repeats and odd spellings."""

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from weftgraph.operators import edge_targets, orphans
from weftgraph.operators.skew import count_by_key, heavy_keys

T0 = datetime(2025, 1, 1)
EDGE = "id string, type string, src_id string, dst_id string, indexed_at timestamp_ntz, extra string"
LIFE = "id string, indexed_at timestamp_ntz, deleted_at timestamp_ntz, attributes string"


def day(n):
    return None if n is None else T0 + timedelta(days=n)


def edges(spark, rows):
    return spark.createDataFrame([(i, t, s, d, day(n), "x") for i, t, s, d, n in rows], EDGE)


def test_targets_count_each_edge_and_source_once(spark):
    rows = [("e1", "Calls ", "a", "t  1", 1), ("e1", "calls", "a", "t 1", 2), ("e2", "CALLS", "b", " t 1\t", 1), ("e3", None, "a", "t 1", 1), ("e4", "calls", "a", None, 1), ("e5", "calls", None, "t 2", 1), (None, "calls", "z", "t 2", 1)]
    got = {tuple(r)[:4] for r in edge_targets.target_counts(edges(spark, rows)).collect()}
    assert got == {("calls", "t 1", 2, 2), ("calls", "t 2", 1, 1)}


def test_heavy_and_light_keys_agree_with_brute_force(spark):
    rows = [(f"e{n}", "calls", f"s{n % 37}", "hot" if n % 3 else f"d{n % 200}", 1) for n in range(3000)]
    table = edges(spark, rows + rows[:500])
    got = {(r["type"], r["dst_id"]): (r["n_edges"], r["n_sources"], r["heavy"]) for r in edge_targets.target_counts(table).collect()}
    for d in {r[3] for r in rows}:
        own = [r for r in rows if r[3] == d]
        assert got["calls", d][:2] == (len(own), len({r[2] for r in own}))
    assert got["calls", "hot"][2] and sum(h for *_, h in got.values()) < len(got)
    assert {r["dst_id"] for r in edge_targets.crowded_targets(table).collect()} == {"hot"}


def test_empty_tables(spark):
    none = edges(spark, [])
    assert edge_targets.target_counts(none).count() == 0 and edge_targets.crowded_targets(none).count() == 0
    assert heavy_keys(none, "dst_id").count() == 0 and count_by_key(none, "dst_id", {"n": ["id"]}).count() == 0
    spans = orphans.life_spans(spark.createDataFrame([], LIFE))
    assert orphans.orphans(orphans.references(none), spans).count() == 0


def test_status_of_orphans(spark):
    life = spark.createDataFrame(
        [("a", day(1), day(5), None), ("a", day(8), None, "{}"), ("a", day(8), None, "{}"), ("late", day(9), None, '{"missing" : false}'), ("stub", day(0), None, '{ "missing":true }'),
         ("quoted", day(0), None, '{"docstring": "Sets \\"missing\\": true"}'), ("empty", day(3), day(3), None), ("odd  id ", day(0), None, "not json")], LIFE)
    refs = edges(spark, [("1", "c", "a", "a", 1), ("2", "c", "a", "late", 5), ("3", "c", "stub", "quoted", 6), ("4", "c", "nobody", "a", 8), ("5", "c", "empty", None, 3), ("6", "c", "odd id", " a", None), ("2", "c", "a", "late", 5)])
    got = {(r["ref_id"], r["ref_column"]): r["status"] for r in orphans.orphans(orphans.references(refs), orphans.life_spans(life)).collect()}
    assert got == {("2", "src_id"): "deleted", ("2", "dst_id"): "late", ("3", "src_id"): "missing", ("4", "src_id"): "missing", ("5", "src_id"): "deleted", ("6", "src_id"): "undated", ("6", "dst_id"): "undated"}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9), st.one_of(st.none(), st.integers(0, 9)))), st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9)), min_size=1))
def test_orphans_are_those_without_a_living_parent(spark, lives, uses):
    life = spark.createDataFrame([(f"k{k}", day(a), day(b), "{}") for k, a, b in lives], LIFE)
    refs = edges(spark, [(f"r{n}", "c", f"k{k}", None, t) for n, (k, t) in enumerate(uses)])
    got = {r["ref_id"] for r in orphans.orphans(orphans.references(refs), orphans.life_spans(life)).collect()}
    assert got == {f"r{n}" for n, (k, t) in enumerate(uses) if not any(i == k and a <= t and (b is None or t < b) for i, a, b in lives)}


def test_hot_keys_are_split_and_still_right(spark):
    life = spark.createDataFrame([("hot", day(2), day(4), "{}")], LIFE)
    refs = edges(spark, [(f"r{n}", "c", "hot", f"x{n}", n % 6) for n in range(2000)])
    got = orphans.orphans(orphans.references(refs, ("src_id",)), orphans.life_spans(life)).collect()
    assert len(got) == sum(1 for n in range(2000) if n % 6 not in (2, 3))
    assert {r["status"] for r in got} == {"late", "deleted"}


def test_heavy_keys_of_a_sample(spark, monkeypatch):
    from weftgraph.operators import skew

    monkeypatch.setattr(skew, "SAMPLED", 20)
    table = spark.range(40_000).selectExpr("case when id % 3 = 0 then 'hot' when id % 10 = 1 then 'warm' else concat('k', id) end as key", "cast(id as string) as v")
    heavy = {r["key"]: r["weight"] for r in skew.heavy_keys(table, "key", 0.02).collect()}
    assert set(heavy) == {"hot", "warm"} and 0.25 < heavy["hot"] < 0.42
    counts = {r["key"]: r["n"] for r in count_by_key(table, "key", {"n": ["v"]}, 0.02).where("heavy or n > 1").collect()}
    assert counts == {"hot": 13334, "warm": table.where("key = 'warm'").count()}
