"""Packing and mixing against brute force and invariants."""

import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import mixture, packing, tokens
from weftgraph.tables import load

SIZES = "doc_id long, source string, t1 long, t2 long, n_tokens long"
PACKS = "pack_name string, capacity int"
TARGETS = "source string, target_share double, max_repeats int"


def sized(spark, rows):
    return spark.createDataFrame([(d, s, t, t, n) for d, s, t, n in rows], SIZES)


def check_packing(packed, sizes, packs):
    room, pieces = defaultdict(int), defaultdict(list)
    for r in packed:
        room[r["pack_name"], r["container"]] += r["n_tokens"]
        pieces[r["pack_name"], r["doc_id"]].append((r["piece"], r["n_tokens"]))
    for name, c in packs.items():
        assert all(n <= c for (p, _), n in room.items() if p == name)
        for d, n in sizes.items():
            own = sorted(pieces.pop((name, d), []))
            assert [p for p, _ in own] == list(range(-(-n // c))) and sum(m for _, m in own) == n
            assert all(m == c for _, m in own[:-1])
    assert not pieces
    return room


def test_packing_loses_nothing_and_wastes_little(spark):
    rng = random.Random(5)
    sizes = {d: min(9000, int(rng.lognormvariate(5, 1.2)) + 1) for d in range(3000)}
    packs = {"short": 512, "long": 8192}
    t = sized(spark, [(d, "s", d, n) for d, n in sizes.items()])
    room = check_packing(packing.pack(t, spark.createDataFrame(list(packs.items()), PACKS)).collect(), sizes, packs)
    for name, c in packs.items():
        used = [n for (p, _), n in room.items() if p == name]
        assert sum(used) / (len(used) * c) > 0.95


def test_packing_edges(spark):
    sizes = {1: 10, 2: 10, 3: 10, 4: 25, 5: 1, 6: 7}
    t = sized(spark, [(d, None, 0, n) for d, n in sizes.items()] + [(7, "x", 0, 0)])
    packs = spark.createDataFrame([("a", 10), ("a", 4), ("b", 1), (None, 5), ("c", 0), ("d", None)], PACKS)
    check_packing(packing.pack(t, packs).collect(), sizes, {"a": 10, "b": 1})
    assert packing.pack(t.where("false"), packs).count() == 0
    assert packing.pack(t, packs.where("false")).count() == 0


def test_more_packs_than_one_batch(spark, monkeypatch):
    monkeypatch.setattr(packing, "PACK_BATCH", 2)
    sizes = {d: d % 7 + 1 for d in range(60)}
    t = sized(spark, [(d, "s", d, n) for d, n in sizes.items()])
    packs = {f"p{n}": n + 5 for n in range(5)}
    check_packing(packing.pack(t, spark.createDataFrame(list(packs.items()), PACKS)).collect(), sizes, packs)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1), st.integers(1, 8))
def test_configurations_use_every_document_once(histogram, groups):
    made = packing.group_sizes(histogram, groups)
    assert sum(n for *_, n in made) == sum(histogram.values()) and all(low <= high for low, high, _ in made)
    sizes, counts = [high for _, high, _ in made], [n for *_, n in made]
    done = [0] * len(made)
    for used, times in packing.configurations(sizes, counts, 40):
        assert times > 0 and sum(sizes[i] * m for i, m in used.items()) <= 40
        for i, m in used.items():
            done[i] += m * times
    assert done == counts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9)), st.lists(st.integers(0, 9)))
def test_fill_never_overfills(small, rooms):
    place, new = packing.fill(small, rooms, 10)
    load_ = defaultdict(int)
    for n, k in zip(small, place):
        load_[k] += n
    assert all(n <= (rooms[k] if k < len(rooms) else 10) for k, n in load_.items())
    assert new == len({k for k in place if k >= len(rooms)})


def mix(spark, rows, targets, total=None):
    t = spark.createDataFrame(targets, TARGETS)
    s = sized(spark, rows)
    return {r["doc_id"]: r["copies"] for r in mixture.mixture(s, t, total).collect()}, {r["source"]: r for r in mixture.shares(s, t, total).collect()}


def test_mixture_meets_budgets(spark):
    rng = random.Random(2)
    rows = [(d, ("a", "B ", "c-d", "none", None)[d % 5], d, rng.randint(1, 100)) for d in range(2000)]
    targets = [("A", 0.2, 1), ("b", 0.5, 3), ("c_d", 0.25, 2), ("missing", 0.05, 9)]
    copies, shares = mix(spark, rows, targets, 40_000)
    size = {d: n for d, _, _, n in rows}
    for name, share, most in (("a", 0.2, 1), ("b", 0.5, 3), ("c_d", 0.25, 2)):
        own = [d for d, s, *_ in rows if s and s.strip().lower().replace("-", "_") == name]
        available, budget = sum(size[d] for d in own), share * 40_000
        drawn = sum(copies.get(d, 0) * size[d] for d in own)
        assert max(copies.get(d, 0) for d in own) <= most
        assert drawn == most * available if budget >= most * available else budget - 100 < drawn <= budget
        assert shares[name]["drawn_tokens"] == drawn
    assert shares["missing"]["drawn_tokens"] == 0 and abs(sum(r["reached_share"] for r in shares.values()) - 1) < 1e-9
    assert all(rows[d][1] not in ("none", None) for d in copies)


def test_cut_runs_through_all_levels(spark, monkeypatch):
    monkeypatch.setattr(mixture, "RANGE_BITS", 1)
    rows = [(d, "a", d, 1 + d % 3) for d in range(500)]
    for total in (1, 333, 500, 1998):
        copies, _ = mix(spark, rows, [("a", 1.0, 2)], total)
        drawn = sum(n * (1 + d % 3) for d, n in copies.items())
        assert total - 3 < drawn <= total


def test_feasible_total_keeps_the_shares(spark):
    rows = [(d, "ab"[d % 4 == 0], d, 10) for d in range(400)]
    _, shares = mix(spark, rows, [("a", 0.2, 1), ("b", 0.6, 2), ("none", 0.2, 1)], mixture.FEASIBLE)
    assert shares["b"]["drawn_tokens"] == 2000 and abs(shares["a"]["drawn_tokens"] - 2000 / 3) < 10 and shares["none"]["drawn_tokens"] == 0


def test_equal_texts_repeat_as_one(spark):
    copies, _ = mix(spark, [(5, "a", 1, 10), (3, "a", 1, 10), (9, "a", 1, 10)], [("a", 1.0, 2)], 1000)
    assert copies == {3: 2}


def test_mixture_of_nothing(spark):
    assert mix(spark, [], [("a", 1.0, 2)])[0] == {} and mix(spark, [(1, "a", 1, 5)], [])[0] == {}
    assert mix(spark, [(1, "a", 1, 5)], [("a", None, 1), (None, 1.0, 1), ("a", 0.5, None)])[0] == {}


def test_token_counts(spark, data):
    docs = load(spark, data, "documents")
    odd = spark.createDataFrame([(-1, None, "s"), (-2, "", "s"), (-3, "<|endoftext|> word " * 5000, "s"), (-3, "x", "s"), (None, "y", "s"), (-4, " ", "s")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.document_sizes(odd).collect()}
    assert set(got) == {-3, -4} and got[-4] == 1
    assert tokens.document_sizes(docs).count() == docs.where("text is not null and text <> ''").count()
