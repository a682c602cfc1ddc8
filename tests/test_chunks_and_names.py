"""Chunks and embeddings against brute force, names of modules, and edges that files resolve to, on small tables."""

import hashlib
import math
import re

from pyspark.sql import functions as F

from weftgraph.functions import names
from weftgraph.operators import chunks, graph, resolve, versions, views

FILES = "repo_id string, path string, content string, indexed_at string, extra int"
ENT = "id string, kind string, name string, qualified_name string, repo_id string, path string, start_line int, end_line int, module string, missing boolean, external boolean, docstring string, deleted_at timestamp"


def ent(spark, rows):
    return spark.createDataFrame([(i, k, n, q, "r", p, a, b, m, False, False, "", None) for i, k, n, q, p, a, b, m in rows], ENT)


def test_chunks_cover_every_line_that_says_something(spark):
    text = "\n".join(f"line {n}" if n % 90 else "" for n in range(1, 501))
    files = spark.createDataFrame([("r", "a.py", text, "2", 0), ("r", "a.py", "old", "1", 0), ("r", "b.toml", "key = 1", "1", 0), ("r", "c.py", "\n \n", "1", 0), ("r", "d.py", None, "1", 0), ("r", "e.py", "", "1", 0)], FILES)
    e = ent(spark, [("f", "function", "f", "f", "a.py", 10, 20, "a"), ("g", "class", "g", "g", "a.py", 5, 30, "a"), ("h", "function", "h", "h", "a.py", 100, 900, "a"), ("odd", "function", "o", "o", "a.py", 9, 3, "a"), ("v", "variable", "v", "v", "a.py", 1, 2, "a")])
    got = {(r["start_line"], r["end_line"]): r["span_id"] for r in chunks.build_chunks(files, e).collect()}
    assert got == {(1, 4): None, (5, 9): "g", (10, 20): "f", (21, 30): "g", (31, 90): None, (81, 99): None, (100, 299): "h", (290, 489): "h", (480, 500): "h"}


def test_hash_embedding_is_the_signed_sum_of_token_hashes(spark):
    texts = ["def readEntry(a): return a", "", None, "x x y"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, text string")
    c = df.select(F.concat(F.lit("c"), "n").alias("chunk_id"), F.lit("r").alias("repo_id"), "text")
    got = {r["chunk_id"]: r["vector"] for r in chunks.embed_chunks(c, 16).collect()}
    for n, t in enumerate(texts):
        v = [0.0] * 16
        for word in re.findall(r"[A-Za-z_]\w*", t or ""):
            parts = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", word)]
            for w in [word.lower(), *(parts if len(parts) > 1 else [])]:
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % 16] += 1.0 if h >> 63 else -1.0
        length = math.sqrt(sum(x * x for x in v)) or 1.0
        assert all(abs(a - b / length) < 1e-6 for a, b in zip(got[f"c{n}"], v))


def test_module_names_and_relative_imports(spark):
    df = spark.createDataFrame([("src/a/b.py",), ("src/a/__init__.py",), ("src/legacy/DateCnv.cbl",), ("index.js",), (None,)], "p string")
    assert [r[0] for r in df.select(names.module_name("p")).collect()] == ["src.a.b", "src.a", "DATECNV", "index", None]
    m = spark.createDataFrame([("src.a.b",)], "m string")
    py = lambda w, package=False: m.select(names.python_import("m", F.lit(w), F.lit(package))).first()[0]
    assert [py("."), py(".c"), py("..c.d"), py("....x"), py("os.path"), py(".c", True)] == ["src.a", "src.a.c", "src.c.d", "x", "os.path", "src.a.b.c"]
    js = lambda w: m.select(names.javascript_import("m", F.lit(w))).first()[0]
    assert [js("./c"), js("../x/y.ts"), js("../index"), js("lodash/fp")] == ["src.a.c", "src.x.y", "src", "lodash/fp"]
    assert spark.range(1).select(names.is_external_name(F.lit("dfhcommx")), names.is_external_name(F.lit("LEDGER")), names.is_external_name(F.lit(None).cast("string"))).first()[:] == (True, False, False)


def test_merged_attributes_skip_nulls(spark):
    df = spark.sql("select map('a', '1', 'b', null) as x, map('b', '2', 'a', null) as y, cast(null as map<string,string>) as z")
    assert df.select(names.merge_attributes("x", "y"), names.merge_attributes("z", "y"), names.merge_attributes("x", "z")).first()[:] == ({"a": "1", "b": "2"}, {"b": "2"}, {"a": "1"})


def test_types_resolve_by_the_nearest_scope(spark):
    e = ent(spark, [("m1", "class", "Base", "m1.Base", "m1.py", 1, 2, "m1"), ("m2", "class", "Base", "m2.Base", "m2.py", 1, 2, "m2"), ("m3", "interface", "Only", "m3.Only", "m3.py", 1, 2, "m3"), *[(f"x{n}", "class", "Many", f"x{n}.Many", f"x{n}.py", 1, 2, f"x{n}") for n in range(6)]])
    refs = spark.createDataFrame([("r", "m1", "A", "Base"), ("r", "m9", "B", "pkg.Base"), ("r", "m8", "C", "Base"), ("r", "m8", "D", "Only"), ("r", "m8", "E", "Many"), ("r", "m8", "F", "Gone"), ("r", "m8", "F", "")], "repo_id string, module string, owner string, name string")
    imported = spark.createDataFrame([("r", "m9", "m2"), ("r", "m9", "m2")], "repo_id string, module string, imported string")
    got = resolve.types(refs, e, imported)
    assert {r["owner"]: (r["target_id"], r["resolution"]) for r in got.collect()} == {"A": ("m1", "same-module"), "B": ("m2", "imported"), "C": ("m1", "candidate"), "D": ("m3", "unique"), "E": (None, "missing"), "F": (None, "missing")}
    assert {(r["owner"], r["type"]) for r in resolve.inheritance(got).collect()} == {("A", "extends"), ("B", "extends"), ("C", "references"), ("D", "implements")}
    assert resolve.types(refs.where("false"), e, imported).count() == 0


def test_bound_calls(spark):
    e = ent(spark, [("f", "function", "run", "pkg.run", "p.py", 1, 2, "pkg"), ("c", "class", "Box", "pkg.Box", "p.py", 1, 2, "pkg")])
    calls = spark.createDataFrame([("1", "r", "m", "pkg.run"), ("2", "r", "m", "Box"), ("3", "r", "m", "pkg.gone"), ("4", "r", "m", "free")], "call_id string, repo_id string, module string, name string")
    binds = spark.createDataFrame([("r", "m", "pkg", "pkg"), ("r", "m", "Box", "pkg.Box")], "repo_id string, module string, local string, target string")
    assert {tuple(r) for r in resolve.bound_calls(calls, binds, e).collect()} == {("1", "f", "import-traced"), ("2", "c", "constructor"), ("3", None, "missing")}


def test_entries_and_triggers(spark):
    e = ent(spark, [("job", "jcl_job", "NIGHT", "NIGHT", "n.jcl", 1, 2, None), ("p", "legacy_program", "P", "P", "p.cbl", 1, 2, None), ("q", "legacy_program", "Q", "Q", "q.cbl", 1, 2, None), ("t", "database_table", "T", "T", "", 1, 1, None)])
    rels = spark.createDataFrame([("1", "runs", "job", "p", "r", "n.jcl", None, False), ("2", "calls", "p", "q", "r", "p.cbl", "syntactic", False), ("3", "reads", "job", "t", "r", "n.jcl", None, False), ("4", "writes", "q", "t", "r", "q.cbl", None, False)], "id string, type string, src_id string, dst_id string, repo_id string, path string, resolution string, pruned boolean")
    starts = spark.createDataFrame([("q",)], "id string")
    assert {tuple(r) for r in graph.triggers(rels, e, starts).collect()} == {("q", "job", "jcl_job", 2)}
    assert {tuple(r) for r in views.downstream(e, rels).collect()} == {("job", 1, 1)}
    assert {tuple(r) for r in views.walkthrough_starts(e, rels).collect()} == {("r", "job", 2)}
    flow = graph.flow(rels, spark.createDataFrame([("job",)], "id string"), 3)
    assert {tuple(r) for r in views.capabilities(flow).collect()} == {("job", 2, 1, 1, 1)}


def test_versions_and_deletes(spark):
    v = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "name string, version int, content string")
    one = spark.createDataFrame([("new",)], "content string")
    assert versions.next_version(v, "a", one).first()[:] == ("a", 3, "new") and versions.next_version(v, "c", one).first()[:] == ("c", 1, "new")
    assert {tuple(r) for r in versions.current(v).collect()} == {("a", 2, "y"), ("b", 1, "z")}
    p = spark.createDataFrame([("k1", "t", 1, 1), ("k2", "t", 1, 1)], "k string, term string, tf int, length int")
    fresh = spark.createDataFrame([("k1", "u", 2, 2), ("k2", None, 0, 0)], "k string, term string, tf int, length int")
    assert {tuple(r) for r in versions.refreshed_postings(p, fresh, "k").collect()} == {("k1", "u", 2, 2)}
    tables = versions.without_repository({"files": spark.createDataFrame([("r",), ("q",), (None,)], "repo_id string"), "churn": spark.createDataFrame([("r",)], "repo_id string")}, "r")
    assert tables["files"].count() == 2 and tables["churn"].count() == 1
