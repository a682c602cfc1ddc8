"""The stored graph as the ladder takes it: calls that only an ancestor class resolves."""

from weftgraph.queries import text


def test_ladder_of_the_stored_graph_knows_ancestors(spark, tmp_path):
    ent = "id string, kind string, name string, qualified_name string, repo_id string, path string, start_line int, end_line int, attributes string, indexed_at timestamp_ntz, deleted_at timestamp_ntz"
    rel = "id string, type string, src_id string, dst_id string, repo_id string, path string, start_line int, confidence double, attributes string, indexed_at timestamp_ntz, received_at timestamp_ntz"
    own = [("C", "class", "m1.C", "m1"), ("C.go", "method", "m1.C.go", "m1"), ("P", "class", "m2.P", "m2"), ("P.base", "method", "m2.P.base", "m2"), ("Q", "class", "m3.Q", "m3"), ("Q.base", "method", "m3.Q.base", "m3"), ("P2", "class", "m4.P", "m4"), ("P2.base", "method", "m4.P.base", "m4")]
    rows = [(i, k, q.rpartition(".")[2], q, "r", f"{m}.py", 1, 2, f'{{"module": "{m}"}}', None, None) for i, k, q, m in own]
    spark.createDataFrame(rows, ent).write.parquet(str(tmp_path / "entities.parquet"))
    edges = [("e1", "extends", "C", "P"), ("e2", "calls", "C.go", "unknown.base")]
    spark.createDataFrame([(i, t, a, b, "r", "m1.py", 1, 0.9, "{}", None, None) for i, t, a, b in edges], rel).write.parquet(str(tmp_path / "relationships.parquet"))
    got = [tuple(x) for x in text.QUERIES["ladder_resolution"](spark, str(tmp_path)).collect()]
    assert got == [("e2", "P.base", "inherited", 0.9, 1)]
