"""Repositories, commit logs, symbol indexes, and control flow of mainframe members."""

import subprocess

from pyspark.sql import functions as F

from weftgraph.operators import control_flow as cf
from weftgraph.sources import commits, repository, scip

FILES = "repo_id string, path string, indexed_at string, content string"


def test_repository_reads_what_is_source(spark, tmp_path):
    for path, text in {"pkg/__init__.py": "x = 1", ".env": "KEY=1", "pkg/deep/a.py": "é", "node_modules/x.js": "no", "skip/b.txt": "no", "top.min.js": "no", "c.py": ""}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "bin.dat").write_bytes(b"a\0b")
    (tmp_path / ".gitignore").write_text("# comment\nskip/\n!keep\n\n")
    spark.dataSource.register(repository.SourceRepository)
    got = {r["path"]: r for r in spark.read.format("source_repository").load(str(tmp_path)).collect()}
    assert set(got) == {"pkg/__init__.py", ".env", "pkg/deep/a.py", "c.py", ".gitignore"}
    assert got["pkg/deep/a.py"]["content"] == "é" and got["c.py"]["size"] == 0
    assert {r["repo_id"] for r in got.values()} == {repository.repo_id(str(tmp_path))}


def test_commits_and_churn(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=A", "-c", "user.email=a@x", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    for n in range(2):
        (tmp_path / "f.py").write_text(str(n))
        (tmp_path / f"g{n}.py").write_text("")
        run("add", "-A")
        run("commit", "-qm", f"change {n}")
    logs = spark.createDataFrame([("r", commits.log_text(str(tmp_path))), ("none", commits.log_text(str(tmp_path / "absent"))), ("null", None)], "repo_id string, log string")
    found = commits.commits(spark, logs)
    assert {(r["repo_id"], r["message"], tuple(r["files"])) for r in found.collect()} == {("r", "change 0", ("f.py", "g0.py")), ("r", "change 1", ("f.py", "g1.py"))}
    assert {(r["path"], r["commits"], tuple(r["authors"])) for r in commits.churn(found).collect()} == {("f.py", 2, ("a@x",)), ("g0.py", 1, ("a@x",)), ("g1.py", 1, ("a@x",))}


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def occurrence(line, symbol, definition=False):
    return field(2, field(1, varint(line) + varint(4) + varint(9)) + field(2, symbol.encode()) + field(3, int(definition)))


def test_symbol_index(spark):
    a = field(2, field(1, b"a.py") + occurrence(199, "sym f", True) + occurrence(3, "local 1", True))
    b = field(2, field(1, b"b.py") + occurrence(11, "sym f") + occurrence(40, "sym f") + occurrence(12, "sym none"))
    index = field(1, b"metadata") + a + b
    frame = spark.createDataFrame([("i.scip", bytearray(index)), ("cut.scip", bytearray(index[:20])), ("none.scip", None)], "path string, content binary")
    found = scip.occurrences(frame)
    assert {tuple(r)[1:] for r in found.where("source = 'i.scip'").collect()} == {("a.py", 200, "sym f", True), ("b.py", 12, "sym f", False), ("b.py", 41, "sym f", False), ("b.py", 13, "sym none", False)}
    spans = spark.createDataFrame([("r", "a.py", 201, 210, "f"), ("r", "b.py", 1, 50, "outer"), ("r", "b.py", 10, 20, "inner"), ("q", "b.py", 11, 12, "elsewhere")], "repo_id string, path string, start_line int, end_line int, span_id string")
    assert {tuple(r) for r in scip.proven_edges(found.withColumn("repo_id", F.lit("r")), spans).collect()} == {("r", "inner", "f", "b.py", 12), ("r", "outer", "f", "b.py", 41)}


def test_hlasm_blocks(spark):
    text = "PROG     CSECT\n* comment\n         LR    R1,R2\n         BE    DONE\n         AR    R1,R3\nLOOP     BCT   R4,LOOP\n         B     DONE\nDEAD     LR    R1,R1\nDONE     BR    R14\n"
    blocks = cf.hlasm_blocks(spark.createDataFrame([("r", "P.asm", "1", text)], FILES))
    assert [(r["block"], r["first_line"], r["last_line"], r["kind"], r["target"]) for r in blocks.orderBy("block").collect()] == [
        (1, 3, 4, "branch", "DONE"), (2, 5, 5, "fall", None), (3, 6, 6, "branch", "LOOP"), (4, 7, 7, "jump", "DONE"), (5, 8, 8, "fall", None), (6, 9, 9, "end", None)]
    assert {(r["src"], r["dst"], r["kind"]) for r in cf.block_edges(blocks).collect()} == {(1, 2, "fall"), (1, 6, "branch"), (2, 3, "fall"), (3, 4, "fall"), (3, 3, "branch"), (4, 6, "jump"), (5, 6, "fall")}


def test_cobol_paragraphs(spark):
    text = "       PROCEDURE DIVISION.\n       MAIN-PARA.\n           PERFORM WORK-PARA\n           GO TO END-PARA.\n       WORK-PARA.\n           PERFORM UNKNOWN-PARA.\n       END-PARA.\n           STOP RUN.\n       LAST-PARA.\n           EXIT.\n"
    got = {(r["src"], r["dst"], r["kind"]) for r in cf.cobol_paragraph_edges(spark.createDataFrame([("r", "P.cbl", "1", text)], FILES)).collect()}
    assert got == {("MAIN-PARA", "WORK-PARA", "perform"), ("MAIN-PARA", "END-PARA", "goto"), ("WORK-PARA", "END-PARA", "fall")}
