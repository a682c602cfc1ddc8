"""Every match of a line is a fact."""

from tests.test_sources_and_engine import files, got
from weftgraph.sources import facts


def test_all_imports_of_a_line(spark):
    f = files(spark, a__py="import sys as s,os as o\nimport a.b, c  # no, d\nimport e; from f import g, h; import i")
    assert got(facts.python_facts(f)) == {(1, "import", "sys", ""), (1, "import", "os", ""), (2, "import", "a.b", ""), (2, "import", "c", ""), (3, "import", "e", ""), (3, "import", "f", "g, h"), (3, "import", "i", "")}


def test_all_matches_of_mainframe_lines(spark):
    cobol = "           SELECT X FROM ACCT A JOIN CUST C\n           PERFORM ONE PERFORM TWO\n           CALL 'P1' CALL 'P2'\n           EXEC CICS LINK PROGRAM('L1') END-EXEC EXEC CICS XCTL PROGRAM('L2')"
    f = files(spark, A__cbl=cobol, B__asm="         EXTRN E1,E2\n         DC A(=V(V1),=V(V2))")
    found = got(facts.mainframe_facts(f))
    assert {(1, "reads", "ACCT", ""), (1, "reads", "CUST", ""), (2, "perform", "ONE", ""), (2, "perform", "TWO", ""), (3, "call", "P1", ""), (3, "call", "P2", ""), (4, "transfer", "L1", "LINK"), (4, "transfer", "L2", "XCTL")} <= found
    assert {(1, "extern", "E1", ""), (1, "extern", "E2", ""), (2, "call", "V1", ""), (2, "call", "V2", "")} <= found
