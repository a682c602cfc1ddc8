"""Every registered query of the optional part runs, and the rest does not need it."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from weftgraph.llm import queries as llm

COLUMNS = {"p2_found": ["chunk_id_a", "chunk_id_b"], "p4_found": ["repo_id", "path"], "p5_found": ["repo_id", "path", "name", "start_line"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(set(llm.QUERIES) - {"p8_scores", "p8_rates"}))
def test_query(spark, data, name):
    df = llm.QUERIES[name](spark, data)
    assert df.columns == COLUMNS.get(name, df.columns)
    assert df.count() > 0


def test_registered():
    assert set(llm.QUERIES) <= set(entry.queries())


def test_core_does_not_import_it():
    code = "import sys; sys.modules['weftgraph.llm'] = None; import __spark_entry__ as e; assert e.llm is None; print(len(e.queries()))"
    root = Path(__file__).resolve().parents[2]
    assert int(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout) > 50
