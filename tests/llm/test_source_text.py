"""Documentation pairs and machine-written files on small texts."""

import pytest

from weftgraph.llm import doc_pairs, doc_text, machine_files, source_spans

FILES = "repo_id string, path string, content string, language string, size long, kind string"


def files(spark, rows):
    return spark.createDataFrame([("r", p, c, None, 0, "clash") for p, c in rows], FILES)


PY = '''"""Module text that is no function's."""
import os

def plain(a, b: dict = {"x": ":"}) -> dict[str, int]:
    """Adds what was counted to the totals of the day."""
    return a

async def late(
    a,
):
    # a comment may stand between
    r\'\'\'Waits until the other side has answered at last.\'\'\'

def after_code(x):
    x += 1
    """This text comes too late to be documentation."""

class Box:
    """A class is no function at all."""

    def method(self): """One line with four words or more."""

    @property
    def outer(self):
        def inner():
            "Inner ones count just as well."
        return f"""def fake(): pass"""

text = """
def fake():
    \'\'\'This is text and not a function.\'\'\'
"""

def f_string():
    f"""Not a docstring as it is formatted."""

def parts():
    "First half of the text, " "second half of it."

def broken(:

def still_found(a):
    """Stands after what no parser accepts."""
'''

JS = """/** Reads the open rows and rounds at the end. */
export const rows = async (a, b) => {
  const re = /"\\/** no *\\/ function x() {}/g;
  return `function y() {} ${a.map((q) => { return q; })}`;
};

/** Too far away to belong to the function. */

function far() {}

/** Some code stands between these two things. */
let n = 1;
function between() {}

/**
 * Decides which of the keys are kept here.
 * @param {string} a - a long text about the parameter a
 */
@Sealed({a: 1})
export class C extends D {
  /** A field in between, not a method at all. */
  limit = 3;
  /** Keeps the last of several equal rows. */
  @Cached()
  static async keep<T>(a: T[], b = {x: 1}): Promise<void> {
    if (a) { return; }
  }
  /** Says what it does in enough words. */
  get size(): number { return 1; }
  bare() { /** not a doc of anything here at all */ }
}
/* Not a doc comment, so it does not count. */
function plainComment() {}
/** Named in an expression of its own here. */
const g = function () {};
"""


def found(spark, rows):
    return {(r["path"], r["name"], r["start_line"]) for r in doc_pairs.documented_functions(files(spark, rows)).collect()}


def test_python_docstrings(spark):
    names = {n for _, n, _ in found(spark, [("a.py", PY)])}
    assert names == {"plain", "late", "method", "inner", "parts", "still_found"}
    assert ("a.py", "late", 8) in found(spark, [("a.py", PY)])


def test_line_ends_and_marks_keep_line_numbers(spark):
    for end in ("\r\n", "\r"):
        assert ("a.py", "late", 8) in found(spark, [("a.py", "﻿" + PY.replace("\n", end))])


def test_javascript_comments(spark):
    assert found(spark, [("a.ts", JS)]) == {("a.ts", "rows", 2), ("a.ts", "keep", 25), ("a.ts", "size", 29), ("a.ts", "g", 35)}


def test_odd_files(spark):
    rows = [("a.py", None), ("b.py", ""), ("c.md", PY), ("d.js", "/** open"), ("e.js", "`${`${"), ("f.py", '"""open'), ("g.py", "x = (" * 3000), ("a.js", "}" * 500 + "/" * 99)]
    assert found(spark, rows) == set()
    twice = files(spark, [("a.py", PY)] * 3)
    assert doc_pairs.documented_functions(twice).count() == 6
    assert doc_pairs.documented_functions(twice.where("false")).count() == 0


@pytest.mark.parametrize(
    ("comment", "name", "trivial"),
    [
        ("", "f", True), ("Docs go here", "f", True), ("TODO: document this function", "f", True), ("Three words only", "f", True), ("Unpacks the limit region.", "unpackLimitRegion", True),
        ("This method will replay a member", "_replay_member", True), ("Replays every member of a file.", "_replay_member", False), (":param a: the first of many words\n:returns: a count of things", "f", True),
        ("Args:\n    a: one two three four five\nReturns:\n    a count of all things", "f", True), ("Walks all rows once.\n\nArgs:\n    a: rows", "f", False),
        ("/**\n * @param {number} a - long text about a thing\n * @returns {boolean}\n */", "f", True), ("/**\n * @description Walks all the rows once.\n */", "f", False), ("Reads rows of a day. TODO: leap years.", "f", False),
        ("Parameters\n----------\na : int\n    A long text about the parameter.\n", "f", True), ("{@inheritDoc}", "f", True),
    ],
)
def test_trivial(comment, name, trivial):
    assert doc_text.is_trivial(comment, name) is trivial


def test_spans_never_overlap_wrongly():
    for read, text in ((source_spans.python_spans, PY), (source_spans.javascript_spans, JS)):
        spans = read(text)
        assert len({(s.at, s.kind) for s in spans}) == len(spans)


HAND = "import { a } from './b';\n\nexport function price(rows) {\n  let total = 0;\n  for (const row of rows) {\n    total += row.amount;\n  }\n  return total;\n}\n"


@pytest.mark.parametrize(
    ("path", "content", "reasons"),
    [
        ("src/a.js", HAND, []),
        ("src/a.js", "// Code generated by maker 1.2; DO NOT EDIT.\n" + HAND, ["generated"]),
        ("src/a.js", HAND + "// end of file - written by maker 1.2 from a.yaml, edit the source instead\n", ["generated"]),
        ("src/a.py", '# Output of this module gets a "DO NOT EDIT" banner; edit the templates here by hand.\nx = 1\n', []),
        ("src/a.py", "# Not autogenerated any more: the old generator was dropped.\nx = 1\n", []),
        ("src/a.py", 'BANNER = "# Generated by {tool} - DO NOT EDIT"\n', []),
        ("src/a.py", "# Copyright (c) Hollowpine Systems. Internal use only.\nx = 1\n", []),
        ("src/a.py", "# SPDX-License-Identifier: MIT\n# Copyright 2010 Some Other Ltd\nx = 1\n", ["vendored"]),
        ("src/A.jcl", "//A JOB (X)\n//* BUILT BY MAKER 3.4 - DO NOT CHANGE BY HAND\n//S EXEC PGM=X\n", ["generated"]),
        ("web/node_modules/x/index.js", HAND, ["vendored"]),
        ("vendor_desk/generators/a.js", HAND, []),
        ("a/package-lock.json", "{}", ["generated"]),
        ("a/settings.json", "{}", []),
        ("a/x.min.js", None, ["minified"]),
        ("a/x.js", "var a=1;function b(c){return c?a:b(a)};" * 60, ["minified"]),
        ("a/x.py", "KEYS = [\n" + "    0.123, 0.456, 0.789,\n" * 40 + "]\n", ["data"]),
        ("a/x.py", "", []),
        ("a/x.py", "x = 1  # " + "long text " * 60 + "\n" + HAND * 6, []),
    ],
)
def test_machine_files(path, content, reasons):
    got = machine_files.classify(path, content, ("hollowpine systems",))
    assert set(got) & set(reasons) == set(reasons) and bool(got) == bool(reasons)


def test_machine_files_table(spark):
    rows = [("a.js", HAND), ("a.js", HAND), ("dist/b.js", HAND), ("dist/b.js", None), (None, HAND)]
    got = machine_files.machine_files(files(spark, rows)).collect()
    assert [(r["path"], list(r["reasons"])) for r in got] == [("dist/b.js", ["generated"])]
    assert machine_files.machine_files(files(spark, rows).where("false")).count() == 0


def test_generics_of_any_length():
    generics = ", ".join(f"T{n} extends Base{n}" for n in range(300))
    text = f"/** Reads the entry of a key. */\nexport const readEntry = <{generics}>(a) => {{ return a; }}\nclass A {{ /** Adds the rows up. */\n  add<{generics}>(x: Map<string, {{a: number}}>): void {{ }} }}"
    found = [s for s in source_spans.javascript_spans(text) if s.kind == "function"]
    assert [(s.name, s.line) for s in found] == [("readEntry", 2), ("add", 4)] and found[0].text.endswith(">(a)")
