"""Fresh files that share no wording with the tables: notices, denials, owners, folders, shapes."""

import pytest

from weftgraph.llm import machine_files as mf

HAND = "import os\n\n\ndef route(table):\n    for row in table:\n        yield row.key, os.sep\n"


@pytest.mark.parametrize(
    ("path", "text", "found"),
    [
        ("a/route.py", "# This file was automatically generated by gensvc and is used to configure routing. DO NOT EDIT.\n" + HAND, True),
        ("a/stub.py", "# Code generated by stubmaker; editing by hand is no longer supported. DO NOT EDIT.\n" + HAND, True),
        ("a/notice.py", "# Copyright (c) 2024 Acme GmbH\n" + HAND, False),
        ("a/licence.py", "# Released by our team under the MIT License\n" + HAND, False),
        ("a/constants.py", "# Constants taken from the ledger specification\n" + HAND, False),
        ("src/build/steps.py", HAND, False),
        ("deploy/target/select.py", HAND, False),
        ("docs/ext/plugin.py", HAND, False),
        ("src/codegen/emit.py", HAND, False),
        ("build/steps.py", HAND, True),
        ("lib/node_modules/x/i.py", HAND, True),
        ("a/old.py", "# This module was once generated from a schema, and has been written by people since.\n" + HAND, False),
        ("a/spoken.py", '# Puts a "Code generated by X. DO NOT EDIT." banner on top of what it prints.\n' + HAND, False),
        ("a/copy.py", "# Vendored copy of leftpad 1.2, see upstream.\n" + HAND, True),
        ("a/tiny.js", "var a=function(b){return b+1};module.exports={a:a,c:a(2)};", True),
        ("a/tiny_hand.js", "const a = (b) => b + 1;\nmodule.exports = { a, c: a(2) };\n", False),
        ("a/short.py", "X = 1\n", False),
        ("a/table.py", "T = [\n" + "".join(f'    ("{n:08x}", {n}),\n' for n in range(60)) + "]\n", True),
        ("a/empty.py", "", False),
        ("a/null.py", None, False),
        ("a/settings.json", '{"a": [1, 2, 3], "b": {"c": 4}}', False),
    ],
)
def test_fresh_files(path, text, found):
    assert bool(mf.classify(path, text, ())) is found


def test_owners_count_only_where_the_house_is_known():
    text = "# Copyright (c) 2024 Acme GmbH\n" + HAND
    assert mf.classify("a/x.py", text, ("own house",)) == ["vendored"] and mf.classify("a/x.py", text, ("acme gmbh",)) == []
