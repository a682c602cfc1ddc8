"""Files that nobody wrote by hand here: generated, minified, vendored, or data stored as code.

Notices in comments are found by one multi-pattern automaton and rules on the path find folders and
names of tools (``_notice`` and ``_path``). Files without either are judged by the ratios of their
lines (``_body``): a separate part, stated in ratios of a file's own size, without a least size.
Everything is a property of one row, so the whole operator is one Arrow pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import clean_id

# Phrases of notices, matched in lower case with white space collapsed. A comment line is a notice when the
# hits of its clauses add up to 2 or more. Orders count as they stand; statements do not in a clause that denies them.
ORDERS = {
    2: """do not edit|do not modify|do not change|don't edit|don't modify|never edit|not to be edited|edit the source instead|edit the template instead|
        change the source instead|changes will be lost|changes are lost|changes will be overwritten|will be overwritten|are overwritten|is overwritten|gets overwritten|
        nicht von hand|nicht manuell|nicht bearbeiten|nicht editieren|ne pas modifier|ne pas éditer|ne pas changer|no modificar|no editar|no tocar""",
    1: "by hand|manually|-- do not",
}
GENERATED = {
    2: """@generated|auto-generated|autogenerated|auto generated|automatically generated|automatically created|created automatically|generated automatically|
        machine-generated|machine generated|generated by|generated from|generated using|generated with|code generated|generated file|generated code|
        symbolic map|bms map|dclgen table(|exported from the|output from the|expanded by the|taken from the catalog|replaced on every|
        automatisch erzeugt|automatisch generiert|automatisch erstellt|maschinell erzeugt|generierte datei|
        produit automatiquement|généré automatiquement|généré par|fichier généré|archivo generado|generado automáticamente|generado por|código generado""",
    1: "built by|produced by|emitted by|written by|created by|compiled by|compiled from|transpiled|output of the|sourcemappingurl=|signedsource<<|generator:|step of the build",
}
VENDORED = {
    2: """licensed materials|property of|copied unchanged|copied verbatim|copied from|copy of upstream|vendored from|vendored copy|bundled copy of|imported from upstream|
        upstream:|upstream version|taken over from|local changes: none|without local changes|supplied with|supplied by|redistributed under|distributed with|
        third-party code|third party code|forked from|backport of|originally from""",
    1: "javascript library|mit license|apache license|bsd license|bsd-style license|gnu general public|gnu lesser|mozilla public|isc license|spdx-license-identifier|@license|@preserve|all rights reserved by",
}
#: Words that deny or date back what a clause states (fixed values).
DENIED = re.compile(r"\b(?:not|no longer|never|no more|any ?more|isn't|wasn't|used to be|was once|were once|formerly|previously|until|rewritten|instead of|nicht mehr|kein|früher|plus jamais|n'est plus|ya no)\b(?!\s+to\s+be\s+edited)")
_CLAUSE = re.compile(r"[;:.!?]\s+|\s[-–—|]+\s|,\s+(?:but|und|mais|pero)\b")

# Names of folders and files by common convention.
DEPENDENCY_FOLDERS = set("node_modules bower_components jspm_packages site-packages dist-packages venv .venv virtualenv vendor vendors _vendor vendored third_party third-party thirdparty 3rdparty 3rd-party 3rd_party godeps".split())
GENERATED_FOLDERS = set("generated generated-sources generated-src generated_sources gen-src autogen __generated__ _generated .next".split())
#: Folders into which tools write where they stand at the root; elsewhere the words also name hand-written parts.
ROOT_OUTPUT_FOLDERS = set("dist build out target pods external externals gen".split())
FILE_NAMES = re.compile(
    r"(?:[.-]min\.(?:js|css|mjs)|[.-]bundle\.(?:js|css)|\.chunk\.js|\.pack\.js|\.map|_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|cc|h)|_pb\.(?:js|ts)|\.g\.(?:dart|cs|ts)|\.generated\.\w+|\.designer\.cs|\.d\.ts\.map"
    r"|[.-]lock(?:file)?(?:\.(?:json|ya?ml|toml))?)$|^(?:package-lock\.json|npm-shrinkwrap\.json|pnpm-lock\.ya?ml|yarn\.lock|poetry\.lock|pipfile\.lock|composer\.lock|cargo\.lock|gemfile\.lock|go\.sum)$"
)
#: Suffixes of languages in fixed form, and of those that have one statement a line at any rate.
FIXED_FORM, ONE_STATEMENT_A_LINE = ("cbl", "cpy", "cob", "asm", "s"), ("jcl", "csd", "bms")
SETTINGS = re.compile(r"\.(?:json|ya?ml|toml|ini|cfg|conf|env|properties|md|rst|txt|xml|html?)$")
OWNER = re.compile(r"(?:copyright|\(c\)|©)[\s:,]*(?:\(c\)|©)?[\s,]*(?:\d{4}(?:\s*[-–,]\s*\d{4})*)?[\s,]*(?:by\s+)?(?P<owner>[^|\n]*)", re.I)
PROPERTY = re.compile(r"property of\s+(?P<owner>[^|\n]*)", re.I)

#: Lines at the head and the foot of a file in which a notice may stand beside code (a job card, a module name); leading comments count at any length.
EDGE_LINES = 12
FOOT_LINES = 6


@lru_cache(maxsize=1)
def _notices() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for kind, table in (("order", ORDERS), ("generated", GENERATED), ("vendored", VENDORED)):
        for weight, phrases in table.items():
            for phrase in phrases.split("|"):
                phrase = " ".join(phrase.split())
                automaton.add_word(phrase, (kind, weight, len(phrase)))
    automaton.make_automaton()
    return automaton


def _comments(lines: list[str], path: str, foot: int) -> list[str]:
    """The comment lines among the leading comments, the first EDGE_LINES and the last ``foot`` lines, without their marks."""
    suffix = path.rpartition(".")[2].lower()
    plain = {"py": r"#", "pyi": r"#", "yaml": r"#", "yml": r"#", "sh": r"#", "rb": r"#", "toml": r"#", "jcl": r"//\*", "cbl": r"\*", "cpy": r"\*", "cob": r"\*", "asm": r"\.?\*", "sql": r"--", "md": r"<!--", "html": r"<!--", "xml": r"<!--"}.get(suffix, r"//")
    fixed = suffix in ("cbl", "cpy", "cob")
    mark, block, found, leading = re.compile(rf"\s*(?:\d{{6}})?{plain}+"), None, [], True
    last = len(lines) - foot
    for i, line in enumerate(lines):
        if not leading and EDGE_LINES <= i < last and block is None:
            if i < last - 1:
                continue
        text = None
        if block:
            text, end, _ = line.partition(block)
            if end:
                block = None
        elif m := mark.match(line):
            text = line[m.end() :]
        elif fixed and re.match(r".{6}[*/]", line):
            text = line[7:]
        elif plain == "//" and (m := re.match(r"\s*(/\*|\*)", line)):
            text, end, _ = line[m.end() :].partition("*/")
            block = "*/" if not end and m[1] == "/*" else None
        elif plain == "<!--" and "<!--" in line:
            text = line
        elif plain == "#" and leading and (m := re.match(r"\s*[rRuU]?('''|\"\"\")", line)):
            text, end, _ = line[m.end() :].partition(m[1])
            block = None if end else m[1]
        elif line.strip() and not line.startswith(("#!", "﻿")):
            leading = False
        if text is not None:
            found.append(text)
    return found


def _notice(comments: list[str], in_house: tuple[str, ...]) -> set[str]:
    """What the comment lines say of the file. Owners tell a third party's file only where the in-house owners are known."""
    reasons: set[str] = set()
    for line in comments:
        text = " ".join(line.lower().split()).strip("*#/-=! ")
        if not text:
            continue
        said = re.sub(r"[\"“”«»][^\"“”«»]*[\"“”«»]|'[^']{6,}'", " ", text)  # a quoted notice is spoken about
        ends = [m.start() for m in _CLAUSE.finditer(said)]
        denied: dict[int, bool] = {}
        found: Counter = Counter()
        for end, (kind, weight, length) in _notices().iter(said):
            clause = sum(e <= end - length + 1 for e in ends)
            if clause not in denied:
                start = ends[clause - 1] if clause else 0
                denied[clause] = bool(DENIED.search(said, start, ends[clause] if clause < len(ends) else len(said)))
            if kind == "order" or not denied[clause]:
                found["generated" if kind == "order" else kind] += weight
        ours = any(o in text for o in in_house)
        if found["generated"] >= 2 or found["generated"] == 1 and re.search(r"\d+\.\d|sourcemappingurl|<<", text):
            reasons.add("generated")
        if found["vendored"] >= 2 and not ours:
            reasons.add("vendored")
        for m in (OWNER.search(text), PROPERTY.search(text)) if in_house and not ours else ():
            owner = re.sub(r"[\W_]+", " ", m["owner"]).strip() if m else ""
            if len(owner) > 2 and not re.match(r"(?:notice|header|line|text|holder|check|year|info)\b", owner):
                reasons.add("vendored")
    return reasons


_LITERAL = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|[-+]?\b(?:0[xX][\da-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)\b|\b(?:true|false|null|None|True|False)\b")
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_RECORD = re.compile(r"[^;,|\t(){}=]*(?:[;,|\t][^;,|\t(){}=]*){2,}$")
_ENCODED = re.compile(r"[\s'\"`+,\\]*[A-Za-z0-9+/=_-]{40,}[\s'\"`+,;\\)]*")
_MAP_FIELD = re.compile(r"^\s+\d\d\s+\w+(?:[LFAIO]|\d[LFAIO])\s+(?:COMP\s+)?PIC|REDEFINES\s+\w+F\b", re.I)
_TABLE_ROW = re.compile(r"FILLER\s+PIC\S*\s+X\(\d+\)\s+VALUE\s+'|^\S*\s+DC\s+\d*X(?:L\d+)?'[0-9A-F]+'", re.I)


#: Statement marks a line, and at most this share of blanks, of minified text: hand-written text has one or two marks a line and a tenth of blanks or more.
MINIFIED_MARKS, MINIFIED_BLANKS = 3.0, 0.12
#: Text is data up to this share of names outside literals, and from these shares of lines of literals only, of records with the same separators, of encoded bytes.
NAMES, BARE_LINES, RECORDS, ENCODED = 0.04, 0.75, 0.75, 0.7
#: Different shapes of lines, as a share of all lines, up to which only a program wrote them; shares of map fields and table rows in fixed-form source.
SHAPES, MAP_FIELDS, TABLE_ROWS = 0.065, 0.6, 0.7


def _body(lines: list[str], path: str) -> set[str]:
    """Minified text, data stored as code, and bodies of the uniform shape that only a program writes. Every bound is a ratio."""
    reasons: set[str] = set()
    full = [x for x in lines if x.strip()]
    if not full or SETTINGS.search(path.lower()):
        return reasons
    size, n = sum(map(len, full)), len(full)
    suffix = path.lower().rpartition(".")[2]
    if suffix in FIXED_FORM:
        if sum(bool(_TABLE_ROW.search(x)) for x in full) > TABLE_ROWS * n:
            reasons.add("data")
        if sum(bool(_MAP_FIELD.search(x)) for x in full) > MAP_FIELDS * n:
            reasons.add("generated")
        return reasons
    if suffix in ONE_STATEMENT_A_LINE:
        return reasons
    rest = [_LITERAL.sub("0", x.strip()) for x in full]
    names = sum(len(w) for b in rest for w in _WORD.findall(b)) / size
    blanks = sum(x.count(" ") + x.count("\t") for x in full) / size
    marks = sum(x.count(";") + x.count("{") + x.count("}") for x in rest) / n
    if names <= NAMES:
        reasons.add("data")
    elif marks >= MINIFIED_MARKS and blanks <= MINIFIED_BLANKS:
        reasons.add("minified")
    bare = sum(len(x) for x, b in zip(full, rest) if not _WORD.search(re.sub(r"^\w+:", "", b)))
    records = Counter(re.sub(r"[^;,|\t]", "", x) for x in full if _RECORD.fullmatch(x.strip()) and re.search(r"\d", x))
    encoded = sum(len(x) for x in full if _ENCODED.fullmatch(x))
    if bare > BARE_LINES * size or records and records.most_common(1)[0][1] > RECORDS * n or encoded > ENCODED * size:
        reasons.add("data")
    if len({_WORD.sub("w", re.sub(r"\d+", "9", b)) for b in rest}) <= SHAPES * n:
        reasons.add("generated")
    return reasons


def _path(path: str) -> set[str]:
    reasons: set[str] = set()
    *folders, name = path.lower().split("/")
    for n, f in enumerate(folders):
        if f in DEPENDENCY_FOLDERS:
            reasons.add("vendored")
        elif f in GENERATED_FOLDERS or n == 0 and f in ROOT_OUTPUT_FOLDERS:
            reasons.add("generated")
    if m := FILE_NAMES.search(name):
        reasons.add("minified" if "min." in m[0] or "bundle" in m[0] or "chunk" in m[0] else "generated")
    return reasons


def classify(path: str, content: str | None, in_house: tuple[str, ...]) -> list[str]:
    """The reasons, sorted, why a file is not hand-written source; empty for hand-written files and plain settings."""
    reasons = _path(path)
    if content:
        lines = re.split(r"\r\n|\r|\n", content.removeprefix("﻿"))
        reasons |= _notice(_comments(lines, path, FOOT_LINES), in_house)
        reasons |= _body(lines, path)
    return sorted(reasons)


def machine_files(files: DataFrame, in_house: tuple[str, ...] = ()) -> DataFrame:
    """(repo_id, path, reasons) of every file that is not hand-written source.

    ``reasons`` are of generated, minified, vendored and data. ``in_house`` are owners, in lower
    case, whose notices do not make a file a third party's, as those of any other owner do; without
    them owners say nothing. A null content is judged by its path,
    a null path or repo_id gives no row. Rows stored twice come out once; if two contents of a path
    differ, their reasons are united. ``language`` and ``size`` may be wrong and are not relied on.
    """
    source = files.select(clean_id("repo_id").alias("repo_id"), clean_id("path").alias("path"), "content").where("repo_id is not null and path is not null")
    schema = T.StructType.fromDDL("repo_id string, path string, reasons array<string>")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            reasons = [classify(p, c, in_house) for p, c in zip(b["path"], b["content"])]
            b = b[["repo_id", "path"]].assign(reasons=reasons)
            yield b[b["reasons"].str.len() > 0]

    found = source.mapInPandas(judge, schema)
    return found.groupBy("repo_id", "path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons"))
