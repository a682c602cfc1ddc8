"""Facts that single lines of source state, taken out with column expressions: one exploded row per line, no Python.

Each fact is (repo_id, path, line, fact, name, detail). The newest stored content of a path counts;
null contents have no facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.metrics import language_of, lines
from ..tables import clean_id


def source_lines(files: DataFrame, *languages: str) -> DataFrame:
    """(repo_id, path, language, line, text): the lines of the files of some languages, by path, numbered from 1."""
    path = clean_id("path")
    own = files.select(clean_id("repo_id").alias("repo_id"), path.alias("path"), language_of(path).alias("language"), "indexed_at", "content")
    own = own.where(F.col("language").isin(*languages) & F.col("content").isNotNull())
    newest = own.groupBy("repo_id", "path", "language").agg(F.max_by("content", "indexed_at").alias("content"))
    return newest.select("repo_id", "path", "language", F.posexplode(lines(F.regexp_replace("content", "^﻿", ""))).alias("n", "text")).select("repo_id", "path", "language", (F.col("n") + 1).alias("line"), "text")


def _fact(language: str, fact: str, pattern: str, name: int = 1, detail: int = 0, upper: bool = False, listed: bool = False) -> Column:
    """The facts of every match in the line; name and detail are groups of the pattern. A ``listed`` name is several, parted by commas."""
    text = F.upper("text") if upper else F.col("text")
    every = lambda group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    names = F.filter(F.flatten(F.transform(every(name), lambda x: F.split(x, ","))), lambda x: x != "") if listed else every(name)
    pairs = F.zip_with(names, every(detail), lambda x, y: F.struct(F.lit(fact).alias("fact"), x.alias("name"), F.coalesce(y, F.lit("")).alias("detail"))) if detail else F.transform(names, lambda x: F.struct(F.lit(fact).alias("fact"), x.alias("name"), F.lit("").alias("detail")))
    return F.when((F.col("language") == language) & text.rlike(pattern), pairs)


def _facts(rows: DataFrame, *facts: Column) -> DataFrame:
    found = rows.select("repo_id", "path", "line", F.explode(F.flatten(F.array_compact(F.array(*facts)))).alias("f"))
    return found.select("repo_id", "path", "line", "f.fact", "f.name", "f.detail")


#: COBOL words that stand where a paragraph name could (fixed values).
COBOL_WORDS = ("EXIT", "GOBACK", "END-IF", "END-EXEC", "END-PERFORM", "END-EVALUATE", "STOP", "CONTINUE", "ELSE")


def mainframe_facts(files: DataFrame) -> DataFrame:
    """Programs, copies, calls, data access and paragraphs of COBOL, steps and data sets of JCL, sections and links of HLASM, screens of BMS, definitions of CSD."""
    rows = source_lines(files, "cobol", "jcl", "hlasm", "bms", "csd")
    comment = ((F.col("language") == "cobol") & F.col("text").rlike(r"^(.{6}[*/]|\s*\*>)")) | ((F.col("language") == "jcl") & F.col("text").startswith("//*")) | (F.col("language").isin("hlasm", "bms") & F.col("text").rlike(r"^\.?\*"))
    rows = rows.where(~comment)
    c, j, h, b, d = "cobol", "jcl", "hlasm", "bms", "csd"
    return _facts(
        rows,
        _fact(c, "program", r"\bPROGRAM-ID\.\s*([A-Z0-9$#@-]+)", upper=True),
        _fact(c, "copy", r"^.{0,10}\s*COPY\s+([A-Z0-9$#@-]+)", upper=True),
        _fact(c, "include", r"\bEXEC\s+SQL\s+INCLUDE\s+([A-Z0-9$#@-]+)", upper=True),
        _fact(c, "call", r"\bCALL\s+['\"]([A-Z0-9$#@-]+)['\"]", upper=True),
        _fact(c, "call-dynamic", r"\bCALL\s+([A-Z][A-Z0-9-]*)\b", upper=True),
        _fact(c, "transfer", r"\bEXEC\s+CICS\s+(XCTL|LINK)\b.*?PROGRAM\s*\(\s*['\"]?([A-Z0-9$#@-]+)", name=2, detail=1, upper=True),
        _fact(c, "reads", r"\b(?:FROM|JOIN)\s+([A-Z][A-Z0-9_.]*)", upper=True),
        _fact(c, "writes", r"\b(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM)\s+([A-Z][A-Z0-9_.]*)", upper=True),
        _fact(c, "file", r"\bSELECT\s+([A-Z0-9-]+)\s+ASSIGN\s+(?:TO\s+)?([A-Z0-9-]+)", detail=2, upper=True),
        _fact(c, "perform", r"\bPERFORM\s+([A-Z0-9-]+)", upper=True),
        F.when(~F.upper(F.trim(F.regexp_replace("text", r"\.\s*$", ""))).isin(*COBOL_WORDS), _fact(c, "paragraph", r"^.{7}([A-Z0-9][A-Z0-9-]*)\.\s*$", upper=True)),
        _fact(j, "job", r"^//([A-Z0-9$#@]+)\s+JOB\b", upper=True),
        _fact(j, "runs", r"^//([A-Z0-9$#@.]*)\s+EXEC\s+PGM=([A-Z0-9$#@&]+)", name=2, detail=1, upper=True),
        _fact(j, "procedure", r"^//([A-Z0-9$#@.]*)\s+EXEC\s+(?:PROC=)?([A-Z0-9$#@&]+)\s*(?:,|$)", name=2, detail=1, upper=True),
        _fact(j, "dataset", r"^//[A-Z0-9$#@.]*\s+DD\s+.*\bDSN(?:AME)?=([A-Z0-9$#@.&()+-]+)(?:.*\bDISP=\(?([A-Z]+))?", detail=2, upper=True),
        _fact(h, "section", r"^(\S+)\s+(CSECT|RSECT|START)\b", detail=2, upper=True),
        _fact(h, "entry", r"^\S*\s+ENTRY\s+(\S+)", upper=True, listed=True),
        _fact(h, "extern", r"^\S*\s+W?EXTRN\s+(\S+)", upper=True, listed=True),
        _fact(h, "call", r"^\S*\s+CALL\s+([A-Z0-9$#@]+)", upper=True),
        _fact(h, "call", r"=V\(([A-Z0-9$#@]+)\)", upper=True),
        _fact(h, "copy", r"^\S*\s+COPY\s+([A-Z0-9$#@]+)", upper=True),
        _fact(b, "mapset", r"^(\S+)\s+DFHMSD\b", upper=True),
        _fact(b, "map", r"^(\S+)\s+DFHMDI\b", upper=True),
        _fact(d, "transaction", r"\bDEFINE\s+TRANSACTION\s*\(\s*(\w+)", upper=True),
        _fact(d, "invokes", r"\bPROGRAM\s*\(\s*(\w+)", upper=True),
        _fact(d, "dataset", r"\bDSN(?:AME)?\s*\(\s*([\w.]+)", upper=True),
    )


def call_literals(facts: DataFrame, moves: DataFrame) -> DataFrame:
    """(repo_id, path, line, name): dynamic calls whose variable is given exactly one literal and nothing else.

    ``moves``: (repo_id, path, variable, literal), the literal null where something else is moved.
    """
    reaching = moves.groupBy("repo_id", "path", "variable").agg(F.min("literal").alias("literal"), F.count_distinct("literal").alias("n"), F.max(F.col("literal").isNull()).alias("tainted"))
    dynamic = facts.where("fact = 'call-dynamic'").select("repo_id", "path", "line", F.col("name").alias("variable"))
    return dynamic.join(reaching.where("n = 1 and not tainted"), ["repo_id", "path", "variable"]).select("repo_id", "path", "line", F.col("literal").alias("name"))


def cobol_moves(files: DataFrame) -> DataFrame:
    """(repo_id, path, variable, literal): what COBOL programs move into variables."""
    rows = source_lines(files, "cobol").where(~F.col("text").rlike(r"^(.{6}[*/]|\s*\*>)"))
    pattern = r"\bMOVE\s+(?:['\"]([A-Z0-9$#@-]+)['\"]|(\S+))\s+TO\s+([A-Z][A-Z0-9-]*)"
    t = F.upper("text")
    return rows.where(t.rlike(pattern)).select("repo_id", "path", F.regexp_extract(t, pattern, 3).alias("variable"), F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")).alias("literal"))


def python_facts(files: DataFrame) -> DataFrame:
    """Functions, methods, tests, classes and imports of Python files, each symbol with its enclosing one as detail.

    The enclosing symbol is the last one before it with a smaller indent. Names in strings that
    begin a line like a definition are taken for one, as lines are read by themselves.
    """
    rows = source_lines(files, "python").where(F.col("text").rlike(r"^\s*(?:(?:async\s+)?def|class)\s+\w|^\s*(?:import|from)\s+[\w.]"))
    indent = F.length(F.regexp_extract(F.regexp_replace("text", "\t", "        "), r"^(\s*)", 1))
    symbol = r"^\s*(?:async\s+)?(def|class)\s+(\w+)"
    each = rows.select("repo_id", "path", "line", "text", indent.alias("indent"), F.nullif(F.regexp_extract("text", symbol, 1), F.lit("")).alias("word"), F.regexp_extract("text", symbol, 2).alias("name"))
    symbols = each.where("word is not null").groupBy("repo_id", "path").agg(F.array_sort(F.collect_list(F.struct("line", "indent", "word", "name"))).alias("s"))  # one file's symbols
    outer = lambda x: F.try_element_at(F.filter("s", lambda y: (y["line"] < x["line"]) & (y["indent"] < x["indent"])), F.lit(-1))
    with_outer = F.transform("s", lambda x: F.struct(x["line"].alias("line"), x["word"].alias("word"), x["name"].alias("name"), outer(x).alias("p")))
    placed = symbols.select("repo_id", "path", F.explode(with_outer).alias("x"))
    fact = F.when(F.col("x.word") == "class", "class").when(F.col("x.p.word") == "class", "method").when(F.col("x.name").startswith("test_"), "test").otherwise("function")
    found = placed.select("repo_id", "path", "x.line", fact.alias("fact"), "x.name", F.coalesce("x.p.name", F.lit("")).alias("detail"))
    # Statements of a line are parted by semicolons, the modules of an import by commas; comments are neither.
    statement = each.where("word is null").select("repo_id", "path", "line", F.explode(F.split(F.regexp_extract("text", r"^([^#]*)", 1), ";")).alias("text"))
    given = r"^\s*from\s+([\w.]+)\s+import\b\s*(.*)$"
    whole = F.array(F.struct(F.regexp_extract("text", given, 1).alias("name"), F.trim(F.regexp_extract("text", given, 2)).alias("detail")))
    modules = F.split(F.regexp_extract("text", r"^\s*import\s+(.*)$", 1), ",")
    several = F.transform(modules, lambda m: F.struct(F.regexp_extract(m, r"^\s*([\w.]+)", 1).alias("name"), F.lit("").alias("detail")))
    imports = statement.select("repo_id", "path", "line", F.explode(F.when(F.col("text").rlike(given), whole).otherwise(several)).alias("i"))
    imports = imports.select("repo_id", "path", "line", F.lit("import").alias("fact"), "i.name", "i.detail").where("name <> ''")
    return found.unionByName(imports)


def javascript_facts(files: DataFrame) -> DataFrame:
    """Functions, arrows, classes with their bases, interfaces and imports of JavaScript and TypeScript files, where a line begins with them."""
    j = "javascript"
    rows = source_lines(files, j).where(~F.col("text").rlike(r"^\s*(//|\*|/\*)"))
    lead = r"^\s*(?:export\s+)?(?:default\s+)?"
    return _facts(
        rows,
        _fact(j, "function", lead + r"(?:async\s+)?function\s*\*?\s*([\w$]+)"),
        _fact(j, "function", lead + r"(?:const|let|var)\s+([\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=]+)?=>|[\w$]+\s*=>)"),
        _fact(j, "class", lead + r"(?:abstract\s+)?class\s+([\w$]+)(?:\s+extends\s+([\w$.]+))?", detail=2),
        _fact(j, "interface", lead + r"interface\s+([\w$]+)(?:\s+extends\s+([\w$.]+))?", detail=2),
        _fact(j, "import", r"""^\s*import\s+(?:(.*?)\s+from\s+)?['"]([^'"]+)['"]""", name=2, detail=1),
        _fact(j, "import", r"""^\s*(?:const|let|var)\s+(.+?)\s*=\s*require\(\s*['"]([^'"]+)['"]""", name=2, detail=1),
    )


def config_keys(files: DataFrame) -> DataFrame:
    """Keys of configuration files, never their values: ``section.key`` of TOML and ini files, top-level keys of YAML and JSON, keys of env and properties files."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    rows = source_lines(files, "config").withColumn("suffix", suffix)
    flat = rows.where("suffix <> 'json'").where(~F.col("text").rlike(r"^\s*[#;!]"))
    section = F.last(F.nullif(F.when(F.col("suffix").isin("toml", "ini", "cfg"), F.regexp_extract("text", r"^\s*\[+\s*([^\]]+?)\s*\]+", 1)), F.lit("")), ignorenulls=True)
    flat = flat.withColumn("section", section.over(Window.partitionBy("repo_id", "path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    key = F.when(F.col("suffix").isin("yaml", "yml"), F.regexp_extract("text", r"^([\w.-]+)\s*:", 1)).otherwise(F.regexp_extract("text", r"^\s*(?:export\s+)?([\w.-]+)\s*[=:]", 1))
    flat = flat.withColumn("key", key).where("key <> ''")
    named = F.when(F.col("section").isNotNull(), F.concat_ws(".", "section", "key")).otherwise(F.col("key"))
    found = flat.select("repo_id", "path", "line", named.alias("name"))
    path = clean_id("path")
    docs = files.where(F.lower(path).endswith(".json") & F.col("content").isNotNull()).groupBy(clean_id("repo_id").alias("repo_id"), path.alias("path")).agg(F.max_by("content", "indexed_at").alias("content"))
    keys = docs.select("repo_id", "path", F.explode(F.json_object_keys(F.regexp_replace("content", "^﻿", ""))).alias("name"))
    return found.unionByName(keys.select("repo_id", "path", F.lit(None).cast("int").alias("line"), "name")).select("repo_id", "path", "line", F.lit("config_key").alias("fact"), "name", F.lit("").alias("detail"))
