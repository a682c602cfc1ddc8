"""Kinds and relations by their aliases, and the soft rules on what an edge may join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import CALLABLE_KINDS, SYMBOL_KINDS

# Other spellings of entity kinds and relations.
KIND_ALIASES = {
    "func": "function", "def": "function", "procedure": "function", "proc": "function", "struct": "class", "record": "class", "protocol": "interface", "trait": "interface",
    "const": "variable", "field": "variable", "attr": "variable", "typedef": "type", "table": "database_table", "column": "database_column",
    "route": "api_endpoint", "endpoint": "api_endpoint", "flag": "feature_flag", "cron": "job",
}
RELATION_ALIASES = {
    "inherits": "extends", "subclasses": "extends", "inherit": "extends", "import": "imports", "require": "imports", "include": "imports", "uses_module": "imports",
    "call": "calls", "invoke": "calls", "reads_from": "reads", "writes_to": "writes", "tested_by": "tests", "configure": "configures", "handled_by": "handles", "owned_by": "owns",
    "depends": "depends_on", "reference": "references", "ref": "references", "contain": "contains", "define": "defines",
}
_SYMBOLS, _CALLABLES = " ".join(SYMBOL_KINDS), " ".join(CALLABLE_KINDS)
# Kinds that the source and the target of a relation should have; an empty end may be anything, as may the ends of other relations.
ENDS = {
    "contains": ("repository directory file module package class", ""),
    "defines": ("file module class package", _SYMBOLS),
    "calls": (_CALLABLES, f"{_CALLABLES} class"),
    "imports": ("module file package", "module package symbol import"),
    "extends": ("class interface", "class interface"),
    "implements": ("class", "interface"),
    "reads": (_CALLABLES, ""),
    "writes": (_CALLABLES, ""),
    "configures": ("config_key", ""),
    "controls": ("feature_flag", ""),
    "handles": ("api_endpoint", f"{_CALLABLES} class"),
    "emits": (_CALLABLES, "log_event"),
    "runs": ("job jcl_job", ""),
    "schedules": ("", "job"),
    "tests": ("test test_suite", f"{_SYMBOLS} module"),
    "covers": ("test test_suite", "business_capability"),
    "owns": ("author team", ""),
    "changed": ("commit", ""),
    "implements_capability": ("", "business_capability"),
    "uses": ("user_flow", ""),
    "invokes": ("transaction_code", ""),
    "candidate_for_migration": ("", "service component"),
}


def _lookup(table: dict[str, str], col: Column) -> Column:
    return F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v))))[col]


def canonical_kind(col: Column | str, known: tuple[str, ...]) -> Column:
    """The kind that a spelling stands for; *symbol* for what is neither a kind nor an alias."""
    key = F.lower(F.trim(col))
    return F.coalesce(F.when(key.isin(*known), key), _lookup(KIND_ALIASES, key), F.lit("symbol"))


def canonical_relation(col: Column | str, known: tuple[str, ...]) -> Column:
    """The relation that a spelling stands for; *relates_to* for what is neither a relation nor an alias."""
    key = F.lower(F.trim(col))
    return F.coalesce(F.when(key.isin(*known), key), _lookup(RELATION_ALIASES, key), F.lit("relates_to"))


def violations(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, type, end, kind): edges whose end has a kind that the relation should not join; ends without an entity are not judged."""
    kinds = entities.select("id", "kind")
    both = rels.select("id", "type", "src_id", "dst_id")
    found = []
    for end, column, n in (("src", "src_id", 0), ("dst", "dst_id", 1)):
        allowed = {t: spec[n] for t, spec in ENDS.items() if spec[n]}
        joined = both.join(kinds.select(F.col("id").alias(column), "kind"), column)
        fits = F.array_contains(F.split(_lookup(allowed, F.col("type")), " "), F.col("kind"))
        found.append(joined.where(~fits).select("id", "type", F.lit(end).alias("end"), "kind"))
    return found[0].unionByName(found[1])
