"""Identifier-aware text functions as column expressions: they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of identifiers, of hints that a query names code, and of secrets.
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*"
IDENTIFIER_HINT = r"(`[^`]+`)|([A-Za-z_][A-Za-z0-9_]*\s*\()|([a-z]+_[a-z0-9_]+)|([a-z]+[A-Z][A-Za-z0-9]*)|(\w+\.\w+)"
AWS_KEY = r"AKIA[0-9A-Z]{16}"
PEM_HEADER = r"-----BEGIN [^-]+-----"
KEY_VALUE = r"(?i)(api[_-]?key|secret|token|password|passwd|pwd|access[_-]?key)(\s*[:=]\s*)(['\"]?)([^\s'\"]{8,})\3"
REDACTED = "***REDACTED***"


def split_identifier(name: Column | str) -> Column:
    """The lower-case words of a snake_case, camelCase or dotted name; null and empty names have none."""
    name = F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))
    spaced = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "[^0-9a-zA-Z]+", " "), "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), " +"), lambda w: w != "")


def tokenize(text: Column | str) -> Column:
    """The tokens of a text in order, each identifier followed by its words if it has several; repeats are kept."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    found = F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1)
    parts = F.transform(found, lambda t: F.when(F.size(split_identifier(t)) > 1, F.concat(F.array(F.lower(t)), split_identifier(t))).otherwise(F.array(F.lower(t))))
    return F.flatten(parts)


def chunk_tokens(text: Column | str, limit: int = 256) -> Column:
    """The first ``limit`` distinct tokens of a text in alphabetical order."""
    return F.slice(F.array_sort(F.array_distinct(tokenize(text))), 1, limit)


def looks_like_identifier(query: Column | str) -> Column:
    return F.coalesce(F.col(query) if isinstance(query, str) else query, F.lit("")).rlike(IDENTIFIER_HINT)


def simple_name(qualified_name: Column | str) -> Column:
    """The last dotted part of a name, closing dots aside."""
    return F.element_at(F.split(F.rtrim(F.coalesce(qualified_name, F.lit("")), F.lit(".")), r"\."), -1)


def sanitize_path(path: Column | str) -> Column:
    """A relative path with forward slashes and without leading ``./`` and slashes."""
    return F.ltrim(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", ""), F.lit("/"))


def scrub_secrets(text: Column | str) -> Column:
    """A text with cloud keys, PEM headers and values of credentials masked."""
    out = F.regexp_replace(F.regexp_replace(text, AWS_KEY, REDACTED.replace("$", r"\$")), PEM_HEADER, REDACTED)
    return F.regexp_replace(out, KEY_VALUE, f"$1$2$3{REDACTED}$3")


def location(path: str, start: str, end: str) -> Column:
    """``path:start-end``, shorter where lines are missing or equal."""
    p, a, b = F.col(path), F.col(start), F.col(end)
    return F.when(a.isNull() | (a <= 0), p).when(b.isNull() | (b <= a), F.concat(p, F.lit(":"), a)).otherwise(F.concat(p, F.lit(":"), a, F.lit("-"), b))


# Layers of an architecture and the path words that speak for them, in the order they are tried.
LAYERS = {
    "Test": "test tests spec __tests__ conftest",
    "API": "api route routes controller controllers endpoint endpoints handler handlers views rest graphql",
    "UI": "ui component components page pages view frontend web widgets",
    "Service": "service services usecase usecases domain logic business core engine manager",
    "Data": "model models repository repositories dao db database store stores entity entities schema migrations orm",
    "Config": "config settings conf env constants",
    "Utility": "util utils helper helpers common shared lib tools",
}


def layer(path: Column | str) -> Column:
    """The first layer one of whose words is a part of the path, else *Core*."""
    parts = F.split(F.lower(F.translate(F.coalesce(path, F.lit("")), "\\.", "//")), "/")
    column = None
    for name, words in LAYERS.items():
        hit = F.arrays_overlap(parts, F.array(*map(F.lit, words.split())))
        column = F.when(hit, name) if column is None else column.when(hit, name)
    return column.otherwise("Core")
