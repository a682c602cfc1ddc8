"""Symbol indexes in SCIP's protocol buffer format: occurrences of symbols in documents, and the edges they prove."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import innermost

OCCURRENCES = "source string, path string, start_line int, symbol string, is_definition boolean"

# Field numbers of the format, and the role bit of a definition.
DOCUMENTS, PATH, OCCURRENCE, RANGE, SYMBOL, ROLES, DEFINITION = 2, 1, 2, 1, 2, 3, 1


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message; a truncated message ends where it breaks off."""
    at = 0
    try:
        while at < len(data):
            key, at = _varint(data, at)
            number, kind = key >> 3, key & 7
            if kind == 0:
                value, at = _varint(data, at)
            elif kind == 2:
                size, at = _varint(data, at)
                value, at = data[at : at + size], at + size
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
                value, at = data[at : at + size], at + size
            else:
                return
            yield number, value
    except IndexError:
        return


def _occurrences(data: bytes) -> Iterator[tuple[str, int, str, bool]]:
    for number, document in fields(data):
        if number != DOCUMENTS or not isinstance(document, bytes):
            continue
        parts = list(fields(document))
        path = next((v.decode("utf-8", "replace") for n, v in parts if n == PATH and isinstance(v, bytes)), "")
        for n, occurrence in parts:
            if n == OCCURRENCE and isinstance(occurrence, bytes):
                line, symbol, roles = None, "", 0
                for k, v in fields(occurrence):
                    if k == RANGE and line is None:
                        line = (_varint(v, 0)[0] if v else None) if isinstance(v, bytes) else v
                    elif k == SYMBOL and isinstance(v, bytes):
                        symbol = v.decode("utf-8", "replace")
                    elif k == ROLES and isinstance(v, int):
                        roles = v
                if line is not None and symbol and not symbol.startswith("local "):
                    yield path, line + 1, symbol, bool(roles & DEFINITION)


def occurrences(indexes: DataFrame) -> DataFrame:
    """Occurrences of the index files (path, content: binary), as ``spark.read.format("binaryFile")`` gives them; lines count from 1."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for source, content in zip(b["path"], b["content"]):
                yield pd.DataFrame([(source, *o) for o in _occurrences(content or b"")], columns=["source", "path", "start_line", "symbol", "is_definition"])

    return indexes.select("path", "content").mapInPandas(read, OCCURRENCES)


def proven_edges(found: DataFrame, spans: DataFrame) -> DataFrame:
    """(repo_id, src_id, dst_id, path, line): the symbol around each reference and the symbol defined where the reference leads.

    ``found`` has the repo_id of its index beside the columns of ``occurrences``; ``spans``:
    (repo_id, path, start_line, end_line, span_id) of stored symbols. A definition belongs to the
    span that starts on its line or next to it, the nearest first; a reference to the narrowest one
    around it. Symbols are looked up within their repository. References from a symbol to itself
    are left out.
    """
    near = found.where("is_definition").select("repo_id", "symbol", "path", F.explode(F.sequence(F.col("start_line") - 1, F.col("start_line") + 1)).alias("start_line"), F.col("start_line").alias("at"))
    defined = near.join(spans.select("repo_id", "path", "start_line", F.col("span_id").alias("dst_id")), ["repo_id", "path", "start_line"])
    defined = defined.groupBy("repo_id", "symbol").agg(F.min(F.struct(F.abs(F.col("start_line") - F.col("at")).alias("d"), "dst_id")).alias("b")).select("repo_id", "symbol", "b.dst_id")
    uses = found.where("not is_definition").select("repo_id", "path", F.col("start_line").alias("line"), F.col("symbol").alias("point_id")).distinct()
    around = innermost(uses, spans, keep_line=True).select("repo_id", "path", "line", F.col("point_id").alias("symbol"), F.col("span_id").alias("src_id"))
    return around.join(defined, ["repo_id", "symbol"]).select("repo_id", "src_id", "dst_id", "path", "line").where("src_id <> dst_id").distinct()
