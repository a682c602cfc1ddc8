"""Functions paired with their documentation.

One Arrow pass over the files extracts function spans and documentation spans, each by itself.
An as-of join, a window in the order of position, gives every function the nearest span before it;
it is its documentation only if no other code stands between.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import clean_id
from . import doc_text, source_spans

PYTHON = r"\.(py|pyi|pyw)$"
JAVASCRIPT = r"\.(js|jsx|mjs|cjs|ts|tsx|mts|cts)$"

SPANS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("repo_id", "path", "language")]
    + [T.StructField(c, T.LongType()) for c in ("version", "at")]
    + [T.StructField("kind", T.StringType()), T.StructField("name", T.StringType())]
    + [T.StructField(c, T.IntegerType()) for c in ("line", "end_line")]
    + [T.StructField("text", T.StringType())]
)


def spans(files: DataFrame) -> DataFrame:
    """All spans of the Python, JavaScript and TypeScript files (by path, as ``language`` may be wrong).

    Null and empty contents give no rows. ``version`` tells different contents of one path apart.
    """
    path = clean_id("path")
    language = F.when(F.lower(path).rlike(PYTHON), "python").when(F.lower(path).rlike(JAVASCRIPT), "javascript")
    source = files.select(clean_id("repo_id").alias("repo_id"), path.alias("path"), language.alias("language"), F.xxhash64("content").alias("version"), "content")
    source = source.where("language is not null and content is not null and repo_id is not null")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                read = source_spans.python_spans if row.language == "python" else source_spans.javascript_spans
                rows += [(row.repo_id, row.path, row.language, row.version, *s) for s in read(row.content)]
            yield pd.DataFrame(rows, columns=SPANS.names)

    return source.mapInPandas(extract, SPANS)


def documented_functions(files: DataFrame) -> DataFrame:
    """(repo_id, path, name, start_line, signature, documentation, description) of every function that has documentation worth the name.

    Documentation is a docstring, or a ``/** */`` comment that ends on the line above the function
    or its decorators. It is left out if it is trivial (see ``doc_text.is_trivial``). A file stored
    twice counts once; of two different contents of one path both are read. Null repo_id, path or
    content give no rows; an empty table gives none.
    """
    before = Window.partitionBy("repo_id", "path", "version").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    nearest = F.max(F.struct("at", "kind", "end_line", "text")).over(before)
    joined = spans(files).withColumn("d", nearest).where("kind = 'function' and d.kind = 'doc'")
    joined = joined.where("language = 'python' or d.end_line = end_line - 1")

    @F.pandas_udf("struct<description string, trivial boolean>")
    def judge(comment: pd.Series, name: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            [(doc_text.description(c).strip(), doc_text.is_trivial(c, n)) for c, n in zip(comment, name)], columns=["description", "trivial"]
        )

    judged = joined.select("repo_id", "path", "name", F.col("line").alias("start_line"), F.col("text").alias("signature"), F.col("d.text").alias("documentation"))
    judged = judged.distinct().withColumn("j", judge("documentation", "name"))
    return judged.where("not j.trivial").select("repo_id", "path", "name", "start_line", "signature", "documentation", "j.description")
