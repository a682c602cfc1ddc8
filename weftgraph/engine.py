"""One object over a folder of stored tables, with the questions that users ask."""

from __future__ import annotations

import re

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, ladder, metrics
from .plans import impact, search
from .tables import canonical, load

#: Stored tables that read-only SQL sees, and the canonical views made of them.
TABLES = ("repositories", "files", "parsed_symbols", "entities", "relationships", "vectors", "documents", "embeddings", "events", "review_labels")


class Engine:
    """Lazy tables of one data folder. Results are DataFrames; nothing is collected here."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.entities, self.relationships = canonical(spark, folder, "entities"), canonical(spark, folder, "relationships")

    def table(self, name: str) -> DataFrame:
        return load(self.spark, self.folder, name)

    def churn(self) -> DataFrame:
        """(repo_id, path, commits): stored versions of each file."""
        return self.table("files").select("repo_id", "path", "indexed_at").distinct().groupBy("repo_id", "path").agg(F.count("*").alias("commits"))

    def find_symbol(self, name: str, exact: bool = False) -> DataFrame:
        """Symbols by name; exact is case-sensitive, as is its result."""
        found = search.resolve_symbol(self.entities.where("not missing"), name)
        return found.where(F.col("name") == name) if exact else found

    def _start(self, symbol: str) -> DataFrame:
        return search.resolve_symbol(self.entities, symbol, 1).select("id")

    def callers(self, symbol: str, depth: int = 1) -> DataFrame:
        return graph.call_graph(self.relationships, self._start(symbol), "in", depth)

    def callees(self, symbol: str, depth: int = 1) -> DataFrame:
        return graph.call_graph(self.relationships, self._start(symbol), "out", depth)

    def neighbours(self, symbol: str, direction: str = "both") -> DataFrame:
        return graph.neighbours(self.entities, self.relationships, self._start(symbol), direction)

    def flow(self, symbol: str, depth: int = 3) -> DataFrame:
        return graph.flow(self.relationships, self._start(symbol), depth)

    def impact(self, symbol: str) -> DataFrame:
        """(id, callers, candidates, callees, tests, level, score, risk) of one symbol."""
        one = self._start(symbol)
        counts = impact.call_counts(self.relationships)
        risk = impact.risk(self.entities, self.relationships, self.churn()).select("id", "score", F.col("level").alias("risk"))
        return one.join(counts, "id", "left").join(impact.completeness(counts), "id", "left").join(risk, "id", "left").fillna(0, ["callers", "candidates", "callees", "tests"])

    def search(self, query: str, limit: int = 10) -> DataFrame:
        return search.hybrid(self.entities, self.relationships, self.churn(), self.table("vectors"), self.table("files"), query, limit)

    def gaps(self) -> DataFrame:
        return ladder.gaps(self.relationships, self.entities).orderBy(F.desc("ref_count"), "stub_id")

    def dead_code(self) -> DataFrame:
        return graph.dead_code(self.entities, self.relationships)

    def architecture(self) -> tuple[DataFrame, DataFrame]:
        return metrics.layers(self.entities, self.relationships), metrics.layer_edges(self.entities, self.relationships)

    def lines_of_code(self) -> DataFrame:
        return metrics.lines_by_language(self.table("files"))

    def mermaid(self, edges: DataFrame, limit: int = 60) -> str:
        """A diagram of at most ``limit`` edges (src_id, dst_id, type) as text."""
        rows = edges.select("src_id", "dst_id", "type").distinct().orderBy("src_id", "dst_id", "type").limit(limit).collect()
        number: dict[str, int] = {}
        label = lambda s: re.sub(r"[\"\[\]{}()|<>]|\s+", " ", s.rpartition(":")[2])[:50].strip() or "?"
        out = ["flowchart TD"]
        for r in rows:
            for end in (r["src_id"], r["dst_id"]):
                if end not in number:
                    number[end] = len(number)
                    out.append(f'  n{number[end]}["{label(end)}"]')
            out.append(f"  n{number[r['src_id']]} -->|{r['type']}| n{number[r['dst_id']]}")
        return "\n".join(out)

    def db_query(self, sql: str, limit: int | None = None) -> DataFrame:
        """The rows of one SELECT or WITH statement over the stored tables; anything else is refused.

        Texts and comments are left out where the statement is judged; which files it reads is asked of its plan.
        """
        if not re.match(r"(?is)\s*(?:--[^\n]*\n\s*|/\*.*?\*/\s*)*(select|with)\b", sql):
            raise ValueError("only one SELECT or WITH statement is allowed")
        # Without texts and comments, in which anything may stand; what Spark is given is the statement as it is.
        named = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)
        if re.search(r"(?i)\b(insert|update|delete|merge|drop|alter|create|truncate|replace|refresh|cache|uncache|set|add|load)\s+(into|table|view|from|overwrite|jar|file|data|database|schema|function|or)\b|;\s*\S", named):
            raise ValueError("only reading is allowed")
        if re.search(r"(?i)\b\w+\s*\.\s*`[^`]*[/:]", named):
            raise ValueError("only the stored tables may be read")
        for name in TABLES:
            if re.search(rf"(?i)\b{name}\b", sql):
                self.table(name).createOrReplaceTempView(name)
        try:
            rows = self.spark.sql(sql.strip().rstrip(";"))
        except ParseException as e:
            raise ValueError(f"not one readable statement: {e.getCondition()}") from e
        own = {f for name in TABLES if re.search(rf"(?i)\b{name}\b", sql) for f in self.table(name).inputFiles()}
        if not set(rows.inputFiles()) <= own:
            raise ValueError("only the stored tables may be read")
        return rows.limit(limit) if limit else rows

    def db_counts(self) -> DataFrame:
        """(table, rows) of every stored table."""
        return graph.union_all([self.table(t).agg(F.lit(t).alias("table"), F.count("*").alias("rows")) for t in TABLES])
