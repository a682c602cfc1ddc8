"""Queries on text and vectors: tokens, secrets, hashes, ranking, search, resolution, merging, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import cosine
from ..operators import graph as g
from ..operators import control_flow, ladder, metrics, upserts
from ..plans import evaluation, search
from ..sources import facts, languages
from ..streaming import windows
from ..tables import canonical, load
from .sql import RESOLVED, over

QUERY = "reconcile ledger entry before the batch closes"
SYMBOL = "write_entry"
PART = "ledger"


def _churn(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "files").select("repo_id", "path", "indexed_at").distinct().groupBy("repo_id", "path").agg(F.count("*").alias("commits"))


def _calls(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Calls, symbols, imports and ancestors of classes of the stored graph as the ladder takes them; a call is known by the name at the end of its target.

    Receivers are not stored, so the rungs that need one (through self, inferred) cannot hold. Classes go by qualified name.
    """
    e = entities(s, d).where("not missing and not external")
    of_class = F.when(F.col("kind") == "method", F.regexp_extract("qualified_name", r"^(.+)\.[^.]+$", 1))
    symbols = e.where("kind in ('function', 'method', 'test', 'legacy_program', 'paragraph')").select("id", "repo_id", "name", "module", of_class.alias("class_name"))
    rels = relationships(s, d)
    last = F.regexp_extract("dst_id", r"([^.:]+)$", 1)
    calls = rels.where("type = 'calls'").select(F.col("id").alias("call_id"), "src_id", last.alias("name")).join(
        symbols.select(F.col("id").alias("src_id"), "repo_id", "module", "class_name"), "src_id"
    )
    calls = calls.select("call_id", "repo_id", "name", "module", "class_name", F.lit(None).cast("string").alias("receiver"), F.lit(None).cast("string").alias("receiver_type"))
    modules = e.where("kind = 'module'").select("id", "repo_id", F.col("qualified_name").alias("module"))
    imports = rels.where("type = 'imports'").select("src_id", "dst_id").join(modules.withColumnRenamed("id", "src_id"), "src_id").join(modules.select(F.col("id").alias("dst_id"), F.col("module").alias("imported")), "dst_id")
    classes = e.where("kind in ('class', 'interface')").select("id", "repo_id", F.col("qualified_name").alias("class_name"))
    above = classes.select(F.col("id").alias("ancestor_id"), "repo_id", F.col("class_name").alias("ancestor"))
    closure = g.ancestors(rels).select("id", F.col("ancestor").alias("ancestor_id")).join(classes, "id").join(above, ["ancestor_id", "repo_id"])
    return calls, symbols, imports.select("repo_id", "module", "imported").distinct(), closure.select("repo_id", "class_name", "ancestor").distinct()


def _delta(s: SparkSession, d: str) -> DataFrame:
    """An oracle's answers as derived from the edges: it promotes what was matched by name with confidence, prunes what it was not."""
    r = relationships(s, d).where("type = 'calls' and resolution = 'name-match'")
    return r.select("id", F.when(F.col("confidence") >= 0.6, "promote").otherwise("prune").alias("op"), F.lit("lsp-verified").alias("resolution"), F.lit(0.95).alias("confidence"))


def _versions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The files as they were first stored and as they are now: the earliest and the latest content of each path, up to and from the middle of May."""
    f = load(s, d, "files").select("repo_id", "path", "indexed_at", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash"))
    old = f.where("indexed_at < '2025-07-01'").groupBy("repo_id", "path").agg(F.min_by("content_hash", "indexed_at").alias("content_hash"))
    new = f.where("indexed_at >= '2025-04-01'").groupBy("repo_id", "path").agg(F.max_by("content_hash", "indexed_at").alias("content_hash"))
    return old, new


def _query_vector(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "embeddings").orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))


def _doc_bm25(s: SparkSession, d: str) -> DataFrame:
    return search.bm25(load(s, d, "documents"), "doc_id", F.col("text"), QUERY, 30)


def _fused(s: SparkSession, d: str) -> DataFrame:
    bm25 = search.ranked(_doc_bm25(s, d), "doc_id", "keyword")
    near = search.nearest(load(s, d, "embeddings"), "vec_id", "embedding", _query_vector(s, d), 30)
    return search.fuse(bm25.unionByName(search.ranked(near, "vec_id", "semantic")))


def _ranked_labels(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents ranked by length, and the ones that reviewers found abusive: a ranking and its golden answers."""
    ranked = load(s, d, "documents").select("source", "doc_id", F.col("n_chars").alias("score")).where("source is not null and score is not null")
    golden = load(s, d, "review_labels").where("abusive = 1").select("doc_id").distinct().join(load(s, d, "documents").select("doc_id", "source"), "doc_id")
    return ranked, golden


def entities(s: SparkSession, d: str) -> DataFrame:
    return canonical(s, d, "entities")


def relationships(s: SparkSession, d: str) -> DataFrame:
    return canonical(s, d, "relationships")


QUERIES = {
    "tokenize": lambda s, d: load(s, d, "documents").select("doc_id", F.size(tx.tokenize("text")).alias("n_tokens"), F.array_join(tx.chunk_tokens("text", 5), " ").alias("first_tokens")),
    "split_identifier": lambda s, d: load(s, d, "parsed_symbols").select("name").where("name is not null").distinct().select("name", F.array_join(tx.split_identifier("name"), " ").alias("words")),
    "looks_like_identifier": lambda s, d: load(s, d, "documents").select("doc_id", tx.looks_like_identifier("text").alias("code")),
    "scrub_secrets": lambda s, d: load(s, d, "files").where("content is not null").select(F.md5("content").alias("content_md5"), F.md5(tx.scrub_secrets("content")).alias("scrubbed_md5")).distinct(),
    "simple_names": lambda s, d: entities(s, d).select("id", tx.simple_name("qualified_name").alias("simple"), tx.layer("path").alias("layer"), tx.location("path", "start_line", "end_line").alias("location")),
    "line_stats": lambda s, d: metrics.line_stats(load(s, d, "files")),
    "loc_by_language_rollup": lambda s, d: metrics.lines_by_language(load(s, d, "files")),
    "classify_language": lambda s, d: languages.classify(load(s, d, "files")).select("repo_id", "path", "language"),
    "content_hash_diff": lambda s, d: upserts.content_diff(*_versions(s, d), ["repo_id", "path"]).groupBy("change").agg(F.count("*").alias("n")),
    "find_by_name_exact": lambda s, d: entities(s, d).where((F.lower("name") == SYMBOL) | (F.lower("qualified_name") == SYMBOL)).select("id", "kind", "name"),
    "find_by_name_fuzzy": lambda s, d: entities(s, d).where(F.lower("name").contains("ledger")).select("id", "kind", "name"),
    "resolve_symbol": lambda s, d: search.resolve_symbol(entities(s, d), PART),
    "bm25_topk": _doc_bm25,
    "postings": lambda s, d: search.postings(load(s, d, "documents"), "doc_id", F.col("text")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")),
    "keyword_overlap": lambda s, d: search.keyword_overlap(entities(s, d), QUERY),
    "cosine_topk": lambda s, d: search.nearest(load(s, d, "embeddings"), "vec_id", "embedding", _query_vector(s, d), 30),
    "cosine_topk_each": lambda s, d: search.nearest_each(e := load(s, d, "embeddings"), "vec_id", "embedding", e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))),
    "rrf_fusion": lambda s, d: _fused(s, d).select("id", "score", F.array_join("signals", ",").alias("signals")),
    "hybrid_search": lambda s, d: search.hybrid(entities(s, d), relationships(s, d), _churn(s, d), load(s, d, "vectors"), load(s, d, "files"), "ledger " + SYMBOL),
    "proximity": lambda s, d: search.proximity_signal(search.resolve_symbol(entities(s, d), PART, 5).select("id"), entities(s, d)).select("id"),
    "graph_expansion": lambda s, d: search.graph_signal(search.resolve_symbol(entities(s, d), PART, 5).select("id", (-F.col("rank")).cast("double").alias("score")), entities(s, d), relationships(s, d)),
    "ladder_resolution": lambda s, d: ladder.resolve_calls(*_calls(s, d)),
    "gaps": lambda s, d: ladder.gaps(relationships(s, d), entities(s, d)),
    "edge_delta_merge": lambda s, d: upserts.apply_delta(relationships(s, d), _delta(s, d)).select("id", "resolution", "confidence", "pruned"),
    "eval_set_f1": lambda s, d: evaluation.set_f1(*(x.select("source", "doc_id") for x in _ranked_labels(s, d)), "source", "doc_id"),
    "eval_mrr": lambda s, d: evaluation.mean_reciprocal_rank(*_ranked_labels(s, d), "source", "doc_id"),
    "program_facts": lambda s, d: facts.mainframe_facts(load(s, d, "files")),
    "python_facts": lambda s, d: facts.python_facts(load(s, d, "files")),
    "javascript_facts": lambda s, d: facts.javascript_facts(load(s, d, "files")),
    "config_keys": lambda s, d: facts.config_keys(load(s, d, "files")),
    "hlasm_blocks": lambda s, d: control_flow.hlasm_blocks(load(s, d, "files")),
    "cobol_flow": lambda s, d: control_flow.cobol_paragraph_edges(load(s, d, "files")),
    "sql_passthrough": lambda s, d: _sql(s, d),
    "events_tumbling": lambda s, d: windows.tumbling(load(s, d, "events"), "6 hours"),
    "events_sessions": lambda s, d: windows.sessions(load(s, d, "events"), "30 minutes").select("user_id", "session_start", "session_end", "n"),
}


def _sql(s: SparkSession, d: str) -> DataFrame:
    from ..engine import Engine

    return Engine(s, d).db_query("select repo_id, count(*) as n, count(distinct path) as paths from files group by repo_id")


TOKENS = r"flatten(list_transform(regexp_extract_all(coalesce({t}, ''), '[A-Za-z_][A-Za-z0-9_]*'), lambda x: case when len({w}) > 1 then list_concat([lower(x)], {w}) else [lower(x)] end))"
WORDS = r"list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace({x}, '[^0-9a-zA-Z]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), ' '), lambda w: w <> '')"


def _tokens_sql(col: str) -> str:
    return TOKENS.format(t=col, w=WORDS.format(x="x"))


_TERMS = "list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'), lambda t: len(t) > 1)"
_WANTED = ["reconcile", "ledger", "entry", "before", "the", "batch", "closes"]
BM25 = f"""terms as (select doc_id, {_TERMS} as t from documents), n as (select count(*) as n, avg(len(t)) as average from terms),
q as (select unnest([{', '.join(repr(w) for w in _WANTED)}]) as w),
tf as (select doc_id, len(t) as length, w, len(list_filter(t, lambda x: x = w)) as tf from terms, q),
df as (select w, count(*) filter (tf > 0) as df from tf group by w),
bm as (select doc_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))), 6) as score from tf join df using (w), n where tf > 0 group by doc_id order by score desc, doc_id limit 30)"""
NEAR = """near as (select vec_id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings order by vec_id limit 1)), 6) as score from embeddings order by score desc, vec_id limit 30)"""
RESOLVE = f"""hits as (select id, name, kind, case when lower(name) = '{PART}' or lower(qualified_name) = '{PART}' then 0 when contains(lower(name), '{PART}') or contains(lower(qualified_name), '{PART}') then 2 end as priority,
  case when kind = 'copybook' then 1 when kind in ('symbol', 'function', 'method', 'class', 'interface', 'enum', 'variable', 'type', 'test', 'legacy_program', 'paragraph', 'jcl_job', 'transaction_code') then 0 else 2 end * 1000 + len(qualified_name) as tie from ent),
resolved_symbols as (select id, name, kind, priority, row_number() over (order by priority, tie, id)::int as rank from hits where priority is not null)"""
SYMBOL_SET = "('symbol', 'function', 'method', 'class', 'interface', 'enum', 'variable', 'type', 'test', 'legacy_program', 'copybook', 'paragraph', 'jcl_job', 'transaction_code')"

def _layer(path: str) -> str:
    parts = rf"string_split(lower(translate(coalesce({path}, ''), '\.', '//')), '/')"
    return "case " + " ".join(f"when len(list_intersect({parts}, [{', '.join(repr(w) for w in words.split())}])) > 0 then '{name}'" for name, words in tx.LAYERS.items()) + " else 'Core' end"


_SUFFIX = "case " + " ".join(f"when lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) in ({', '.join(repr(x) for x in suffixes.split())}) then '{name}'" for suffixes, name in metrics.SUFFIXES.items()) + " end"
_MARK = "case language " + " ".join(f"when '{k}' then '{v}'" for k, v in metrics.COMMENT_MARKS.items()) + f" else '{metrics.COMMENT_MARKS['text']}' end"
LINE_STATS = rf"""newest as (select repo_id, path, content from (select *, row_number() over (partition by repo_id, path order by indexed_at desc) as rn from files) where rn = 1 and content is not null),
split as (select repo_id, path, language, unnest(string_split_regex(content, '\r\n|\r|\n')) as x, {_MARK} as mark from (select *, coalesce({_SUFFIX}, 'text') as language from newest)),
stats as (select repo_id, path, language, count(*) filter (not blank and not comment) as code, count(*) filter (not blank and comment) as comment, count(*) filter (blank) as blank
  from (select *, trim(translate(x, chr(9), ' ')) = '' as blank, regexp_matches(x, mark) as comment from split) group by 1, 2, 3)"""
QUERY_TOKENS = "[" + ", ".join(repr(t) for t in search.query_tokens(QUERY)) + "]"

SQL = {
    "simple_names": over("ent", body=rf"""select id, list_extract(string_split(rtrim(coalesce(qualified_name, ''), '.'), '.'), -1) as simple, {_layer('path')} as layer,
      case when start_line is null or start_line <= 0 then path when end_line is null or end_line <= start_line then path || ':' || start_line else path || ':' || start_line || '-' || end_line end as location from ent"""),
    "line_stats": f"with {LINE_STATS} select repo_id, path, language, code::int as code, comment::int as comment, blank::int as blank from stats",
    "loc_by_language_rollup": f"""with {LINE_STATS} select coalesce(language, 'total') as language, count(*) as files, sum(code)::bigint as code, sum(comment)::bigint as comment, sum(blank)::bigint as blank,
      case when sum(code) + sum(comment) > 0 then round(sum(comment) / (sum(code) + sum(comment))::double, 3) else 0.0 end as comment_ratio from stats group by rollup (language)""",
    "keyword_overlap": over("ent", f"scored as (select id, name, len(list_intersect(list_distinct(list_concat(list_concat({_tokens_sql('name')}, {_tokens_sql('qualified_name')}), {_tokens_sql('docstring')})), {QUERY_TOKENS})) as overlap from ent)",
        body=f"select id, (overlap + case when list_contains({QUERY_TOKENS}, lower(name)) then 2 else 0 end)::double as score from scored where overlap > 0 order by score desc, id limit 30"),
    "tokenize": f"select doc_id, len({_tokens_sql('text')})::int as n_tokens, coalesce(array_to_string(list_sort(list_distinct({_tokens_sql('text')}))[1:5], ' '), '') as first_tokens from documents",
    "split_identifier": f"select name, array_to_string({WORDS.format(x='name')}, ' ') as words from (select distinct name from parsed_symbols where name is not null)",
    "looks_like_identifier": r"select doc_id, regexp_matches(coalesce(text, ''), '(`[^`]+`)|([A-Za-z_][A-Za-z0-9_]*\s*\()|([a-z]+_[a-z0-9_]+)|([a-z]+[A-Z][A-Za-z0-9]*)|(\w+\.\w+)') as code from documents",
    "find_by_name_exact": over("ent", body=f"select id, kind, name from ent where lower(name) = '{SYMBOL}' or lower(qualified_name) = '{SYMBOL}'"),
    "find_by_name_fuzzy": over("ent", body="select id, kind, name from ent where contains(lower(name), 'ledger')"),
    "resolve_symbol": over("ent", RESOLVE, body="select * from resolved_symbols where rank <= 25"),
    "bm25_topk": f"with {BM25} select * from bm",
    "postings": f"with p as (select doc_id, unnest({_TERMS}) as term from documents) select term, count(distinct doc_id) as df, count(*) as cf from p group by term",
    "cosine_topk": f"with {NEAR} select * from near",
    "cosine_topk_each": """select query, vec_id, score from (select *, row_number() over (partition by query order by score desc, vec_id) as r from (
      select q.vec_id as query, e.vec_id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) as score from embeddings e, embeddings q where q.vec_id % 100 = 0)) where r <= 30""",
    "rrf_fusion": f"""with {BM25}, {NEAR}, ranked as (select doc_id as id, 'keyword' as signal, row_number() over (order by score desc, doc_id) as r from bm union all select vec_id, 'semantic', row_number() over (order by score desc, vec_id) from near)
      select id, round(sum(1.0 / (60 + r)), 8) as score, string_agg(signal, ',' order by signal) as signals from ranked group by id""",
    "proximity": over("ent", RESOLVE, "seeds as (select id from resolved_symbols where rank <= 5)", "paths as (select distinct repo_id, path from ent join seeds using (id) where path is not null and path <> '')",
        body=f"select id from ent where kind in {SYMBOL_SET} and not missing and (repo_id, path) in (select repo_id, path from paths) and id not in (select id from seeds) order by id limit 30"),
    "graph_expansion": over("ent", "rel", RESOLVE, "seeds as (select id, -rank::double as score from resolved_symbols where rank <= 5)", f"steps as (select src_id, dst_id from rel where type in ('calls', 'imports', 'depends_on', 'references', 'defines') and (type <> 'calls' or {RESOLVED}))",
        "both_ways as (select src_id as a, dst_id as b from steps union all select dst_id, src_id from steps)",
        body="select b as id, max(score) as score from both_ways join seeds on seeds.id = a where b in (select id from ent where not missing) group by 1 order by score desc, id limit 100"),
    "gaps": over("ent", "rel", body="select dst_id as stub_id, count(*) as ref_count, count(distinct path) as n_files from rel where dst_id not in (select id from ent where not missing) group by 1"),
    "edge_delta_merge": over("rel", body="""select id, case when type = 'calls' and resolution = 'name-match' and confidence >= 0.6 then 'lsp-verified' else resolution end as resolution,
        case when type = 'calls' and resolution = 'name-match' and confidence >= 0.6 then 0.95 else confidence end as confidence,
        pruned or (type = 'calls' and resolution = 'name-match' and not coalesce(confidence >= 0.6, false)) as pruned from rel"""),
    "content_hash_diff": """with f as (select repo_id, path, indexed_at, sha256(coalesce(content, '')) as h from files), o as (select repo_id, path, arg_min(h, indexed_at) as a from f where indexed_at < '2025-07-01' group by 1, 2),
      n as (select repo_id, path, arg_max(h, indexed_at) as b from f where indexed_at >= '2025-04-01' group by 1, 2)
      select case when a is null then 'new' when b is null then 'deleted' when a = b then 'unchanged' else 'changed' end as change, count(*) as n from o full join n using (repo_id, path) group by 1""",
    "sql_passthrough": "select repo_id, count(*) as n, count(distinct path) as paths from files group by repo_id",
    "events_tumbling": "select event_type, time_bucket(interval '6 hours', ts) as window_start, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "events_sessions": """with gaps as (select user_id, ts, case when ts >= lag(ts) over w + interval '30 minutes' or lag(ts) over w is null then 1 else 0 end as starts from events window w as (partition by user_id order by ts, event_id)),
      numbered as (select user_id, ts, sum(starts) over (partition by user_id order by ts rows unbounded preceding) as session from gaps)
      select user_id, min(ts) as session_start, max(ts) + interval '30 minutes' as session_end, count(*) as n from numbered group by user_id, session""",
    "eval_set_f1": """with a as (select distinct source, doc_id from documents where source is not null and n_chars is not null), b as (select distinct d.source, l.doc_id from review_labels l join documents d using (doc_id) where abusive = 1 and d.source is not null),
      n as (select coalesce(a.source, b.source) as source, count(a.doc_id) as found, count(b.doc_id) as expected, count(*) filter (a.doc_id is not null and b.doc_id is not null) as hits from a full join b on a.source = b.source and a.doc_id = b.doc_id group by 1)
      select source, found, expected, hits, round(case when found + expected > 0 then 2.0 * hits / (found + expected) else 0 end, 6) as f1 from n""",
    "eval_mrr": """with r as (select source, doc_id, row_number() over (partition by source order by n_chars desc, doc_id) as r from documents where source is not null and n_chars is not null),
      g as (select distinct d.source, l.doc_id from review_labels l join documents d using (doc_id) where abusive = 1 and d.source is not null)
      select source, min(r) as first_rank, round(1.0 / min(r), 6) as reciprocal_rank from r join g using (source, doc_id) group by 1""",
}
