"""Queries on the graph: scans, names, neighbours, frontiers, closures, coverage, counts.

Frontier queries start from symbols that the data give: the least of the most called ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import intervals, metrics, schema, upserts
from ..plans import impact
from ..tables import SYMBOL_KINDS, canonical, load
from .sql import RESOLVED, clean_id, over

N_STARTS = 5


def _starts(rels: DataFrame, column: str, types: tuple[str, ...] = ("calls",)) -> DataFrame:
    """The N_STARTS ids with the most distinct partners over edges of some types, ties to the lesser id."""
    pairs = rels.where(F.col("type").isin(*types)).select("src_id", "dst_id").distinct()
    return pairs.groupBy(F.col(column).alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(N_STARTS).select("id")


def _starts_sql(column: str, types: str = "'calls'") -> str:
    return f"starts as (select {column} as id from (select distinct src_id, dst_id from rel where type in ({types})) group by 1 order by count(*) desc, 1 limit {N_STARTS})"


def _er(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return entities(s, d), relationships(s, d)


def _spans(s: SparkSession, d: str) -> DataFrame:
    return entities(s, d).where("start_line is not null and path is not null and kind in ('function', 'method', 'class', 'test')").select("repo_id", "path", "start_line", "end_line", F.col("id").alias("span_id"))


def _points(s: SparkSession, d: str) -> DataFrame:
    return relationships(s, d).where("type in ('calls', 'references') and start_line is not null and path is not null").select("repo_id", "path", F.col("start_line").alias("line"), F.col("id").alias("point_id"))


SPANS = "spans as (select repo_id, path, start_line, end_line, id as span_id from ent where start_line is not null and path is not null and kind in ('function', 'method', 'class', 'test'))"
POINTS = "points as (select repo_id, path, start_line as line, id as point_id from rel where type in ('calls', 'references') and start_line is not null and path is not null)"


def _churn(s: SparkSession, d: str) -> DataFrame:
    """Commits of each file: its distinct stored versions by the time they were indexed."""
    return load(s, d, "files").select("repo_id", "path", "indexed_at").distinct().groupBy("repo_id", "path").agg(F.count("*").alias("commits"))


CHURN = "churn as (select repo_id, path, count(distinct indexed_at) as commits from files group by repo_id, path)"
SYMBOL_SET = "(" + ", ".join(map(repr, SYMBOL_KINDS)) + ")"
CALLABLES = "('function', 'method', 'test', 'legacy_program', 'paragraph')"
COUNTS = f"""pairs as (select src_id, dst_id, bool_or({RESOLVED}) as resolved from rel where type = 'calls' and not pruned group by 1, 2),
counts as (select coalesce(a.id, b.id, c.id) as id, coalesce(callers, 0) as callers, coalesce(candidates, 0) as candidates, coalesce(callees, 0) as callees, coalesce(tests, 0) as tests
  from (select dst_id as id, count(*) filter (resolved) as callers, count(*) filter (not resolved) as candidates from pairs group by 1) a
  full join (select src_id as id, count(*) as callees from pairs where resolved group by 1) b on a.id = b.id
  full join (select dst_id as id, count(distinct src_id) as tests from rel where type = 'tests' group by 1) c on coalesce(a.id, b.id) = c.id)"""
STEPS_BOTH = "steps as (select distinct src_id as a, dst_id as b from rel union select distinct dst_id, src_id from rel)"


def _reach_sql(steps: str, starts: str, depth: int) -> str:
    return over("rel", starts, steps, f"walk as (select id as root, id, 0 as depth from starts union select w.root, s.b, w.depth + 1 from walk w join steps s on s.a = w.id where w.depth < {depth})",
                body="select root, id, min(depth) as depth from walk group by root, id", recursive=True)


def _call_sql(a: str, b: str, depth: int) -> str:
    return over(
        "rel", _starts_sql(a),
        f"steps as (select {a} as a, {b} as b, bool_or({RESOLVED}) as resolved from rel where type = 'calls' and not pruned group by 1, 2)",
        f"""walk as (select id as root, id, 0 as depth, true as resolved from starts
          union select w.root, s.b, w.depth + 1, s.resolved from walk w join steps s on s.a = w.id where w.resolved and w.depth < {depth} and (w.depth = 0 or s.resolved))""",
        "least_depth as (select root, id, min(depth) as depth from walk group by root, id)",
        body="select w.root, w.id, w.depth, bool_or(w.resolved) as resolved from walk w join least_depth l on w.root = l.root and w.id = l.id and w.depth = l.depth where w.depth > 0 group by 1, 2, 3", recursive=True,
    )


def entities(s: SparkSession, d: str) -> DataFrame:
    return canonical(s, d, "entities")


def relationships(s: SparkSession, d: str) -> DataFrame:
    return canonical(s, d, "relationships")


QUERIES = {
    "scan_entities_by_kind": lambda s, d: entities(s, d).where("kind in ('function', 'method')").select("id", "name", "repo_id"),
    "scan_relationships_by_type": lambda s, d: g.of_types(relationships(s, d), ("calls", "imports")).select("id", "type", "src_id", "dst_id"),
    "entity_counts": lambda s, d: metrics.counts_by(entities(s, d), "kind"),
    "relationship_counts": lambda s, d: metrics.counts_by(relationships(s, d), "type"),
    "resolution_distribution": lambda s, d: metrics.resolution_distribution(relationships(s, d)),
    "neighbors_out": lambda s, d: g.neighbours(*(er := _er(s, d)), _starts(er[1], "src_id"), "out"),
    "neighbors_in": lambda s, d: g.neighbours(*(er := _er(s, d)), _starts(er[1], "src_id"), "in"),
    "neighbors_both": lambda s, d: g.neighbours(*(er := _er(s, d)), _starts(er[1], "src_id"), "both", ("calls", "references", "imports")),
    "callers_depth1": lambda s, d: g.call_graph(r := relationships(s, d), _starts(r, "dst_id"), "in", 1),
    "callers_depth2": lambda s, d: g.call_graph(r := relationships(s, d), _starts(r, "dst_id"), "in", 2),
    "callees_depth2": lambda s, d: g.call_graph(r := relationships(s, d), _starts(r, "src_id"), "out", 2),
    "bfs_depth3": lambda s, d: g.reach(r := relationships(s, d), _starts(r, "src_id"), "out", ("calls", "references"), 3),
    "neighbourhood_nodes": lambda s, d: g.reach(r := relationships(s, d), _starts(r, "src_id"), "both", None, 2),
    "neighbourhood_tree": lambda s, d: g.tree_edges(r := relationships(s, d), _starts(r, "src_id"), 1),
    "neighbourhood_tree_depth2": lambda s, d: g.tree_edges(r := relationships(s, d), _starts(r, "src_id")),
    "ancestor_closure": lambda s, d: g.ancestors(relationships(s, d)),
    "flow_edges": lambda s, d: g.flow(r := relationships(s, d), _starts(r, "src_id", ("runs", "invokes")), 3),
    "trigger_discovery": lambda s, d: g.triggers(r := relationships(s, d), entities(s, d), _starts(r, "dst_id", ("reads", "runs", "invokes")), 4),
    "fan_in_topk": lambda s, d: g.fan_in(relationships(s, d)).orderBy(F.desc("n_edges"), "id").limit(24),
    "cross_file_hubs": lambda s, d: g.fan_in(relationships(s, d), ("calls", "references", "imports")).orderBy(F.desc("n_files"), "id").limit(15),
    "cross_group_edges": lambda s, d: metrics.cross_edges(*_er(s, d)),
    "dead_code": lambda s, d: g.dead_code(*_er(s, d)),
    "shallow_modules": lambda s, d: g.shallow_modules(*_er(s, d)),
    "entry_points": lambda s, d: g.entry_points(entities(s, d)),
    "layers": lambda s, d: metrics.layers(*_er(s, d)),
    "layer_edges": lambda s, d: metrics.layer_edges(*_er(s, d)),
    "reader_writer_inventory": lambda s, d: metrics.readers_writers(relationships(s, d)),
    "access_merge": lambda s, d: metrics.access_modes(relationships(s, d)),
    "impact_counts": lambda s, d: impact.call_counts(relationships(s, d)),
    "completeness_level": lambda s, d: impact.completeness(impact.call_counts(relationships(s, d))),
    "risk_score": lambda s, d: impact.risk(*_er(s, d), _churn(s, d)),
    "tests_for_symbol": lambda s, d: impact.test_callers(*_er(s, d), by_name=False),
    "tests_and_names_for_symbol": lambda s, d: impact.test_callers(*_er(s, d)),
    "lineage": lambda s, d: impact.lineage(relationships(s, d)),
    "overrides": lambda s, d: impact.overrides(*_er(s, d)),
    "override_groups": lambda s, d: impact.override_groups(*_er(s, d)),
    "schema_violations": lambda s, d: schema.violations(relationships(s, d), entities(s, d)),
    "edge_ordinal": lambda s, d: g.edge_ordinals(relationships(s, d)),
    "dedupe_union": lambda s, d: upserts.latest(load(s, d, "relationships").withColumn("id", F.expr("trim(id)")), ["id"], ["indexed_at", "received_at"]).select("id", "indexed_at", "received_at"),
    "pagination": lambda s, d: entities(s, d).orderBy("id").offset(100).limit(50).select("id", "kind"),
    "asof_enclosing": lambda s, d: intervals.enclosing(_points(s, d), _spans(s, d)).select("point_id", "span_id"),
    "band_match": lambda s, d: intervals.band(_points(s, d), _spans(s, d)).select("point_id", "span_id", "distance"),
    "interval_containment": lambda s, d: intervals.innermost(_points(s, d), _spans(s, d)).select("point_id", "span_id"),
    "line_ownership": lambda s, d: intervals.line_owners(_spans(s, d)),
    "run_segmentation": lambda s, d: intervals.runs(intervals.line_owners(_spans(s, d))),
    "chunk_windows": lambda s, d: intervals.line_windows(intervals.runs(intervals.line_owners(_spans(s, d))), 20, 5).select("repo_id", "path", "span_id", "start_line", "end_line"),
    "churn": lambda s, d: metrics.churn(load(s, d, "events"), "event_type", "user_id", "ts"),
}

OWNERS = "owners as (select repo_id, path, line, arg_min(span_id, (end_line - start_line, -start_line, span_id)) as span_id from (select *, unnest(range(start_line, end_line + 1)) as line from spans where start_line <= end_line) group by 1, 2, 3)"
RUNS = "runs as (select repo_id, path, span_id, min(line) as first_line, max(line) as last_line from (select *, line - row_number() over (partition by repo_id, path, span_id order by line) as island from owners) group by repo_id, path, span_id, island)"
BINDING = "('calls', 'imports', 'references', 'extends', 'implements', 'depends_on', 'reads', 'writes', 'maps_to', 'runs', 'invokes', 'uses')"
_STEP = lambda types: f"steps as (select distinct src_id as a, dst_id as b from rel where type in ({types}))"


def _neighbours_sql(direction: str, types: str | None = None) -> str:
    where = f"where r.type in ({types})" if types else ""
    out = f"select s.id, 'out' as direction, r.type, r.id as edge_id, e.id as neighbour, e.kind as neighbour_kind from starts s join rel r on r.src_id = s.id join ent e on e.id = r.dst_id {where}"
    back = f"select s.id, 'in' as direction, r.type, r.id as edge_id, e.id as neighbour, e.kind as neighbour_kind from starts s join rel r on r.dst_id = s.id join ent e on e.id = r.src_id {where}"
    return over("ent", "rel", _starts_sql("src_id"), body={"out": out, "in": back, "both": f"{out} union all {back}"}[direction])


def _layer_sql() -> str:
    from ..functions.text import LAYERS

    tests = " ".join(f"when len(list_intersect(parts, [{', '.join(repr(w) for w in words.split())}])) > 0 then '{name}'" for name, words in LAYERS.items())
    return rf"modules as (select id, missing, external, case {tests} else 'Core' end as layer from (select id, missing, external, string_split(lower(translate(coalesce(path, ''), '\.', '//')), '/') as parts from ent where kind = 'module'))"


ALLOWED_SQL = "(values " + ", ".join(f"('{t}', '{e}', '{k}')" for t, spec in schema.ENDS.items() for e, kinds in zip(("src", "dst"), spec) for k in kinds.split()) + ") as allowed(type, \"end\", kind)"
FAN_IN = "select dst_id as id, count(*) as n_edges, count(distinct src_id) as n_sources, count(distinct path) as n_files from rel where type in ({}) and not pruned group by 1"
NAMED_SQL = r"(regexp_matches(lower(name), '^(main|run|start|handler|app|setup|teardown|constructor|__\w+__|test_?\w*)$') or regexp_matches(lower(coalesce(path, '')), '(^|/)(tests?|specs?)/|(^|/)test_[^/]*$|[._](test|spec)\.\w+$'))"

SQL = {
    "scan_entities_by_kind": over("ent", body="select id, name, repo_id from ent where kind in ('function', 'method')"),
    "scan_relationships_by_type": over("rel", body="select id, type, src_id, dst_id from rel where type in ('calls', 'imports')"),
    "entity_counts": over("ent", body="select kind, count(*) as n from ent group by 1"),
    "relationship_counts": over("rel", body="select type, count(*) as n from rel group by 1"),
    "resolution_distribution": over("rel", body="select coalesce(resolution, 'unlabeled') as resolution, count(*) as n from rel where type = 'calls' group by 1"),
    "neighbors_out": _neighbours_sql("out"),
    "neighbors_in": _neighbours_sql("in"),
    "neighbors_both": _neighbours_sql("both", "'calls', 'references', 'imports'"),
    "callers_depth1": _call_sql("dst_id", "src_id", 1),
    "callers_depth2": _call_sql("dst_id", "src_id", 2),
    "callees_depth2": _call_sql("src_id", "dst_id", 2),
    "bfs_depth3": _reach_sql(_STEP("'calls', 'references'"), _starts_sql("src_id"), 3),
    "neighbourhood_nodes": _reach_sql(STEPS_BOTH, _starts_sql("src_id"), 2),
    "neighbourhood_tree": over("rel", _starts_sql("src_id"), "both_ways as (select src_id as a, dst_id as b, id from rel union all select dst_id, src_id, id from rel)",
        body="select s.id as root, b.b as id, s.id as parent, min(b.id) as edge_id, 1 as depth from starts s join both_ways b on b.a = s.id where b.b <> s.id group by 1, 2"),
    "ancestor_closure": over("rel", f"up as (select distinct src_id as id, dst_id as ancestor from rel where type in ('extends', 'implements') and (resolution is null or {RESOLVED}))",
        "walk as (select id, ancestor, 1 as depth from up union select w.id, u.ancestor, w.depth + 1 from walk w join up u on u.id = w.ancestor where w.id <> u.ancestor and w.depth < 50)",
        body="select id, ancestor, min(depth) as depth from walk group by 1, 2", recursive=True),
    "flow_edges": over("rel", _starts_sql("src_id", "'runs', 'invokes'"), _STEP("'invokes', 'runs', 'calls'"),
        "walk as (select id as root, id, 0 as depth from starts union select w.root, s.b, w.depth + 1 from walk w join steps s on s.a = w.id where w.depth < 3)",
        "near as (select root, id, min(depth) as depth from walk group by 1, 2)",
        body="select distinct n.root, r.src_id, r.dst_id, r.type, n.depth from near n join rel r on r.src_id = n.id where not r.pruned and (r.type in ('reads', 'writes', 'uses') or (r.type in ('invokes', 'runs', 'calls') and n.depth < 3))", recursive=True),
    "trigger_discovery": over("ent", "rel", _starts_sql("dst_id", "'reads', 'runs', 'invokes'"), "steps as (select distinct dst_id as a, src_id as b from rel where type in ('invokes', 'runs', 'calls'))",
        "walk as (select id as root, id, 0 as depth from starts union select w.root, s.b, w.depth + 1 from walk w join steps s on s.a = w.id where w.depth < 4)",
        body="select w.root, e.id as trigger, e.kind, min(w.depth) as depth from walk w join ent e on e.id = w.id where e.kind in ('transaction_code', 'jcl_job') group by 1, 2, 3 having min(w.depth) > 0", recursive=True),
    "fan_in_topk": over("rel", body=FAN_IN.format("'calls'") + " order by n_edges desc, id limit 24"),
    "cross_file_hubs": over("rel", body=FAN_IN.format("'calls', 'references', 'imports'") + " order by n_files desc, id limit 15"),
    "cross_group_edges": over("ent", "rel", "e as (select id, concat_ws(':', repo_id, path) as file, regexp_replace(concat_ws(':', repo_id, path), '/?[^/]*$', '') as folder from ent where path is not null and path <> '')",
        body=f"select r.type, count(*) as edges, count(*) filter (a.file <> b.file) as cross_file, count(*) filter (a.folder <> b.folder) as cross_directory from rel r join e a on a.id = r.src_id join e b on b.id = r.dst_id where r.type in {BINDING} group by 1"),
    "dead_code": over("ent", "rel", body=f"select id, name, path from ent where kind in ('function', 'method') and not missing and not external and deleted_at is null and not {NAMED_SQL} and id not in (select dst_id from rel where type in ('calls', 'references') and not pruned)"),
    "shallow_modules": over("ent", "rel", body="select id, path from ent where kind = 'module' and not missing and not external and id not in (select src_id from rel where type = 'defines')"),
    "entry_points": over("ent", body=r"""select id, kind, name, path from ent where kind in ('function', 'method', 'jcl_job', 'transaction_code', 'module')
      and (lower(name) in ('main', 'run', 'start', 'handler', 'app') or coalesce(regexp_matches(lower(path), '(^|/)(__main__\.py|main\.\w+|index\.(js|ts)|app\.\w+|server\.\w+)$'), false) or kind in ('jcl_job', 'transaction_code'))"""),
    "layers": over("ent", "rel", _layer_sql(), body="select layer, count(*) as modules, coalesce(sum(n), 0)::bigint as symbols from modules m left join (select src_id, count(*) as n from rel where type = 'defines' group by 1) d on d.src_id = m.id where not missing and not external group by 1"),
    "layer_edges": over("ent", "rel", _layer_sql(), body="select a.layer as source, b.layer as target, count(*) as weight from rel r join modules a on a.id = r.src_id join modules b on b.id = r.dst_id where r.type = 'imports' and a.layer <> b.layer group by 1, 2"),
    "reader_writer_inventory": over("rel", "p as (select distinct dst_id, type, src_id from rel where type in ('reads', 'writes'))", "few as (select * from (select *, row_number() over (partition by dst_id, type order by src_id) as n from p) where n <= 6)",
        body="""select c.dst_id as table_id, n_readers, n_writers, readers, writers from (select dst_id, count(*) filter (type = 'reads') as n_readers, count(*) filter (type = 'writes') as n_writers from p group by 1) c
          join (select dst_id, coalesce(string_agg(src_id, '|' order by src_id) filter (type = 'reads'), '') as readers, coalesce(string_agg(src_id, '|' order by src_id) filter (type = 'writes'), '') as writers from few group by 1) l on l.dst_id = c.dst_id"""),
    "access_merge": over("rel", body="select src_id, dst_id, string_agg(distinct case when type = 'reads' then 'read' else 'write' end, '/' order by case when type = 'reads' then 'read' else 'write' end) as access from rel where type in ('reads', 'writes') group by 1, 2"),
    "impact_counts": over("rel", COUNTS, body="select * from counts"),
    "completeness_level": over("rel", COUNTS, body="select id, case when candidates = 0 then 'exact' when callers = 0 then 'heuristic' else 'partial' end as level from counts"),
    "risk_score": over("ent", "rel", COUNTS, CHURN, f"""raw as (select e.id, round(least(0.5, (coalesce(callers, 0) + coalesce(candidates, 0)) * 0.06::double) + least(0.25, coalesce(commits, 0) * 0.03::double) + least(0.1, coalesce(callees, 0) * 0.01::double)
        + case when coalesce(tests, 0) = 0 then 0.25 else 0.0 end, 10) as x from ent e left join counts c on c.id = e.id left join churn h on h.repo_id = e.repo_id and h.path = e.path where e.kind in {CALLABLES} and not missing and not external)""",
        body="select id, round(least(x, 1.0), 2) as score, case when x >= 0.66 then 'high' when x >= 0.33 then 'medium' else 'low' end as level from raw"),
    "tests_for_symbol": over("ent", "rel", body="""select id, test_id, max(confidence) as confidence, arg_max(via, confidence) as via from (
        select dst_id as id, src_id as test_id, 1.0::double as confidence, 'edge' as via from rel where type = 'tests'
        union all select r.dst_id, r.src_id, 0.9, 'call' from rel r join ent e on e.id = r.src_id where r.type = 'calls' and not pruned and e.kind = 'test') group by 1, 2"""),
    "tests_and_names_for_symbol": over("ent", "rel", r"simple as (select id, repo_id, lower(regexp_extract(rtrim(qualified_name, '.'), '([^.]*)$', 1)) as name from ent where kind in " + SYMBOL_SET + ")", body="""select id, test_id, max(confidence) as confidence, arg_max(via, confidence) as via from (
        select dst_id as id, src_id as test_id, 1.0::double as confidence, 'edge' as via from rel where type = 'tests'
        union all select r.dst_id, r.src_id, 0.9, 'call' from rel r join ent e on e.id = r.src_id where r.type = 'calls' and not pruned and e.kind = 'test'
        union all select s.id, t.id, 0.6, 'name' from simple s join ent t on t.repo_id = s.repo_id and t.kind = 'test' and s.name <> '' and contains(lower(t.name), s.name)) group by 1, 2"""),
    "lineage": over("rel", body="select distinct src_id as id, type, dst_id as data_id from rel where type in ('reads', 'writes', 'maps_to')"),
    "overrides": over("ent", "rel", "up as (select distinct src_id as sub, dst_id as base from rel where type in ('extends', 'implements'))", "pairs as (select sub as c1, base as c2, 'base' as relation from up union all select base, sub, 'subclass' from up)",
        r"own as (select m.id, m.name, c.id as class_id from ent m join ent c on c.repo_id = m.repo_id and c.qualified_name = regexp_replace(m.qualified_name, '\.[^.]*$', '') where m.kind = 'method' and c.kind in ('class', 'interface'))",
        body="select distinct a.id, b.id as other_id, p.relation from pairs p join own a on a.class_id = p.c1 join own b on b.class_id = p.c2 and b.name = a.name where a.id <> b.id"),
    "override_groups": over("ent", "rel", "up as (select distinct src_id as class_id, dst_id as base_id from rel where type in ('extends', 'implements') and dst_id in (select id from ent))",
        r"own as (select m.id, m.name, c.id as class_id from ent m join ent c on c.repo_id = m.repo_id and c.qualified_name = regexp_replace(m.qualified_name, '\.[^.]*$', '') where m.kind = 'method' and c.kind in ('class', 'interface'))",
        "members as (select distinct base_id, name, id, class_id from up join own using (class_id))",
        body="select * from members a where exists (select 1 from members b where b.base_id = a.base_id and b.name = a.name and b.class_id <> a.class_id)"),
    "schema_violations": over("ent", "rel", f"allowed as (select * from {ALLOWED_SQL})", """ends as (select r.id, r.type, 'src' as "end", e.kind from rel r join ent e on e.id = r.src_id union all select r.id, r.type, 'dst', e.kind from rel r join ent e on e.id = r.dst_id)""",
        body="""select id, type, "end", kind from ends x where exists (select 1 from allowed a where a.type = x.type and a."end" = x."end") and not exists (select 1 from allowed a where a.type = x.type and a."end" = x."end" and a.kind = x.kind)"""),
    "edge_ordinal": over("rel", body="select id, (row_number() over (partition by type, src_id, dst_id order by start_line nulls first, id) - 1)::int as ordinal from rel"),
    "dedupe_union": "select trim(id) as id, max(indexed_at) as indexed_at, arg_max(received_at, (indexed_at, received_at)) as received_at from relationships group by 1",
    "pagination": over("ent", body="select id, kind from ent order by id offset 100 limit 50"),
    "asof_enclosing": over("ent", "rel", SPANS, POINTS, body="select p.point_id, arg_max(s.span_id, (s.start_line, s.span_id)) as span_id from points p left join spans s on s.repo_id = p.repo_id and s.path = p.path and s.start_line <= p.line group by 1"),
    "band_match": over("ent", "rel", SPANS, POINTS, body="select p.point_id, s.span_id, abs(p.line - s.start_line) as distance from points p join spans s on s.repo_id = p.repo_id and s.path = p.path and abs(p.line - s.start_line) <= 1"),
    "interval_containment": over("ent", "rel", SPANS, POINTS, body="select p.point_id, arg_min(s.span_id, (s.end_line - s.start_line, -s.start_line, s.span_id)) as span_id from points p join spans s on s.repo_id = p.repo_id and s.path = p.path and p.line between s.start_line and s.end_line group by 1"),
    "line_ownership": over("ent", SPANS, OWNERS, body="select repo_id, path, line::int as line, span_id from owners"),
    "run_segmentation": over("ent", SPANS, OWNERS, RUNS, body="select repo_id, path, span_id, first_line::int as first_line, last_line::int as last_line from runs"),
    "chunk_windows": over("ent", SPANS, OWNERS, RUNS, "starts as (select *, unnest(case when last_line - first_line + 1 <= 20 then [first_line] else range(first_line, greatest(first_line, last_line - 5) + 1, 15) end) as start_line from runs)",
        body="select repo_id, path, span_id, start_line::int as start_line, least(start_line + 19, last_line)::int as end_line from starts"),
    "churn": "select event_type, count(*) as commits, count(distinct user_id) as authors, max(ts) as last_ts from events group by 1",
}
