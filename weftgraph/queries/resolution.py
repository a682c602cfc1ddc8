"""Queries on names, resolution and views of the graph, with their SQL.

References are taken from the stored edges and parsed symbols: the name at the end of a target's id
is what the source wrote, and is resolved again from the entities alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions import text as tx
from ..operators import graph as g
from ..operators import chunks, resolve, schema, versions, views
from ..operators.metrics import SUFFIXES, lines
from ..tables import canonical, clean_id, load
from .graph import RESOLVED, _starts, _starts_sql
from .sql import clean_id as clean_id_sql
from .sql import over

#: Names as they stand in import statements, seen from each module.
WANTED_PYTHON = (".", ".entry", "..common.money", "os.path")
WANTED_JAVASCRIPT = ("./entry", "../common/money.js", "../index", "lodash/fp")
END, LAST_TWO = r"([^:]+)$", r"([^.:]+\.[^.:]+)$"


def _ent(s: SparkSession, d: str) -> DataFrame:
    return canonical(s, d, "entities")


def _rel(s: SparkSession, d: str) -> DataFrame:
    return canonical(s, d, "relationships")


def _refs(s: SparkSession, d: str, types: tuple[str, ...], pattern: str = END) -> DataFrame:
    """(repo_id, path, fact, name) of the edges of some types, by the place of their source."""
    r = g.of_types(_rel(s, d), types).select("src_id", F.col("type").alias("fact"), F.regexp_extract("dst_id", pattern, 1).alias("name"))
    return r.join(_ent(s, d).select(F.col("id").alias("src_id"), "repo_id", "path", "module"), "src_id").where("path is not null and name <> ''")


def _imported(s: SparkSession, d: str) -> DataFrame:
    modules = _ent(s, d).where("kind = 'module' and not missing and not external").select("id", "repo_id", F.col("qualified_name").alias("module"))
    edges = _rel(s, d).where("type = 'imports'").select("src_id", "dst_id")
    a, b = modules.withColumnRenamed("id", "src_id"), modules.select(F.col("id").alias("dst_id"), F.col("module").alias("imported"))
    return edges.join(a, "src_id").join(b, "dst_id").select("repo_id", "module", "imported").distinct()


def _bases(s: SparkSession, d: str) -> DataFrame:
    p = load(s, d, "parsed_symbols").where("kind in ('class', 'interface')")
    return p.select("repo_id", F.col("parent_qname").alias("module"), F.col("qualified_name").alias("owner"), F.explode("bases").alias("name")).where("name is not null and module is not null and owner is not null")


def _bound(s: SparkSession, d: str) -> DataFrame:
    binds = _imported(s, d).select("repo_id", "module", F.element_at(F.split("imported", r"\."), -1).alias("local"), F.col("imported").alias("target"))
    calls = _rel(s, d).where("type = 'calls'").select(F.col("id").alias("call_id"), "src_id", F.regexp_extract("dst_id", LAST_TWO, 1).alias("name"))
    calls = calls.join(_ent(s, d).select(F.col("id").alias("src_id"), "repo_id", "module"), "src_id").where("name <> ''")
    return resolve.bound_calls(calls.select("call_id", "repo_id", "module", "name"), binds, _ent(s, d))


def _tables(s: SparkSession, d: str) -> DataFrame:
    r = _rel(s, d).where("type in ('reads', 'writes')").select("repo_id", F.regexp_extract("dst_id", END, 1).alias("name"))
    return resolve.materialised(r, _ent(s, d), "database_table")


def _relative(s: SparkSession, d: str) -> DataFrame:
    """What the names of WANTED mean in each stored module."""
    m = load(s, d, "files").where("path is not null").select(clean_id("path").alias("path")).distinct().withColumn("module", names.module_name("path"))
    package = F.col("path").rlike(r"(^|/)__init__\.[^/]*$")
    py = m.where(F.col("path").rlike(r"\.py$")).withColumn("wanted", F.explode(F.array(*map(F.lit, WANTED_PYTHON)))).select("path", "wanted", names.python_import("module", "wanted", package).alias("module"))
    js = m.where(F.col("path").rlike(r"\.(js|ts)$")).withColumn("wanted", F.explode(F.array(*map(F.lit, WANTED_JAVASCRIPT)))).select("path", "wanted", names.javascript_import("module", "wanted").alias("module"))
    return py.unionByName(js)


def _slices(s: SparkSession, d: str) -> DataFrame:
    """The lines of each function in the newest content of its file, as a hash, with their number."""
    newest = load(s, d, "files").where("content is not null").groupBy(clean_id("repo_id").alias("repo_id"), clean_id("path").alias("path")).agg(F.max_by("content", "indexed_at").alias("content"))
    own = _ent(s, d).where("kind in ('function', 'method') and start_line > 0 and end_line >= start_line and not missing").select("id", "repo_id", "path", "start_line", "end_line")
    cut = F.slice(lines("content"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1)
    return own.join(newest, ["repo_id", "path"]).select("id", F.md5(F.array_join(cut, "\n")).alias("text_md5"), F.size(cut).alias("n_lines"))


def _flow(s: SparkSession, d: str) -> DataFrame:
    r = _rel(s, d)
    return g.flow(r, _starts(r, "src_id", ("runs", "invokes", "calls")), 2)


def _merged(s: SparkSession, d: str) -> DataFrame:
    e = _ent(s, d).select("id", F.create_map(F.lit("kind"), "kind", F.lit("module"), "module").alias("a"), F.create_map(F.lit("module"), F.when(F.col("kind") == "module", F.col("name")), F.lit("path"), F.col("path")).alias("b"))
    m = names.merge_attributes("a", "b")
    return e.select("id", m["kind"].alias("kind"), m["module"].alias("module"), m["path"].alias("path"), F.size(m).alias("n"))


RELATIONS = tuple(schema.ENDS)
QUERIES = {
    "get_entity": lambda s, d: _ent(s, d).where(F.col("id") == "module:atlas-core-5fe3a4fbf0c9:src/common/money.py:src.common.money").select("id", "kind", "name", "path"),
    "find_exact_symbol": lambda s, d: _ent(s, d).where("name = 'write_entry' or qualified_name = 'write_entry'").select("id", "kind"),
    "module_names": lambda s, d: load(s, d, "files").where("path is not null").select(clean_id("path").alias("path")).distinct().withColumn("module", names.module_name("path")),
    "relative_imports": _relative,
    "external_names": lambda s, d: _ent(s, d).where("name is not null").select("id", names.is_external_name("name").alias("external")),
    "relation_aliases": lambda s, d: load(s, d, "relationships").where("type is not null").groupBy(schema.canonical_relation(clean_id("type"), RELATIONS).alias("relation")).agg(F.count("*").alias("n")),
    "truncated_cells": lambda s, d: load(s, d, "documents").select("doc_id", names.truncated("text").alias("cell")),
    "merged_attributes": _merged,
    "source_slices": _slices,
    "definer_resolve": lambda s, d: resolve.definers(load(s, d, "parsed_symbols"), _ent(s, d)),
    "import_resolve": lambda s, d: resolve.imports(_refs(s, d, ("imports",)), _ent(s, d)),
    "type_ref_resolve": lambda s, d: resolve.types(_bases(s, d), _ent(s, d), _imported(s, d)),
    "inheritance_edges": lambda s, d: resolve.inheritance(resolve.types(_bases(s, d), _ent(s, d), _imported(s, d))),
    "bound_calls": _bound,
    "member_resolve": lambda s, d: resolve.members(_refs(s, d, ("calls", "runs", "imports")), _ent(s, d)),
    "materialised_tables": _tables,
    "gap_sites": lambda s, d: resolve.gap_sites(_rel(s, d), _ent(s, d)),
    "gaps_of_symbols": lambda s, d: resolve.gaps_of_files(_rel(s, d), _ent(s, d)),
    "gap_reasons": lambda s, d: resolve.gap_reasons(_rel(s, d), _ent(s, d)),
    "unresolved_calls": lambda s, d: resolve.unresolved_calls(_rel(s, d)),
    "unresolved_from": lambda s, d: resolve.unresolved_from(_rel(s, d)),
    "entry_point_counts": lambda s, d: views.entry_counts(_ent(s, d), _rel(s, d), load(s, d, "files")),
    "overview_totals": lambda s, d: views.totals(_ent(s, d)),
    "documented_share": lambda s, d: views.documented(_ent(s, d)),
    "perspectives": lambda s, d: views.perspectives(_ent(s, d), _rel(s, d)),
    "downstream": lambda s, d: views.downstream(_ent(s, d), _rel(s, d)),
    "walkthrough_starts": lambda s, d: views.walkthrough_starts(_ent(s, d), _rel(s, d)),
    "explain_modules": lambda s, d: views.modules(_ent(s, d), _rel(s, d)),
    "flow_summary": lambda s, d: views.capabilities(_flow(s, d)),
    "flow_kinds": lambda s, d: views.kinds_of_flow(_flow(s, d), _ent(s, d)),
    "abilities": lambda s, d: views.abilities(_ent(s, d), _rel(s, d), load(s, d, "vectors")),
    "united_neighbourhoods": lambda s, d: views.neighbourhoods(_rel(s, d), g.reach(_rel(s, d), _starts(_rel(s, d), "src_id"), "both", ("calls",), 1)),
    "deleted_vectors": lambda s, d: versions.without_keys(load(s, d, "vectors"), load(s, d, "vectors").where("dim <> size(vector) or vector is null"), ["chunk_id"]).groupBy("model").agg(F.count("*").alias("n")),
    "without_repository": lambda s, d: versions.without_repository({"files": load(s, d, "files")}, "atlas-core-5fe3a4fbf0c9")["files"].groupBy("repo_id").agg(F.count("*").alias("n")),
    "call_budget": lambda s, d: versions.within_budget(_rel(s, d).where("type = 'calls'").select("id", "repo_id", "confidence"), "repo_id", ["confidence", "id"], 20).select("id", "repo_id"),
    "build_chunks": lambda s, d: chunks.build_chunks(load(s, d, "files"), _ent(s, d)).select("chunk_id", "span_id", "start_line", "end_line"),
    "chunk_embeddings": lambda s, d: chunks.embed_chunks(chunks.build_chunks(load(s, d, "files"), _ent(s, d))),
    "semantic_hits": lambda s, d: chunks.semantic_hits(chunks.build_chunks(load(s, d, "files"), _ent(s, d)), "reconcile ledger entry before the batch closes"),
    "triggers_of_programs": lambda s, d: g.triggers(_rel(s, d), _ent(s, d), g.of_types(_rel(s, d), ("calls", "runs", "invokes")).join(_ent(s, d).where("kind in ('jcl_job', 'transaction_code')").select(F.col("id").alias("src_id")), "src_id", "left_semi").select(F.col("dst_id").alias("id")), 4),
}


def _quoted(words: tuple[str, ...] | list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _case(table: dict[str, str], key: str) -> str:
    return " ".join(f"when {key} = '{k}' then '{v}'" for k, v in table.items())


MODULE = r"case when lower(regexp_extract({p}, '\.([^./]*)$', 1)) in " + _quoted(names.MEMBER_SUFFIXES) + r" then upper(regexp_extract({p}, '([^/]*?)(?:\.[^./]*)?$', 1)) else regexp_replace(regexp_replace(replace(regexp_replace({p}, '\.[^./]*$', ''), '/', '.'), '(^|\.)__init__$', ''), '^\.+', '') end"
PATHS = f"paths as (select distinct {clean_id_sql('path')} as path from files where path is not null)"
IMPORTED = """mods as (select id, repo_id, qualified_name as module from ent where kind = 'module' and not missing and not external),
imported as (select distinct a.repo_id, a.module, b.module as imported from rel r join mods a on a.id = r.src_id join mods b on b.id = r.dst_id where r.type = 'imports')"""
TYPES = """refs as (select distinct repo_id, parent_qname as module, qualified_name as owner, list_extract(string_split(base, '.'), -1) as name from (select *, unnest(bases) as base from parsed_symbols where kind in ('class', 'interface')) where base <> '' and parent_qname is not null and qualified_name is not null),
c as (select repo_id, name, module, {'id': id, 'kind': kind} as c from ent where kind in ('class', 'interface') and not missing),
a as (select repo_id, name, count(*) as n, min(c) as t from c group by 1, 2), m as (select repo_id, name, module, count(*) as n, min(c) as t from c group by 1, 2, 3),
i as (select r.repo_id, r.module, r.name, sum(m.n) as n, min(m.t) as t from (select distinct repo_id, module, name from refs) r join imported x on x.repo_id = r.repo_id and x.module = r.module join m on m.repo_id = r.repo_id and m.name = r.name and m.module = x.imported group by 1, 2, 3),
hit as (select r.*, case when m.n = 1 then m.t when i.n = 1 then i.t when a.n <= 5 then a.t end as t, case when m.n = 1 then 'same-module' when i.n = 1 then 'imported' when a.n = 1 then 'unique' when a.n <= 5 then 'candidate' else 'missing' end as resolution
  from refs r left join a on a.repo_id = r.repo_id and a.name = r.name left join m on m.repo_id = r.repo_id and m.name = r.name and m.module = r.module left join i on i.repo_id = r.repo_id and i.module = r.module and i.name = r.name)"""
FLOW = ("steps as (select distinct src_id as a, dst_id as b from rel where type in ('invokes', 'runs', 'calls'))",
        "walk as (select id as root, id, 0 as depth from starts union select w.root, s.b, w.depth + 1 from walk w join steps s on s.a = w.id where w.depth < 2)",
        "near as (select root, id, min(depth) as depth from walk group by 1, 2)",
        "flow as (select distinct n.root, r.src_id, r.dst_id, r.type, n.depth from near n join rel r on r.src_id = n.id where not r.pruned and (r.type in ('reads', 'writes', 'uses') or (r.type in ('invokes', 'runs', 'calls') and n.depth < 2)))")
OPEN = "type = 'calls' and not pruned and coalesce(resolution, 'missing') in ('missing', 'candidate', 'fan-out-capped', 'dynamic', 'name-match')"
ENTRIES = r"""entries as (select id, repo_id from ent where not missing and not external and kind in ('function', 'method', 'jcl_job', 'transaction_code', 'module')
  and (lower(name) in ('main', 'run', 'start', 'handler', 'app') or coalesce(regexp_matches(lower(path), '(^|/)(__main__\.py|main\.\w+|index\.(js|ts)|app\.\w+|server\.\w+)$'), false) or kind in ('jcl_job', 'transaction_code')))"""
DOWN = "down as (select src_id as id, count(*) filter (not data) as n_calls, count(*) filter (data) as n_data from (select distinct src_id, dst_id, type in ('reads', 'writes', 'maps_to') as data from rel where type in ('calls', 'runs', 'invokes', 'reads', 'writes', 'maps_to') and not pruned and src_id in (select id from entries)) group by 1)"
GAPS = "sites as (select dst_id as stub_id, repo_id, path, count(*) as n from rel where dst_id not in (select id from ent where not missing) group by 1, 2, 3)"
REFS = lambda types: rf"refs as (select distinct e.repo_id, e.path, r.type as fact, regexp_extract(r.dst_id, '([^:]+)$', 1) as name from rel r join ent e on e.id = r.src_id where r.type in ({types}) and e.path is not null and regexp_extract(r.dst_id, '([^:]+)$', 1) <> '')"
TRIGGER_STARTS = "starts as (select distinct r.dst_id as id from rel r join ent e on e.id = r.src_id where r.type in ('calls', 'runs', 'invokes') and e.kind in ('jcl_job', 'transaction_code'))"


def _members_sql() -> str:
    rank = "case kind " + " ".join(f"when '{k}' then {n}" for n, k in enumerate(resolve.MEMBER_KINDS, 1)) + " end"
    prefixed = f"regexp_matches(upper(r.name), '^({'|'.join(names.PREFIXES)})') or upper(r.name) in {_quoted(names.UTILITIES)}"
    own = f"own as (select repo_id, upper(name) as member, path, {{'r': {rank}, 'id': id, 'kind': kind}} as b from ent where kind in {_quoted(resolve.MEMBER_KINDS)} and not missing and not external and name is not null)"
    body = f"""select r.*, coalesce(n.b, f.b).id as target_id, coalesce(n.b, f.b).kind as target_kind, case when f.b is not null then 'member' when {prefixed} then 'external' else 'missing' end as resolution from refs r
      left join (select repo_id, member, path, min(b) as b from own group by 1, 2, 3) n on n.repo_id = r.repo_id and n.member = upper(r.name) and n.path = r.path left join (select repo_id, member, min(b) as b from own group by 1, 2) f on f.repo_id = r.repo_id and f.member = upper(r.name)"""
    return over("ent", "rel", REFS("'calls', 'runs', 'imports'"), own, body=body)


def _relative_sql() -> str:
    m = MODULE.format(p="path")
    py = r"""select path, wanted, case when not starts_with(wanted, '.') then wanted else array_to_string(list_concat(string_split(module, '.')[1:greatest(0, len(string_split(module, '.')) - len(regexp_extract(wanted, '^(\.*)', 1)) + case when regexp_matches(path, '(^|/)__init__\.[^/]*$') then 1 else 0 end)],
      case when regexp_replace(wanted, '^\.+', '') = '' then [] else [regexp_replace(wanted, '^\.+', '')] end), '.') end as module from m, (select unnest([{w}]) as wanted) where regexp_matches(path, '\.py$')"""
    # In SQL the leading steps of a path are counted by hand: one less for each '../'.
    js = r"""select path, wanted, case when not starts_with(wanted, '.') then wanted else regexp_replace(array_to_string(list_concat(string_split(module, '.')[1:greatest(0, len(string_split(module, '.')) - 1 - (len(wanted) - len(replace(wanted, '../', ''))) // 3)],
      [replace(regexp_replace(regexp_replace(wanted, '^(\.\.?/)+', ''), '\.(js|jsx|ts|tsx|mjs|cjs)$', ''), '/', '.')]), '.'), '(^|\.)index$', '') end as module from m, (select unnest([{w}]) as wanted) where regexp_matches(path, '\.(js|ts)$')"""
    quote = lambda words: ", ".join(f"'{w}'" for w in words)
    return f"with {PATHS}, m as (select path, {m} as module from paths) " + py.format(w=quote(WANTED_PYTHON)) + " union all " + js.format(w=quote(WANTED_JAVASCRIPT))


_CONFIG = _quoted([x for k, v in SUFFIXES.items() if v == "config" for x in k.split()])
CHUNKS = rf"""newest as (select repo_id, path, string_split_regex(content, '\r\n|\r|\n') as lines from (select {clean_id_sql('repo_id')} as repo_id, {clean_id_sql('path')} as path, content,
    row_number() over (partition by {clean_id_sql('repo_id')}, {clean_id_sql('path')} order by indexed_at desc) as rn from files where content is not null) where rn = 1 and not coalesce(lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)) in {_CONFIG}, false)),
spans as (select e.repo_id, e.path, greatest(1, start_line) as start_line, least(end_line, len(lines)) as end_line, id as span_id from (select * replace ({clean_id_sql('repo_id')} as repo_id, {clean_id_sql('path')} as path) from ent) e join newest n on n.repo_id = e.repo_id and n.path = e.path
  where kind in {_quoted(chunks.CHUNK_KINDS)} and not missing and start_line is not null and end_line is not null),
owners as (select repo_id, path, line, arg_min(span_id, (end_line - start_line, -start_line, span_id)) as span_id from (select *, unnest(range(start_line, end_line + 1)) as line from spans where start_line <= end_line) group by 1, 2, 3),
every as (select repo_id, path, unnest(range(1, len(lines) + 1)) as line from newest),
placed as (select e.repo_id, e.path, e.line, coalesce(o.span_id, '') as span_id from every e left join owners o on o.repo_id = e.repo_id and o.path = e.path and o.line = e.line),
runs as (select repo_id, path, span_id, min(line) as first_line, max(line) as last_line, case when span_id = '' then 60 else 200 end as size from (select *, line - row_number() over (partition by repo_id, path, span_id order by line) as island from placed) group by repo_id, path, span_id, island),
starts as (select *, unnest(case when last_line - first_line + 1 <= size then [first_line] else range(first_line, greatest(first_line, last_line - 10) + 1, size - 10) end) as start_line from runs)"""

SQL = {
    "build_chunks": over("ent", CHUNKS, body=r"""select 'chunk:' || s.repo_id || ':' || s.path || ':' || start_line || '-' || least(start_line + size - 1, last_line) as chunk_id, nullif(span_id, '') as span_id, start_line::int as start_line, least(start_line + size - 1, last_line)::int as end_line
      from starts s join newest n on n.repo_id = s.repo_id and n.path = s.path where span_id <> '' or regexp_matches(array_to_string(lines[start_line:least(start_line + size - 1, last_line)], chr(10)), '\S')"""),
    "get_entity": over("ent", body="select id, kind, name, path from ent where id = 'module:atlas-core-5fe3a4fbf0c9:src/common/money.py:src.common.money'"),
    "find_exact_symbol": over("ent", body="select id, kind from ent where name = 'write_entry' or qualified_name = 'write_entry'"),
    "module_names": f"with {PATHS} select path, {MODULE.format(p='path')} as module from paths",
    "relative_imports": _relative_sql(),
    "external_names": over("ent", body=f"select id, upper(name) in {_quoted(names.UTILITIES)} or regexp_matches(upper(name), '^({'|'.join(names.PREFIXES)})') as external from ent where name is not null"),
    "relation_aliases": f"select case when t in {_quoted(RELATIONS)} then t {_case(schema.RELATION_ALIASES, 't')} else 'relates_to' end as relation, count(*) as n from (select lower({clean_id_sql('type')}) as t from relationships where type is not null) group by 1",
    "truncated_cells": "select doc_id, case when len(text) > 200 then text[1:200] || '…' else text end as cell from documents",
    "merged_attributes": over("ent", body="select id, kind, coalesce(case when kind = 'module' then name end, module) as module, path, (kind is not null)::int + (coalesce(case when kind = 'module' then name end, module) is not null)::int + (path is not null)::int as n from ent"),
    "definer_resolve": over("ent", """owners as (select repo_id, qualified_name as parent_qname, min({'r': case when kind in ('class', 'interface') then 0 when kind = 'module' then 1 else 2 end, 'id': id}) as p from ent where kind in ('class', 'interface', 'module', 'legacy_program', 'file') and not missing group by 1, 2)""",
        "mods as (select repo_id, path, min(id) as m from ent where kind = 'module' and not missing group by 1, 2)", "s as (select distinct repo_id, path, qualified_name, parent_qname from parsed_symbols)",
        body="select s.repo_id, s.path, s.qualified_name, coalesce(p.id, m) as definer_id, case when p is not null then 'parent' when m is not null then 'file' else 'missing' end as via from s left join owners o on o.repo_id = s.repo_id and o.parent_qname = s.parent_qname left join mods on mods.repo_id = s.repo_id and mods.path = s.path"),
    "import_resolve": over("ent", "rel", REFS("'imports'"), "here as (select * from ent where not missing and not external)",
        "members as (select repo_id, upper(name) as member, min(id) as t from here where kind in ('legacy_program', 'copybook') group by 1, 2)", "modules as (select repo_id, qualified_name as name, min(id) as t from here where kind = 'module' group by 1, 2)",
        "tops as (select distinct repo_id, string_split(qualified_name, '.')[1] as top from here where kind = 'module')",
        body=f"""select r.repo_id, r.path, r.name, coalesce(m.t, o.t) as target_id, case when m.t is not null then 'member' when o.t is not null then 'module' when t.top is null or string_split(r.name, '.')[1] in {_quoted(names.STANDARD)} then 'external' else 'missing' end as resolution
          from (select distinct repo_id, path, name from refs) r left join members m on m.repo_id = r.repo_id and m.member = upper(r.name) left join modules o on o.repo_id = r.repo_id and o.name = r.name left join tops t on t.repo_id = r.repo_id and t.top = string_split(r.name, '.')[1]"""),
    "type_ref_resolve": over("ent", "rel", IMPORTED, TYPES, body="select repo_id, module, owner, name, t.id as target_id, t.kind as target_kind, resolution from hit"),
    "inheritance_edges": over("ent", "rel", IMPORTED, TYPES, body="select distinct repo_id, owner, t.id as target_id, case when resolution = 'candidate' then 'references' when t.kind = 'interface' then 'implements' else 'extends' end as type from hit where t is not null"),
    "bound_calls": over("ent", "rel", IMPORTED, "binds as (select repo_id, module, list_extract(string_split(imported, '.'), -1) as local, max(imported) as target from imported group by 1, 2, 3)",
        r"calls as (select r.id as call_id, e.repo_id, e.module, regexp_extract(r.dst_id, '([^.:]+\.[^.:]+)$', 1) as name from rel r join ent e on e.id = r.src_id where r.type = 'calls')",
        "own as (select repo_id, qualified_name, min({'id': id, 'kind': kind}) as e from ent where not missing and kind in ('function', 'method', 'test', 'class', 'interface') group by 1, 2)",
        body="select call_id, e.id as target_id, case when e is null then 'missing' when e.kind in ('class', 'interface') then 'constructor' else 'import-traced' end as resolution from calls c join binds b on b.repo_id = c.repo_id and b.module = c.module and b.local = string_split(c.name, '.')[1] left join own o on o.repo_id = c.repo_id and o.qualified_name = b.target || '.' || string_split(c.name, '.')[2]"),
    "member_resolve": _members_sql(),
    "materialised_tables": over("ent", "rel", "refs as (select repo_id, upper(name) as key, min(name) as name from (select repo_id, regexp_extract(dst_id, '([^:]+)$', 1) as name from rel where type in ('reads', 'writes')) where name <> '' group by 1, 2)",
        "own as (select repo_id, upper(name) as key, min(id) as id from ent where kind = 'database_table' group by 1, 2)", body="select r.repo_id, r.name, coalesce(o.id, 'database_table:' || r.repo_id || '::' || r.name) as id, o.id is null as made from refs r left join own o on o.repo_id = r.repo_id and o.key = r.key"),
    "gap_sites": over("ent", "rel", GAPS, body="select * from sites"),
    "gaps_of_symbols": over("ent", "rel", GAPS, body="select e.id, f.gaps, f.refs from ent e join (select repo_id, path, count(*) as gaps, sum(n)::bigint as refs from sites where path is not null group by 1, 2) f using (repo_id, path) where not missing and kind in ('function', 'method', 'class', 'legacy_program', 'paragraph')"),
    "gap_reasons": over("ent", "rel", body="select dst_id as stub_id, count(*) as ref_count, count(distinct path) as n_files, string_agg(distinct type, ',' order by type) as reasons from rel where dst_id not in (select id from ent where not missing) group by 1"),
    "unresolved_calls": over("rel", body=rf"select lower(regexp_extract(dst_id, '([^.:]+)$', 1)) as name, count(*) as n_calls, count(distinct src_id) as n_callers from rel where {OPEN} group by 1"),
    "unresolved_from": over("rel", body=f"select src_id as id, count(*) filter ({OPEN}) as n_open, count(*) as n_calls from rel where type = 'calls' and not pruned group by 1 having count(*) filter ({OPEN}) > 0"),
    "entry_point_counts": over("ent", "rel", "used as (select dst_id from rel where type in ('calls', 'runs', 'invokes') and not pruned)", "here as (select * from ent where not missing and not external)",
        body=r"""select kind, count(*) as n from (select 'jobs' as kind from here where kind = 'jcl_job' and not regexp_matches(lower(coalesce(path, '')), '[.]pro?c$') union all select 'transactions' from here where kind = 'transaction_code'
          union all select 'uncalled_programs' from here where kind = 'legacy_program' and id not in (select dst_id from used) union all select 'main_guards' from (select distinct repo_id, path from files where regexp_matches(path, '\.py\s*$') and regexp_matches(content, '(?m)^if\s+__name__\s*==\s*[''"]__main__[''"]'))) group by 1"""),
    "overview_totals": over("ent", "n as (select repo_id, " + ", ".join(f"count(*) filter (kind = '{k}' and not missing and not external) as {k}{'es' if k == 'class' else 's'}" for k in ("file", "module", "function", "method", "class", "test")) + " from ent group by 1)",
        body="select n.*, coalesce(x.externals, 0) as externals from n left join (select repo_id, count(distinct qualified_name) as externals from ent where external group by 1) x on x.repo_id = n.repo_id"),
    "documented_share": over("ent", body="select kind, count(*) as eligible, count(*) filter (trim(docstring) <> '') as covered, round(avg(len(docstring)) filter (trim(docstring) <> ''), 4) as average_length from ent where kind in ('function', 'method', 'test', 'legacy_program', 'paragraph', 'class', 'interface') and not missing and not external group by 1"),
    "perspectives": over("ent", "rel", ENTRIES, """seeds as (select 'entry_points' as perspective, id, 0 as n from entries union all select 'hubs', dst_id, count(*) from rel where type = 'calls' and not pruned and dst_id in (select id from ent where not missing and not external) group by dst_id
        union all select 'modules', src_id, count(*) from rel where type = 'defines' and src_id in (select id from ent where kind = 'module' and not missing) group by src_id)""",
        body="select perspective, id, rank::int as rank from (select perspective, id, row_number() over (partition by perspective order by n desc, id) as rank from seeds) where rank <= 12"),
    "downstream": over("ent", "rel", ENTRIES, DOWN, body="select * from down"),
    "walkthrough_starts": over("ent", "rel", ENTRIES, DOWN, body="select repo_id, id, size from (select e.repo_id, d.id, n_calls + n_data as size, row_number() over (partition by e.repo_id order by n_calls + n_data desc, d.id) as rn from down d join entries e on e.id = d.id) where rn = 1"),
    "explain_modules": over("ent", "rel", "mods as (select id, repo_id, path from ent where kind = 'module' and not missing and not external)",
        "across as (select b.repo_id, b.path, count(*) as n from rel r join ent a on a.id = r.src_id join ent b on b.id = r.dst_id where r.type = 'calls' and not r.pruned and a.path is not null and b.path is not null and not (a.repo_id is not distinct from b.repo_id and a.path = b.path) group by 1, 2)",
        body="""select m.id, coalesce(d.n, 0) as symbols, coalesce(o.n, 0) as imports, coalesce(i.n, 0) as importers, coalesce(x.n, 0) as callers_outside from mods m left join (select src_id, count(distinct dst_id) as n from rel where type = 'defines' group by 1) d on d.src_id = m.id
          left join (select src_id, count(distinct dst_id) as n from rel where type = 'imports' group by 1) o on o.src_id = m.id left join (select dst_id, count(distinct src_id) as n from rel where type = 'imports' group by 1) i on i.dst_id = m.id left join across x on x.repo_id = m.repo_id and x.path = m.path"""),
    "flow_summary": over("rel", _starts_sql("src_id", "'runs', 'invokes', 'calls'"), *FLOW, body="""select coalesce(p.root, d.root) as root, coalesce(programs, 0) as programs, coalesce(data, 0) as data, coalesce(read_data, 0) as read_data, coalesce(written_data, 0) as written_data
        from (select root, count(distinct dst_id) as programs from flow where type in ('calls', 'runs', 'invokes') group by 1) p full join (select root, count(distinct dst_id) as data, count(distinct dst_id) filter (type = 'reads') as read_data, count(distinct dst_id) filter (type = 'writes') as written_data from flow where type in ('reads', 'writes') group by 1) d on d.root = p.root""", recursive=True),
    "flow_kinds": over("ent", "rel", _starts_sql("src_id", "'runs', 'invokes', 'calls'"), *FLOW, body="select root, coalesce(e.kind, 'unknown') as kind, count(*) as n from (select root, src_id as id from flow union select root, dst_id from flow) x left join ent e on e.id = x.id group by 1, 2", recursive=True),
    "abilities": over("ent", "rel", body="""select 'call_graph' as ability, exists(select 1 from rel where type = 'calls') as present union all select 'lineage', exists(select 1 from rel where type in ('reads', 'writes')) union all select 'tests', exists(select 1 from rel where type = 'tests')
        union all select 'triggers', exists(select 1 from ent where kind in ('jcl_job', 'transaction_code')) union all select 'capabilities', exists(select 1 from ent where kind = 'business_capability') union all select 'semantic', exists(select 1 from vectors where vector is not null)"""),
    "united_neighbourhoods": over("rel", _starts_sql("src_id"), "near as (select id from starts union select r.dst_id from rel r join starts s on s.id = r.src_id where r.type = 'calls' union select r.src_id from rel r join starts s on s.id = r.dst_id where r.type = 'calls')",
        body="select id, src_id, dst_id, type from rel where src_id in (select id from near) and dst_id in (select id from near)"),
    "deleted_vectors": "select model, count(*) as n from vectors where chunk_id is null or chunk_id not in (select chunk_id from vectors where (dim <> len(vector) or vector is null) and chunk_id is not null) group by 1",
    "without_repository": "select repo_id, count(*) as n from files where repo_id is null or repo_id <> 'atlas-core-5fe3a4fbf0c9' group by 1",
    "call_budget": over("rel", body="select id, repo_id from (select id, repo_id, row_number() over (partition by repo_id order by confidence nulls first, id) as n from rel where type = 'calls') where n <= 20"),
    "triggers_of_programs": over("ent", "rel", TRIGGER_STARTS, "steps as (select distinct dst_id as a, src_id as b from rel where type in ('invokes', 'runs', 'calls'))",
        "walk as (select id as root, id, 0 as depth from starts union select w.root, s.b, w.depth + 1 from walk w join steps s on s.a = w.id where w.depth < 4)",
        body="select w.root, e.id as trigger, e.kind, min(w.depth) as depth from walk w join ent e on e.id = w.id where e.kind in ('transaction_code', 'jcl_job') group by 1, 2, 3 having min(w.depth) > 0", recursive=True),
}
