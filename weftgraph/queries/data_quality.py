"""Problems 1 and 3: crowded targets and orphan references."""

from __future__ import annotations

from ..operators import edge_targets, orphans
from ..tables import load
from .sql import clean_id, clean_type

PARENTS = "select distinct {id} as id, indexed_at, deleted_at from entities where not coalesce(json_extract_string(attributes, '$.missing') = 'true', false)".format(id=clean_id("id"))
REFS = f"""select distinct {clean_id('id')} as ref_id, 'src_id' as ref_column, {clean_id('src_id')} as key, indexed_at as t from relationships where src_id is not null
  union select distinct {clean_id('id')}, 'dst_id', {clean_id('dst_id')}, indexed_at from relationships where dst_id is not null"""
ORPHANS = f"""with parents as ({PARENTS}), refs as ({REFS}), firsts as (select id, min(indexed_at) as first from parents group by id),
orphans as (select r.*, case when f.id is null then 'missing' when f.first > r.t then 'late' else 'deleted' end as status
  from refs r left join firsts f on f.id = r.key
  where not exists (select 1 from parents p where p.id = r.key and p.indexed_at <= r.t and (p.deleted_at is null or r.t < p.deleted_at)))"""
EDGES = f"""with edges as (select {clean_type('type')} as type, {clean_id('dst_id')} as dst_id, {clean_id('id')} as id, {clean_id('src_id')} as src_id from relationships),
counts as (select type, dst_id, count(distinct id) as n_edges, count(distinct src_id) as n_sources from edges where type is not null and dst_id is not null group by type, dst_id)"""


def _refs_and_spans(spark, d):
    return orphans.references(load(spark, d, "relationships")), orphans.life_spans(load(spark, d, "entities"))


QUERIES = {
    "p1_found": lambda s, d: edge_targets.crowded_targets(load(s, d, "relationships")),
    "p1_edge_targets": lambda s, d: edge_targets.target_counts(load(s, d, "relationships")).drop("heavy"),
    "p3_found": lambda s, d: orphans.orphans(*_refs_and_spans(s, d)).select("ref_id", "ref_column").distinct().withColumnRenamed("ref_id", "id"),
    "p3_orphans": lambda s, d: orphans.orphans(*_refs_and_spans(s, d)),
    "p3_report": lambda s, d: orphans.orphan_report(orphans.orphans(*_refs_and_spans(s, d))),
}

SQL = {
    "p1_found": f"{EDGES} select type, dst_id from counts where n_edges >= 0.02 * (select count(distinct id) from edges)",
    "p1_edge_targets": f"{EDGES} select type, dst_id, n_edges, n_sources from counts",
    "p3_found": f"{ORPHANS} select distinct ref_id as id, ref_column from orphans",
    "p3_orphans": f"{ORPHANS} select ref_id, ref_column, key, t, status from orphans",
    "p3_report": f"{ORPHANS} select ref_column, strftime(t, '%Y-%m') as month, status, count(*) as n from orphans group by all",
}
