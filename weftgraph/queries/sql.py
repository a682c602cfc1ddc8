"""Pieces of SQL that several of the checking queries share."""

#: The characters of weftgraph.tables.WHITE_SPACE.
WHITE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]+"


def clean_id(col: str) -> str:
    return f"trim(regexp_replace({col}, '{WHITE}', ' ', 'g'))"


def clean_type(col: str) -> str:
    return f"lower({clean_id(col)})"


ENTITIES = f"""ent as (select id, kind, name, qualified_name, repo_id, path, start_line, end_line, indexed_at, deleted_at,
    coalesce(json_extract_string(attributes, '$.missing') = 'true', false) as missing, coalesce(json_extract_string(attributes, '$.external') = 'true', false) as external,
    json_extract_string(attributes, '$.module') as module, coalesce(json_extract_string(attributes, '$.docstring'), '') as docstring
  from (select * replace ({clean_id('id')} as id), row_number() over (partition by {clean_id('id')}
      order by indexed_at desc nulls last, coalesce(deleted_at, timestamp '9999-01-01') desc, attributes desc nulls last) as rn from entities) where rn = 1)"""

RELATIONSHIPS = f"""rel as (select id, type, src_id, dst_id, repo_id, path, start_line, confidence,
    json_extract_string(attributes, '$.resolution') as resolution, cast(json_extract_string(attributes, '$.fan_out') as int) as fan_out,
    coalesce(json_extract_string(attributes, '$.pruned') = 'true', false) as pruned
  from (select *, row_number() over (partition by id order by indexed_at desc nulls last, received_at desc nulls last, confidence desc nulls last) as rn
    from (select {clean_id('id')} as id, {clean_type('type')} as type, {clean_id('src_id')} as src_id, {clean_id('dst_id')} as dst_id,
        repo_id, path, start_line, confidence, attributes, indexed_at, received_at
      from relationships where src_id is not null and dst_id is not null and type is not null) where src_id <> dst_id) where rn = 1)"""

RESOLVED = "coalesce(resolution in ('syntactic', 'import-traced', 'inherited', 'inferred', 'lsp-verified', 'scip'), false)"


def over(*tables: str, body: str, recursive: bool = False) -> str:
    """A query over the canonical tables ``ent`` and ``rel``."""
    parts = [{"ent": ENTITIES, "rel": RELATIONSHIPS}.get(t, t) for t in tables]
    return ("with recursive " if recursive else "with ") + ",\n".join(parts) + "\n" + body
