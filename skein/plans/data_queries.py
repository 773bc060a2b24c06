"""Queries of the general data-preparation operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.paths import canonical_path
from skein.operators.drift import TARGET, consistent_records, open_records, schema_changes
from skein.operators.nested import flatten_maps
from skein.operators.selection import distinct_per_key, quantiles_per_key
from skein.operators.snapshots import snapshot_changes
from skein.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that each code map added, removed or changed against the map before it."""
    return snapshot_changes(
        table(spark, sf_dir, "code_maps"), table(spark, sf_dir, "map_files"),
        snapshot="map_id", series="root", at="generated_at", key="file_path",
        values=[F.lower("hash")], received="received_at",
    )


def p2_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files each map added, removed and changed."""
    return p2_found(spark, sf_dir).groupBy("map_id", "change_kind").agg(F.count("*").alias("n_files"))


def _importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "import_edges")
    dst, src = canonical_path(F.col("dst_file")), canonical_path(F.col("src_file"))
    return distinct_per_key(edges.where(dst != src), dst, src)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths whose recorded in-degree is not the number of files that import them."""
    nodes = [table(spark, sf_dir, t).select("path", "in_degree") for t in ("file_nodes", "hub_nodes")]
    recorded = nodes[0].unionByName(nodes[1]).where("path is not null and in_degree is not null")
    real = _importers(spark, sf_dir)
    return (
        recorded.withColumn("key", canonical_path(F.col("path")))
        .join(real, "key", "left")
        .where(F.col("in_degree") != F.coalesce("n", F.lit(0)))
        .select("path")
        .distinct()
    )


def p3_importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of importers of every imported file."""
    return _importers(spark, sf_dir).select(F.col("key").alias("path"), F.col("n").alias("n_importers"))


def p3_seen_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each imported file: how many edges, and exact quantiles of when they were seen (in microseconds)."""
    seen = F.unix_micros(F.col("seen_at").cast("timestamp"))
    found = quantiles_per_key(table(spark, sf_dir, "import_edges"), canonical_path(F.col("dst_file")), seen, [0.1, 0.5, 0.9])
    return found.select(
        F.col("key").alias("path"), F.col("n").alias("n_edges"), F.col("q0").alias("seen_p10"),
        F.col("q1").alias("seen_p50"), F.col("q2").alias("seen_p90"),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of all readable code maps, with links to their parents."""
    return flatten_maps(table(spark, sf_dir, "raw_maps"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_records(table(spark, sf_dir, "raw_symbols"), "feed", "batch_no", "payload", "sid")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each batch of a feed changed in the schema."""
    return schema_changes(_records(spark, sf_dir)).withColumnRenamed("batch", "batch_no")


def p6_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All symbol records in one schema; what the target lacks stays in a JSON column."""
    rows = consistent_records(table(spark, sf_dir, "raw_symbols"), "feed", "batch_no", "payload", "sid")
    return rows.withColumnRenamed("batch", "batch_no").withColumn("other", F.to_json("other"))


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_change_counts, p3_found, p3_importers, p3_seen_quantiles, p4_found, p6_found, p6_symbols)
}

_CHANGES = """
with ranks as (
  select map_id, root, row_number() over w as seq, lead(map_id) over w as nxt
  from code_maps where root is not null and generated_at is not null window w as (partition by root order by generated_at, map_id)
), rows as (
  select r.root, r.seq, r.nxt, m.* from (
    select map_id, file_path, lower(arg_max(struct_pack(h := hash), received_at).h) as h
    from map_files where file_path is not null group by map_id, file_path) m join ranks r using (map_id)
), changes as (
  select a.map_id, a.file_path, case when b.map_id is null then 'added' else 'changed' end as change_kind
  from rows a left join rows b on a.root = b.root and a.file_path = b.file_path and b.seq = a.seq - 1
  where a.seq > 1 and (b.map_id is null or a.h is distinct from b.h)
  union all
  select b.nxt, b.file_path, 'removed'
  from rows b left join rows a on a.root = b.root and a.file_path = b.file_path and b.seq = a.seq - 1
  where a.map_id is null and b.nxt is not null
)
"""

_CANON = r"""regexp_replace(regexp_replace(regexp_replace(replace(trim({0}), '\', '/'), '/+', '/', 'g'), '(/\.)+(/|$)', '\2', 'g'), '^(\./)+', '')"""

_IMPORTERS = f"""
with edges as (select {_CANON.format("dst_file")} as dst, {_CANON.format("src_file")} as src from import_edges),
importers as (select dst, count(distinct src) as n from edges where dst <> src group by dst)
"""

_FIELDS = """
with cells as (
  select distinct r.feed, r.batch_no, json_extract_string(r.payload, '$.sid') as sid, e.key,
    case e.type when 'VARCHAR' then 'string' when 'BIGINT' then 'integer' when 'UBIGINT' then 'integer' when 'DOUBLE' then 'fraction'
      when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'list' when 'OBJECT' then 'object' end as kind,
    e.value::varchar as v
  from raw_symbols r, json_each(r.payload) e
), schemas as (
  select feed, batch_no, key, coalesce(string_agg(distinct kind, '|' order by kind), '') as kinds from cells group by all
), batches as (
  select feed, batch_no, lag(batch_no) over (partition by feed order by batch_no) as before from (select distinct feed, batch_no from cells)
), come as (
  select s.feed, s.batch_no, b.before, s.key from schemas s join batches b using (feed, batch_no)
  left join schemas p on p.feed = s.feed and p.batch_no = b.before and p.key = s.key where b.before is not null and p.key is null
), gone as (
  select b.feed, b.batch_no, b.before, p.key from batches b join schemas p on p.feed = b.feed and p.batch_no = b.before
  left join schemas s on s.feed = b.feed and s.batch_no = b.batch_no and s.key = p.key where s.key is null
), moved as (
  select g.feed, g.batch_no, g.key as old, c.key as new
  from gone g join come c using (feed, batch_no)
  join cells o on o.feed = g.feed and o.batch_no = g.before and o.key = g.key and o.kind is not null
  join cells n on n.feed = c.feed and n.batch_no = c.batch_no and n.key = c.key and n.kind is not null and n.sid = o.sid
  group by all having bool_and(o.kind = n.kind and o.v = n.v)
)
"""

_SYMBOLS = (
    _FIELDS.replace("with cells", "with recursive cells", 1).rstrip()
    + """, steps(feed, batch_no, key, first_name, since) as (
  select feed, batch_no, new, old, batch_no from moved
  union all
  select s.feed, s.batch_no, s.key, m.old, m.batch_no from steps s join moved m on m.feed = s.feed and m.new = s.first_name and m.batch_no < s.since
), named as (
  select feed, batch_no, key, arg_min(first_name, since) as first_name from steps group by all
), records as (
  select feed, batch_no, json_extract_string(payload, '$.sid') as sid, max(payload) as p from raw_symbols where json_extract_string(payload, '$.sid') is not null group by all
), opened as (
  select r.feed, r.batch_no, r.sid, e.key, case when e.type = 'VARCHAR' then json_extract_string(e.value, '$') when e.type <> 'NULL' then e.value::varchar end as v
  from records r, json_each(r.p) e where e.key <> 'sid'
), routed as (
  select o.feed, o.batch_no, o.sid, coalesce(arg_max(n.first_name, n.batch_no), o.key) as field, count(n.key) = 0 as own, o.v
  from opened o left join named n on n.feed = o.feed and n.key = o.key and n.batch_no <= o.batch_no group by o.feed, o.batch_no, o.sid, o.key, o.v
), one as (
  select * from routed qualify row_number() over (partition by feed, batch_no, sid, field order by own, v) = 1
)
"""
)


def _target_sql(name: str, kind: str, default) -> str:
    value = f"max(v) filter (where field = '{name}')"
    if kind == "bigint":
        value = f"case when regexp_full_match({value}, '[+-]?[0-9]+') then try_cast({value} as bigint) end"
    elif kind != "string":
        value = f"try_cast({value} as {kind})"
    return f"{value if default is None else f'coalesce({value}, {default})'} as {name}"


ORACLE = {
    "p2_found": _CHANGES + "select map_id, file_path, change_kind from changes",
    "p2_change_counts": _CHANGES + "select map_id, change_kind, count(*) as n_files from changes group by all",
    "p3_found": _IMPORTERS
    + f"""select distinct path from (select path, in_degree from file_nodes union all select path, in_degree from hub_nodes) f
left join importers i on i.dst = {_CANON.format("f.path")} where in_degree is not null and in_degree <> coalesce(n, 0)""",
    "p3_importers": _IMPORTERS + "select dst as path, n as n_importers from importers",
    "p3_seen_quantiles": f"""
with e as (select {_CANON.format("dst_file")} as path, epoch_us(seen_at) as t from import_edges where dst_file is not null and seen_at is not null),
r as (select path, t, row_number() over (partition by path order by t) as i, count(*) over (partition by path) as n from e)
select path, n as n_edges, min(case when i = greatest(1, ceil(0.1 * n - 1e-9)) then t end) as seen_p10,
  min(case when i = greatest(1, ceil(0.5 * n - 1e-9)) then t end) as seen_p50, min(case when i = greatest(1, ceil(0.9 * n - 1e-9)) then t end) as seen_p90
from r group by path, n""",
    "p6_found": _FIELDS
    + """
select c.feed, c.batch_no, case when m.old is null then 'added' else 'renamed' end as change_kind, c.key as field_name, coalesce(m.old, '') as was
from come c left join moved m on m.feed = c.feed and m.batch_no = c.batch_no and m.new = c.key
union all
select g.feed, g.batch_no, 'removed', g.key, '' from gone g left join moved m on m.feed = g.feed and m.batch_no = g.batch_no and m.old = g.key where m.old is null
union all
select s.feed, s.batch_no, 'retyped', s.key, '' from schemas s join batches b using (feed, batch_no)
join schemas p on p.feed = s.feed and p.batch_no = b.before and p.key = s.key where s.kinds <> '' and p.kinds <> '' and s.kinds <> p.kinds""",
    "p6_symbols": _SYMBOLS
    + f"""select feed, batch_no, sid, {", ".join(_target_sql(*t) for t in TARGET)},
  '{{' || coalesce(string_agg(to_json(field)::varchar || ':' || coalesce(to_json(v)::varchar, 'null'), ',' order by field)
    filter (where field not in ({", ".join(f"'{t[0]}'" for t in TARGET)})), '') || '}}' as other
from one group by feed, batch_no, sid""",
    "p4_found": r"""
with recursive one as (
  select raw_id, arg_max(payload, received_at) as p from raw_maps group by raw_id
), layers(raw_id, j, depth) as (
  select raw_id, json(p), 0 from one where json_valid(p)
  union all
  select raw_id, case json_type(j) when 'VARCHAR' then json(json_extract_string(j, '$')) when 'ARRAY' then (j->0) else (j->'code_map') end, depth + 1
  from layers where depth < 8 and ((json_type(j) = 'VARCHAR' and json_valid(json_extract_string(j, '$'))) or json_type(j) = 'ARRAY' or (json_type(j) = 'OBJECT' and (j->'code_map') is not null))
), maps as (
  select raw_id, arg_max(j, depth) as j from layers where json_type(j) = 'OBJECT' and ((j->'files') is not null or (j->'index') is not null or (j->'stats') is not null or (j->'root') is not null) group by raw_id
), files as (
  select m.raw_id, case when json_type((m.j->'files')) = 'OBJECT' then e.key else json_extract_string(e.value, '$.path') end as path, e.value as f from maps m, json_each(m.j->'files') e
), symbols(raw_id, own, parent, s) as (
  select f.raw_id, f.path || '#' || e.key, f.path, e.value from files f, json_each(f.f->'symbols') e where json_type(f.f->'symbols') = 'ARRAY'
  union all
  select s.raw_id, s.own || '#' || e.key, s.own, e.value from symbols s, json_each(s.s->'members') e where json_type(s.s->'members') = 'ARRAY'
), entries as (
  select m.raw_id, e.key as name, case when json_type(e.value) = 'ARRAY' then e.value else json_array(e.value) end as found from maps m, json_each(m.j->'index') e
)
select raw_id, 'map' as node_kind, '' as own_key, '' as parent_key, coalesce(json_extract_string(j, '$.stats.files_processed'), '') as label from maps
union all select raw_id, 'file', path, '', coalesce(json_extract_string(f, '$.hash'), '') from files
union all select raw_id, 'symbol', own, parent, coalesce(json_extract_string(s, '$.name'), '') from symbols
union all select s.raw_id, 'dep', s.own || '@' || e.key, s.own, coalesce(json_extract_string(e.value, '$'), '') from symbols s, json_each(s.s->'deps') e where json_type(s.s->'deps') = 'ARRAY'
union all select n.raw_id, 'entry', n.name || '#' || e.key, n.name, coalesce(json_extract_string(e.value, '$.file'), '') from entries n, json_each(n.found) e""",
}
