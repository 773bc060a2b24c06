"""More queries of the code index: call graph, flow, statistics, relative and loose resolution, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import diff, graph, lines, resolve, rollup, search
from skein.plans.code_queries import _CANON, _GRAPH, _KEYS, _MAPPED, _SYM, _converged_sql, _degrees, _graph, _hits, _score_sql, _symbols, incremental_status
from skein.plans.code_queries import ORACLE as CODE_SQL
from skein.sources.imports import raw_imports
from skein.sources.languages import language_table
from skein.sources.parse import parse_files
from skein.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


@query("""with f as (select name, min(file_path) as callee_file from symbols where name is not null group by name),
c as (select distinct file_path as caller_file, name as caller_name, unnest(dependencies) as callee_name from symbols)
select caller_file, caller_name, callee_file, callee_name from c join f on f.name = c.callee_name""")
def call_graph(spark, sf_dir):
    """Calls of names that some file defines."""
    return search.call_graph(_symbols(spark, sf_dir))


@query(f"""with {_GRAPH}, f as (select distinct {_CANON.format("file_path")} as path from files where file_path is not null)
select src, dst from g where src <> dst and src in (from f) and dst in (from f)""")
def internal_imports(spark, sf_dir):
    """Imports between files whose content is kept."""
    return graph.internal_edges(_graph(spark, sf_dir), table(spark, sf_dir, "files").select(F.col("file_path").alias("path")))


@query(f"""with {_GRAPH}, l as (select {_CANON.format("path")} as path, max(lower(trim(language))) as language from file_nodes group by 1)
select language, count(*) as files, sum(out_degree)::bigint as edges, count(*) filter (where in_degree >= 3) as hubs, avg(in_degree) as avg_in, avg(out_degree) as avg_out from d left join l using (path) group by language""")
def graph_language_stats(spark, sf_dir):
    """The graph by language."""
    return graph.language_stats(_degrees(spark, sf_dir), table(spark, sf_dir, "file_nodes"))


@query(f"""with {_GRAPH}, r as (select src as path, dst, row_number() over (partition by src order by dst) as k from g),
i as (select path, string_agg(dst, ', ' order by k) as imports, count(*) as n from r where k <= 3 group by path)
select case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else 'root' end as dir, path, in_degree, imports, out_degree - n as more from d join i using (path)""")
def dependency_flow(spark, sf_dir):
    """What the files of each folder import."""
    return graph.dependency_flow(_graph(spark, sf_dir), _degrees(spark, sf_dir)).withColumn("imports", F.array_join("imports", ", "))


@query(f"""select path, in_degree, out_degree, rank, case when in_degree >= 8 then 'critical' when in_degree >= 5 then 'high' when in_degree >= 3 then 'medium' when in_degree >= 2 then 'low' else 'none' end as level,
in_degree * (1 + ln(1 + out_degree)) as hub_score from ({_converged_sql(30)}) r join (with {_GRAPH} from d) d using (path)""")
def graph_analysis(spark, sf_dir):
    """Degrees, level, score and rank of every file in one call."""
    return graph.analyze(table(spark, sf_dir, "import_edges"), table(spark, sf_dir, "file_nodes")).withColumn("rank", F.round("rank", 9))


@query(f"""select count(*) as total, count(path) as resolved, count(*) - count(path) as unresolved, count(path) / count(*) as rate from ({CODE_SQL["resolve_priority"]})""")
def resolution_stats(spark, sf_dir):
    """How many imports lead to a file."""
    from skein.plans.code_queries import resolve_priority

    return resolve.resolution_stats(resolve_priority(spark, sf_dir))


@query(r"""with f as (select distinct path, regexp_replace(path, '([^/])\.[^./]+$', '\1') as bare from file_nodes where path is not null),
k as (select path, 1 as prio, 'exact' as strategy, path as key from f union all select path, 2, 'no_ext', bare from f
  union all select path, 3, 'index', case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end from f where regexp_extract(bare, '[^/]*$', 0) in ('index', '__init__', 'mod')
  union all select path, 4, 'lower', lower(bare) from f union all select path, 5, 'suffix', array_to_string(p[len(p) - i + 1:len(p)], '/') from (select path, string_split(bare, '/') as p from f), unnest(range(1, len(p) + 1)) as u(i)),
s as (select distinct upper(replace(raw_import, '.', '/')) as spec from import_edges where raw_import is not null union select distinct replace(raw_import, '.', '/') from import_edges where raw_import is not null),
h as (select spec, prio, strategy, first(path order by case strategy when 'lower' then length(path) else 0 end, path) as path, count(*) as n
  from s join k on k.key = case strategy when 'lower' then lower(spec) else spec end group by all),
b as (select * from h where strategy <> 'suffix' or n = 1 qualify row_number() over (partition by spec order by prio) = 1)
select spec, path, coalesce(strategy, 'not_found') as strategy from s left join b using (spec)""")
def resolve_shortest(spark, sf_dir):
    """Names in any letter case, the shortest path first."""
    spec = F.translate("raw_import", ".", "/")
    edges = table(spark, sf_dir, "import_edges").where("raw_import is not null")
    specs = edges.select(spec.alias("spec")).unionByName(edges.select(F.upper(spec).alias("spec")))
    return resolve.resolve_loosely(specs, table(spark, sf_dir, "file_nodes").select("path"))


@query(rf"""with {_KEYS}, r as ({CODE_SQL["imports_javascript"]}), i as (select file_path as src, raw_import as spec, string_split(case when contains(file_path, '/') then regexp_replace(file_path, '/[^/]*$', '') else '' end, '/') as folder,
  len(string_split(raw_import, '../')) - 1 as ups, regexp_replace(raw_import, '^(\./|\.\./)+', '') as tail from r where regexp_matches(raw_import, '^\.\.?/')),
n as (select src, spec, regexp_replace(array_to_string(list_append(folder[1:greatest(len(folder) - ups, 0)], tail), '/'), '^/+|/+$', '', 'g') as key from i),
h as (select src, spec, case when kind = 'index' then 'index' else 'relative' end as strategy, min(path) as path, count(distinct path) as n from n join keys using (key) where kind <> 'suffix' and path <> src group by all),
b as (select * from h qualify row_number() over (partition by src, spec order by strategy, path) = 1)
select n.src, n.spec, path, coalesce(strategy, 'not_found') as strategy, coalesce(n, 0) as candidates from n left join b using (src, spec)""".replace("from n left join b using", "from (select distinct src, spec from n) n left join b using").replace("coalesce(n, 0)", "coalesce(b.n, 0)"))
def resolve_relative(spark, sf_dir):
    """Relative imports of JavaScript and TypeScript, climbing from their files."""
    recorded = table(spark, sf_dir, "files").where(F.lower("language").isin("javascript", "typescript"))
    raw = raw_imports(recorded, ("javascript", "typescript")).where(F.col("raw_import").rlike(r"^\.\.?/"))
    asked = raw.select(F.col("file_path").alias("src"), F.col("raw_import").alias("spec"), F.lit("javascript").alias("language"))
    return resolve.resolve_imports(asked, table(spark, sf_dir, "file_nodes").select("path"))


@query(f"""with {_KEYS}, i as (select distinct raw_import as spec from import_edges where raw_import is not null),
h as (select spec, min(path) as path from i join keys on starts_with(spec, 'net.') and key = 'shared-commons/net/' || substr(spec, 5) where kind in ('exact', 'no_ext', 'index') group by spec)
select spec, path, case when path is null then 'not_found' else 'alias' end as strategy from i left join h using (spec)""")
def alias_all(spark, sf_dir):
    """All imports against one alias of the shared library; those of other form are not found by it."""
    edges = table(spark, sf_dir, "import_edges").where("raw_import is not null").select(F.lit("-").alias("src"), F.col("raw_import").alias("spec"), F.lit("").alias("language"))
    found = resolve.resolve_imports(edges, table(spark, sf_dir, "file_nodes").select("path"), aliases=[resolve.Alias("net.*", ("shared-commons/net/*",))])
    by_alias = F.col("strategy") == "alias"
    return found.select("spec", F.when(by_alias, F.col("path")).alias("path"), F.when(by_alias, "alias").otherwise("not_found").alias("strategy"))


@query("""with m as (select distinct file_path, parent as class_name, sym_ord, line_start, name from symbols where type = 'method' and parent is not null),
r as (select *, row_number() over (partition by file_path, class_name order by sym_ord, line_start, name) as k from m)
select file_path, class_name, count(*) as n_methods, coalesce(string_agg(name, ', ' order by k) filter (where k <= 3), '') as methods from r group by all""")
def class_methods(spark, sf_dir):
    """The methods of each class."""
    return rollup.class_methods(_symbols(spark, sf_dir))


@query(f"""with {_GRAPH}, s as (select distinct file_path, sym_ord, line_start, name, type from symbols)
select file_path, count(*) filter (where type = 'class') as classes, count(*) filter (where type = 'function') as functions, count(*) filter (where type = 'method') as methods,
coalesce(max(in_degree), 0) as in_degree, coalesce(max(out_degree), 0) as out_degree from s left join d on d.path = s.file_path group by file_path""")
def meta_degrees(spark, sf_dir):
    """Counts of each file's symbols beside its place in the graph."""
    return rollup.meta_with_degrees(_symbols(spark, sf_dir), _degrees(spark, sf_dir))


@query(f"""select coalesce(nullif(lower(regexp_extract(file_path, '[^/](\\.[^./]+)$', 1)), ''), '<none>') as ext, count(*) as n
from (select distinct file_path from map_files) where lower(regexp_extract(file_path, '[^/](\\.[^./]+)$', 1)) not in ({_MAPPED}) group by 1 order by n desc, ext limit 4""")
def unmapped_top4(spark, sf_dir):
    """The four extensions that most files without a language have."""
    found = diff.unmapped_extensions(table(spark, sf_dir, "map_files"), language_table(spark).where("ext <> '.h'"))
    return found.orderBy(F.desc("n"), "ext").limit(4)


@query(f"""with f as (select file_path, max(length(trim(content))) as n, lower(regexp_extract(file_path, '[^/](\\.[^./]+)$', 1)) in ({_MAPPED}) as known from files group by file_path)
select cause, count(*) as n from (select case when not known then 'unmapped' when n is null then 'unreadable' when n = 0 then 'empty' end as cause from f) where cause is not null group by cause""")
def skip_causes(spark, sf_dir):
    """Why files are not parsed, headers taken for unmapped."""
    return diff.skip_causes(table(spark, sf_dir, "files"), language_table(spark).where("ext <> '.h'"))


@query(f"""select * from ({_score_sql("merge_")}) where file_path like '%.py'""")
def search_glob_cut(spark, sf_dir):
    """A glob that only shortens a result already cut."""
    return _hits(search.search_files_glob(search.search_symbols(_symbols(spark, sf_dir), "merge_", similarity=False, limit=25), "*.py"))


@query(f"""with st as ({CODE_SQL["incremental_status"]})
select file_path, name, type, line_start, 'kept' as origin from symbols where file_path in (select file_path from st where status = 'unchanged')
union all select distinct file_path, name, type, line_start, 'again' from symbols where file_path in (select file_path from st where status in ('modified', 'added'))""")
def merge_incremental(spark, sf_dir):
    """Symbols carried over from unchanged files, with those of changed and new ones."""
    status = incremental_status(spark, sf_dir)
    cols = ["file_path", "name", "type", "line_start"]
    again = diff.symbols_of_changed(_symbols(spark, sf_dir), status.where("status in ('modified', 'added')")).select(cols).distinct()
    return diff.merge_incremental(_symbols(spark, sf_dir).select(cols).withColumn("origin", F.lit("kept")), again.withColumn("origin", F.lit("again")), status)


@query("""select map_id, files_processed, case when files_processed < 150 then 3 when files_processed < 1000 then 4 when files_processed < 5000 then 5 else 6 end as matches,
case when files_processed < 150 then 1600 when files_processed < 1000 then 1800 when files_processed < 5000 then 2000 else 2400 end as chars from code_maps where files_processed is not null""")
def lookup_budgets(spark, sf_dir):
    """What a lookup may show in each map, by its size."""
    matches, chars = lines.lookup_budgets(F.col("files_processed"))
    return table(spark, sf_dir, "code_maps").where("files_processed is not null").select("map_id", "files_processed", matches.alias("matches"), chars.alias("chars"))


@query(f"""with {_SYM} select distinct 'calls' as direction, file_path, callee as name, line_start from (select file_path, line_start, unnest(list_slice(list_sort(list_distinct(dependencies)), 1, 10)) as callee from symbols where lower(name) = 'merge_stream_gap' and contains(file_path, '/src/'))
union select distinct 'called_by', file_path, name, line_start from symbols where list_contains(dependencies, 'merge_stream_gap') and contains(file_path, '/src/')""")
def callees_in_folder(spark, sf_dir):
    """What one symbol calls and who calls it, in paths that contain a text."""
    return search.dependencies_of(_symbols(spark, sf_dir), "merge_stream_gap", file_contains="/src/")


# The recorded symbols of the tables are what a scan of the same files finds, but for constants, which they hold in part.

_VALUES = ("constant", "const", "variable", "type", "type_alias")


def _recorded_sql(columns: str, suffixes: str, where: str = "true") -> str:
    return f"""select distinct {columns} from symbols where regexp_matches(file_path, '\\.({suffixes})$') and type not in {_VALUES} and name is not null and line_start is not null and {where}
and file_path in (select file_path from files where content is not null)"""


def _parsed(spark, sf_dir, suffixes: str):
    """Symbols that parsing finds in the files of some suffixes."""
    files = table(spark, sf_dir, "files").where(F.col("file_path").rlike(rf"\.({suffixes})$"))
    return parse_files(files).where(~F.col("type").isin(*_VALUES))


def _where_recorded(spark, sf_dir, found, column: str):
    """Rows whose recorded symbol tells the column: the tables have nulls in optional fields."""
    told = _symbols(spark, sf_dir).where(F.col(column).isNotNull()).select("file_path", "name", "line_start").distinct()
    return found.join(told, ["file_path", "name", "line_start"], "left_semi").select("file_path", "name", "line_start", column).distinct()


_PLACE = ["file_path", "name", "type", "line_start", "line_end", "parent"]


@query(_recorded_sql(", ".join(_PLACE), "py"))
def parse_python_symbols(spark, sf_dir):
    """Classes, functions and methods of Python, by the syntax tree."""
    return _parsed(spark, sf_dir, "py").select(*_PLACE).distinct()


@query(_recorded_sql(", ".join(_PLACE), "java|rs|rb|c|h"))
def parse_rules_symbols(spark, sf_dir):
    """Symbols of Java, Rust, Ruby and C, by rules."""
    return _parsed(spark, sf_dir, "java|rs|rb|c|h").select(*_PLACE).distinct()


@query(_recorded_sql(", ".join(_PLACE), "ts|tsx|jsx"))
def parse_script_symbols(spark, sf_dir):
    """Symbols of TypeScript and of scripts with markup, by rules."""
    return _parsed(spark, sf_dir, "ts|tsx|jsx").select(*_PLACE).distinct()


@query(_recorded_sql("file_path, name, line_start, line_end", "go"))
def parse_go_symbols(spark, sf_dir):
    """Symbols of Go, by rules."""
    return _parsed(spark, sf_dir, "go").select("file_path", "name", "line_start", "line_end").distinct()


@query(_recorded_sql("file_path, name, line_start, signature", "py|java|rs|rb|c|h|ts|tsx|jsx|go", "signature is not null"))
def parse_signatures(spark, sf_dir):
    """First lines of declarations, cut to their length."""
    return _where_recorded(spark, sf_dir, _parsed(spark, sf_dir, "py|java|rs|rb|c|h|ts|tsx|jsx|go"), "signature")


@query(_recorded_sql("file_path, name, line_start, docstring", "py|java|rs|rb|c|h", "docstring is not null"))
def parse_docstrings(spark, sf_dir):
    """The first lines of documentation."""
    return _where_recorded(spark, sf_dir, _parsed(spark, sf_dir, "py|java|rs|rb|c|h"), "docstring")
