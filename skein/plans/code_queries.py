"""Queries of the code index, and their SQL.

Each query runs an operator over its whole tables.  A limit stands only where
it is the feature (ranked search, first matches, top-k reports).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.paths import canonical_path, content_hash, extension
from skein.operators import diff, graph, lines, resolve, rollup, search
from skein.sources.ignore import DEFAULT_RULES, ignored_paths, parse_rules
from skein.sources.imports import PATTERNS, raw_imports
from skein.sources.languages import EXTENSIONS, language_table
from skein.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "symbols")


_CANON = r"""regexp_replace(regexp_replace(regexp_replace(replace(trim({0}), '\', '/'), '/+', '/', 'g'), '(/\.)+(/|$)', '\2', 'g'), '^(\./)+', '')"""
_SYM = "s as (select distinct file_path, sym_ord, name, type, line_start, line_end, signature, parent, lower(name) as nl from symbols where name is not null)"


# Scan, hash, languages


@query("""with f as (select file_path, max(content) as c from files where content is not null group by file_path)
select file_path, substr(md5(c), 1, 12) as hash from f""")
def scan_hash(spark, sf_dir):
    """Content hash of every file."""
    return diff.current_hashes(table(spark, sf_dir, "files"))


def _ext_sql(column: str) -> str:
    cases = " ".join(f"when '{e}' then '{x}'" for e, x in EXTENSIONS.items())
    return f"case lower(regexp_extract({column}, '[^/](\\.[^./]+)$', 1)) {cases} end"


@query(f"select {_ext_sql('path')} as language, count(distinct path) as n from file_nodes group by 1")
def scan_language_counts(spark, sf_dir):
    """Files by the language of their extension."""
    paths = table(spark, sf_dir, "file_nodes").select("path").distinct().withColumn("ext", extension(F.col("path")))
    return paths.join(F.broadcast(language_table(spark)), "ext", "left").groupBy("language").agg(F.count("path").alias("n"))


@query(r"""with f as (select file_path, max(language) as language, max(content) as c from files group by file_path),
l as (select lower(language) as language, file_path, unnest(string_split(replace(replace(c, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) as t from f)
select language, sum(case when trim(t, ' ' || chr(9) || chr(11) || chr(12)) <> '' then 1 else 0 end)::bigint as code_lines from l group by language""")
def nonblank_lines_by_lang(spark, sf_dir):
    """Lines with code, by recorded language."""
    one = table(spark, sf_dir, "files").groupBy("file_path").agg(F.max("language").alias("language"), F.max(diff.code_line_count(F.col("content"))).alias("n"))
    return one.groupBy(F.lower("language").alias("language")).agg(F.sum("n").alias("code_lines"))


@query(r"""with f as (select file_path, max(language) as language, max(content) as c from files where content is not null group by file_path)
select distinct file_path, unnest(list_concat(list_concat(
  regexp_extract_all(c, '(?m)^\s*import\s+[^;\n]*?from\s+[''"]([^''"\n]+)[''"]', 1), regexp_extract_all(c, '(?m)^\s*import\s+[''"]([^''"\n]+)[''"]', 1)), list_concat(
  regexp_extract_all(c, '\brequire\(\s*[''"]([^''"\n]+)[''"]\s*\)', 1), regexp_extract_all(c, '\bimport\(\s*[''"]([^''"\n]+)[''"]\s*\)', 1)))) as raw_import
from f where lower(language) in ('javascript', 'typescript')""")
def imports_javascript(spark, sf_dir):
    """Raw imports of files recorded as JavaScript or TypeScript, found by native patterns."""
    recorded = table(spark, sf_dir, "files").where(F.lower("language").isin("javascript", "typescript"))
    return raw_imports(recorded, ("javascript", "typescript"))


def _all_of_sql(name: str) -> str:
    """All that the patterns of a language find in ``c``."""
    found = [f"regexp_extract_all(c, '{p.replace(chr(39), chr(39) * 2)}', 1)" for p in PATTERNS[name]]
    if name == "python":
        lists = r"regexp_extract_all(regexp_replace(c, '\\\r?\n', ' ', 'g'), '(?m)^[ \t]*import[ \t]+([^\n#]+)', 1)"
        parts = rf"flatten(list_transform({lists}, lambda x: string_split(regexp_replace(regexp_replace(x, ';[ \t]*import[ \t]+', ',', 'g'), ';.*', ''), ',')))"
        found.append(rf"list_filter(list_transform({parts}, lambda x: regexp_extract(x, '^\s*([\w.]+)', 1)), lambda x: x <> '')")
    if name == "go":
        found.append(r"""regexp_extract_all(regexp_extract(c, '(?s)\bimport\s*\((.*?)\)', 1), '"([^"\n]+)"', 1)""")
    return "flatten([" + ", ".join(found) + "])"


@query(f"""with f as (select distinct file_path, content as c, coalesce({_ext_sql("file_path")}, lower(trim(language))) as lang from files where content is not null)
select distinct file_path, unnest(case lang {" ".join(f"when '{name}' then {_all_of_sql(name)}" for name in PATTERNS)} end) as raw_import from f""")
def imports_all(spark, sf_dir):
    """Raw imports of every language that has patterns."""
    return raw_imports(table(spark, sf_dir, "files"))


# Search


def _score_sql(q: str, where: str = "true", limit: int = 25) -> str:
    return f"""with {_SYM}, w as (select * from s where {where}),
near as (select *, case when contains(nl, '{q}') then 0.7 + 0.2 * {len(q)} / length(nl) else 0.5 end as base
  from w where nl <> '{q}' and (contains(nl, '{q}') or contains('{q}', nl))),
one as (select * from near qualify row_number() over (partition by file_path, nl order by sym_ord, line_start, type) = 1),
scored as (select name, type, file_path, line_start, sym_ord, 1.0::double as score from w where nl = '{q}'
  union all select name, type, file_path, line_start, sym_ord, least(1.0, base + case when contains(lower(coalesce(signature, '')), '{q}') then 0.1 else 0 end)::double from one)
select name, type, file_path, line_start, round(score, 6) as score from scored order by scored.score desc, name, file_path, sym_ord limit {limit}"""


def _hits(df: DataFrame) -> DataFrame:
    return df.select("name", "type", "file_path", "line_start", F.round("score", 6).alias("score"))


@query(f"with {_SYM} select name, type, file_path, line_start, round(1.0, 6)::double as score from s where nl = 'main' or nl = 'e' order by name, file_path, sym_ord limit 25".replace("nl = 'main' or ", ""))
def search_exact(spark, sf_dir):
    """Symbols of exactly this name."""
    return _hits(search.search_symbols(_symbols(spark, sf_dir), "E", fuzzy=False, limit=25))


@query(_score_sql("merge_"))
def search_substring_ranked(spark, sf_dir):
    """Ranked by how much of the name the query covers."""
    return _hits(search.search_symbols(_symbols(spark, sf_dir), "merge_", similarity=False, limit=25))


@query(_score_sql("ledger", "type = 'class'"))
def search_typed(spark, sf_dir):
    """The same among classes."""
    return _hits(search.search_symbols(_symbols(spark, sf_dir), "Ledger", symbol_type="class", similarity=False, limit=25))


@query(_score_sql("lock", "regexp_matches(file_path, '/(core|api)/.*\\.py$', 'i')"))
def search_file_pattern(spark, sf_dir):
    """The same in files whose path matches."""
    return _hits(search.search_symbols(_symbols(spark, sf_dir), "lock", file_pattern=r"/(core|api)/.*\.py$", similarity=False, limit=25))


@query()
def search_fuzzy_difflib(spark, sf_dir):
    """With misspelt names, by the matcher's ratio."""
    return _hits(search.search_symbols(_symbols(spark, sf_dir), "merge_strem_gap", limit=25))


@query(f"""with {_SYM} select name, type, file_path, line_start from (select * from s where type = 'class' order by file_path, sym_ord, line_start limit 40)""")
def list_by_type_cut_then_sort(spark, sf_dir):
    """The first classes in map order."""
    return search.list_by_type(_symbols(spark, sf_dir), "class", limit=40).select("name", "type", "file_path", "line_start")


@query(f"""with {_SYM}, hit as (select * from s where regexp_matches(file_path, '/tests/', 'i')), f as (select distinct file_path from hit order by 1 limit 20)
select file_path, type, count(*) as n, sum(count(*)) over (partition by file_path)::bigint as total from hit where file_path in (from f) group by file_path, type""")
def search_file_histogram(spark, sf_dir):
    """Files by path, with their symbols by type."""
    return search.search_files(_symbols(spark, sf_dir), "/tests/")


@query("select type, count(*) as n from (select distinct file_path, sym_ord, name, type, line_start from symbols) group by type")
def stats_by_type(spark, sf_dir):
    """Symbols by type."""
    return search.stats_by_type(_symbols(spark, sf_dir))


@query("""with m as (select max_by(map_id, generated_at) as map_id from code_maps where root is not null group by root)
select map_id, files_processed as files, symbols_found as total_symbols from code_maps join m using (map_id)""")
def stats_passthrough(spark, sf_dir):
    """What the latest map of each root says of itself."""
    maps = table(spark, sf_dir, "code_maps").where("root is not null")
    last = maps.groupBy("root").agg(F.max_by("map_id", "generated_at").alias("map_id"))
    return maps.join(last.select("map_id"), "map_id").select("map_id", F.col("files_processed").alias("files"), F.col("symbols_found").alias("total_symbols"))


@query(f"""with {_SYM} select distinct nl as name_lower, file_path, type, line_start, line_end, parent from s""")
def name_index(spark, sf_dir):
    """The inverted index of names."""
    return search.name_index(_symbols(spark, sf_dir))


@query("""with f as (select name, min(file_path || chr(1) || lpad(sym_ord::varchar, 9, '0')) as place from symbols where name is not null group by name)
select name from (select name from f order by place, name limit 100)""")
def completion_names(spark, sf_dir):
    """Names offered for completion."""
    return search.completion_names(_symbols(spark, sf_dir))


# Calls


@query("""select distinct file_path as caller_file, name as caller_name, type as caller_type, line_start, line_end, unnest(dependencies) as callee_name from symbols""")
def call_edges(spark, sf_dir):
    """One row per symbol and callee."""
    return search.call_edges(_symbols(spark, sf_dir))


_DEPS10 = "unnest(list_slice(list_sort(list_distinct(dependencies)), 1, 10))"


@query(f"select distinct file_path as caller_file, name as caller_name, type as caller_type, line_start, line_end, {_DEPS10} as callee_name from symbols")
def deps_capped10(spark, sf_dir):
    """The callees a stored map keeps of each symbol."""
    return search.call_edges(_symbols(spark, sf_dir), first=10)


@query("""with e as (select distinct file_path, name, type, line_start, unnest(dependencies) as callee from symbols)
select callee, count(*) as n_callers, count(distinct file_path) as n_files from e where callee is not null group by callee""")
def caller_counts(spark, sf_dir):
    """How many symbols call each name."""
    edges = search.call_edges(_symbols(spark, sf_dir)).select("caller_file", "caller_name", "caller_type", "line_start", F.col("callee_name").alias("callee")).distinct()
    return edges.groupBy("callee").agg(F.count("*").alias("n_callers"), F.countDistinct("caller_file").alias("n_files"))


@query("select distinct file_path, name, type, line_start, line_end from symbols where list_contains(dependencies, 'lockDocstring')")
def callers_of(spark, sf_dir):
    """Who calls one name."""
    return search.callers_of(_symbols(spark, sf_dir), "lockDocstring")


@query(f"""select distinct 'calls' as direction, file_path, callee as name, line_start from (select file_path, line_start, {_DEPS10} as callee from symbols where lower(name) = 'merge_stream_gap')
union select distinct 'called_by', file_path, name, line_start from symbols where list_contains(dependencies, 'merge_stream_gap')""")
def callees_of(spark, sf_dir):
    """What one symbol calls, and who calls it."""
    return search.dependencies_of(_symbols(spark, sf_dir), "merge_stream_gap")


@query(f"""with {_SYM}, c as (select file_path, name as class_name, max_by(line_start, sym_ord) as class_line, max(sym_ord) as class_ord from s where type = 'class' group by all),
m as (select file_path, parent as class_name, name as member, line_start as member_line, sym_ord from s where type = 'method' and parent is not null)
select c.file_path, c.class_name, class_line, member, member_line from c left join (select m.* from m join c using (file_path, class_name) where m.sym_ord > c.class_ord) x on x.file_path = c.file_path and x.class_name = c.class_name""")
def file_structure(spark, sf_dir):
    """Members under their classes."""
    return search.file_structure(_symbols(spark, sf_dir))


# Differences


_STORED = """cur as (select file_path, substr(md5(max(content)), 1, 12) as h from files where content is not null group by file_path),
latest as (select max_by(map_id, generated_at) as map_id from code_maps where root is not null group by root),
old as (select file_path, lower(max_by(hash, received_at)) as h from map_files where map_id in (from latest) and hash is not null group by file_path)"""


def _stored(spark, sf_dir) -> DataFrame:
    """Hashes in the latest map of each root."""
    maps = table(spark, sf_dir, "code_maps").where("root is not null").groupBy("root").agg(F.max_by("map_id", "generated_at").alias("map_id"))
    rows = table(spark, sf_dir, "map_files").where("hash is not null").join(maps.select("map_id"), "map_id", "left_semi")
    return rows.groupBy("file_path").agg(F.lower(F.max_by("hash", "received_at")).alias("hash"))


@query(f"""with {_STORED} select file_path, case when old.file_path is null then 'added' when cur.file_path is null then 'deleted' when old.h = cur.h then 'unchanged' else 'modified' end as status
from old full join cur using (file_path)""".replace("case when old.file_path", "case when old.h").replace("when cur.file_path is", "when cur.h is"))
def incremental_status(spark, sf_dir):
    """Files now against the latest stored maps."""
    return diff.incremental_status(_stored(spark, sf_dir), diff.current_hashes(table(spark, sf_dir, "files")))


@query(f"""with {_STORED} select file_path, case when old.h is null then 'new' when cur.h is null then 'missing' else 'stale' end as status
from old full join cur using (file_path) where old.h is distinct from cur.h""")
def stale_files(spark, sf_dir):
    """Files whose stored entry is out of date."""
    return diff.stale_files(_stored(spark, sf_dir), diff.current_hashes(table(spark, sf_dir, "files")))


@query(f"with {_STORED} select file_path from old anti join cur using (file_path)")
def deleted_files(spark, sf_dir):
    """Stored files that are gone."""
    current = diff.current_hashes(table(spark, sf_dir, "files"))
    return _stored(spark, sf_dir).select("file_path").join(current, "file_path", "left_anti")


@query(f"""with {_STORED}, ch as (select file_path from cur join old using (file_path) where old.h <> cur.h)
select distinct file_path, name, type, line_start from symbols semi join ch using (file_path)""")
def changed_since_semi(spark, sf_dir):
    """Symbols in files that changed."""
    changed = incremental_status(spark, sf_dir).where("status = 'modified'")
    return diff.symbols_of_changed(_symbols(spark, sf_dir), changed).select("file_path", "name", "type", "line_start").distinct()


_COVERAGE = r"""f as (select file_path, lower(max(language)) as language, max(content) as c from files group by file_path),
n as (select file_path, count(*) as n from (select distinct file_path, sym_ord, name, line_start from symbols) group by file_path),
cl as (select file_path, len(list_filter(string_split(replace(replace(c, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12)) <> '')) as k from f),
cov as (select language, count(*) as files, count(n) as files_with_symbols, coalesce(sum(n), 0)::bigint as symbols, coalesce(sum(k), 0)::bigint as code_lines from f left join n using (file_path) left join cl using (file_path) group by language)"""


@query(f"with {_COVERAGE} from cov")
def coverage_by_language(spark, sf_dir):
    """Files, files with symbols and symbols by language."""
    return diff.coverage_by_language(table(spark, sf_dir, "files"), _symbols(spark, sf_dir))


@query(f"""with {_COVERAGE.replace("from symbols)", "from symbols where type = 'class')")} select * from cov where files >= 3 and files_with_symbols = 0 and code_lines >= 30""")
def coverage_gaps(spark, sf_dir):
    """Languages that yield no class at all though they have code."""
    classes = _symbols(spark, sf_dir).where("type = 'class'")
    return diff.coverage_gaps(diff.coverage_by_language(table(spark, sf_dir, "files"), classes))


_MAPPED = ", ".join(f"'{e}'" for e in EXTENSIONS if e != ".h")


@query(f"""with e as (select distinct file_path, lower(regexp_extract(file_path, '[^/](\\.[^./]+)$', 1)) in ({_MAPPED}) as m from map_files)
select count(*) filter (where m) as mapped, count(*) filter (where not m) as unmapped, round(100.0 * count(*) filter (where m) / count(*), 1)::double as percent from e""")
def coverage_pct(spark, sf_dir):
    """Share of files whose extension is mapped, headers left out."""
    mapped = language_table(spark).where("ext <> '.h'")
    return diff.coverage_percent(table(spark, sf_dir, "map_files"), mapped)


@query(f"""select coalesce(nullif(lower(regexp_extract(file_path, '[^/](\\.[^./]+)$', 1)), ''), '<none>') as ext, count(*) as n
from (select distinct file_path from map_files) where lower(regexp_extract(file_path, '[^/](\\.[^./]+)$', 1)) not in ({_MAPPED}) group by 1""")
def unmapped_extensions(spark, sf_dir):
    """Extensions without a language, headers left out."""
    return diff.unmapped_extensions(table(spark, sf_dir, "map_files"), language_table(spark).where("ext <> '.h'"))


@query("select count(*) filter (where truncated) as n_truncated, count(*) as n from (select distinct file_path, sym_ord, truncated from symbols)")
def truncated_count(spark, sf_dir):
    """Symbols whose end was not found."""
    return _symbols(spark, sf_dir).select("file_path", "sym_ord", "truncated").distinct().agg(F.count_if("truncated").alias("n_truncated"), F.count("*").alias("n"))


# Lines


_LINES = r"""fc as (select file_path, max(content) as c from files where content is not null group by file_path),
lx as (select file_path, string_split(regexp_replace(replace(replace(c, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n$', ''), chr(10)) as t from fc),
l as (select file_path, unnest(range(1, len(t) + 1))::int as num, unnest(t) as content from lx)"""
_RANGES = "r as (select distinct file_path, sym_ord as range_id, line_start as first, line_start + 2 as last from symbols where line_start is not null)"


def _ranges(spark, sf_dir) -> DataFrame:
    return _symbols(spark, sf_dir).where("line_start is not null").select("file_path", F.col("sym_ord").alias("range_id"), F.col("line_start").alias("first"), (F.col("line_start") + 2).alias("last")).distinct()


@query(f"""with {_LINES}, {_RANGES} select file_path, range_id, num, content, num between first and last as in_range from l join r using (file_path) where num between first - 1 and last + 1""")
def read_lines_context(spark, sf_dir):
    """The head of every symbol with a line of context."""
    return lines.read_with_context(lines.file_texts(table(spark, sf_dir, "files")), _ranges(spark, sf_dir), context=1)


@query(f"""with {_LINES}, {_RANGES}, n as (select file_path, max(num) as n from l group by 1),
w as (select file_path, greatest(1, first - 2) as a, least(n, last + 2) as b from r join n using (file_path) where first <= n),
o as (select *, case when a > coalesce(max(b) over (partition by file_path order by a, b rows between unbounded preceding and 1 preceding), -100) + 5 then 1 else 0 end as opened from w),
i as (select *, sum(opened) over (partition by file_path order by a, b)::bigint as section from o), m as (select file_path, section, min(a) as a, max(b) as b from i group by all)
select file_path, section, num, content from l join m using (file_path) where num between a and b""")
def read_ranges_merged(spark, sf_dir):
    """The same ranges merged where they come close."""
    return lines.read_merged(lines.file_texts(table(spark, sf_dir, "files")), _ranges(spark, sf_dir), context=2)


@query(f"""with {_LINES}, y as (select distinct file_path, name, line_start, line_end from symbols where name is not null and line_start is not null and line_end is not null),
b as (select *, count(*) over (partition by file_path, name, line_start, line_end) as n, num - line_start + 1 as i from l join y using (file_path) where num between line_start and line_end)
select file_path, name, line_start, line_end, i, num, content from b where n <= 20 or i <= 10 or i > n - 9
union all select file_path, name, line_start, line_end, i, null, '... ' || (n - 19) || ' lines skipped ...' from b where n > 20 and i = 11""")
def read_symbol_truncated(spark, sf_dir):
    """The bodies of all symbols, at most 20 lines each."""
    return lines.read_symbols(lines.file_texts(table(spark, sf_dir, "files")), _symbols(spark, sf_dir), max_lines=20)


@query(f"""with {_LINES}, h as (select * from l where regexp_matches(content, 'return \\w+;', 'i') qualify row_number() over (partition by file_path order by num) <= 3), n as (select file_path, max(num) as n from l group by 1),
w as (select file_path, greatest(1, num - 1) as a, least(n, num + 1) as b from h join n using (file_path)),
o as (select *, case when a > coalesce(max(b) over (partition by file_path order by a, b rows between unbounded preceding and 1 preceding), -100) + 5 then 1 else 0 end as opened from w),
i as (select *, sum(opened) over (partition by file_path order by a, b)::bigint as section from o), m as (select file_path, section, min(a) as a, max(b) as b from i group by all)
select l.file_path, section, l.num, l.content, h.num is not null as is_match from l join m using (file_path) left join h on h.file_path = l.file_path and h.num = l.num where l.num between a and b""")
def grep_first_k(spark, sf_dir):
    """The first three matches in each file, with context."""
    return lines.grep_first(lines.file_texts(table(spark, sf_dir, "files")), r"return \w+;", max_matches=3, context=1)


@query(f"""with {_LINES}, y as (select distinct file_path, name, line_start, line_end from symbols where name is not null and line_start is not null and line_end is not null and type = 'class'),
b as (select *, sum(length(content) + 1) over (partition by file_path, name, line_start order by num)::bigint as used from l join y using (file_path) where num between line_start and line_end)
select file_path, name, line_start, num, content, used from b where used <= 400 or num = line_start""")
def lookup_char_budget(spark, sf_dir):
    """Class bodies within a budget of characters."""
    return lines.lookup_bodies(lines.file_texts(table(spark, sf_dir, "files")), _symbols(spark, sf_dir).where("type = 'class'"), chars=400)


# Graph


_GRAPH = f"""g as (select distinct {_CANON.format("src_file")} as src, {_CANON.format("dst_file")} as dst from import_edges where src_file is not null and dst_file is not null),
nodes as (select distinct {_CANON.format("path")} as path from file_nodes where path is not null),
d as (select path, sum(i)::bigint as in_degree, sum(o)::bigint as out_degree from (select dst as path, 1 as i, 0 as o from g union all select src, 0, 1 from g union all select path, 0, 0 from nodes) group by path)"""


def _graph(spark, sf_dir) -> DataFrame:
    return graph.import_graph(table(spark, sf_dir, "import_edges"))


def _degrees(spark, sf_dir) -> DataFrame:
    return graph.degrees(_graph(spark, sf_dir), table(spark, sf_dir, "file_nodes"))


@query(f"with {_GRAPH} from d")
def degrees(spark, sf_dir):
    """In- and out-degree of every file."""
    return _degrees(spark, sf_dir)


@query(f"""with {_GRAPH} select count(*) as files, sum(out_degree)::bigint as edges, count(*) filter (where in_degree >= 3) as hubs, count(*) filter (where in_degree = 0 and out_degree = 0) as isolated, avg(in_degree) as avg_in, max(in_degree) as max_in from d""")
def graph_stats(spark, sf_dir):
    """The graph in one row."""
    return graph.graph_stats(_degrees(spark, sf_dir))


@query(f"with {_GRAPH} select path from d where in_degree = 0 and out_degree = 0")
def isolated(spark, sf_dir):
    """Files without imports and importers."""
    return _degrees(spark, sf_dir).where("in_degree = 0 and out_degree = 0").select("path")


@query(f"""with {_GRAPH} select path, in_degree, out_degree, case when in_degree >= 8 then 'critical' when in_degree >= 5 then 'high' when in_degree >= 3 then 'medium' end as level from d where in_degree >= 3""")
def hub_levels(spark, sf_dir):
    """Hubs and how much depends on them."""
    return graph.hubs(_degrees(spark, sf_dir))


@query(f"with {_GRAPH} select path, in_degree, out_degree, in_degree * (1 + ln(1 + out_degree)) as hub_score from d where in_degree > 0")
def hub_score(spark, sf_dir):
    """Imported files scored by both degrees."""
    return graph.hub_score(_degrees(spark, sf_dir))


@query(f"with {_GRAPH} select path, in_degree, out_degree from d order by in_degree desc, path limit 20")
def hub_targets(spark, sf_dir):
    """The files imported most."""
    return _degrees(spark, sf_dir).orderBy(F.desc("in_degree"), "path").limit(20)


@query(f"with {_GRAPH} select path, in_degree + out_degree as degree from d order by degree desc, path limit 10")
def top_connected(spark, sf_dir):
    """The files with most neighbours."""
    return _degrees(spark, sf_dir).select("path", (F.col("in_degree") + F.col("out_degree")).alias("degree")).orderBy(F.desc("degree"), "path").limit(10)


_HUB = "shared-commons/%"


@query(f"""with {_GRAPH}, h as (select path from d order by in_degree desc, path limit 1)
select dst as path from g where src = (from h) and dst <> (from h) union select src from g where dst = (from h) and src <> (from h)""")
def connected_files(spark, sf_dir):
    """The neighbours of the greatest hub."""
    top = hub_targets(spark, sf_dir).first()
    return graph.connected(_graph(spark, sf_dir), top["path"] if top else "")


def _pagerank_sql(rounds: int) -> str:
    steps = [
        f"p{k} as materialized (select d.path, d.out_degree, 0.15 / n + 0.85 * (dm / n + coalesce(got, 0)) as rank from d cross join (select count(*) as n, sum(case when out_degree = 0 then rank else 0 end) as dm from p{k - 1}) t "
        f"left join (select dst, sum(rank / out_degree) as got from g join p{k - 1} p on p.path = g.src group by dst) q on q.dst = d.path)"
        for k in range(1, rounds + 1)
    ]
    return f"with {_GRAPH.replace(' as (', ' as materialized (')}, p0 as materialized (select path, out_degree, 1.0::double / (select count(*) from d) as rank from d), " + ", ".join(steps)


@query(_pagerank_sql(20) + " select path, round(rank, 9) as rank from p20")
def pagerank_k20(spark, sf_dir):
    """PageRank after 20 rounds."""
    ranks = graph.pagerank(_graph(spark, sf_dir), table(spark, sf_dir, "file_nodes"), iterations=20, tolerance=0.0)
    return ranks.select("path", F.round("rank", 9).alias("rank"))


@query(_pagerank_sql(5) + " select p5.path, in_degree, round(rank, 9) as rank from p5 join d using (path) order by rank desc, p5.path limit 15")
def critical_topn(spark, sf_dir):
    """The files that matter most."""
    g = _graph(spark, sf_dir)
    nodes = table(spark, sf_dir, "file_nodes")
    ranks = graph.pagerank(g, nodes, iterations=5, tolerance=0.0)
    return ranks.join(graph.degrees(g, nodes), "path").select("path", "in_degree", F.round("rank", 9).alias("rank")).orderBy(F.desc("rank"), "path").limit(15)


def _converged_sql(most: int) -> str:
    """The ranks of the first round that moves them by less than a millionth a file, of at most ``most`` rounds."""
    moved = " union all ".join(f"select {k} as k, sum(abs(a.rank - b.rank)) as moved from p{k} a join p{k - 1} b using (path)" for k in range(1, most + 1))
    ranks = " union all ".join(f"select {k} as k, path, rank from p{k}" for k in range(1, most + 1))
    return f"{_pagerank_sql(most)}, stop as (select min(k) as k from ({moved}) where moved < 1e-6 * (select count(*) from d)) select path, round(rank, 9) as rank from ({ranks}) where k = (select k from stop)"


@query(_converged_sql(30))
def pagerank_converged(spark, sf_dir):
    """PageRank with the operator's own rounds and tolerance."""
    return graph.pagerank(_graph(spark, sf_dir), table(spark, sf_dir, "file_nodes")).select("path", F.round("rank", 9).alias("rank"))


def _chain_sql(reverse: bool, start: str) -> str:
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return f"""with recursive {_GRAPH}, t(start, depth, node, trail) as (
select path, 0, path, [path] from ({start}) union all
select start, depth + 1, g.{b}, list_append(trail, g.{b}) from t join g on g.{a} = t.node where depth < 3 and not list_contains(trail, g.{b}))
select start, depth, node, array_to_string(trail, ' > ') as trail from t where depth > 0"""


@query(_chain_sql(False, "select path from d order by out_degree desc, path limit 5"))
def dependency_chain_d3(spark, sf_dir):
    """What the five largest importers reach in three imports."""
    start = _degrees(spark, sf_dir).orderBy(F.desc("out_degree"), "path").limit(5).select("path")
    return graph.chains(_graph(spark, sf_dir), start)


@query(_chain_sql(True, "select path from d where in_degree between 1 and 5 order by path limit 20"))
def importers_chain_d3(spark, sf_dir):
    """What reaches the first rarely imported files in three imports."""
    start = _degrees(spark, sf_dir).where("in_degree between 1 and 5").orderBy("path").limit(20).select("path")
    return graph.chains(_graph(spark, sf_dir), start, reverse=True)


@query(_chain_sql(True, f"select distinct {_CANON.format('path')} as path from hub_nodes where path is not null"))
def importers_chain_hubs_d3(spark, sf_dir):
    """What reaches the hubs of the shared library in three imports."""
    start = table(spark, sf_dir, "hub_nodes").select(canonical_path(F.col("path")).alias("path")).dropna().distinct()
    return graph.chains(_graph(spark, sf_dir), start, reverse=True)


@query(f"""with {_GRAPH}, h as (select path from d where in_degree >= 8), y as (select file_path, count(distinct name) as n from symbols where type in ('class', 'function') group by 1)
select h.path, coalesce(n, 0) as n_symbols from h left join y on y.file_path = h.path""")
def hub_symbols(spark, sf_dir):
    """How many names each critical hub offers."""
    names = _symbols(spark, sf_dir).where("type in ('class', 'function')").groupBy(F.col("file_path").alias("path")).agg(F.countDistinct("name").alias("n"))
    critical = _degrees(spark, sf_dir).where("in_degree >= 8").select("path")
    return critical.join(names, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n_symbols"))


# Import resolution


_KEYS = r"""f as (select distinct path, regexp_replace(path, '([^/])\.[^./]+$', '\1') as bare from file_nodes where path is not null),
p as (select path, bare, string_split(bare, '/') as parts from f),
keys as (select 'exact' as kind, path as key, path from f union select 'no_ext', bare, path from f
  union select 'index', case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end, path from p where parts[len(parts)] in ('index', '__init__', 'mod')
  union select 'suffix', array_to_string(parts[len(parts) - i + 1:len(parts)], '/'), path from p, unnest(range(2, len(parts) + 1)) as u(i))"""


@query(f"with {_KEYS} select kind, key, path from keys")
def file_keys_suffix(spark, sf_dir):
    """All keys by which a file can be imported."""
    return resolve.file_keys(table(spark, sf_dir, "file_nodes"))


@query(f"""with {_KEYS}, i as (select distinct raw_import, replace(raw_import, '.', '/') as key from import_edges where raw_import is not null)
select raw_import, min(path) as path from i join keys using (key) where kind = 'suffix' group by raw_import having count(distinct path) = 1""")
def resolve_unique_suffix(spark, sf_dir):
    """Imports whose suffix one file has."""
    keys = resolve.file_keys(table(spark, sf_dir, "file_nodes")).where("kind = 'suffix'")
    wanted = table(spark, sf_dir, "import_edges").select("raw_import").dropna().distinct().withColumn("key", F.translate("raw_import", ".", "/"))
    return wanted.join(keys, "key").groupBy("raw_import").agg(F.min("path").alias("path"), F.countDistinct("path").alias("n")).where("n = 1").drop("n")


@query(f"""with {_KEYS}, i as (select distinct {_CANON.format("src_file")} as src, raw_import as spec, replace(raw_import, '.', '/') as key from import_edges where src_file is not null and raw_import is not null),
h as (select src, spec, case kind when 'exact' then 1 when 'no_ext' then 2 when 'index' then 3 else 4 end as prio, min(path) as path, count(distinct path) as n from i join keys using (key) where path <> src group by all),
b as (select * from h where prio < 4 or n = 1 qualify row_number() over (partition by src, spec order by prio) = 1)
select i.src, i.spec, path, case prio when 1 then 'exact' when 2 then 'no_ext' when 3 then 'index' when 4 then 'suffix' else 'not_found' end as strategy, coalesce(n, 0) as candidates from (select distinct src, spec from i) i left join b using (src, spec)""")
def resolve_priority(spark, sf_dir):
    """Every import to its file, and how it was found."""
    edges = table(spark, sf_dir, "import_edges").select(canonical_path(F.col("src_file")).alias("src"), F.col("raw_import").alias("spec"), F.lit("python").alias("language"))
    return resolve.resolve_imports(edges, table(spark, sf_dir, "file_nodes").select("path"))


@query(f"""with {_KEYS}, r as (select distinct regexp_extract(path, '^[^/]+', 0) as root from f), i as (select distinct raw_import as spec from import_edges where starts_with(raw_import, 'net.')),
h as (select spec, min(path) as path from i join keys on key = 'shared-commons/net/' || substr(spec, 5) where kind in ('exact', 'no_ext') group by spec)
select spec, path, case when path is null then 'not_found' else 'alias' end as strategy from i left join h using (spec)""")
def alias_match(spark, sf_dir):
    """Imports through an alias of the shared library."""
    edges = table(spark, sf_dir, "import_edges").where(F.startswith("raw_import", F.lit("net."))).select(F.lit("-").alias("src"), F.col("raw_import").alias("spec"), F.lit("").alias("language"))
    alias = resolve.Alias("net.*", ("shared-commons/net/*",))
    found = resolve.resolve_imports(edges, table(spark, sf_dir, "file_nodes").select("path"), aliases=[alias])
    return found.select("spec", F.when(F.col("strategy") == "alias", F.col("path")).alias("path"), F.when(F.col("strategy") == "alias", "alias").otherwise("not_found").alias("strategy"))


@query(f"""with {_KEYS}, k as (select distinct key, path from keys where kind in ('no_ext', 'suffix', 'index')), s as (select distinct raw_import as spec, string_split(raw_import, '.') as parts from import_edges where raw_import is not null),
a as (select spec, i as len, array_to_string(parts[1:i], '/') as key from s, unnest(range(1, len(parts) + 1)) as u(i)),
o as (select spec, len, key, min(path) as path from a join k using (key) group by all having count(*) = 1)
select spec, arg_max(path, len) as path, arg_max(key, len) as prefix from o group by spec""")
def resolve_longest_prefix(spark, sf_dir):
    """Dotted names by their longest prefix that one file has."""
    specs = table(spark, sf_dir, "import_edges").select(F.col("raw_import").alias("spec"))
    return resolve.longest_prefix(specs, table(spark, sf_dir, "file_nodes"))


# Roll-ups


@query(f"""with fs as (select distinct file_path from files where contains(file_path, '/')), {_GRAPH},
n as (select file_path, count(*) as n from (select distinct file_path, sym_ord, name, line_start from symbols where type in ('class', 'function')) group by 1),
per as (select file_path, n, case when in_degree >= 3 then 1 end as h, string_split(regexp_replace(file_path, '/[^/]*$', ''), '/') as parts from fs left join n using (file_path) left join d on d.path = file_path)
select array_to_string(parts[1:i], '/') as dir, i::int as depth, count(*) as files, coalesce(sum(n), 0)::bigint as symbols, count(h) as hubs from per, unnest(range(1, len(parts) + 1)) as u(i) group by 1, 2""")
def dir_rollup(spark, sf_dir):
    """Files, symbols and hubs below every folder."""
    hub = _degrees(spark, sf_dir).where("in_degree >= 3").select("path")
    return rollup.directory_rollup(table(spark, sf_dir, "files"), _symbols(spark, sf_dir), hub)


@query("""with s as (select distinct file_path, sym_ord, line_start, name, type as kind from symbols where type in ('class', 'method', 'function')),
r as (select *, row_number() over (partition by file_path, kind order by sym_ord, line_start, name) as i from s)
select file_path, kind, count(*) as n, string_agg(name, ', ' order by i) filter (where i <= case kind when 'class' then 2 else 3 end) as names from r group by file_path, kind""")
def micro_meta(spark, sf_dir):
    """The first names of each kind in each file."""
    return rollup.micro_meta(_symbols(spark, sf_dir))


@query("""select file_path, bool_or(coalesce(contains(file_path, 'test') or (type = 'function' and starts_with(name, 'test_')), false)) as is_test from symbols group by 1""")
def test_files(spark, sf_dir):
    """Which files are tests."""
    return rollup.is_test_file(_symbols(spark, sf_dir))


@query("""with a as (select coalesce(sum(n), 0)::bigint as full_chars from (select max(length(content)) as n from files where content is not null group by file_path)),
b as (select coalesce(sum(length(coalesce(name, '')) + length(coalesce(signature, ''))), 0)::bigint as index_chars from (select distinct file_path, sym_ord, name, line_start, signature from symbols))
select full_chars, index_chars, full_chars // 4 as full_tokens, index_chars // 4 as index_tokens, round(100 * (1 - index_chars / full_chars), 1) as saved_percent from a, b""")
def token_estimate(spark, sf_dir):
    """Estimated tokens of the sources against those of the index."""
    return rollup.token_estimate(table(spark, sf_dir, "files"), _symbols(spark, sf_dir))


@query("select file_path, max(line_end) as last_line from symbols group by 1")
def longest_files(spark, sf_dir):
    """Where the last symbol of each file ends."""
    return rollup.longest_files(_symbols(spark, sf_dir))


@query("""select count(distinct file_path) as files, count(*) as symbols from (select distinct file_path, sym_ord, name, line_start from symbols where type in ('class', 'function'))""")
def render_summary(spark, sf_dir):
    """What a rendering counts."""
    return rollup.summary(_symbols(spark, sf_dir))


# Ignore rules, changes


_RULES = "*.min.js\n!src/**/*.min.js\nbuild/\n/dist\n**/generated/\n*_pb2.py\nvendor/\nnode_modules/\n[tT]ests/\n!important.py\n"


def _ignored_sql(rules: str, paths: str) -> str:
    """Paths of which a part, from the top, has an ignoring rule as its last match; folders end below their last slash."""
    rows = []
    for k, line in enumerate(x for x in rules.splitlines() if x.strip() and not x.startswith("#")):
        body = line.strip().removeprefix("!")
        folder, body = body.endswith("/"), body.rstrip("/")
        placed = "/" in body
        text = "".join({"**/": "(.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(t) or (t.replace("[!", "[^") if t[0] == "[" else re.escape(t)) for t in re.findall(r"\*\*/|/\*\*$|\*|\?|\[[^\]]+\]|.", body.removeprefix("/")))
        rows.append(f"({k}, {line.startswith('!')}, {folder}, '{'^' if placed else '(^|/)'}{text}$')")
    return f"""with rules(k, kept, folder, pattern) as (values {", ".join(rows)}), p as ({paths}), t as (select path, string_split(path, '/') as parts from p),
parts as (select path, array_to_string(parts[1:i], '/') as part, i < len(parts) as is_folder from t, unnest(range(1, len(parts) + 1)) as u(i)),
said as (select distinct part, is_folder from parts), judged as (select part, is_folder, arg_max(kept, k) as kept from said join rules on regexp_matches(part, pattern) and (is_folder or not folder) group by all)
select distinct path from parts join judged using (part, is_folder) where not kept"""


@query(_ignored_sql(_RULES, "select distinct regexp_replace(path, '^[^/]+/', '') as path from file_nodes"))
def ignore_last_match(spark, sf_dir):
    """Paths that ignore rules exclude: the last matching rule wins, and nothing comes back below an excluded folder."""
    paths = table(spark, sf_dir, "file_nodes").select(F.regexp_replace("path", "^[^/]+/", "").alias("path")).distinct()
    return ignored_paths(paths, parse_rules(_RULES)).where("ignored").select("path")


@query(_ignored_sql(DEFAULT_RULES, "select distinct path from file_nodes where path is not null"))
def ignore_defaults(spark, sf_dir):
    """Paths that the default rules exclude."""
    return ignored_paths(table(spark, sf_dir, "file_nodes").select("path").distinct(), parse_rules(DEFAULT_RULES)).where("ignored").select("path")


@query("""with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 1 hour then 0 else 1 end as opened from (select distinct user_id, ts from events where user_id is not null and ts is not null)),
s as (select user_id, ts, sum(opened) over (partition by user_id order by ts) as k from e) select user_id, min(ts) as first_change, count(*) as n_changes from s group by user_id, k""")
def debounce_sessions(spark, sf_dir):
    """Changes of each user, one session until an hour is quiet."""
    from skein.streaming.watch import quiet_sessions

    return quiet_sessions(table(spark, sf_dir, "events"), "user_id", "ts", "1 hour")


@query("""with c as (select map_id, dense_rank() over (partition by root order by generated_at desc) as seq from code_maps where root is not null),
k as (select file_path, lower(max_by(hash, received_at)) as h, seq from map_files join c using (map_id) where seq <= 2 group by file_path, map_id, seq),
a as (select file_path, h from k where seq = 1 and h is not null), b as (select file_path, h from k where seq = 2 and h is not null)
select file_path, case when b.h is null then 'new' when a.h is null then 'deleted' else 'modified' end as change from a full join b using (file_path) where a.h is distinct from b.h""")
def change_feed(spark, sf_dir):
    """What a poll of the latest two maps of each root would report."""
    from skein.streaming.watch import poll_changes

    maps = table(spark, sf_dir, "code_maps").where("root is not null")
    from pyspark.sql import Window

    ranked = maps.withColumn("seq", F.dense_rank().over(Window.partitionBy("root").orderBy(F.desc("generated_at")))).where("seq <= 2").select("map_id", "seq")
    rows = table(spark, sf_dir, "map_files").join(ranked, "map_id").groupBy("file_path", "map_id", "seq").agg(F.lower(F.max_by("hash", "received_at")).alias("hash"))
    known = rows.where("hash is not null")
    return poll_changes(known.where("seq = 2").select("file_path", "hash"), known.where("seq = 1").select("file_path", "hash"))


# Parsing


@query()
def parse_python(spark, sf_dir):
    """Symbols of the Python files, from their syntax trees."""
    from skein.sources.parse import parse_files

    return parse_files(table(spark, sf_dir, "files").where("file_path like '%.py'")).select("file_path", "sym_ord", "name", "type", "line_start", "parent", "signature")


@query()
def parse_patterns(spark, sf_dir):
    """Symbols of all other files, by language rules."""
    from skein.sources.parse import parse_files

    return parse_files(table(spark, sf_dir, "files").where("file_path not like '%.py'")).select("file_path", "sym_ord", "name", "type", "line_start", "parent", "signature")
