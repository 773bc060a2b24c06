"""Line-exact reads: ranges with context, merged ranges, symbol bodies, searches, budgeted lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.patterns import java_regex, safe_pattern
from skein.sources.tables import one_content

COLLAPSE_GAP = 5


def file_texts(files: DataFrame) -> DataFrame:
    """``(file_path, lines)``: every file with content as the array of its lines; a line ends at ``\\r\\n``, ``\\n`` or ``\\r``.

    A last line end opens no further line.  Of repeated paths the last content
    in order counts.
    """
    text = F.regexp_replace(F.regexp_replace("content", "\r\n?", "\n"), "\n\\z", "")
    return one_content(files).select("file_path", F.split(text, "\n").alias("lines"))


def file_lines(files: DataFrame) -> DataFrame:
    """``(file_path, num, content)``: the lines of every file, from 1."""
    return file_texts(files).select("file_path", F.posexplode("lines").alias("num", "content")).withColumn("num", F.col("num") + 1)


def line_counts(texts: DataFrame) -> DataFrame:
    return texts.select("file_path", F.size("lines").alias("n_lines"))


def _part(first: Column, last: Column) -> Column:
    """The lines from ``first`` to ``last`` as ``(num, content)``: cut from the file's array, so that a range costs its own lines only."""
    start = F.greatest(first, F.lit(1))
    cut = F.slice("lines", start, F.greatest(last - start + 1, F.lit(0)))
    return F.transform(cut, lambda x, i: F.struct((start + i).alias("num"), x.alias("content")))


def read_with_context(texts: DataFrame, ranges: DataFrame, *, context: int = 0) -> DataFrame:
    """``(file_path, range_id, num, content, in_range)`` of ``ranges(file_path, range_id, first, last)`` and lines around."""
    near = texts.join(ranges, "file_path").select("file_path", "range_id", "first", "last", F.explode(_part(F.col("first") - context, F.col("last") + context)).alias("x"))
    return near.select("file_path", "range_id", "x.num", "x.content", F.col("x.num").between(F.col("first"), F.col("last")).alias("in_range"))


def merge_ranges(ranges: DataFrame, *, gap: int = COLLAPSE_GAP) -> DataFrame:
    """``(file_path, section, first, last, n_ranges)``: ranges that start at most ``gap`` after any earlier one's end are one.

    Gaps and islands over the running end; a range whose end precedes its start
    is no range.
    """
    w = Window.partitionBy("file_path").orderBy("first", "last")
    before = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(before.isNull() | (F.col("first") > before + gap), 1).otherwise(0)
    island = ranges.where("last >= first").select("file_path", "first", "last").withColumn("_o", opened).withColumn("section", F.sum("_o").over(w))
    return island.groupBy("file_path", "section").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("n_ranges"))


def read_merged(texts: DataFrame, ranges: DataFrame, *, context: int = 0, gap: int = COLLAPSE_GAP) -> DataFrame:
    """``(file_path, section, num, content)`` of merged ranges, each widened by ``context`` within the file."""
    wide = ranges.join(line_counts(texts), "file_path").where("first <= n_lines").select(
        "file_path", F.greatest(F.lit(1), F.col("first") - context).alias("first"), F.least("n_lines", F.col("last") + context).alias("last")
    )
    sections = merge_ranges(wide, gap=gap)
    return texts.join(sections.select("file_path", "section", "first", "last"), "file_path").select("file_path", "section", F.inline(_part(F.col("first"), F.col("last"))))


def read_symbols(texts: DataFrame, symbols: DataFrame, *, max_lines: int = 100) -> DataFrame:
    """Bodies of symbols ``(file_path, name, line_start, line_end)``; long ones keep head and tail around one marker row.

    The head has ``max_lines // 2`` lines, the tail ``max_lines - head - 1``;
    the marker's ``num`` is null and its content says how many are skipped.
    """
    head, tail = max_lines // 2, max_lines - max_lines // 2 - 1
    wanted = symbols.select("file_path", "name", "line_start", "line_end").dropna().distinct()
    body = texts.join(wanted, "file_path").select("file_path", "name", "line_start", "line_end", _part(F.col("line_start"), F.col("line_end")).alias("x"))
    n = F.size("x")
    numbered = F.transform("x", lambda x: F.struct((x["num"] - F.col("line_start") + 1).alias("i"), x["num"].alias("num"), x["content"].alias("content")))
    skipped = F.concat(F.lit("... "), (n - head - tail).cast("string"), F.lit(" lines skipped ..."))
    kept = F.filter("y", lambda y: (n <= max_lines) | (y["i"] <= head) | (y["i"] > n - tail))
    marks = F.transform(
        F.filter("y", lambda y: (n > max_lines) & (y["i"] == head + 1)),
        lambda y: F.struct(y["i"].alias("i"), F.lit(None).cast("int").alias("num"), skipped.alias("content")),
    )
    return body.withColumn("y", numbered).select("file_path", "name", "line_start", "line_end", F.inline(F.concat(kept, marks)))


def grep_first(texts: DataFrame, pattern: str, *, max_matches: int = 10, context: int = 2, gap: int = COLLAPSE_GAP) -> DataFrame:
    """Sections around the first ``max_matches`` matching lines of each file: ``(file_path, section, num, content, is_match)``.

    All of it inside a file's row: nothing is shuffled.
    """
    found = F.transform("lines", lambda x, i: F.when(x.rlike(java_regex(safe_pattern(pattern), ignore_case=True)), i + 1))
    hits = texts.select("file_path", "lines", F.slice(F.filter(found, lambda k: k.isNotNull()), 1, max_matches).alias("hits")).where(F.size("hits") > 0)
    n = F.size("lines")
    one = lambda first, last: F.array(F.struct(first.alias("first"), last.alias("last")))

    def merged(done: Column, k: Column) -> Column:
        first, last, open_ = F.greatest(F.lit(1), k - context), F.least(n, k + context), F.get(done, F.size(done) - 1)
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), one(open_["first"], F.greatest(open_["last"], last)))
        return F.when((F.size(done) > 0) & (first <= open_["last"] + gap), joined).otherwise(F.concat(done, one(first, last)))

    sections = F.aggregate("hits", F.array().cast("array<struct<first:int,last:int>>"), merged)
    parts = hits.select("file_path", "lines", "hits", F.posexplode(sections).alias("k", "s"))
    rows = parts.select("file_path", "hits", (F.col("k") + 1).cast("long").alias("section"), F.inline(_part(F.col("s.first"), F.col("s.last"))))
    return rows.select("file_path", "section", "num", "content", F.array_contains("hits", F.col("num")).alias("is_match"))


#: Files below, matches shown, characters of each; above the last: six of 2400.
BUDGETS = ((150, 3, 1600), (1000, 4, 1800), (5000, 5, 2000))


def lookup_budgets(n_files: Column) -> tuple[Column, Column]:
    """``lookup_budget`` for a column of sizes."""
    matches, chars = F.lit(6), F.lit(2400)
    for below, m, c in reversed(BUDGETS):
        matches, chars = F.when(n_files < below, m).otherwise(matches), F.when(n_files < below, c).otherwise(chars)
    return matches, chars


def lookup_budget(n_files: int) -> tuple[int, int]:
    """Matches shown and characters of each, by the size of the repository (files below, matches, characters)."""
    for below, matches, chars in BUDGETS:
        if n_files < below:
            return matches, chars
    return 6, 2400


def lookup_bodies(texts: DataFrame, matches: DataFrame, *, chars: int) -> DataFrame:
    """Lines of each match while their running length (and a line end each) stays within ``chars``; always the first line."""
    wanted = matches.select("file_path", "name", "line_start", "line_end").dropna().distinct()
    body = texts.join(wanted, "file_path").select("file_path", "name", "line_start", _part(F.col("line_start"), F.col("line_end")).alias("x"))
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<num:int,content:string,used:long>>").alias("out"))

    def take(done: Column, x: Column) -> Column:
        used = done["used"] + F.length(x["content"]) + 1
        row = F.array(F.struct(x["num"].alias("num"), x["content"].alias("content"), used.alias("used")))
        fits = (used <= chars) | (x["num"] == F.col("line_start"))
        return F.struct(used.alias("used"), F.when(fits, F.concat(done["out"], row)).otherwise(done["out"]).alias("out"))

    return body.select("file_path", "name", "line_start", F.inline(F.aggregate("x", empty, take)["out"]))
