"""Symbol and file search over the index, structure and call lookups.

All take ``symbols`` (see ``skein.sources.schemas``) and return DataFrames.
The order of a map is ``(file_path, sym_ord)``; ties always end there, so every
limit is deterministic.  Repeated rows count once.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from skein.functions.patterns import glob_to_regex, java_regex, safe_pattern

RESULT = ("name", "type", "file_path", "line_start", "line_end", "signature", "docstring", "parent", "score")
MAX_LIMIT = 200


def clamp_limit(limit: int, most: int = MAX_LIMIT) -> int:
    return max(1, min(int(limit), most))


@F.pandas_udf(DoubleType())
def _similarity(names: pd.Series, query: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of the query and each name, both lower case (null where no name is given)."""
    match = difflib.SequenceMatcher()
    out = []
    for name, q in zip(names, query, strict=True):
        if name is None:
            out.append(None)
            continue
        match.set_seqs(q, name)
        out.append(match.ratio())
    return pd.Series(out, dtype="float64")


def _common_letters(name: Column, query: str) -> Column:
    """Letters that a name shares with the query, each as often as both hold it: no matching has more."""
    shared = F.lit(0)
    for letter in sorted(set(query)):
        held = F.length(name) - F.length(F.replace(name, F.lit(letter), F.lit("")))
        shared = shared + F.least(held, F.lit(query.count(letter)))
    return shared


def _wanted(symbols: DataFrame, symbol_type: str | None, file_pattern: str | None) -> DataFrame:
    if symbol_type is not None:
        symbols = symbols.where(F.col("type") == symbol_type)
    if file_pattern is not None:
        symbols = symbols.where(F.col("file_path").rlike(java_regex(safe_pattern(file_pattern), ignore_case=True)))
    return symbols.where("name is not null").withColumn("name_lower", F.lower("name"))


def _bonus(score: Column, query: str) -> Column:
    return F.least(F.lit(1.0), score + F.when(F.contains(F.lower("signature"), F.lit(query)), 0.1).otherwise(0.0))


def search_symbols(
    symbols: DataFrame,
    query: str,
    *,
    symbol_type: str | None = None,
    file_pattern: str | None = None,
    limit: int = 10,
    fuzzy: bool = True,
    similarity: bool = True,
) -> DataFrame:
    """Ranked symbols with a ``score`` in (0.3, 1].

    An equal name (letter case aside) scores 1.  Otherwise, if ``fuzzy`` or
    nothing is equal, the first symbol of each name in each file scores
    ``0.7 + 0.2 * len(query) / len(name)`` if the name contains the query, 0.5
    if the query contains the name, else 0.6 of the ratio where that is above
    one half (``similarity``); a signature that contains the query adds 0.1.
    """
    q = query.lower()
    rows = _wanted(symbols, symbol_type, file_pattern)
    keys = ["file_path", "sym_ord", "name", "type", "line_start", "line_end", "signature", "docstring", "parent", "name_lower"]
    rows = rows.select(keys)
    # Repeated rows go last, among what was found: the table itself is filtered in its scan and never shuffled.
    one = ["file_path", "sym_ord", "name", "type", "line_start"]
    exact = rows.where(F.col("name_lower") == q).dropDuplicates(one).withColumn("score", F.lit(1.0))
    found = exact
    if fuzzy or exact.isEmpty():
        first = Window.partitionBy("file_path", "name_lower").orderBy("sym_ord", "line_start", "type")
        rest = rows.where(F.col("name_lower") != q)
        length = F.length("name_lower")
        if q:
            native = F.when(F.contains(F.col("name_lower"), F.lit(q)), 0.7 + 0.2 * F.lit(float(len(q))) / length).when(
                F.contains(F.lit(q), F.col("name_lower")), 0.5
            )
        else:
            native = F.lit(0.7)
        scored = rest.withColumn("score", native)
        near = scored.where("score is not null")
        if similarity and q:
            # Python sees different names only, once each, and only those whose length and letters can reach one half.
            long_enough = scored.where(F.col("score").isNull() & (2.0 * F.least(length, F.lit(len(q))) > 0.5 * (length + len(q))))
            names = long_enough.select("name_lower").distinct().where(2.0 * _common_letters(F.col("name_lower"), q) > 0.5 * (length + len(q)))
            ratios = names.withColumn("ratio", _similarity("name_lower", F.lit(q))).where("ratio > 0.5")
            far = scored.where("score is null").drop("score").join(ratios, "name_lower").withColumn("score", 0.6 * F.col("ratio")).drop("ratio")
            near = near.unionByName(far)
        near = near.dropDuplicates(one).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").withColumn("score", _bonus(F.col("score"), q)).where("score > 0.3")
        found = exact.unionByName(near)
    return found.orderBy(F.desc("score"), "name", "file_path", "sym_ord").limit(clamp_limit(limit)).select(*RESULT)


def search_files_glob(results: DataFrame, pattern: str) -> DataFrame:
    """A glob on the paths of a result that is already limited: it can only shorten it."""
    return results.where(F.col("file_path").rlike(glob_to_regex(pattern)))


def search_files(symbols: DataFrame, pattern: str, *, limit: int = 20) -> DataFrame:
    """Files whose path matches, with their symbols by type: ``(file_path, type, n, total)``."""
    hit = symbols.where(F.col("file_path").rlike(java_regex(safe_pattern(pattern), ignore_case=True)))
    counts = hit.select("file_path", "sym_ord", "type", "name", "line_start").distinct().groupBy("file_path", "type").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("file_path"))
    files = hit.select("file_path").distinct().orderBy("file_path").limit(clamp_limit(limit))
    return counts.withColumn("total", total).join(files, "file_path", "left_semi")


def list_by_type(symbols: DataFrame, symbol_type: str, *, file_pattern: str | None = None, limit: int = 50) -> DataFrame:
    """The first symbols of a type in map order, then sorted by file and name (cut before sorting)."""
    rows = _wanted(symbols, symbol_type, file_pattern).select("file_path", "sym_ord", "name", "type", "line_start").distinct()
    return rows.orderBy("file_path", "sym_ord", "line_start").limit(clamp_limit(limit)).orderBy("file_path", "name")


def stats_by_type(symbols: DataFrame) -> DataFrame:
    return symbols.select("file_path", "sym_ord", "name", "type", "line_start").distinct().groupBy("type").agg(F.count("*").alias("n"))


def call_edges(symbols: DataFrame, *, first: int | None = None) -> DataFrame:
    """One row per symbol and callee; ``first`` keeps so many callees of each in name order, as a stored map does."""
    deps = F.array_sort(F.array_distinct(F.filter("dependencies", lambda d: d.isNotNull())))
    deps = F.slice(deps, 1, first) if first else deps
    return symbols.select(
        F.col("file_path").alias("caller_file"), F.col("name").alias("caller_name"), F.col("type").alias("caller_type"),
        "line_start", "line_end", F.explode(deps).alias("callee_name"),
    ).distinct()


def call_graph(symbols: DataFrame) -> DataFrame:
    """``(caller_file, caller_name, callee_file, callee_name)``: each call whose name some file defines, to the first such file by path."""
    first = symbols.where("name is not null").groupBy(F.col("name").alias("callee_name")).agg(F.min("file_path").alias("callee_file"))
    calls = call_edges(symbols).select("caller_file", "caller_name", "callee_name").distinct()
    return calls.join(first, "callee_name").select("caller_file", "caller_name", "callee_file", "callee_name")


def callers_of(symbols: DataFrame, name: str) -> DataFrame:
    """Who calls ``name`` (exact letter case): filtered on the array before anything is exploded."""
    hit = symbols.where(F.array_contains("dependencies", name))
    return hit.select("file_path", "name", "type", "line_start", "line_end").distinct()


def dependencies_of(symbols: DataFrame, name: str, *, file_contains: str | None = None, first: int = 10) -> DataFrame:
    """``(direction, file_path, name, line_start)``: callees of the symbol (letter case aside) and its callers (exact)."""
    rows = symbols if file_contains is None else symbols.where(F.contains("file_path", F.lit(file_contains)))
    own = rows.where(F.lower("name") == name.lower())
    calls = call_edges(own, first=first).select(F.lit("calls").alias("direction"), F.col("caller_file").alias("file_path"), F.col("callee_name").alias("name"), "line_start")
    callers = callers_of(rows, name).select(F.lit("called_by").alias("direction"), "file_path", "name", "line_start")
    return calls.unionByName(callers).distinct()


def file_structure(symbols: DataFrame) -> DataFrame:
    """Members under the class that precedes them: ``(file_path, class_name, class_line, member, member_line)``.

    A member belongs to the latest class of its parent's name that comes before
    it in the file; members without one, and members of a class that is defined
    again later, are left out.  Classes without members have a null member.
    """
    rows = symbols.select("file_path", "sym_ord", "name", "type", "parent", "line_start").distinct()
    classes = rows.where("type = 'class'").select("file_path", F.col("name").alias("class_name"), F.col("line_start").alias("class_line"), F.col("sym_ord").alias("class_ord"))
    last = classes.groupBy("file_path", "class_name").agg(F.max_by("class_line", "class_ord").alias("class_line"), F.max("class_ord").alias("class_ord"))
    members = rows.where("type = 'method' and parent is not null").select("file_path", F.col("parent").alias("class_name"), F.col("name").alias("member"), F.col("line_start").alias("member_line"), "sym_ord")
    inside = members.join(last, ["file_path", "class_name"]).where("sym_ord > class_ord")
    full = last.join(inside.select("file_path", "class_name", "member", "member_line"), ["file_path", "class_name"], "left")
    return full.select("file_path", "class_name", "class_line", "member", "member_line")


def name_index(symbols: DataFrame) -> DataFrame:
    """The inverted name index: ``(name_lower, file_path, type, line_start, line_end, parent)``."""
    return symbols.where("name is not null").select(F.lower("name").alias("name_lower"), "file_path", "type", "line_start", "line_end", "parent").distinct()


def completion_names(symbols: DataFrame, *, limit: int = 100) -> DataFrame:
    """The first different names in map order, sorted."""
    first = symbols.where("name is not null").groupBy("name").agg(F.min(F.struct("file_path", "sym_ord")).alias("at"))
    return first.orderBy("at", "name").limit(limit).select("name").orderBy("name")
