"""Directory roll-ups and per-file summaries for compact renderings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.paths import parent_dir

#: How many names of each kind a file's summary shows.
SHOWN = {"class": 2, "method": 3, "function": 3}


def micro_meta(symbols: DataFrame) -> DataFrame:
    """``(file_path, kind, n, names)`` for classes, methods and functions: counts, and the first names in order."""
    rows = symbols.where(F.col("type").isin(*SHOWN)).select("file_path", "sym_ord", "line_start", "name", F.col("type").alias("kind")).distinct()
    w = Window.partitionBy("file_path", "kind").orderBy("sym_ord", "line_start", "name")
    most = F.element_at(F.create_map(*[x for k, v in SHOWN.items() for x in (F.lit(k), F.lit(v))]), F.col("kind"))
    shown = F.when(F.row_number().over(w) <= most, F.struct(F.row_number().over(w).alias("i"), "name"))
    return (
        rows.withColumn("s", shown).groupBy("file_path", "kind")
        .agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["name"]), ", ").alias("names"))
    )


def class_methods(symbols: DataFrame, *, shown: int = 3) -> DataFrame:
    """``(file_path, class_name, n_methods, methods)``: the methods of each parent, the first ``shown`` in order by name."""
    rows = symbols.where("type = 'method' and parent is not null").select("file_path", F.col("parent").alias("class_name"), "sym_ord", "line_start", "name").distinct()
    k = F.row_number().over(Window.partitionBy("file_path", "class_name").orderBy("sym_ord", "line_start", "name"))
    numbered = rows.withColumn("k", k).withColumn("s", F.when(F.col("k") <= shown, F.struct("k", "name")))
    return numbered.groupBy("file_path", "class_name").agg(
        F.count("*").alias("n_methods"), F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["name"]), ", ").alias("methods")
    )


def meta_with_degrees(symbols: DataFrame, degree: DataFrame) -> DataFrame:
    """``(file_path, classes, functions, methods, in_degree, out_degree)`` of every file with symbols; 0 for files of no import."""
    rows = symbols.select("file_path", "sym_ord", "line_start", "name", "type").distinct()
    counts = rows.groupBy("file_path").agg(*[F.count_if(F.col("type") == t).alias(n) for t, n in (("class", "classes"), ("function", "functions"), ("method", "methods"))])
    known = degree.select(F.col("path").alias("file_path"), "in_degree", "out_degree")
    return counts.join(known, "file_path", "left").na.fill(0, ["in_degree", "out_degree"])


def is_test_file(symbols: DataFrame) -> DataFrame:
    """``(file_path, is_test)``: 'test' in the path, or a function named ``test_...``."""
    flag = F.contains("file_path", F.lit("test")) | ((F.col("type") == "function") & F.startswith("name", F.lit("test_")))
    return symbols.groupBy("file_path").agg(F.bool_or(F.coalesce(flag, F.lit(False))).alias("is_test"))


def directory_rollup(files: DataFrame, symbols: DataFrame, hub_paths: DataFrame) -> DataFrame:
    """``(dir, depth, files, symbols, hubs)`` of every folder above a file; symbols are classes and functions."""
    counted = symbols.where(F.col("type").isin("class", "function")).select("file_path", "sym_ord", "name", "line_start").distinct().groupBy("file_path").agg(F.count("*").alias("n"))
    hub = hub_paths.select(F.col("path").alias("file_path"), F.lit(1).alias("h")).distinct()
    per = files.select("file_path").dropna().distinct().join(counted, "file_path", "left").join(hub, "file_path", "left")
    parts = F.split(parent_dir(F.col("file_path")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("dir"), i.alias("depth")))
    return (
        per.where("instr(file_path, '/') > 0").select(F.explode(above).alias("d"), "n", "h").groupBy("d.dir", "d.depth")
        .agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols"), F.count("h").alias("hubs"))
    )


def token_estimate(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: characters and estimated tokens (four characters each) of all contents against those of names and signatures."""
    full = files.where("content is not null").groupBy("file_path").agg(F.max(F.length("content")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("full_chars"))
    rows = symbols.select("file_path", "sym_ord", "name", "line_start", "signature").distinct()
    small = rows.agg(F.coalesce(F.sum(F.length(F.coalesce("name", F.lit(""))) + F.length(F.coalesce("signature", F.lit("")))), F.lit(0)).alias("index_chars"))
    both = full.withColumn("k", F.lit(1)).join(small.withColumn("k", F.lit(1)), "k").drop("k")
    return both.select(
        "full_chars", "index_chars", F.floor(F.col("full_chars") / 4).alias("full_tokens"), F.floor(F.col("index_chars") / 4).alias("index_tokens"),
        F.when(F.col("full_chars") > 0, F.round(100 * (1 - F.col("index_chars") / F.col("full_chars")), 1)).otherwise(0.0).alias("saved_percent"),
    )


def longest_files(symbols: DataFrame) -> DataFrame:
    """``(file_path, last_line)``: where a file's last symbol ends."""
    return symbols.groupBy("file_path").agg(F.max("line_end").alias("last_line"))


def summary(symbols: DataFrame) -> DataFrame:
    """One row: files, and symbols as a summary counts them (classes and functions)."""
    rows = symbols.where(F.col("type").isin("class", "function")).select("file_path", "sym_ord", "name", "line_start").distinct()
    return rows.agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("symbols"))
