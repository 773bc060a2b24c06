"""Staleness, incremental status and coverage of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.paths import content_hash, extension
from skein.sources.tables import one_content, small_side

GAP_FILES, GAP_LINES = 3, 30


def current_hashes(files: DataFrame) -> DataFrame:
    """``(file_path, hash)`` of the contents as they are now; of repeated paths the greatest content counts."""
    return one_content(files).select("file_path", content_hash(F.col("content")).alias("hash"))


def incremental_status(stored: DataFrame, current: DataFrame) -> DataFrame:
    """``(file_path, status)``: unchanged, modified, added or deleted; both sides are ``(file_path, hash)``, a path once."""
    s, c = stored.select("file_path", F.col("hash").alias("s"), F.lit(1).alias("_s")), current.select("file_path", F.col("hash").alias("c"), F.lit(1).alias("_c"))
    status = (
        F.when(F.col("_s").isNull(), "added").when(F.col("_c").isNull(), "deleted").when(F.col("s").eqNullSafe(F.col("c")), "unchanged").otherwise("modified")
    )
    return s.join(c, "file_path", "full_outer").select("file_path", status.alias("status"))


def stale_files(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Files of the index that changed (``stale``) or vanished (``missing``), and files it lacks (``new``)."""
    names = {"modified": "stale", "deleted": "missing", "added": "new"}
    status = incremental_status(stored, current).where("status <> 'unchanged'")
    renamed = F.coalesce(*[F.when(F.col("status") == k, F.lit(v)) for k, v in names.items()])
    return status.select("file_path", renamed.alias("status"))


def merge_incremental(existing: DataFrame, reparsed: DataFrame, status: DataFrame) -> DataFrame:
    """Symbols carried over from unchanged files, with those of files parsed again."""
    kept = existing.join(status.where("status = 'unchanged'").select("file_path"), "file_path", "left_semi")
    return kept.unionByName(reparsed, allowMissingColumns=True)


def symbols_of_changed(symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """Symbols in files named by ``changed(file_path)``."""
    return symbols.join(changed.select("file_path").distinct(), "file_path", "left_semi")


def code_line_count(content):
    """Lines that hold more than white space."""
    return F.size(F.filter(F.split(content, "\r\n|\n|\r"), lambda x: F.trim(F.translate(x, "\t\f\v", "   ")) != ""))


def coverage_by_language(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(language, files, files_with_symbols, symbols, code_lines)``; languages without symbols stay.

    Symbols are counted by file first, so a large file or language is summed
    before it is shuffled.
    """
    per_file = symbols.select("file_path", "sym_ord", "name", "line_start").distinct().groupBy("file_path").agg(F.count("*").alias("n"))
    one = files.groupBy("file_path").agg(F.max("language").alias("language"), F.max(code_line_count(F.col("content"))).alias("code_lines"))
    return (
        one.withColumn("language", F.lower("language")).join(per_file, "file_path", "left").groupBy("language")
        .agg(F.count("*").alias("files"), F.count("n").alias("files_with_symbols"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols"), F.coalesce(F.sum("code_lines"), F.lit(0)).alias("code_lines"))
    )


def coverage_gaps(coverage: DataFrame) -> DataFrame:
    """Languages with files and code of which nothing was found: probably a broken analyser."""
    return coverage.where(f"files >= {GAP_FILES} and files_with_symbols = 0 and code_lines >= {GAP_LINES}")


def coverage_percent(files: DataFrame, mapped: DataFrame) -> DataFrame:
    """One row: mapped and unmapped files by extension, and the percentage mapped (100 for nothing)."""
    ext = files.select("file_path").distinct().withColumn("ext", extension(F.col("file_path"))).join(small_side(mapped.select("ext", F.lit(1).alias("_m"))), "ext", "left")
    sums = ext.agg(F.count("_m").alias("mapped"), F.count_if(F.col("_m").isNull()).alias("unmapped"))
    total = F.col("mapped") + F.col("unmapped")
    return sums.withColumn("percent", F.when(total > 0, F.round(100 * F.col("mapped") / total, 1)).otherwise(100.0))


def unmapped_extensions(paths: DataFrame, mapped: DataFrame) -> DataFrame:
    """``(ext, n)`` of paths whose extension no language has; ``<none>`` for those without one."""
    ext = F.when(extension(F.col("file_path")) == "", "<none>").otherwise(extension(F.col("file_path")))
    rows = paths.select("file_path").distinct().select(ext.alias("ext"))
    return rows.join(small_side(mapped.select("ext")), "ext", "left_anti").groupBy("ext").agg(F.count("*").alias("n"))


def skip_causes(files: DataFrame, mapped: DataFrame) -> DataFrame:
    """``(cause, n)`` of the paths that are not parsed: ``unmapped`` extension, ``unreadable`` (no content) or ``empty``."""
    ext = extension(F.col("file_path"))
    one = files.groupBy("file_path").agg(F.max(F.length(F.trim("content"))).alias("n")).withColumn("ext", ext)
    known = one.join(small_side(mapped.select("ext", F.lit(True).alias("known"))), "ext", "left")
    cause = F.when(F.col("known").isNull(), "unmapped").when(F.col("n").isNull(), "unreadable").when(F.col("n") == 0, "empty")
    return known.select(cause.alias("cause")).dropna().groupBy("cause").agg(F.count("*").alias("n"))
