"""Import specifications to files, by prioritised keys.

Every file has several keys (its path, the path without extension, the folder
of an index file, all suffixes of two parts or more); every import expands
into candidate keys with a priority.  One equi-join and a ranking resolve all
imports at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.paths import basename, parent_dir, without_extension

#: Names that stand for their folder.
INDEX_FILES = ("index", "__init__", "mod")
STRATEGIES = ("relative", "alias", "exact", "no_ext", "index", "module", "suffix", "not_found")


@dataclass(frozen=True)
class Alias:
    """``prefix*suffix`` (or a plain name) and the targets it may stand for, ``*`` filled in."""

    pattern: str
    targets: tuple[str, ...]

    def apply(self, spec: str) -> list[str]:
        head, star, tail = self.pattern.partition("*")
        if not star:
            return list(self.targets) if spec == head else []
        if spec.startswith(head) and spec.endswith(tail) and len(spec) >= len(head) + len(tail):
            middle = spec[len(head) : len(spec) - len(tail)]
            return [t.replace("*", middle, 1) for t in self.targets]
        return []


def file_keys(paths: DataFrame) -> DataFrame:
    """``(kind, key, path)`` of ``paths(path)``: exact, no_ext, index, and suffix keys with and without extension."""
    p = F.col("path")
    bare = without_extension(p)
    parts = F.split(bare, "/")
    n = F.size(parts)
    suffixes = F.when(n > 1, F.transform(F.sequence(F.lit(2), n), lambda i: F.array_join(F.slice(parts, n - i + 1, i), "/")))
    base = paths.select("path").dropna().distinct()
    keyed = base.select(
        "path",
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("exact").alias("kind"), p.alias("key")), F.struct(F.lit("no_ext").alias("kind"), bare.alias("key"))),
                F.when(basename(bare).isin(*INDEX_FILES), F.array(F.struct(F.lit("index").alias("kind"), parent_dir(p).alias("key")))).otherwise(F.array().cast("array<struct<kind:string,key:string>>")),
                F.coalesce(F.transform(suffixes, lambda s: F.struct(F.lit("suffix").alias("kind"), s.alias("key"))), F.array().cast("array<struct<kind:string,key:string>>")),
            )
        ).alias("k"),
    )
    return keyed.select("k.kind", "k.key", "path").distinct()


def normal_spec(spec: Column, language: Column) -> Column:
    """Slashes for the separators of the language; quotes go."""
    s = F.regexp_replace(F.trim(spec), "^[\"'<]|[\"'>]$", "")
    return (
        F.when(language.isin("rust"), F.regexp_replace(F.regexp_replace(s, "^(crate|self)::", ""), "::", "/"))
        .when(language.isin("python", "java") & ~F.startswith(s, F.lit(".")), F.translate(s, ".", "/"))
        .when(language.isin("javascript", "typescript", "go", "ruby", "c") | F.contains(s, F.lit("/")), s)
        .otherwise(F.translate(s, ".", "/"))
    )


def climb(source: Column, spec: Column, language: Column) -> Column:
    """The path of a relative import seen from its source file; null for others."""
    folder = F.split(parent_dir(source), "/")
    dots = F.length(F.regexp_extract(spec, r"^(\.+)", 1))
    python = F.concat_ws("/", F.slice(folder, 1, F.greatest(F.size(folder) - dots + 1, F.lit(0))), F.translate(F.regexp_replace(spec, r"^\.+", ""), ".", "/"))
    ups = F.size(F.split(spec, r"\.\./")) - 1
    tail = F.regexp_replace(spec, r"^(\./|\.\./)+", "")
    other = F.concat_ws("/", F.slice(folder, 1, F.greatest(F.size(folder) - ups, F.lit(0))), tail)
    path = F.when((language == "python") & spec.rlike(r"^\.+"), python).when(spec.rlike(r"^\.\.?/"), other)
    return F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), "/+", "/")


def resolve_imports(imports: DataFrame, paths: DataFrame, *, aliases: list[Alias] = (), module: str | None = None) -> DataFrame:
    """``(src, spec, path, strategy, candidates)`` of ``imports(src, spec, language)``.

    The candidate of the best strategy wins: relative, alias, exact path, path
    without extension, index file of a folder, path below the module's own
    name, and last a suffix that only one file has.  Other strategies with
    several files take the first by path.  A file never resolves to itself.
    """
    wanted = imports.select("src", "spec", F.lower("language").alias("language")).where("src is not null and spec is not null").distinct()
    spec = normal_spec(F.col("spec"), F.col("language"))
    near = climb(F.col("src"), F.col("spec"), F.col("language"))
    candidate = lambda prio, kind, key, strategy: F.struct(F.lit(prio).alias("prio"), F.lit(kind).alias("kind"), key.alias("key"), F.lit(strategy).alias("strategy"))
    found = [candidate(1, k, near, "relative" if k != "index" else "index") for k in ("exact", "no_ext", "index")]
    prio = 10
    for alias in aliases:
        head, star, tail = alias.pattern.partition("*")
        hit = (F.startswith("spec", F.lit(head)) & F.endswith("spec", F.lit(tail)) & (F.length("spec") >= len(head) + len(tail))) if star else (F.col("spec") == alias.pattern)
        middle = F.expr(f"substring(spec, {len(head) + 1}, length(spec) - {len(head) + len(tail)})")
        for target in alias.targets:
            before, s, after = target.partition("*")
            key = F.when(hit, F.concat(F.lit(before), middle, F.lit(after)) if s else F.lit(target))
            found += [candidate(prio, k, key, "alias") for k in ("exact", "no_ext", "index")]
            prio += 1
    absolute = F.when(near.isNull(), spec)
    found += [candidate(100, "exact", absolute, "exact"), candidate(101, "no_ext", absolute, "no_ext"), candidate(102, "index", absolute, "index")]
    if module:
        inner = F.when(F.startswith(spec, F.lit(module)), F.regexp_replace(spec, f"^{module}/?", ""))
        found += [candidate(103, k, inner, "module") for k in ("exact", "no_ext", "index")]
    found += [candidate(104, "suffix", F.when(F.contains(absolute, F.lit("/")), absolute), "suffix")]
    asked = wanted.select("src", "spec", F.explode(F.array(*found)).alias("c")).select("src", "spec", "c.*").where("key is not null and key <> ''")
    # A key may belong to many files and be asked for by many: the files shrink to two and a count before they meet.
    every = file_keys(paths).where("kind <> 'no_ext' or key <> path")
    keys = every.groupBy("kind", "key").agg(F.min("path").alias("first"), F.max("path").alias("last"), F.count("*").alias("n"))
    seconds = every.join(keys.where("n > 2").select("kind", "key", "first"), ["kind", "key"]).where(F.col("path") != F.col("first")).groupBy("kind", "key").agg(F.min("path").alias("second"))
    keys = keys.join(seconds, ["kind", "key"], "left").withColumn("second", F.coalesce("second", F.when(F.col("n") == 2, F.col("last"))))
    # Of its own keys a file counts as one candidate less: which those are, its path tells.
    known = paths.select(F.col("path").alias("src"), F.lit(True).alias("is_file")).dropna().distinct()
    bare = without_extension(F.col("src"))
    own = (
        F.when(F.col("kind") == "exact", F.col("key") == F.col("src")).when(F.col("kind") == "no_ext", (F.col("key") == bare) & (bare != F.col("src")))
        .when(F.col("kind") == "index", basename(bare).isin(*INDEX_FILES) & (F.col("key") == parent_dir(F.col("src"))))
        .otherwise(F.contains("key", F.lit("/")) & F.endswith(F.concat(F.lit("/"), bare), F.concat(F.lit("/"), F.col("key"))))
    )
    others = F.col("n") - F.when(F.col("is_file") & own, 1).otherwise(0)
    per = (
        asked.join(keys, ["kind", "key"]).join(known, "src", "left").withColumn("others", others).where("others > 0")
        .withColumn("path", F.when(F.col("first") == F.col("src"), F.col("second")).otherwise(F.col("first")))
        .groupBy("src", "spec", "prio", "strategy").agg(F.min("path").alias("path"), F.sum("others").alias("candidates")).where("strategy <> 'suffix' or candidates = 1")
    )
    best = Window.partitionBy("src", "spec").orderBy("prio", "strategy", "path")
    won = per.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "prio")
    return wanted.select("src", "spec").distinct().join(won, ["src", "spec"], "left").select(
        "src", "spec", "path", F.coalesce("strategy", F.lit("not_found")).alias("strategy"), F.coalesce("candidates", F.lit(0)).alias("candidates")
    )


def resolution_stats(resolved: DataFrame) -> DataFrame:
    """One row: imports, resolved and unresolved ones, and the share resolved (0 for none)."""
    sums = resolved.agg(F.count("*").alias("total"), F.count("path").alias("resolved"))
    rate = F.when(F.col("total") > 0, F.col("resolved") / F.col("total")).otherwise(0.0)
    return sums.select("total", "resolved", (F.col("total") - F.col("resolved")).alias("unresolved"), rate.alias("rate"))


def resolve_loosely(specs: DataFrame, paths: DataFrame) -> DataFrame:
    """``(spec, path, strategy)`` of ``specs(spec)`` with slashes: equal path, path without extension, index file of the folder,
    the same letters in any case (the shortest path, then the first), or a suffix that one file alone has (of one part or more).
    """
    asked = specs.select("spec").dropna().distinct()
    files = paths.select("path").dropna().distinct()
    bare = without_extension(F.col("path"))
    parts = F.split(bare, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.size(parts) - i + 1, i), "/"))
    kind = lambda prio, name, key, ok=None: F.when(F.lit(True) if ok is None else ok, F.array(F.struct(F.lit(prio).alias("prio"), F.lit(name).alias("strategy"), key.alias("key"))))
    keyed = F.flatten(F.array_compact(F.array(
        kind(1, "exact", F.col("path")), kind(2, "no_ext", bare), kind(3, "index", parent_dir(F.col("path")), basename(bare).isin(*INDEX_FILES)), kind(4, "lower", F.lower(bare)),
        F.transform(suffixes, lambda x: F.struct(F.lit(5).alias("prio"), F.lit("suffix").alias("strategy"), x.alias("key"))),
    )))
    best = F.min(F.struct(F.when(F.col("strategy") == "lower", F.length("path")).otherwise(0).alias("length"), "path"))["path"]
    # A key of many files is one row before it meets those who ask.
    keys = files.select("path", F.explode(keyed).alias("k")).select("path", "k.*").groupBy("prio", "strategy", "key").agg(best.alias("path"), F.count("*").alias("n")).where("strategy <> 'suffix' or n = 1")
    said = F.when(F.col("strategy") == "lower", F.lower("spec")).otherwise(F.col("spec"))
    wanted = asked.select("spec", F.explode(F.array(*[F.lit(x) for x in ("exact", "no_ext", "index", "lower", "suffix")])).alias("strategy")).withColumn("key", said)
    won = wanted.join(keys, ["strategy", "key"]).groupBy("spec").agg(F.min(F.struct("prio", "path", "strategy")).alias("b"))
    return asked.join(won, "spec", "left").select("spec", "b.path", F.coalesce("b.strategy", F.lit("not_found")).alias("strategy"))


def longest_prefix(specs: DataFrame, paths: DataFrame) -> DataFrame:
    """``(spec, path, prefix)``: dotted names by their longest prefix that some file's suffix or bare path equals, if one only."""
    parts = F.split("spec", r"\.")
    prefixes = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda i: F.struct(i.alias("len"), F.array_join(F.slice(parts, 1, i), "/").alias("key")))
    asked = specs.select("spec").dropna().distinct().select("spec", F.explode(prefixes).alias("p")).select("spec", "p.len", "p.key")
    keys = file_keys(paths).where("kind in ('no_ext', 'suffix', 'index')").select("key", "path").distinct()
    one = asked.join(keys, "key").groupBy("spec", "len", "key").agg(F.min("path").alias("path"), F.count("*").alias("n")).where("n = 1")
    return one.groupBy("spec").agg(F.max_by(F.struct("path", "key"), "len").alias("b")).select("spec", "b.path", F.col("b.key").alias("prefix"))
