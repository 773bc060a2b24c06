"""The index of one tree, and the tools an assistant or a script would call on it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.paths import content_hash
from skein.operators import diff, graph, lines, resolve, search
from skein.render import text
from skein.sources import codec, config, listing
from skein.sources.imports import file_language, raw_imports
from skein.sources.listing import inside
from skein.sources.parse import MAX_LINES, parse_files
from skein.sources.tables import ensure_checkpoint_dir


#: Seconds that listing a tree may take.
SCAN_BUDGET = 30.0


class CodeIndex:
    """Files, symbols and import edges of a tree as DataFrames, with the queries over them."""

    def __init__(self, spark: SparkSession, files: DataFrame, symbols: DataFrame, root: str = "", stats: dict | None = None):
        self.spark, self.files, self.symbols, self.root, self.stats = spark, files, symbols, root, stats or {}

    @classmethod
    def scan(cls, spark: SparkSession, root: str, *, ignore: list[str] | None = None, use_gitignore: bool = False, git_only: bool = False, max_symbol_lines: int = MAX_LINES, budget: float | None = SCAN_BUDGET) -> CodeIndex:
        """List, read and parse a tree; a listing that takes longer than ``budget`` seconds is cut and says so in ``stats``."""
        ensure_checkpoint_dir(spark)
        stats: dict = {}
        listed = listing.list_tree(spark, root, ignore=ignore, use_gitignore=use_gitignore, git_only=git_only, budget=budget, stats=stats)
        files = listing.read_files(listed, root).withColumn("hash", content_hash(F.col("content"))).checkpoint()
        index = cls(spark, files, parse_files(files, max_lines=max_symbol_lines).checkpoint(), root, stats)
        gaps = diff.coverage_gaps(diff.coverage_by_language(files, index.symbols)).orderBy("language").collect()
        if gaps:
            stats["coverage_gaps"] = [g["language"] for g in gaps]
        return index

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CodeIndex:
        """From a map in JSON; contents are read from its root when asked for."""
        files, symbols, about = codec.read_map(spark, path)
        row = about.first()
        stats = {k: _decoded(v) for k, v in ((row and row["stats"]) or {}).items()}
        return cls(spark, files, symbols, (row and row["root"]) or "", stats)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> CodeIndex:
        """From tables written by ``write``."""
        about = json.loads(spark.read.text(f"{folder}/about").first()[0])
        return cls(spark, spark.read.parquet(f"{folder}/files"), spark.read.parquet(f"{folder}/symbols"), about["root"], about["stats"])

    def write(self, folder: str) -> None:
        """The index as tables in any shared folder, for indexes that one JSON document cannot hold; nothing is collected."""
        self.files.write.mode("overwrite").parquet(f"{folder}/files")
        self.symbols.write.mode("overwrite").parquet(f"{folder}/symbols")
        about = json.dumps({"version": codec.INDEX_VERSION, "root": self.root, "stats": self.stats})
        self.spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/about")

    def rescan(self, old_map: str, **options) -> CodeIndex:
        """Scan again, parsing only files whose hash is not the stored one; another map version parses all."""
        before = codec.read_map(self.spark, old_map)
        version = before[2].first()
        listed = listing.list_tree(self.spark, self.root, **options)
        files = listing.read_files(listed, self.root).withColumn("hash", content_hash(F.col("content"))).checkpoint()
        if not version or version["version"] != codec.INDEX_VERSION:
            return CodeIndex(self.spark, files, parse_files(files).checkpoint(), self.root)
        status = diff.incremental_status(before[0].select("file_path", "hash"), files.select("file_path", "hash")).checkpoint()
        again = files.join(status.where("status in ('added', 'modified')").select("file_path"), "file_path", "left_semi")
        symbols = diff.merge_incremental(before[1], parse_files(again), status).checkpoint()
        counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
        return CodeIndex(self.spark, files, symbols, self.root, {f"files_{k}": v for k, v in counts.items()})

    def to_map(self) -> dict:
        files = self.files
        if "content" in files.columns:
            edges = self.import_edges().groupBy(F.col("src_file").alias("file_path")).agg(F.array_sort(F.collect_set("dst_file")).alias("imports"))
            files = files.select("file_path", "hash").join(edges, "file_path", "left")
        return codec.to_map(files, self.symbols, self.root, self.stats)

    def save(self, path: str, *, compact: bool = False) -> dict:
        out = self.to_map()
        codec.write_map(out, path, compact=compact)
        return out

    def contents(self) -> DataFrame:
        """Files with content, read from the root if the index came from a map."""
        if "content" in self.files.columns:
            return self.files
        listed = self.files.select(F.lit(0).cast("long").alias("file_ord"), "file_path", F.lit(None).cast("string").alias("language"))
        return listing.read_files(listed, self.root)

    def import_edges(self) -> DataFrame:
        """``(src_file, dst_file)`` between files of the index."""
        if "content" not in self.files.columns:
            return self.files.select(F.col("file_path").alias("src_file"), F.explode("imports").alias("dst_file")).distinct()
        raw = raw_imports(self.files).join(self.files.select("file_path", file_language(F.col("file_path"), F.col("language")).alias("language")), "file_path")
        asked = raw.select(F.col("file_path").alias("src"), F.col("raw_import").alias("spec"), "language")
        aliases = config.tsconfig_aliases(self.root) + config.pyproject_aliases(self.root) if self.root else []
        module = config.import_name(self.root) if self.root else None
        found = resolve.resolve_imports(asked, self.files.select(F.col("file_path").alias("path")), aliases=aliases, module=module)
        return found.where("path is not null").select(F.col("src").alias("src_file"), F.col("path").alias("dst_file")).distinct()

    def search(self, query: str, **options) -> DataFrame:
        return search.search_symbols(self.symbols, query, **options)

    def degrees(self) -> DataFrame:
        return graph.degrees(graph.import_graph(self.import_edges()), self.files.select(F.col("file_path").alias("path")))

    def hubs(self, *, threshold: int = graph.HUB_DEGREE, top: int | None = 10) -> DataFrame:
        found = graph.hubs(self.degrees(), threshold=threshold).orderBy(F.desc("in_degree"), "path")
        return found if top is None else found.limit(top)

    def flow(self, *, shown: int = 3) -> str:
        """What the files of each folder import, and the greatest hubs."""
        g = graph.import_graph(self.import_edges())
        rows = graph.dependency_flow(g, self.degrees(), shown=shown).orderBy("dir", F.desc("in_degree"), "path").collect()
        return text.dependency_flow([r.asDict() for r in rows], [(r["path"], r["in_degree"]) for r in self.hubs(top=6).collect()])

    def graph_document(self, *, top: int = 20) -> dict:
        """The import graph as one document: what it amounts to, its edges, and the files that matter most."""
        edges = self.import_edges().checkpoint()
        found = graph.analyze(edges, self.files.select(F.col("file_path").alias("path"))).checkpoint()
        return {
            "stats": graph.graph_stats(found).first().asDict(),
            "critical": [r.asDict() for r in found.orderBy(F.desc("rank"), "path").limit(top).collect()],
            "edges": [[r["src_file"], r["dst_file"]] for r in edges.orderBy("src_file", "dst_file").toLocalIterator()],
        }

    def health_note(self) -> str:
        """What the index lacks, for answers that found nothing; '' for a whole one."""
        said = []
        skipped = int(self.stats.get("files_skipped") or 0)
        if skipped:
            causes = " ".join(f"{k.removeprefix('skipped_')}:{v}" for k, v in sorted(self.stats.items()) if k.startswith("skipped_") and v)
            said.append(f"{skipped} files skipped" + (f" ({causes})" if causes else ""))
        if self.stats.get("scan_timeout"):
            said.append("the scan ran out of time")
        if self.stats.get("coverage_gaps"):
            said.append("nothing found in " + ", ".join(self.stats["coverage_gaps"]))
        if int(self.stats.get("files_unmapped") or 0):
            said.append(f"{self.stats['files_unmapped']} files of no known language")
        return "The index is partial, what was not found may not be indexed: " + "; ".join(said) if said else ""

    def stale(self) -> DataFrame:
        now = listing.list_tree(self.spark, self.root)
        return diff.stale_files(self.files.select("file_path", "hash"), diff.current_hashes(listing.read_files(now, self.root)))

    def since(self, ref: str) -> DataFrame:
        changed = listing.git_changed(self.root, ref) or []
        return diff.symbols_of_changed(self.symbols, self.spark.createDataFrame([(c,) for c in changed], "file_path string"))

    def path_of(self, name: str) -> str | None:
        """The file of that path, else the first in order whose path contains it."""
        hit = self.files.where(F.contains("file_path", F.lit(name))).select("file_path", (F.col("file_path") != name).alias("partial")).orderBy("partial", "file_path").first()
        return hit and hit["file_path"]

    def structure(self, name: str) -> DataFrame:
        return search.file_structure(self.symbols.where(F.col("file_path") == (self.path_of(name) or name)))

    def read(self, name: str, ranges: list[tuple[int, int]], *, context: int = 0) -> DataFrame:
        path = self.path_of(name) or name
        wanted = self.spark.createDataFrame([(path, a, b) for a, b in ranges], "file_path string, first int, last int")
        return lines.read_merged(lines.file_texts(self.contents().where(F.col("file_path") == path)), wanted, context=context).orderBy("section", "num")

    def lookup(self, query: str) -> list[dict]:
        """Matches with body and callers in one call, within a budget by the size of the index."""
        most, chars = lines.lookup_budget(self.files.count())
        found = self.search(query, limit=20).limit(most).collect()
        if not found:
            return []
        wanted = self.spark.createDataFrame([(r["file_path"], r["name"], r["line_start"], r["line_end"]) for r in found], "file_path string, name string, line_start int, line_end int")
        near = self.contents().join(F.broadcast(wanted.select("file_path").distinct()), "file_path", "left_semi")
        body: dict = {}
        for r in lines.lookup_bodies(lines.file_texts(near), wanted, chars=chars).orderBy("num").collect():
            body.setdefault((r["file_path"], r["name"], r["line_start"]), []).append(r["content"])
        out = []
        for r in found:
            callers = [c["name"] for c in search.callers_of(self.symbols, r["name"]).orderBy("file_path", "line_start").limit(6).collect()]
            out.append({"name": r["name"], "file": r["file_path"], "lines": [r["line_start"], r["line_end"]], "body": body.get((r["file_path"], r["name"], r["line_start"]), []), "callers": callers[:5], "more_callers": len(callers) > 5})
        return out


def _decoded(value: str):
    try:
        return json.loads(value)
    except (ValueError, TypeError):
        return value


def tools(index: CodeIndex) -> dict:
    """The calls offered to an assistant, each returning text."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    dump = lambda x: json.dumps(x, ensure_ascii=False, default=str)

    def dependencies(path: str, depth: int = 1) -> str:
        g = graph.import_graph(index.import_edges())
        start = index.spark.createDataFrame([(index.path_of(path) or path,)], "path string")
        return dump({"imports": rows(graph.chains(g, start, depth=depth).orderBy("depth", "trail")), "imported_by": rows(graph.chains(g, start, depth=depth, reverse=True).orderBy("depth", "trail"))})

    return {
        "scan": lambda depth=3: text.skeleton(index.to_map(), {r["path"]: r["in_degree"] for r in index.hubs(threshold=2, top=None).toLocalIterator()}, depth=depth),
        "search": lambda query, limit=10, symbol_type=None, pattern=None: dump(
            rows(search.search_files_glob(index.search(query, limit=limit, symbol_type=symbol_type), pattern) if pattern else index.search(query, limit=limit, symbol_type=symbol_type))
        ),
        "read": lambda path, first, last, context=0: "\n".join(f"{r['num']}: {r['content']}" for r in index.read(path, [(first, last)], context=context).collect()),
        "lookup": lambda query: dump(index.lookup(query)),
        "stats": lambda: dump({"by_type": {r["type"]: r["n"] for r in search.stats_by_type(index.symbols).collect()}, "files": index.files.count(), **index.stats}),
        "hubs": lambda threshold=graph.HUB_DEGREE, top=10: dump(rows(index.hubs(threshold=threshold, top=top))),
        "dependencies": dependencies,
        "structure": lambda path, private=True: dump([r for r in rows(index.structure(path)) if private or not (r["member"] or "").startswith("_")]),
    }
