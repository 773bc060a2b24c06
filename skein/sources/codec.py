"""The JSON form of an index: written atomically, read without inference."""

from __future__ import annotations

import json
import os
import tempfile
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.schemas import INDEX_VERSION, SYMBOLS

KEPT_CALLS = 10
_OPTIONAL = ("docstring", "parent", "source", "visibility", "return_type")
_LISTS = ("decorators", "modifiers", "mixins")


def to_map(files: DataFrame, symbols: DataFrame, root: str, stats: dict | None = None) -> dict:
    """The nested form of an index that fits the driver: this is an export of one tree, not a pipeline step."""
    out: dict = {}
    for f in files.select("file_path", "hash", *[c for c in ("imports",) if c in files.columns]).orderBy("file_path").toLocalIterator():
        out[f["file_path"]] = {"hash": f["hash"], "symbols": [], **({"imports": f["imports"]} if "imports" in f and f["imports"] else {})}
    index: dict[str, list] = {}
    for s in symbols.orderBy("file_path", "sym_ord").toLocalIterator():
        r = s.asDict()
        entry = {"name": r["name"], "type": r["type"], "lines": [r["line_start"], r["line_end"]]}
        if r.get("signature"):
            entry["signature"] = r["signature"]
        entry |= {k: r[k] for k in _OPTIONAL if r.get(k)} | {k: r[k] for k in _LISTS if r.get(k)}
        if r.get("dependencies"):
            entry["deps"] = sorted(set(r["dependencies"]))[:KEPT_CALLS]
        if r.get("truncated"):
            entry["truncated"] = True
        out.setdefault(r["file_path"], {"hash": None, "symbols": []})["symbols"].append(entry)
        index.setdefault(r["name"].lower(), []).append({"file": r["file_path"], "type": r["type"], "lines": entry["lines"], "parent": r.get("parent")})
    total = sum(len(f["symbols"]) for f in out.values())
    return {"version": INDEX_VERSION, "root": root, "generated_at": datetime.now().isoformat(), "stats": {"files_processed": len(out), "symbols_found": total, **(stats or {})}, "files": out, "index": index}


def write_map(code_map: dict, path: str, *, compact: bool = False) -> None:
    """Replace the file in one step, so that readers see the old or the new map."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(dir=folder, suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(code_map, f, ensure_ascii=False, **({"separators": (",", ":")} if compact else {"indent": 2}))
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


_SYMBOL = "struct<name:string,type:string,lines:array<int>,signature:string,docstring:string,parent:string,deps:array<string>,decorators:array<string>,truncated:boolean,source:string,visibility:string,modifiers:array<string>,mixins:array<string>,return_type:string>"
_MAP = f"struct<version:string,root:string,generated_at:string,stats:map<string,string>,files:map<string,struct<hash:string,symbols:array<{_SYMBOL}>,imports:array<string>>>>"


def read_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(files, symbols, stats)`` of a map in JSON; keys that older maps lack are null."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", _MAP).alias("m"))
    entries = raw.select("m.root", F.explode("m.files").alias("file_path", "f"))
    files = entries.select("file_path", F.col("f.hash").alias("hash"), F.col("f.imports").alias("imports"))
    s = entries.select("file_path", F.posexplode("f.symbols").alias("sym_ord", "s"))
    known = {"line_start": F.col("s.lines")[0], "line_end": F.col("s.lines")[1], "dependencies": F.col("s.deps"), "file_path": F.col("file_path"), "sym_ord": F.col("sym_ord")}
    names = [x.strip().split(" ")[0] for x in SYMBOLS.split(", ")]
    symbols = s.select(*[known.get(n, F.col(f"s.{n}")).alias(n) for n in names])
    return files, symbols, raw.select("m.version", "m.root", "m.generated_at", "m.stats")
