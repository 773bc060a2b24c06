"""Source trees as tables: listing on the driver, reading and parsing on the executors."""

from __future__ import annotations

import os
import subprocess
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.patterns import safe_ref
from skein.sources.ignore import DEFAULT_RULES, Rule, is_ignored, parse_rules
from skein.sources.languages import language_of
from skein.sources.tables import spread

FILES_READ = "file_ord long, file_path string, language string, content string"


def git(root: str, *args: str) -> str | None:
    """Output of a git command in ``root``; None if git or the repository is not there."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def git_tracked(root: str) -> set[str] | None:
    out = git(root, "ls-files", "-z")
    return None if out is None else {x for x in out.split("\0") if x}


def git_changed(root: str, ref: str) -> list[str] | None:
    """Files changed since a revision, or None."""
    out = git(root, "diff", "--name-only", "-z", safe_ref(ref), "--")
    return None if out is None else sorted({x for x in out.split("\0") if x})


def git_uncommitted(root: str) -> list[str] | None:
    """Files with changes that are not committed, untracked ones too."""
    out = git(root, "status", "--porcelain=v1", "-z", "--untracked-files=all")
    return None if out is None else sorted({x[3:] for x in out.split("\0") if len(x) > 3})


def _read(path: str) -> str:
    try:
        with open(path, encoding="utf-8", errors="ignore") as f:
            return f.read()
    except OSError:
        return ""


def git_rules(root: str) -> list[Rule]:
    """Rules of the user's excludes file, ``.git/info/exclude`` and the root's ``.gitignore``, in git's order."""
    named = (git(root, "config", "--get", "core.excludesFile") or "").strip()
    general = os.path.expanduser(named) if named else os.path.expanduser("~/.config/git/ignore")
    texts = [_read(general), _read(os.path.join(root, ".git", "info", "exclude")), _read(os.path.join(root, ".gitignore"))]
    return [r for t in texts for r in parse_rules(t)]


def walk(root: str, rules: list[Rule], *, nested: bool = False, only: set[str] | None = None, symlinks: bool = False, budget: float | None = None, stats: dict | None = None) -> Iterator[str]:
    """Paths of files below ``root`` in path order, relative, ignored ones and whole ignored folders left out.

    ``nested`` adds each folder's ``.gitignore`` for what is below it; ``only``
    keeps the given paths.  After ``budget`` seconds no further folder is
    opened and ``stats`` says ``scan_timeout``; it also counts files skipped,
    by cause.
    """
    began, stats = time.monotonic(), {} if stats is None else stats

    def skip(cause: str) -> None:
        for k in ("files_skipped", f"skipped_{cause}"):
            stats[k] = stats.get(k, 0) + 1

    def below(folder: str, known: list[Rule]) -> Iterator[str]:
        if budget is not None and time.monotonic() - began > budget:
            stats["scan_timeout"] = True
            return
        if nested and folder:
            known = known + parse_rules(_read(os.path.join(root, folder, ".gitignore")), folder)
        try:
            entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            if e.is_symlink() and not symlinks:
                continue
            if e.is_dir():
                if not is_ignored(path, known, is_folder=True):
                    yield from below(path, known)
            elif is_ignored(path, known):
                skip("ignored")
            elif only is not None and path not in only:
                skip("not_tracked")
            else:
                yield path

    yield from below("", rules)


def list_tree(spark: SparkSession, root: str, *, ignore: list[str] | None = None, use_gitignore: bool = False, git_only: bool = False, budget: float | None = None, stats: dict | None = None) -> DataFrame:
    """``(file_ord, file_path, language)`` of the source files of a tree.

    ``ignore`` replaces the default rules; only files of known languages count.
    ``stats``, if given, takes what the scan left out: files by cause, files and
    extensions without a language, and whether ``budget`` seconds ran out.
    """
    stats = {} if stats is None else stats
    rules = parse_rules("\n".join(ignore) if ignore else DEFAULT_RULES)
    rules += git_rules(root) if use_gitignore else []
    only = git_tracked(root) if git_only else None
    found: list[tuple] = []
    unmapped: dict[str, int] = {}
    for path in walk(root, rules, nested=use_gitignore, only=only, budget=budget, stats=stats):
        if language_of(path):
            found.append((len(found), path, language_of(path)))
        else:
            ext = os.path.splitext(path)[1].lower() or "<none>"
            unmapped[ext] = unmapped.get(ext, 0) + 1
    stats |= {"files_unmapped": sum(unmapped.values()), "unmapped_extensions": unmapped}
    return spark.createDataFrame(found, "file_ord long, file_path string, language string")


def inside(root: str, path: str) -> str:
    """The real path of a file below the root; ValueError if it leads out of it."""
    base, full = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    if full != base and not full.startswith(base.rstrip(os.sep) + os.sep):
        raise ValueError(f"{path!r} is outside {root!r}")
    return full


def decode(data: bytes) -> str:
    """UTF-8 with bad bytes left out and one kind of line end."""
    return data.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")


def read_files(listing: DataFrame, root: str) -> DataFrame:
    """The listing with contents, read where the task runs; files that cannot be read, or lead out of the root, have a null content.

    The tree must be visible to the executors (a shared file system).
    """
    names = ["file_ord", "file_path", "language"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            contents = []
            for path in b["file_path"].to_pylist():
                try:
                    with open(inside(root, path), "rb") as f:
                        contents.append(decode(f.read()))
                except (OSError, ValueError):
                    contents.append(None)
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), pa.array(contents, pa.string())], names=[*names, "content"])

    return spread(listing.select(*names)).mapInArrow(read, FILES_READ)


def scan_binary(spark: SparkSession, root: str) -> DataFrame:
    """``(file_path, content)`` of every file below a folder of any file system Spark reads, decoded in Arrow batches."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["path"], pa.array([decode(x) for x in b["content"].to_pylist()], pa.string())], names=["file_path", "content"])

    base = root.rstrip("/") + "/"
    found = raw.mapInArrow(text, "file_path string, content string")
    return found.withColumn("file_path", F.regexp_replace("file_path", "^(?:\\w+:)?/*" + "\\Q" + base.lstrip("/") + "\\E", ""))
