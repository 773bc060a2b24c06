"""Path and hash expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_path(path: Column) -> Column:
    """One spelling of a repository path.

    Back slashes become slashes, doubled slashes collapse and marks of the
    current folder (``./`` in front, ``/./`` inside, ``/.`` at the end) go.
    White space around the path goes too.  Null stays null.
    """
    p = F.translate(F.trim(path), "\\", "/")
    p = F.regexp_replace(p, "/+", "/")
    p = F.regexp_replace(p, r"(?:/\.)+(?=/|$)", "")
    p = F.regexp_replace(p, r"^(?:\./)+", "")
    # Nearly all paths are spelled that way already: plain searches tell, and spare them the patterns.
    odd = [F.contains(path, F.lit(x)) for x in ("\\", "./", "//")] + [F.endswith(path, F.lit("/.")), F.trim(path) != path]
    return F.when(odd[0] | odd[1] | odd[2] | odd[3] | odd[4], p).otherwise(path)


def content_hash(text: Column) -> Column:
    """The first 12 hexadecimal digits of the MD5 of the UTF-8 text."""
    return F.substring(F.md5(text), 1, 12)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_dir(path: Column) -> Column:
    """The path without its last part; '' for a file at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot, '' where there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")
