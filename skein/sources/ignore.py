"""Ignore rules with git's semantics, evaluated inside the JVM.

Rules become one ordered CASE over regular expressions (the last match wins)
and a path is ignored if the rules ignore it or a folder above it, so nothing
can be taken back below an excluded folder.  No join, no Python.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is ignored unless told otherwise.
DEFAULT_RULES = """
node_modules
__pycache__
venv
env
dist
build
.next
coverage
.nyc_output
*.min.js
*.bundle.js
.tox
eggs
*.egg-info
.pytest_cache
vendor
target
bin
obj
.dart_tool
.flutter-plugins
.flutter-plugins-dependencies
*.g.dart
*.freezed.dart
*.gr.dart
.git
.svn
.hg
.idea
.vscode
.env
.env.*
.env.local
.env.*.local
.env.production*
.env.development*
.envrc
*.env
secrets*
*secret*
*secrets*
*credential*
*credentials*
.aws
.gcp
.ssh
.gnupg
*.pem
*.key
*.p8
*.p12
*.pfx
id_rsa*
id_ed25519*
id_ecdsa*
*.crt
*.cer
.npmrc
.pypirc
.netrc
config/database.yml
config/secrets.yml
*apikey*
*api_key*
*token*
"""


@dataclass(frozen=True)
class Rule:
    """One line of an ignore file: a regex over paths relative to ``base``."""

    regex: str
    negated: bool = False
    folders_only: bool = False
    base: str = ""


def _segment(text: str) -> str:
    out, i = "", 0
    while i < len(text):
        c = text[i]
        i += 1
        if c == "*":
            while i < len(text) and text[i] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\" and i < len(text):
            out += re.escape(text[i])
            i += 1
        elif c == "[":
            end = text.find("]", i + (2 if text[i : i + 1] in ("!", "^") else 1))
            if end < 0:
                out += r"\["
                continue
            body = text[i:end]
            i = end + 1
            inverse = body[:1] in ("!", "^")
            body = (body[1:] if inverse else body).replace("\\", r"\\").replace("[", r"\[").replace("&", r"\&")
            out += f"(?!/)[{'^' if inverse else ''}{body}]"
        else:
            out += re.escape(c)
    return out


def parse_rule(line: str, base: str = "") -> Rule | None:
    """A rule, or None for blank lines and comments."""
    text = line.rstrip("\r\n")
    while text.endswith(" ") and not text.endswith("\\ "):
        text = text[:-1]
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[1:] if negated else text
    folders = text.endswith("/")
    text = text.rstrip("/")
    if not text:
        return None
    anchored = "/" in text
    parts = text.lstrip("/").split("/")
    body = ""
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            body += ".+" if last else "(?:[^/]+/)*"
        else:
            body += _segment(part) + ("" if last else "/")
    return Rule(body if anchored else "(?:.*/)?" + body, negated, folders, base.strip("/"))


def parse_rules(text: str, base: str = "") -> list[Rule]:
    return [r for r in (parse_rule(x, base) for x in text.splitlines()) if r]


def verdict(path: Column, is_folder: Column, rules: list[Rule]) -> Column:
    """True if the last rule that matches this very path excludes it, false if it takes it back or none matches."""
    out = F.lit(False)
    for r in rules:
        base = re.escape(r.base) + "/" if r.base else ""
        hit = path.rlike(f"(?s)^{base}{r.regex}$")
        out = F.when(hit & is_folder if r.folders_only else hit, F.lit(not r.negated)).otherwise(out)
    return out


def ignored_paths(paths: DataFrame, rules: list[Rule]) -> DataFrame:
    """``paths(path)`` of files with ``ignored``: by the rules, for the file or any folder above it.

    A null path is not ignored.  The different folders are judged once each
    (there are far fewer than files), then files meet the verdict of theirs.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", ""))
    known = paths.withColumn("_folder", folder)
    folders = known.select("_folder").where("_folder is not null").distinct().withColumn("path", F.concat("_folder", F.lit("/x")))
    judged = folders.select("_folder", F.exists(above, lambda a: verdict(a, F.lit(True), rules)).alias("_above"))
    own = verdict(F.col("path"), F.lit(False), rules)
    return known.join(judged, "_folder", "left").select(*[F.col(c) for c in paths.columns], (F.coalesce("_above", F.lit(False)) | F.coalesce(own, F.lit(False))).alias("ignored"))


def is_ignored(path: str, rules: list[Rule], *, is_folder: bool = False) -> bool:
    """The same for one path on the driver, for listings."""
    parts = path.strip("/").split("/")
    for k in range(1, len(parts) + 1):
        at, folder = "/".join(parts[:k]), k < len(parts) or is_folder
        out = False
        for r in rules:
            inner = at[len(r.base) + 1 :] if r.base and at.startswith(r.base + "/") else at if not r.base else None
            if inner is not None and (folder or not r.folders_only) and re.fullmatch(r.regex, inner, re.S):
                out = not r.negated
        if out:
            return True
    return False
