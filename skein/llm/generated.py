"""Source files that nobody wrote by hand here: generated, squeezed, bundled, vendored, data.

A Re-Pair grammar is inferred over each file's tokens.  A small grammar (rules
used over and over) marks generated code; tokens that are nearly all literals
mark data.  The inference then continues across files with the catalogue of
known outside files beside them: rules shared with a catalogue entry, from
another repository, mark vendored copies, which an exact shingle comparison
confirms.  Place names and the statement at the head of a file count as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.repair import Grammar
from skein.sources.tables import spread

SIGNALS_SCHEMA = (
    "file_path string, n_tokens long, grammar_ratio double, literal_share double, literal_ratio double, short_names double, "
    "stated boolean, outside_place boolean, catalog_item long, catalog_similarity double"
)

#: Grammar size over tokens below which a file is rules repeated by a program.
GENERATED_RATIO = 0.35
#: Share of a file's names and literals that literals must hold to be data, and the size of the grammar of their sequence
#: over its length: data hardly compresses.
LITERAL_SHARE, LITERAL_RATIO = 0.93, 0.9
#: Fewer tokens tell no ratio or share: a grammar needs that many to show a rule twice.
LEAST_TOKENS = 20
#: Share of one-letter names in squeezed code.
SHORT_NAMES = 0.5
#: Share of the tokens under rules shared with the catalogue that makes a candidate, and the similarity that decides.
SHARED_SHARE, SHARED_LENGTH, SIMILARITY, SHINGLE = 0.25, 12, 0.8, 5
#: The catalogue goes to every task, in blocks of at most this size: each further block is a pass over the files.
CATALOG_BYTES = 32_000_000
#: Characters of one grammar batch.
BATCH_CHARS = 2_500_000

#: Folders kept for outside code (whole path parts, lower case).
OUTSIDE_PLACES = frozenset(
    "third_party third-party thirdparty 3rdparty vendor _vendor vendored node_modules bower_components "
    "jspm_packages site-packages pods deps external extern externals".split()
)
#: Statements of a tool at the head of a file, each from the line's first word on: a mark, an order not to touch it, or
#: who made it from what.  Mentions of such statements do not begin like that.
_MADE = r"(?:generated|created|produced|built|made|emitted|compiled|erzeugt|erstellt|generiert|produite?|généré|creado|generado|generato)"
_FROM = r"(?:by|from|with|using|par|depuis|von|aus|mit|por|da)\b"
STATED = re.compile(
    rf"^\W*(?:auto-?generated\b|generated code\b|(?:please )?do not (?:edit|modify|change|touch)\b|(?:generated|built|produced) {_FROM} \w"
    rf"|(?:machine|tool|auto(?:matically|matisch)?)[ -]{_MADE}\b"
    rf"|(?:(?:this|the|diese[rs]?|ces?|cette|este|questo) )?(?:source |code )?(?:file|code|module|source|datei|quelltext|fichier|archivo) (?:(?:is|was|has been|wurde|ist|est|a été|fue|è) )?(?:(?:auto(?:matically|matisch)?|machine)[ -])?{_MADE}(?: {_FROM}|[.!]))"
    r"|(?<!\w)@generated\b(?!\w)",
    re.I | re.M,
)
TOKEN = re.compile(r"[^\W\d]+|\d[\w.]*|\"[^\"\n]*\"|'[^'\n]*'|[^\w\s]")


def file_head(text: str) -> str:
    """The comment lines before the first line of code (blank lines between them do not end it)."""
    lines, in_block = [], False
    for line in text.lstrip("﻿").splitlines():
        s = line.strip()
        if in_block:
            lines.append(s)
            in_block = "*/" not in s
        elif s.startswith("/*"):
            lines.append(s)
            in_block = "*/" not in s
        elif s.startswith(("//", "#", "--")):
            lines.append(s)
        elif s:
            break
    return "\n".join(lines)


def in_outside_place(path: str) -> bool:
    return not OUTSIDE_PLACES.isdisjoint(p.lower() for p in path.split("/")[:-1])


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers, their owners, and the different tokens; digits are one token, whatever they are."""
    found = [TOKEN.findall(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(f) for f in found])
    flat = np.empty(len(owner), object)
    flat[:] = [x for f in found for x in f]
    code, names = pd.factorize(flat)
    return code, owner, names


def _shingles(codes: np.ndarray) -> np.ndarray:
    """Sorted different hashes of SHINGLE tokens in a row."""
    n = len(codes) - SHINGLE + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (codes[i : i + n].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def file_signals(paths: list[str], texts: list[str], catalog: list[tuple[int, str]]) -> pd.DataFrame:
    """The signals of a batch of files; ``catalog`` holds (item, content)."""
    n, k = len(texts), len(catalog)
    code, owner, names = _tokens(texts + [c for _, c in catalog])
    first = np.array([x[0] for x in names] or [""])
    is_number = np.char.isdigit(first)
    is_literal = is_number | np.isin(first, ['"', "'"])
    is_name = np.char.isalpha(first) | (first == "_")
    width = np.array([len(x) for x in names] or [0])
    total = n + k
    per = lambda mask, w=None: np.bincount(owner[mask[code]], None if w is None else w[code[mask[code]]], total)
    n_tokens = np.bincount(owner, minlength=total)
    literal, named = per(is_literal, width), per(is_name, width)
    names_n, short_n = per(is_name), per(is_name & (width == 1))

    # One symbol for all numbers: rules differ by their counters only.
    symbols = code.copy()
    if is_number.any():
        symbols[is_number[code]] = int(np.flatnonzero(is_number)[0])
    marks = pd.util.hash_array(names.astype(object), categorize=False) if len(names) else np.zeros(1, np.uint64)
    g = Grammar(symbols, owner, max(1, len(names)), total, np.where(is_number, np.uint64(1), marks) if len(names) else marks).infer()
    ratio = g.size_ratio(n_tokens)
    # Literals as they are, in the files that hold mostly such.
    share = literal / np.maximum(literal + named, 1)
    of_data = is_literal[code] & (share >= LITERAL_SHARE)[owner] & (owner < n)
    n_literals = np.bincount(owner[of_data], minlength=total)
    literals = Grammar(code[of_data], owner[of_data], max(1, len(names)), total, marks).infer()
    literal_ratio = np.where(n_literals > 0, literals.size_ratio(n_literals), 0.0)

    item, similarity = np.full(n, -1), np.zeros(n)
    if k:
        inside = [np.zeros(0, np.int64)]

        def heard(rules: np.ndarray, owners: np.ndarray) -> None:
            inside.append(rules[owners >= n])

        g.infer(shared=True, on_rule=heard)
        known = np.zeros(len(g.length), bool)
        known[np.concatenate(inside)] = True
        known[g.symbols[g.owner >= n]] = True
        under = g.covered(known & (g.length >= SHARED_LENGTH))
        mine = g.owner < n
        covered = np.bincount(g.owner[mine], under[g.symbols[mine]], n) / np.maximum(n_tokens[:n], 1)
        edges = np.searchsorted(owner, np.arange(total + 1))
        shingles = [_shingles(code[edges[n + j] : edges[n + j + 1]]) for j in range(k)] if (covered >= SHARED_SHARE).any() else []
        for i in np.flatnonzero(covered >= SHARED_SHARE):
            own = _shingles(code[edges[i] : edges[i + 1]])
            for j, theirs in enumerate(shingles):
                both = len(np.intersect1d(own, theirs, assume_unique=True))
                alike = both / max(1, len(own) + len(theirs) - both)
                if alike > similarity[i]:
                    item[i], similarity[i] = catalog[j][0], alike
    return pd.DataFrame(
        {
            "file_path": paths,
            "n_tokens": n_tokens[:n],
            "grammar_ratio": ratio[:n],
            "literal_share": share[:n],
            "literal_ratio": literal_ratio[:n],
            "short_names": (short_n / np.maximum(names_n, 1))[:n],
            "stated": [bool(STATED.search(file_head(t))) for t in texts],
            "outside_place": [in_outside_place(p) for p in paths],
            "catalog_item": item,
            "catalog_similarity": similarity,
        }
    )


def _blocks(catalog: DataFrame) -> list[list[tuple[int, str]]]:
    """The catalogue's entries in blocks of at most CATALOG_BYTES (one entry at least)."""
    out: list[list[tuple[int, str]]] = [[]]
    held = 0
    for item, text in catalog.select("item_id", "content").dropna().distinct().orderBy("item_id").toLocalIterator():
        size = len(text.encode("utf-8", "surrogatepass"))
        if out[-1] and held + size > CATALOG_BYTES:
            out.append([])
            held = 0
        out[-1].append((int(item), text))
        held += size
    return out


def signals(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per row of ``files(file_path, content)`` with every signal.

    A null or empty content has no tokens and only its place counts; rows with
    a null path are left out; repeated rows are measured each.  ``catalog``
    needs ``item_id`` and ``content``; an empty one is fine, one above
    CATALOG_BYTES goes out in blocks, and the most similar entry of all counts
    (then repeated rows are measured once).  What a file's ratios are does not
    depend on the files around it.
    """
    rows = spread(files.where("file_path is not null").select("file_path", "content"))
    found = [rows.mapInArrow(_measurer(block), SIGNALS_SCHEMA) for block in _blocks(catalog)]
    if len(found) == 1:
        return found[0]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    names = [c for c in every.columns if not c.startswith("catalog_")]
    best = F.max(F.struct("catalog_similarity", (-F.col("catalog_item")).alias("item")))
    return every.groupBy(*names).agg(best.alias("b")).select(*names, (-F.col("b.item")).alias("catalog_item"), "b.catalog_similarity")


def _measurer(known: list[tuple[int, str]]):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: list[str] = []
        texts: list[str] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pandas(file_signals(paths, texts, known), preserve_index=False)

        for b in batches:
            for path, text in zip(b["file_path"].to_pylist(), b["content"].to_pylist(), strict=True):
                paths.append(path)
                texts.append(text or "")
                held += len(texts[-1])
                if held >= BATCH_CHARS:
                    yield out()
                    paths, texts, held = [], [], 0
        if paths:
            yield out()

    return measure


def verdicts(found: DataFrame) -> DataFrame:
    """Signals with what they say: ``kinds`` names each reason, and is empty for hand-written files."""
    enough = F.col("n_tokens") >= LEAST_TOKENS
    is_data = (F.col("literal_share") >= LITERAL_SHARE) & (F.col("literal_ratio") >= LITERAL_RATIO)
    reasons = {
        "stated": F.col("stated"),
        "generated": enough & (F.col("grammar_ratio") < GENERATED_RATIO) & ~is_data,
        "squeezed": enough & (F.col("short_names") > SHORT_NAMES),
        "data": enough & is_data,
        "outside": F.col("outside_place"),
        "copied": F.col("catalog_similarity") >= SIMILARITY,
    }
    kinds = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in reasons.items()]))
    return found.withColumn("kinds", kinds)
