"""Evaluation texts that leak into training text.

Texts are canonicalised: markup, entities, invisible characters, letter case
and layout go, identifiers become one word, numbers become typed slots beside
the words; in the template, unit words are one placeholder and names (words
spelt as identifiers) another.  Windows of the items' templates are hash-joined
with the windows of every document's; each hit fixes an alignment, which is
verified over its whole length by the words themselves.  Where those differ too
much but the templates agree, the slots decide: if every name and number is
replaced by one other throughout, the passage is a re-parameterised copy.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.tables import ensure_checkpoint_dir, spread

LEAKS_SCHEMA = "doc_id long, item_id long, n_words int, n_replaced int, n_slots int, reparameterised boolean"

#: Words in a row that make a leak, and one replaced word in so many.
LEAST_WORDS, ONE_IN = 20, 10
#: Of LEAST_WORDS words, two replaced ones leave a run of this many.  Longer passages leave longer runs.
WINDOW = 6
#: Characters of items in one broadcast block; more items are worked through block by block.
BLOCK_CHARS = 8_000_000
#: Words that say in what something is counted; one placeholder, so that a changed unit is a changed slot.
UNITS = frozenset("ms msec millisecond milliseconds sec secs second seconds min mins minute minutes kb mb gb kib mib gib byte bytes px percent".split())
#: Template symbols of units and names, and of a document's words that no item holds.
UNIT, NAME, UNKNOWN = 1, 2, 0

#: Anything short in angle brackets that begins with a letter, and tags with attributes of any length.
_TAGS = re.compile(r"""</?[A-Za-z][^<>]{0,200}>|</?[A-Za-z][\w:.-]*+(?:\s++[\w:@.-]++(?:\s*+=\s*+(?:"[^"<]*+"|'[^'<]*+'|[^\s"'<>=`]++))?)*+\s*+/?>|<!--.*?-->""", re.S)
_HIDDEN = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
_INNER = re.compile(r"[a-z][A-Z]|[A-Za-z]_+[A-Za-z]")
_LETTERS = re.compile(r"(?:[^\W\d])*")
_PIECE = re.compile(r"[^\W\d_]+(?:_+[^\W\d_]+)*|\d+")


def canonical(text: str) -> tuple[list[str], list[tuple[int, str]]]:
    """The words of a text, and its numbers as ``(words before it, digits)``."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAGS.sub(" ", text)
    if not text.isascii():
        text = _HIDDEN.sub("", text)
    pieces = _PIECE.findall(text.lower())
    words: list[str] = []
    numbers: list[tuple[int, str]] = []
    for p in pieces:
        if p[0].isdecimal():
            numbers.append((len(words), p))
        else:
            words.append(p.replace("_", "") if "_" in p else p)
    return words, numbers


def names_of(text: str) -> set[str]:
    """The words of a text that are spelt as identifiers, as ``canonical`` gives them."""
    out, end = set(), 0
    for m in _INNER.finditer(text):
        if m.start() < end:
            continue
        first, end = m.start(), _LETTERS.match(text, m.end()).end()
        while first and (text[first - 1] == "_" or text[first - 1].isalpha()):
            first -= 1
        out.add(text[first:end].replace("_", "").lower())
    return out


class Index:
    """Windows of a block of items: sorted hashes, and where each stands."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.words: list[np.ndarray] = []
        self.numbers: list[dict[int, list[str]]] = []
        self.vocabulary: dict[str, int] = {u: UNIT for u in UNITS}
        hashes, owners, places = [], [], []
        spelt: set[str] = set()
        opened = []
        for _, text in items:
            words, numbers = canonical(text or "")
            spelt |= names_of(text or "")
            opened.append((np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 3) for w in words], np.int64), numbers))
        #: The template symbol of each word's number.
        self.symbol = np.arange(len(self.vocabulary) + 3, dtype=np.uint64)
        self.symbol[[self.vocabulary[w] for w in spelt if w in self.vocabulary and w not in UNITS]] = NAME
        self.text = {c: w for w, c in self.vocabulary.items()}
        for n, (codes, numbers) in enumerate(opened):
            self.words.append(codes)
            slots: dict[int, list[str]] = {}
            for at, digits in numbers:
                slots.setdefault(at, []).append(digits)
            self.numbers.append(slots)
            h = window_hashes(self.symbol[codes])
            hashes.append(h)
            owners.append(np.full(len(h), n))
            places.append(np.arange(len(h)))
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.owners = np.concatenate(owners)[order] if owners else np.empty(0, np.int64)
        self.places = np.concatenate(places)[order] if places else np.empty(0, np.int64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def template(self, words: list[str], codes: np.ndarray, names: set[str]) -> np.ndarray:
        """Template symbols of a document: names of the items, and names that no item holds, are NAME."""
        out = self.symbol[codes]
        if names:
            out[[k for k in np.flatnonzero(codes == UNKNOWN) if words[k] in names]] = NAME
        return out

    def hits(self, template: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(place in the document, item, place in item)`` of each common window."""
        h = window_hashes(template)
        at = np.flatnonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)])
        left = np.searchsorted(self.hashes, h[at], "left")
        count = np.searchsorted(self.hashes, h[at], "right") - left
        at, left, count = at[count > 0], left[count > 0], count[count > 0]
        entry = np.repeat(left, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(at, count), self.owners[entry], self.places[entry]


def window_hashes(codes: np.ndarray) -> np.ndarray:
    n = len(codes) - WINDOW + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        h = (h ^ (codes[i : i + n] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def longest_passage(same: np.ndarray) -> tuple[int, int]:
    """``(start, end)`` of the longest stretch with at most one different word in ONE_IN; (0, 0) if below LEAST_WORDS."""
    n = len(same)
    if n < LEAST_WORDS:
        return 0, 0
    height = np.concatenate([[0], np.cumsum(np.where(same, 1, 1 - ONE_IN))])
    # A stretch i..j qualifies if height does not fall from i to j: each word counts 1, each replaced one ONE_IN less.
    lowest = np.minimum.accumulate(height)
    best = (0, 0)
    for j in range(n, LEAST_WORDS - 1, -1):
        if j - 0 <= best[1] - best[0]:
            break
        i = int(np.searchsorted(-lowest[: j + 1], -height[j], "left"))
        if j - i >= LEAST_WORDS and j - i > best[1] - best[0]:
            best = (i, j)
    return best


def document_leaks(words: list[str], numbers: list[tuple[int, str]], index: Index, codes: np.ndarray, template: np.ndarray, found: tuple) -> list[tuple]:
    """``(item, words, replaced, slots, reparameterised)`` of one document.

    For each item the longest passage by words; if there is none, the longest
    by templates whose slots are replaced consistently.
    """
    at, owner, place = found
    diagonal = at - place
    best: dict[int, tuple] = {}
    alike: dict[int, list[tuple]] = {}
    for item, shift in np.unique(np.stack([owner, diagonal], 1), axis=0):
        theirs = index.words[item]
        a, b = max(0, -shift), min(len(theirs), len(codes) - shift)
        same = theirs[a:b] == codes[a + shift : b + shift]
        i, j = longest_passage(same)
        if j - i > best.get(item, (0, 0))[1]:
            best[item] = (int(shift), j - i, a + i, a + j)
        if j == i:
            fits = index.symbol[theirs[a:b]] == template[a + shift : b + shift]
            i, j = longest_passage(fits) if (fits & ~same).any() else (0, 0)
            if j > i:
                alike.setdefault(item, []).append((int(shift), j - i, a + i, a + j))
    slots: dict[int, list[str]] = {}
    for k, digits in numbers:
        slots.setdefault(k, []).append(digits)

    def row(item: int, shift: int, length: int, start: int, end: int) -> tuple:
        theirs = index.words[item]
        mapping: dict[str, set[str]] = {}
        n_slots = 0
        for k in range(start, end):
            pairs = list(zip(index.numbers[item].get(k, ()), slots.get(k + shift, ()), strict=False)) if k > start else []
            if index.symbol[theirs[k]] == NAME and template[k + shift] == NAME:
                pairs.append((index.text[int(theirs[k])], words[k + shift]))
            for x, y in pairs:
                mapping.setdefault(x, set()).add(y)
                n_slots += 1
        changed = any(v != {k} for k, v in mapping.items()) and all(len(v) == 1 for v in mapping.values())
        return index.ids[item], length, int((theirs[start:end] != codes[start + shift : end + shift]).sum()), n_slots, changed

    out = [row(item, *passage) for item, passage in best.items()]
    for item, passages in alike.items():
        if item not in best:
            changed = [r for r in (row(item, *p) for p in passages) if r[4]]
            out += [max(changed, key=lambda r: r[1])] if changed else []
    return out


def leaks(documents: DataFrame, items: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, item_id, n_words, n_replaced, n_slots, reparameterised)``: the longest leaked passage of each pair.

    A document leaks an item if it holds LEAST_WORDS words in a row of the
    item's text of which at most one in ONE_IN is replaced by another; letter
    case, punctuation, markup, digits and layout do not matter.  Every item
    with such a passage counts, also those that share it.  Null and empty texts
    leak nothing; repeated rows give repeated pairs; other columns are ignored.
    A passage whose words differ more, but only in names (and numbers) that are
    each replaced by one other throughout, is a row as well; ``n_replaced`` is
    above a tenth of its ``n_words`` then.
    The items are a stated query set: they go out in blocks of BLOCK_CHARS, and
    every document is compared with every block.  If there are several, the
    documents are canonicalised once, and one block is held at a time.
    """
    known = items.select("item_id", "text").dropna().distinct().orderBy("item_id")
    rows = documents.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    rows = spread(rows)
    blocks = _blocks(known.toLocalIterator())
    block = next(blocks, None)
    if block is None:
        return documents.sparkSession.createDataFrame([], LEAKS_SCHEMA)
    following = next(blocks, None)
    if following is None:
        return rows.mapInArrow(_searcher(block, _open_text), LEAKS_SCHEMA)
    ensure_checkpoint_dir(documents.sparkSession)
    opened = rows.mapInArrow(_opened, OPENED_SCHEMA).checkpoint()
    out = None
    while block is not None:
        found = opened.mapInArrow(_searcher(block, _open_row), LEAKS_SCHEMA).checkpoint()
        out = found if out is None else out.unionByName(found)
        block, following = following, next(blocks, None)
    return out


def _blocks(items: Iterator) -> Iterator[list[tuple[int, str]]]:
    block: list[tuple[int, str]] = []
    size = 0
    for item_id, text in items:
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((int(item_id), text))
        size += len(text)
    if block:
        yield block


OPENED_SCHEMA = "doc_id long, words array<string>, places array<int>, digits array<string>, names array<string>"


def _open_text(b: pa.RecordBatch) -> Iterator[tuple]:
    for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
        words, numbers = canonical(text)
        if len(words) >= LEAST_WORDS:
            yield doc_id, words, numbers, names_of(text)


def _open_row(b: pa.RecordBatch) -> Iterator[tuple]:
    for doc_id, words, places, digits, names in zip(*(b[c].to_pylist() for c in ("doc_id", "words", "places", "digits", "names")), strict=True):
        yield doc_id, words, list(zip(places, digits, strict=True)), set(names)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string()))
    for b in batches:
        rows = [(d, w, [k for k, _ in n], [x for _, x in n], sorted(s)) for d, w, n, s in _open_text(b)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "words", "places", "digits", "names"])


def _searcher(block: list[tuple[int, str]], opened):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(block)
        code_of = index.vocabulary.get
        for b in batches:
            rows: list[tuple] = []
            for doc_id, words, numbers, names in opened(b):
                codes = np.array([code_of(w, UNKNOWN) for w in words], np.int64)
                template = index.template(words, codes, names)
                found = index.hits(template)
                if len(found[0]):
                    rows += [(doc_id, *r) for r in document_leaks(words, numbers, index, codes, template, found)]
            if rows:
                ids, item, n, replaced, slots, changed = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(item, pa.int64()), pa.array(n, pa.int32()), pa.array(replaced, pa.int32()), pa.array(slots, pa.int32()), pa.array(changed, pa.bool_())],
                    names=["doc_id", "item_id", "n_words", "n_replaced", "n_slots", "reparameterised"],
                )

    return search
