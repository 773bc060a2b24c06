"""Repetition inside a single document.

A logistic regression over hashed word and character n-grams is fitted on a
bounded sample of labelled rows, calibrated, and scored in Arrow batches; a
fixed, low threshold on the calibrated probability selects candidates and the
exact share of repeated words decides about those.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.tables import spread

#: A run of RUN words that already began earlier is repeated; this share of all words makes a case.
RUN, SHARE = 5, 0.4
#: Rows that the classifier is fitted on, at most.
SAMPLE_ROWS = 2000
#: Weight of the squared weights in the fit.
DECAY = 1e-3
#: Calibrated probability from which a document is checked exactly.
CANDIDATE = 0.05
#: Words and bytes of the hashed n-grams, and the cells of each.
WORD_ORDERS, CHAR_ORDERS = (1, 2, 3), (8, 24)
BUCKET_BITS = 4
BUCKETS = 1 << BUCKET_BITS
N_FEATURES = 2 * BUCKETS * (len(WORD_ORDERS) + len(CHAR_ORDERS))
#: Sign of each weight: n-grams seen before count for repetition, new ones against it.
SIGNS = np.tile(np.repeat([-1.0, 1.0], BUCKETS), len(WORD_ORDERS) + len(CHAR_ORDERS))

WORDS = re.compile(r"[^\W\d_]+")


def word_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words (letter case aside) and the text that each belongs to."""
    found = [WORDS.findall(t.lower()) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(f) for f in found])
    flat = np.empty(len(owner), object)
    flat[:] = [w for f in found for w in f]
    return pd.factorize(flat)[0], owner


def _runs(codes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of ``n`` words inside one text, and where each begins."""
    m = len(codes) - n + 1
    if m < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(owner[:m] == owner[n - 1 :])
    h = (owner[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)
    for i in range(n):
        h = (h ^ (codes[at + i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h, at


def _again(h: np.ndarray) -> np.ndarray:
    """Whether each hash occurred before in the array."""
    code, names = pd.factorize(h)
    first = np.full(len(names), len(h), np.int64)
    np.minimum.at(first, code, np.arange(len(h)))
    return first[code] < np.arange(len(h))


def _covered(size: int, starts: np.ndarray, n: int) -> np.ndarray:
    """Places that lie in a run of ``n`` beginning at one of ``starts``."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, np.minimum(starts + n, size), 1)
    return np.cumsum(edge[:size]) > 0


def _named(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_codes``, and a 64-bit hash of each different word that is the same in every batch."""
    found = [WORDS.findall(t.lower()) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(f) for f in found])
    flat = np.empty(len(owner), object)
    flat[:] = [w for f in found for w in f]
    code, names = pd.factorize(flat)
    return code, owner, pd.util.hash_array(names, categorize=False) if len(names) else np.empty(0, np.uint64)


def _word_grams(words: np.ndarray, owner: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and whether it stood earlier in its text, of each run of ``order`` words."""
    m = len(words) - order + 1
    if m < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool)
    at = np.flatnonzero(owner[:m] == owner[order - 1 :])
    h = np.zeros(len(at), np.uint64)
    for i in range(order):
        h = (h ^ words[at + i]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    of = owner[at]
    return h, of, _again(h ^ (of.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))


def _word_counts(grams: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
    h, of, again = grams
    place = (of * 2 + again) * BUCKETS + (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    return np.bincount(place, minlength=n * 2 * BUCKETS).reshape(n, 2 * BUCKETS)


def _char_counts(flat: np.ndarray, holder: np.ndarray, sizes: np.ndarray, order: int) -> np.ndarray:
    """New and repeated runs of ``order`` bytes by cell; told apart by a hash table of eight places a byte of the text."""
    n, m = len(sizes), len(flat) - order + 1
    if m < 1:
        return np.zeros((n, 2 * BUCKETS), np.int64)
    # Eight bytes from each place on, as one number; orders are multiples of eight.
    eights = np.ndarray(len(flat) - 7, "<u8", flat, strides=(1,))
    h = np.zeros(m, np.uint64)
    for i in range(0, order, 8):
        h = (h ^ eights[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    inside = holder[:m] == holder[order - 1 :]
    h, of = h[inside], holder[:m][inside]
    bits = np.maximum(np.ceil(np.log2(np.maximum(sizes, 1) * 8)), BUCKET_BITS).astype(np.int64)
    first = np.cumsum(1 << bits) - (1 << bits)
    used = np.zeros(int((1 << bits).sum()), bool)
    used[first[of] + (h >> (64 - bits).astype(np.uint64)[of]).astype(np.int64)] = True
    edges = (first[:, None] + (np.arange(BUCKETS) << (bits - BUCKET_BITS)[:, None])).ravel()
    new = np.add.reduceat(used, edges, dtype=np.int64).reshape(n, BUCKETS)
    every = np.bincount(of * BUCKETS + (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
    return np.concatenate([new, every - new], 1)


def features(texts: list[str]) -> np.ndarray:
    """Hashed word and character n-grams, a row for each text.

    Every n-gram (WORD_ORDERS words, CHAR_ORDERS bytes) falls into one of
    BUCKETS cells by its hash, and into one of two sets of cells by whether it
    stood earlier in the text; a cell's value is its share of the text's n-grams of
    that order, times BUCKETS.  The order whose runs make a case is none of them.
    """
    n = len(texts)
    codes, owner, hashes = _named(texts)
    words = hashes[codes]
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    flat = np.frombuffer(b"".join(raw), np.uint8)
    holder = np.repeat(np.arange(n), sizes)
    counts = [_word_counts(_word_grams(words, owner, k), n) for k in WORD_ORDERS] + [_char_counts(flat, holder, sizes, k) for k in CHAR_ORDERS]
    out = [c * (BUCKETS / np.maximum(c.sum(1, keepdims=True), 1)) for c in counts]
    return np.concatenate(out, 1) if n else np.zeros((0, N_FEATURES))


def exact_shares(texts: list[str]) -> np.ndarray:
    """The share of words inside a run of RUN words that already began earlier in the text, compared word by word."""
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        words = WORDS.findall(text.lower())
        seen: set[tuple] = set()
        hit = bytearray(len(words))
        for j in range(len(words) - RUN + 1):
            run = tuple(words[j : j + RUN])
            if run in seen:
                hit[j : j + RUN] = b"\x01" * RUN
            else:
                seen.add(run)
        out[i] = sum(hit) / len(words) if words else 0.0
    return out


class Model:
    """Logistic regression with weights of fixed sign and Platt calibration, in numpy.

    An n-gram seen before never lowers the score and a new one never raises it,
    whatever the sample holds.
    """

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray, steps: int = 400, rate: float = 4.0) -> tuple[np.ndarray, float]:
        w, b = np.zeros(x.shape[1]), -1.0
        balance = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
        for _ in range(steps):
            g = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) * balance
            w = signs * np.maximum(0, signs * (w - rate * (x.T @ g + DECAY * w)))
            b -= rate * g.sum()
        return w, b

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Model:
        """Weights on the even rows, calibration on the odd ones; a sample of one class alone scores all as candidates."""
        if len(np.unique(y[::2])) < 2 or len(np.unique(y[1::2])) < 2:
            return cls(np.zeros(x.shape[1]), 0.0, 1.0, 0.0)
        w, b = cls._fit(x[::2], y[::2], SIGNS, rate=0.2)
        score = (x[1::2] @ w + b)[:, None]
        a, c = cls._fit(score - score.min(), y[1::2], np.ones(1), rate=0.5)
        return cls(w, b, float(a[0]), float(c - a[0] * score.min()))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (x @ self.weights + self.bias) + self.offset, -30, 30)))


def fit_model(documents: DataFrame, *, text: str = "text", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` rows, chosen by a hash of their key and labelled by the exact share."""
    n = documents.count()
    rows = documents.where(F.col(text).isNotNull())
    if n > sample_rows:
        rows = rows.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < max(1, 1_000_000 * sample_rows // n))
    texts = [r[0] for r in rows.select(text).limit(sample_rows).collect()]
    if not texts:
        return Model.fit(np.zeros((0, N_FEATURES)), np.zeros(0))
    return Model.fit(features(texts), (exact_shares(texts) >= SHARE).astype(float))


def _batches(batches: Iterator[pa.RecordBatch], chars: int = 2_000_000) -> Iterator[tuple[list, list[str]]]:
    ids: list = []
    texts: list[str] = []
    held = 0
    for b in batches:
        for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
            ids.append(i)
            texts.append(t or "")
            held += len(texts[-1])
            if held >= chars or len(texts) >= 2000:
                yield ids, texts
                ids, texts, held = [], [], 0
    if texts:
        yield ids, texts


def _rows(documents: DataFrame, key: str, text: str) -> DataFrame:
    return spread(documents.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).alias("text")))


def repetitive(documents: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, probability, share)`` of the documents whose exact share of repeated words reaches SHARE.

    A null or empty text and one of fewer than RUN words repeats nothing.
    Repeated rows are judged each; other columns are ignored.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _batches(batches):
            p = model.probability(features(texts))
            at = np.flatnonzero(p >= CANDIDATE)
            share = exact_shares([texts[i] for i in at])
            keep = share >= SHARE
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in at[keep]], pa.int64()), pa.array(p[at[keep]]), pa.array(share[keep])],
                names=["doc_id", "probability", "share"],
            )

    return _rows(documents, key, text).mapInArrow(score, "doc_id long, probability double, share double")


def repetition_shares(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, repeated_share)``: the share of repeated words of every document."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _batches(batches):
            codes, owner = word_codes(texts)
            n = np.bincount(owner, minlength=len(texts))
            h, at = _runs(codes, owner, RUN)
            hit = np.bincount(owner[_covered(len(codes), at[_again(h)], RUN)], minlength=len(texts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(hit / np.maximum(n, 1))],
                names=["doc_id", "n_words", "repeated_share"],
            )

    return _rows(documents, key, text).mapInArrow(measure, "doc_id long, n_words long, repeated_share double")
