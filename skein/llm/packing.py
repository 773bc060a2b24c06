"""Filling fixed-capacity containers with items.

Bounded-space online best-fit: a fixed number of containers stays open, in a
bitset keyed by free space.  An item goes where it leaves the least room; if
none has room a container is opened, and when too many are open the fullest
closes.  Each task packs its own rows; containers still open at its end are
packed again, together, in far fewer tasks.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.tables import spread

#: Containers open at once, for each capacity.
OPEN_BINS = 256
#: A container with at most this share of its room left is never packed again.
FULL = 0.02
#: Tasks whose left-over containers are packed together.
FAN_IN = 32

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public splitting rule of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

SIZES_SCHEMA = "doc_id long, n_tokens long"
PACKED_SCHEMA = "pack_id int, container string, doc_id long, piece int, first_token long, n_tokens long, is_open boolean"


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("skein", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, *, doc: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``(doc_id, n_tokens)`` of each row by the tokenizer file at ``tokenizer``; a null text has 0 tokens.

    The file need only be where the driver runs: executors that do not see it get it from there.
    """
    name = os.path.basename(tokenizer)
    if os.path.exists(tokenizer):
        documents.sparkSession.sparkContext.addFile(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer if os.path.exists(tokenizer) else SparkFiles.get(name), pattern).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    rows = documents.where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    return spread(rows).mapInArrow(count, SIZES_SCHEMA)


class Packer:
    """Best-fit over at most ``open_bins`` containers; ``place`` says what a closed container held."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.free = 0  # bit f is set if a container with room f is open
        self.bins: dict[int, list[list]] = {}
        self.n_open = 0

    def _take(self, room: int) -> list:
        held = self.bins[room]
        bin_ = held.pop()
        if not held:
            del self.bins[room]
            self.free &= ~(1 << room)
        self.n_open -= 1
        return bin_

    def _put(self, room: int, bin_: list) -> None:
        self.bins.setdefault(room, []).append(bin_)
        self.free |= 1 << room
        self.n_open += 1

    def place(self, size: int, item) -> list | None:
        """Put an item of ``1..capacity``; the container this closes, if any."""
        fitting = self.free >> size
        closed = None
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(room)
        else:
            if self.n_open >= self.open_bins:
                closed = self._take((self.free & -self.free).bit_length() - 1)
            room, bin_ = self.capacity, []
        bin_.append(item)
        if room == size:
            return bin_ if closed is None else self._both(closed, bin_)
        self._put(room - size, bin_)
        return closed

    _late: list | None = None

    def _both(self, closed: list, filled: list) -> list:
        self._late = filled
        return closed

    def late(self) -> list | None:
        """A second container closed by the same ``place``."""
        out, self._late = self._late, None
        return out

    def rest(self) -> Iterator[tuple[int, list]]:
        for room in sorted(self.bins):
            for bin_ in self.bins[room]:
                yield room, bin_


def pieces(n_tokens: int, capacity: int) -> Iterator[tuple[int, int, int]]:
    """``(piece, first token, tokens)``: one piece, or full ones and a remainder for an item beyond the capacity."""
    for k, first in enumerate(range(0, n_tokens, capacity)):
        yield k, first, min(capacity, n_tokens - first)


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
    names = ["pack_id", "container", "doc_id", "piece", "first_token", "n_tokens", "is_open"]
    cols = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


class _Writer:
    """Numbers containers and turns them into rows."""

    def __init__(self, stage: str):
        self.name = f"{stage}{TaskContext.get().partitionId() if TaskContext.get() else 0}"
        self.n = 0
        self.rows: list[tuple] = []

    def add(self, pack: int, bin_: list | None, is_open: bool = False) -> None:
        if bin_:
            self.n += 1
            self.rows += [(pack, f"{self.name}-{self.n}", *item, is_open) for item in bin_]

    def ready(self) -> bool:
        return len(self.rows) >= 20_000

    def flush(self) -> pa.RecordBatch:
        out, self.rows = _emit(self.rows), []
        return out


def pack(sizes: DataFrame, packs: list[tuple[int, int]], *, open_bins: int = OPEN_BINS) -> DataFrame:
    """``(pack_id, container, doc_id, piece, first_token, n_tokens)`` for each capacity of ``packs``.

    ``sizes`` has ``doc_id`` and ``n_tokens``.  An item beyond the capacity is
    cut into full containers and a remainder; no other is cut.  Every row is
    packed, repeated ids as often as they occur.  Items without tokens take no
    room: they stand in no container (``container`` null, one row a capacity).
    Null sizes count as 0; an empty table gives no rows.  A capacity below 1
    is refused.
    """
    if any(c < 1 for _, c in packs):
        raise ValueError("a container needs room for a token")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = {p: Packer(c, open_bins) for p, c in packs}
        out = _Writer("a")
        for b in batches:
            for doc_id, n in zip(b["doc_id"].to_pylist(), b["n_tokens"].to_pylist(), strict=True):
                for p, c in packs:
                    if not n:
                        out.rows.append((p, None, doc_id, 0, 0, 0, False))
                    for k, start, size in pieces(n or 0, c):
                        out.add(p, packers[p].place(size, (doc_id, k, start, size)))
                        out.add(p, packers[p].late())
                if out.ready():
                    yield out.flush()
        for p, c in packs:
            for room, bin_ in packers[p].rest():
                out.add(p, bin_, room > FULL * c)
        yield out.flush()

    capacity = dict(packs)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What is left: items of open containers, longest first within a batch.
        packers = {p: Packer(c, open_bins * 4) for p, c in capacity.items()}
        out = _Writer("b")
        for b in batches:
            for r in sorted(b.to_pylist(), key=lambda r: -r["n_tokens"]):
                p = packers[r["pack_id"]]
                out.add(r["pack_id"], p.place(r["n_tokens"], (r["doc_id"], r["piece"], r["first_token"], r["n_tokens"])))
                out.add(r["pack_id"], p.late())
            if out.ready():
                yield out.flush()
        for p, packer in packers.items():
            for _, bin_ in packer.rest():
                out.add(p, bin_)
        yield out.flush()

    packed = sizes.mapInArrow(first, PACKED_SCHEMA).checkpoint()
    tasks = max(1, packed.rdd.getNumPartitions() // FAN_IN)
    rest = packed.where("is_open").repartition(tasks).mapInArrow(again, PACKED_SCHEMA)
    return packed.where("not is_open").unionByName(rest).drop("is_open")


def packing_faults(packed: DataFrame, sizes: DataFrame, packs: DataFrame) -> DataFrame:
    """For each capacity: documents, those whose pieces are not their tokens, containers above capacity, and items cut though they fit."""
    rooms = packed.where("container is not null").groupBy("pack_id", "container").agg(F.sum("n_tokens").alias("n"))
    above = rooms.join(packs.select("pack_id", "capacity"), "pack_id").groupBy("pack_id").agg(F.count_if(F.col("n") > F.col("capacity")).alias("n_above_capacity"))
    whole = sizes.groupBy("doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("times"))
    pieces_of = packed.groupBy("pack_id", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"))
    met = pieces_of.join(whole, "doc_id").join(packs.select("pack_id", "capacity"), "pack_id")
    per = met.groupBy("pack_id").agg(
        F.count("*").alias("n_docs"), F.count_if(F.col("n") != F.col("tokens")).alias("n_lost"),
        F.count_if((F.col("pieces") > F.col("times")) & (F.col("tokens") <= F.col("capacity"))).alias("n_cut_needlessly"),
    )
    return per.join(above, "pack_id", "left").na.fill(0, ["n_above_capacity"])


def fill_report(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """For each capacity: containers, tokens, and the share of their room that is filled."""
    per = packed.where("container is not null").groupBy("pack_id", "container").agg(F.sum("n_tokens").alias("n"))
    return (
        per.groupBy("pack_id").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"))
        .join(packs.select("pack_id", "capacity").dropna().distinct(), "pack_id")
        .withColumn("filled", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")))
    )
