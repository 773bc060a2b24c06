"""Deeply nested records into flat tables with parent links.

The JVM decodes the JSON text into typed nested columns; Python only sees Arrow
buffers.  A child table is emitted from a list column's offsets: its values
are the child rows, ``list_parent_indices`` names each child's parent and keys
travel down by one ``take``.  Members below the typed levels are read as one stream of
JSON into columns again; only packed payloads are visited one by one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES_SCHEMA = "raw_id long, node_kind string, own_key string, parent_key string, label string"

#: Levels of members that the JVM decodes; deeper ones follow in Arrow.
TYPED_LEVELS = 3
#: What tells a map; the first two hold its records.
KNOWN = ("files", "index", "stats", "root", "generated_at")


def _symbol_type(levels: int) -> str:
    members = "string" if levels == 0 else f"array<{_symbol_type(levels - 1)}>"
    return f"struct<name: string, deps: array<string>, members: {members}>"


SYMBOLS = f"array<{_symbol_type(TYPED_LEVELS)}>"
FILE = f"struct<path: string, hash: string, symbols: {SYMBOLS}>"
PROBE = "struct<files string, index string, stats string, root string, generated_at string>"


def _is_map(text: Column) -> Column:
    probe = F.from_json(text, PROBE)
    known = (probe["files"], probe["index"], probe["stats"], probe["root"], probe["generated_at"])
    return F.startswith(text, F.lit("{")) & F.coalesce(*known).isNotNull()


def _holds_records(text: Column) -> Column:
    probe = F.from_json(text, PROBE)
    return F.startswith(text, F.lit("{")) & F.coalesce(*[F.when(probe[k].rlike(r"^\s*[{\[]"), True) for k in KNOWN[:2]], F.lit(False))


#: Brackets that a type may nest.
MOST_TYPED = 64
_STRINGS = re.compile(r'"(?:[^"\\]|\\.)*"')
_BLANK = re.compile(r"[ \t\r\n]*")
_DECODER = json.JSONDecoder(strict=False)


def _parts(text: str) -> Iterator[tuple[str | None, object, str]]:
    """Key (None in a list), value and own text of each part of an object or list."""
    skip = lambda i: _BLANK.match(text, i).end()
    i = skip(1)
    while text[i] not in "}]":
        key = None
        if text[0] == "{":
            key, i = _DECODER.raw_decode(text, i)
            i = skip(skip(i) + 1)
        value, end = _DECODER.raw_decode(text, i)
        yield key, value, text[i:end]
        i = skip(end)
        i = skip(i + 1) if text[i] == "," else i


def _unpacked(text: str) -> str:
    """The text of the map inside any layers of packing, of several the one that tells most, then the first."""
    best, found = (False, 0), text
    stack = [text]
    while stack:
        t = stack.pop().lstrip("\ufeff \t\r\n")
        try:
            if t[:1] == '"':
                stack.append(_DECODER.raw_decode(t)[0])
            if t[:1] not in ("{", "["):
                continue
            parts = list(_parts(t))
        except (ValueError, IndexError, RecursionError):
            continue
        known = {k: v for k, v, _ in parts if k in KNOWN and v is not None}
        records = any(isinstance(known.get(k), (dict, list)) or (isinstance(known.get(k), str) and known[k].lstrip()[:1] in ("{", "[")) for k in KNOWN[:2])
        if (records, len(known)) > best:
            best, found = (records, len(known)), t
        if not records:
            inside = [own for k, v, own in parts if k not in KNOWN and isinstance(v, (dict, list, str))]
            stack.extend(reversed(inside))
    return found


def _unpack(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else _unpacked(t) for t in texts.to_pylist()], pa.string())


def decoded_maps(raw: DataFrame) -> DataFrame:
    """``raw_id`` with the typed nested columns of each readable payload.

    A payload counts once per ``raw_id`` (the one received last).  Texts that
    are no valid JSON give no row; ``is_map`` is not true where no layer holds a map.
    Payloads that are no map with records themselves are opened to any depth,
    through every value of every layer.
    """
    text = F.ltrim(F.regexp_replace(F.col("payload"), "^﻿", ""))
    one = raw.groupBy("raw_id").agg(F.max_by("payload", F.struct("received_at", "payload")).alias("payload"))
    texts = one.where(F.try_parse_json("payload").isNotNull()).select("raw_id", text.alias("t"))
    texts = texts.select("raw_id", "t", F.when(~_holds_records(F.col("t")), F.col("t")).alias("packed"))
    texts = texts.select("raw_id", F.coalesce(F.arrow_udf(_unpack, "string")("packed"), "t").alias("t"))
    # No filter here: pushed below the projections above it would copy each layer's expressions into the next.
    top = texts.select("raw_id", _is_map(F.col("t")).alias("is_map"), "t").select(
        "raw_id",
        "is_map",
        F.from_json("t", "struct<files string, index string, stats struct<files_processed string>>").alias("m"),
    )
    keyed = F.transform(
        F.map_entries(F.from_json("m.files", f"map<string, {FILE}>")),
        lambda e: F.struct(
            e["key"].alias("path"), e["value"]["hash"].alias("hash"), e["value"]["symbols"].alias("symbols")
        ),
    )
    listed = F.transform(
        F.from_json("m.files", f"array<{FILE}>"),
        lambda f: F.struct(f["path"].alias("path"), f["hash"].alias("hash"), f["symbols"].alias("symbols")),
    )
    entry = "struct<file: string>"
    index = F.transform(
        F.map_entries(F.from_json("m.index", "map<string,string>")),
        lambda e: F.struct(
            e["key"].alias("name"),
            F.when(F.startswith(e["value"], F.lit("[")), F.from_json(e["value"], f"array<{entry}>"))
            .otherwise(F.array(F.from_json(e["value"], entry)))
            .alias("entries"),
        ),
    )
    return top.select(
        "raw_id",
        "is_map",
        F.col("m.stats.files_processed").alias("files_processed"),
        F.when(F.startswith("m.files", F.lit("{")), keyed).when(F.startswith("m.files", F.lit("[")), listed).alias("files"),
        index.alias("index"),
    )


def _children(lists: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Values of a list array, the parent's row of each, and its position as text."""
    values, parent = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    starts = np.cumsum(lengths) - lengths
    return values, parent, pa.array(np.arange(len(values)) - starts[parent]).cast(pa.string())


def _text(a: pa.Array) -> pa.Array:
    return pc.fill_null(a.cast(pa.string()), "")


def _joined(left: pa.Array, mark: str, right: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(left, right, mark)


def _depth(text: str) -> int:
    a = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
    steps = np.isin(a, (91, 123)).astype(np.int32) - np.isin(a, (93, 125))
    return int(np.cumsum(steps).max(initial=0))


def _decode_deep(texts: pa.Array) -> pa.Array:
    """Members below the typed levels, all levels at once: the texts as one stream of JSON lines, read into typed columns.

    The type goes as deep as brackets nest.  Where values are not of that type
    (a number for a name, an object for a list) or nest deeper than MOST_TYPED
    brackets, one level is decoded by value, and the rest comes back here.
    """
    lines = pc.replace_substring(pc.fill_null(pc.if_else(pc.equal(pc.fill_null(texts, ""), ""), None, texts), "null"), "\n", " ")
    stream = "\n".join(pc.binary_join_element_wise('{"m":', lines, "}", "").to_pylist())
    kind: list[tuple] = [("name", pa.string()), ("deps", pa.list_(pa.string()))]
    depth = _depth(stream)
    if depth > MOST_TYPED:
        depth = _depth(_STRINGS.sub('""', stream))
    if depth > MOST_TYPED:
        return _decode_level(texts)
    for _ in range(depth // 2):
        kind = [*kind[:2], ("members", pa.list_(pa.struct(kind)))]
    shape = pa.schema([kind[2] if len(kind) > 2 else ("members", pa.list_(pa.struct(kind)))]).field(0)
    try:
        found = pj.read_json(
            pa.BufferReader(stream.encode("utf-8", "surrogatepass")), pj.ReadOptions(use_threads=False, block_size=min(max(1 << 20, 4 * len(stream) + 64), 2**31 - 1)),
            pj.ParseOptions(explicit_schema=pa.schema([("m", shape.type)]), unexpected_field_behavior="ignore"),
        )
    except (pa.ArrowException, OverflowError):
        return _decode_level(texts)
    return found["m"].combine_chunks() if found.num_rows == len(texts) else _decode_level(texts)


def _decode_level(texts: pa.Array) -> pa.Array:
    """Members below the typed levels: one more level, deeper ones as text again."""
    kind = pa.list_(pa.struct([("name", pa.string()), ("deps", pa.list_(pa.string())), ("members", pa.string())]))

    def level(text: str | None) -> list | None:
        found = json.loads(text) if text else None
        return [
            m and {
                "name": m.get("name") if m.get("name") is None else str(m["name"]),
                "deps": m.get("deps") if isinstance(m.get("deps"), list) else None,
                "members": json.dumps(m["members"]) if m.get("members") else None,
            }
            for m in found
        ] if isinstance(found, list) else None

    return pa.array([level(t) for t in texts.to_pylist()], kind)


def _nodes(ids: pa.Array, kind: str, own: pa.Array, parent: pa.Array, label: pa.Array) -> pa.RecordBatch:
    n = len(ids)
    cols = [ids.cast(pa.int64()), pa.array([kind] * 1).take(pa.array(np.zeros(n, np.int64))), own, parent, label]
    return pa.RecordBatch.from_arrays(
        [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols],
        names=["raw_id", "node_kind", "own_key", "parent_key", "label"],
    )


def _symbols(ids: pa.Array, owner: pa.Array, lists: pa.Array) -> Iterator[pa.RecordBatch]:
    """Rows of a list of symbols, of their calls, and of the members below, to any depth."""
    while len(lists) and pc.any(pc.greater(pc.fill_null(pc.list_value_length(lists), 0), 0)).as_py():
        values, parent, position = _children(lists)
        ids, owner = ids.take(pa.array(parent)), owner.take(pa.array(parent))
        own = _joined(owner, "#", position)
        yield _nodes(ids, "symbol", own, owner, _text(pc.struct_field(values, "name")))
        deps = pc.struct_field(values, "deps")
        callee, of, at = _children(deps)
        holder = own.take(pa.array(of))
        yield _nodes(ids.take(pa.array(of)), "dep", _joined(holder, "@", at), holder, _text(callee))
        if values.type.get_field_index("members") < 0:
            break
        owner, lists = own, pc.struct_field(values, "members")
        if pa.types.is_string(lists.type) or pa.types.is_large_string(lists.type):
            lists = _decode_deep(lists)


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        b = b.filter(pc.fill_null(b["is_map"], False))
        ids, n = b["raw_id"], b.num_rows
        if not n:
            continue
        blank = pa.array([""]).take(pa.array(np.zeros(n, np.int64)))
        yield _nodes(ids, "map", blank, blank, _text(b["files_processed"]))
        files, parent, _ = _children(b["files"])
        of = ids.take(pa.array(parent))
        path = _text(pc.struct_field(files, "path"))
        none = blank.take(pa.array(parent))
        yield _nodes(of, "file", path, none, _text(pc.struct_field(files, "hash")))
        yield from _symbols(of, path, pc.struct_field(files, "symbols"))
        names, parent, _ = _children(b["index"])
        of = ids.take(pa.array(parent))
        name = _text(pc.struct_field(names, "name"))
        entries, parent, at = _children(pc.struct_field(names, "entries"))
        holder = name.take(pa.array(parent))
        yield _nodes(of.take(pa.array(parent)), "entry", _joined(holder, "#", at), holder, _text(pc.struct_field(entries, "file")))


def flatten_maps(raw: DataFrame) -> DataFrame:
    """All records of the code maps in ``raw(raw_id, payload, received_at)`` as one node table.

    ``(raw_id, node_kind, own_key, parent_key, label)`` with kinds ``map``,
    ``file``, ``symbol``, ``dep`` and ``entry``.  Missing and null labels are
    ''; absent, null and empty containers have no children; a null element of
    a list is a record with an empty label and keeps its position.  Unreadable
    payloads give no rows, repeated ones count once, other columns are ignored.
    """
    return decoded_maps(raw).mapInArrow(_flatten, NODES_SCHEMA)


def node_table(nodes: DataFrame, kind: str) -> DataFrame:
    """The flat table of one kind of record."""
    return nodes.where(F.col("node_kind") == kind).drop("node_kind")
