"""Snapshots, skewed keys, nesting and drift against plain Python on small and awkward inputs."""

import json
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skein.functions.paths import canonical_path
from skein.operators.drift import consistent_records, open_records, schema_changes
from skein.operators.nested import flatten_maps
from skein.operators.selection import distinct_per_key, quantiles_per_key
from skein.operators.snapshots import snapshot_changes
from skein.sources import tables

T0 = datetime(2025, 1, 1)
MAPS = "map_id long, root string, generated_at timestamp, clash string"
RECORDS = "map_id long, file_path string, hash string, received_at timestamp, _key string"


def changes(spark, maps, records):
    m = spark.createDataFrame([(*r, "x") for r in maps], MAPS)
    f = spark.createDataFrame([(*r, "y") for r in records], RECORDS)
    return snapshot_changes(m, f, snapshot="map_id", series="root", at="generated_at", key="file_path", values=[F.lower("hash")], received="received_at")


def brute_changes(maps, records):
    held = defaultdict(dict)
    for m, p, h, at in records:
        if p is not None:
            old = held[m].get(p)
            if old is None or (at or T0 - timedelta(999)) >= old[1]:
                held[m][p] = (h.lower() if h else h, at or T0 - timedelta(999))
    series = defaultdict(list)
    for m, root, at in maps:
        if m is not None and root is not None and at is not None:
            series[root].append((at, m))
    out = set()
    for s in series.values():
        s.sort()
        for (_, a), (_, b) in zip(s, s[1:]):
            for p in held[a].keys() | held[b].keys():
                if p not in held[a]:
                    out.add((b, p, "added"))
                elif p not in held[b]:
                    out.add((b, p, "removed"))
                elif held[a][p][0] != held[b][p][0]:
                    out.add((b, p, "changed"))
    return out


def test_snapshots_random(spark, rows):
    rng = random.Random(4)
    maps = [(i, f"r{i % 3}", T0 + timedelta(days=rng.randrange(40), seconds=i)) for i in range(12)] + [(77, None, T0), (78, "r0", None)]
    records, n = [], 0
    for m in [x for x in range(12) if x != 5] + [78, 99]:
        for _ in range(30):
            n += 1
            records.append((m, f"f{rng.randrange(20)}", rng.choice([None, "aa", "AA", "bb"]), T0 + timedelta(seconds=n)))
    records += records[:10] + [(0, None, "aa", T0)]
    got = rows(changes(spark, maps, records))
    assert len(got) == len(set(got))
    assert set(got) == brute_changes(maps, records)


def test_snapshots_empty(spark, rows):
    assert rows(changes(spark, [], [])) == []
    # A map that lists nothing removes everything; coming back adds it again.
    maps = [(1, "r", T0), (2, "r", T0 + timedelta(1)), (3, "r", T0 + timedelta(2))]
    assert rows(changes(spark, maps, [(1, "a", "x", T0), (3, "a", "x", T0)])) == [(2, "a", "removed"), (3, "a", "added")]


def test_snapshots_latest_row_counts(spark, rows):
    maps = [(1, "r", T0), (2, "r", T0 + timedelta(1))]
    records = [(1, "a", "new", T0 + timedelta(hours=2)), (1, "a", "old", T0), (1, "a", "null-time", None), (2, "a", "NEW", T0), (1, "b", None, T0), (2, "b", "x", T0)]
    assert rows(changes(spark, maps, records)) == [(2, "b", "changed")]


@pytest.mark.parametrize("given,wanted", [("./a/b.py", "a/b.py"), ("a\\b\\c.py", "a/b/c.py"), ("././a//b/./c", "a/b/c"), (".\\a", "a"), ("a/.b/c", "a/.b/c"), ("a/..b", "a/..b"), (None, None), ("a/.", "a")])
def test_canonical_path(spark, given, wanted):
    assert spark.createDataFrame([(given,)], "p string").select(canonical_path(F.col("p"))).first()[0] == wanted


def test_distinct_per_key(spark, rows):
    data = [("hot", str(i % 500)) for i in range(3000)] + [("cold", "a"), ("cold", "a"), ("nul", None), (None, "x")]
    df = spark.createDataFrame([(k, v, 1) for k, v in data], "key string, v string, n int")
    assert rows(distinct_per_key(df, F.col("key"), F.col("v"))) == [("cold", 1), ("hot", 500)]
    assert rows(distinct_per_key(df.where("false"), F.col("key"), F.col("v"))) == []


@pytest.mark.parametrize("prefixes,limit", [((16, 32, 64), 10), ((2, 4, 64), 0), ((1,), 10_000), ((1, 3, 6), 3)])
def test_distinct_bins_are_split_until_each_holds_one(spark, rows, monkeypatch, prefixes, limit):
    monkeypatch.setattr(tables, "BROADCAST_ROWS", limit)
    data = [("hot", f"v{i * i % 997}") for i in range(9000)] + [(f"k{i % 40}", f"w{i % 7}") for i in range(400)]
    want = sorted((k, len({v for key, v in data if key == k})) for k in {k for k, _ in data})
    df = spark.createDataFrame(data, "key string, v string")
    assert rows(distinct_per_key(df, F.col("key"), F.col("v"), prefixes=prefixes)) == sorted(want, key=repr)


@pytest.mark.parametrize("bins", [64, 256])
def test_quantiles_above_the_old_bounds(spark, bins):
    rng = random.Random(bins)
    data = [("hot", rng.randrange(-(2**62), 2**62)) for _ in range(12_000)] + [(f"k{i % 300}", i // 300) for i in range(1500)]
    df = spark.createDataFrame(data, "key string, v long")
    held = defaultdict(list)
    for k, v in data:
        held[k].append(v)
    want = {k: (len(v), sorted(v)[max(1, -(-len(v) // 2)) - 1], max(v)) for k, v in held.items()}
    assert {r[0]: tuple(r)[1:] for r in quantiles_per_key(df, F.col("key"), F.col("v"), [0.5, 1.0], bins=bins).collect()} == want


@pytest.mark.parametrize("hot_share", [0.0, 0.05, 1.0])
def test_quantiles_exact(spark, rows, hot_share):
    rng = random.Random(1)
    data = [("hot", int(rng.paretovariate(0.3)) % 10**12 * rng.choice([1, -1])) for _ in range(3000)]
    data += [("tied", 7)] * 400 + [("tied", 8)] * 3 + [("one", -5), ("nul", None), (None, 3)]
    df = spark.createDataFrame(data, "key string, v long")
    probs = [0.0, 0.01, 0.5, 0.99, 1.0]
    got = {r[0]: tuple(r)[1:] for r in quantiles_per_key(df, F.col("key"), F.col("v"), probs, bins=16, hot_share=hot_share).collect()}
    want = {}
    for k in ("hot", "tied", "one"):
        v = sorted(x for key, x in data if key == k)
        want[k] = (len(v), *[v[max(1, -(-int(p * len(v) * 100) // 100)) - 1] for p in probs])
    assert got == want


def brute_nodes(raw_id, payload):
    try:
        v = json.loads(payload)
        while isinstance(v, str):
            v = json.loads(v)
    except (ValueError, TypeError):
        return set()
    if isinstance(v, list):
        v = v[0]
    v = v.get("code_map", v)
    text = lambda x: "" if x is None else str(x)
    out = {(raw_id, "map", "", "", text((v.get("stats") or {}).get("files_processed")))}

    def symbols(owner, found):
        for i, s in enumerate(found or []):
            own = f"{owner}#{i}"
            s = s or {}
            out.add((raw_id, "symbol", own, owner, text(s.get("name"))))
            for j, d in enumerate(s.get("deps") or []):
                out.add((raw_id, "dep", f"{own}@{j}", own, text(d)))
            symbols(own, s.get("members"))

    files = v.get("files") or {}
    for path, f in files.items() if isinstance(files, dict) else [(f["path"], f) for f in files]:
        out.add((raw_id, "file", path, "", text((f or {}).get("hash"))))
        symbols(path, (f or {}).get("symbols"))
    for name, found in (v.get("index") or {}).items():
        for i, e in enumerate(found if isinstance(found, list) else [found]):
            out.add((raw_id, "entry", f"{name}#{i}", name, text(e.get("file"))))
    return out


def deep(n):
    s = {"name": f"s{n}", "deps": ["a", None]}
    return {**s, "members": [deep(n - 1), None]} if n else s


def test_nested(spark, rows):
    plain = {"version": 2, "root": "/w", "files": {"a.py": {"hash": "h", "symbols": [deep(9), {"name": None, "deps": None, "members": []}]}, "b.py": None, "ü/ß.py": {}}, "index": {"x": {"file": "a.py"}, "y": [{"file": None}, {"file": "b.py"}], "z": []}, "stats": {"files_processed": 3}}
    listed = {"files": [{"path": "l.go", "hash": None, "symbols": None}, {"path": "m.go", "symbols": [{"name": "q\"\n"}]}], "stats": {"files_processed": "7"}}
    bare = {"version": "1", "root": "/x", "generated_at": "t"}
    payloads = {
        1: json.dumps(plain), 2: json.dumps(listed, indent=2), 3: json.dumps({"code_map": plain, "sent_by": "s"}), 4: json.dumps(json.dumps(listed)), 5: json.dumps(plain)[:-9],
        6: "<html>", 7: "", 8: None, 9: json.dumps(bare), 10: "  " + json.dumps(json.dumps({"code_map": listed})), 11: json.dumps({"error": "busy"}), 12: "[]", 13: "3",
    }
    data = [(i, p, T0, "clash") for i, p in payloads.items()] + [(1, payloads[1], T0, "again")]
    got = rows(flatten_maps(spark.createDataFrame(data, "raw_id long, payload string, received_at timestamp, own_key string")))
    want = set().union(*[brute_nodes(i, payloads[i]) for i in (1, 2, 3, 4, 9)], {(10, *r[1:]) for r in brute_nodes(2, payloads[2])})
    assert len(got) == len(set(got))
    assert set(got) == want
    assert flatten_maps(spark.createDataFrame([], "raw_id long, payload string, received_at timestamp")).count() == 0


def test_nested_any_packing(spark, rows):
    plain = {"files": {"a.py": {"hash": "h", "symbols": [{"name": "f", "deps": ["g"]}]}}, "index": {"f": {"file": "a.py"}}, "stats": {"files_processed": 1.50}}
    text = json.dumps(plain)
    five = text
    for _ in range(5):
        five = json.dumps(five)
    lists = text
    for _ in range(9):
        lists = f"[{lists}]"
    payloads = {
        1: five, 2: lists, 3: json.dumps({"sent_by": {"name": "s", "stats": {"files": 3}}, "code_map": plain}), 4: json.dumps([{"part": 1}, "x", json.dumps({"body": [text]})]),
        5: json.dumps({"root": "/w", "note": "{not json", "data": {"inner": text}}), 6: json.dumps({"sent_by": {"root": "/s"}, "files": 3, "code_map": plain}),
    }
    df = spark.createDataFrame([(i, p, T0) for i, p in payloads.items()], "raw_id long, payload string, received_at timestamp")
    want = brute_nodes(0, text)
    assert len(want) == 5
    assert set(rows(flatten_maps(df))) == {(i, *r[1:]) for i in payloads for r in want}


def drift(spark, batches):
    data = [(f, b, json.dumps(r) if isinstance(r, dict) else r, "x") for f, b, r in batches]
    return spark.createDataFrame(data, "f string, b int, p string, key string")


def test_drift_changes(spark, rows):
    first = [{"sid": i, "name": f"n{i}", "line": i, "flag": True, "gone": i, "ext": None} for i in range(6)]
    second = [{"sid": i, "label": f"n{i}", "line": str(i), "flag": None, "fresh": [i], "ext": {"a": 1}} for i in range(5)]
    third = [{"sid": i, "label": f"n{i}", "line": str(i), "flag": 1.5, "ext": {"a": 1}} for i in range(6)]
    data = drift(spark, [("f", 1, r) for r in first * 2] + [("f", 2, r) for r in second] + [("f", 4, r) for r in third] + [("g", 1, first[0]), ("g", 2, "no json"), (None, 1, first[0]), ("g", 3, "[1]")])
    got = rows(schema_changes(open_records(data, "f", "b", "p", "sid")))
    want = [("f", 2, "renamed", "label", "name"), ("f", 2, "removed", "gone", ""), ("f", 2, "added", "fresh", ""), ("f", 2, "retyped", "line", ""), ("f", 4, "removed", "fresh", "")]
    assert got == sorted(want, key=repr)
    assert rows(schema_changes(open_records(data.where("false"), "f", "b", "p", "sid"))) == []


def test_drift_rename_needs_equal_values(spark, rows):
    data = drift(spark, [("f", 1, {"sid": i, "a": True, "b": i}) for i in range(8)] + [("f", 2, {"sid": i, "c": i % 2 == 0, "d": i}) for i in range(8)])
    got = rows(schema_changes(open_records(data, "f", "b", "p", "sid")))
    assert got == sorted([("f", 2, "removed", "a", ""), ("f", 2, "added", "c", ""), ("f", 2, "renamed", "d", "b")], key=repr)


def test_drift_one_table(spark):
    batches = [("f", 1, {"sid": 1, "name": "x", "line_start": 3}), ("f", 2, {"sid": 1, "label": "x", "line_start": "4"}), ("f", 3, {"sid": 1, "tag": "x", "line_start": "q", "truncated": True})]
    got = consistent_records(drift(spark, batches), "f", "b", "p", "sid").orderBy("batch").select("batch", "name", "line_start", "truncated", "other").collect()
    assert [tuple(r) for r in got] == [(1, "x", 3, False, {}), (2, "x", 4, False, {}), (3, "x", None, True, {})]


def test_drift_two_keys_lead_to_one_field(spark):
    batches = [("f", 1, {"sid": i, "name": f"x{i}"}) for i in range(3)] + [("f", 2, {"sid": i, "label": f"x{i}"}) for i in range(3)]
    batches += [("f", 3, {"sid": 1, "label": "new", "name": "other", "deep": {"a": [1, None]}}), ("f", 3, {"sid": 1, "label": "new", "name": "other", "deep": {"a": [1, None]}}), ("f", 3, {"sid": 2})]
    got = consistent_records(drift(spark, batches), "f", "b", "p", "sid").where("batch = 3").orderBy("sid").select("sid", "name", "other").collect()
    assert [tuple(r) for r in got] == [("1", "new", {"deep": '{"a":[1,null]}'}), ("2", None, {})]
    assert consistent_records(drift(spark, batches).where("false"), "f", "b", "p", "sid").count() == 0


def test_drift_steps_too_many_to_send(spark, rows, monkeypatch):
    data = drift(spark, [("f", 1, {"sid": i, "a": True, "b": i}) for i in range(8)] + [("f", 2, {"sid": i, "c": i % 2 == 0, "d": i}) for i in range(8)])
    want = rows(schema_changes(open_records(data, "f", "b", "p", "sid"))), [repr(r) for r in rows(consistent_records(data, "f", "b", "p", "sid"))]
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 0)
    assert (rows(schema_changes(open_records(data, "f", "b", "p", "sid"))), [repr(r) for r in rows(consistent_records(data, "f", "b", "p", "sid"))]) == want


def test_members_deeper_than_types_and_brackets_in_strings(spark, rows):
    deep = {"name": "[" * 5000, "deps": ["{" * 99]}
    for k in range(60):
        deep = {"name": str(k), "members": [deep]}
    raw = spark.createDataFrame([(1, json.dumps({"files": {"a": {"symbols": [deep]}}}), T0)], "raw_id long, payload string, received_at timestamp")
    got = rows(flatten_maps(raw))
    assert sum(r[1] == "symbol" for r in got) == 61 and sum(r[1] == "dep" for r in got) == 1 and any(r[4] == "[" * 5000 for r in got)


@pytest.mark.parametrize("odd", [None, 7, {"x": 1}, [["a"]], "2024-01-01"])
@pytest.mark.parametrize("depth", [2, 3, 4, 5, 9, 14])
def test_members_to_any_depth(spark, rows, depth, odd):
    def member(k):
        m = {"name": f'n{k} "[{{\n' if k % 2 else None, "deps": [f"d{k}", None], "extra": {"members": [1]}}
        return m if k == 0 else {**m, "members": [member(k - 1), None, {"name": odd, "deps": None, "members": []}]}

    payload = json.dumps({"files": {"a": {"hash": "h", "symbols": [member(depth), {"name": "flat"}]}, "b": {"symbols": [{"name": "x", "members": [{"name": "y"}]}]}}, "stats": {"files_processed": 2}})
    raw = spark.createDataFrame([(1, payload, T0)], "raw_id long, payload string, received_at timestamp")
    got = [r for r in rows(flatten_maps(raw)) if r[1] in ("symbol", "dep")]
    want = set()

    def walk(owner, found):
        for i, m in enumerate(found or []):
            own, m = f"{owner}#{i}", m or {}
            if i != 2 or owner.count("#") == 0:
                want.add((1, "symbol", own, owner, m.get("name") or ""))
            for j, d in enumerate(m.get("deps") or []):
                want.add((1, "dep", f"{own}@{j}", own, d or ""))
            walk(own, m.get("members"))

    for path, f in json.loads(payload)["files"].items():
        walk(path, f["symbols"])
    third = lambda r: r[1] == "symbol" and r[2].endswith("#2") and r[3].count("#")
    assert {r for r in got if not third(r)} == want and sum(map(bool, map(third, got))) == depth
    if odd is None or isinstance(odd, str):
        assert {r[4] for r in got if third(r)} == {odd or ""}
