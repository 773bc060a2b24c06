"""What changed between full snapshots of a table.

Every record is reduced to a compact key (two 64-bit hashes), a row hash and
its snapshot's rank.  Those arrays are hash-bucketed by key, so no group,
source or snapshot ends up in one task, sorted in numpy, and consecutive
snapshots are subtracted with ``searchsorted``.  Only keys that differ go back
to the table for their full values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.tables import ensure_checkpoint_dir, small_side, tasks_for

KINDS = ("added", "removed", "changed")


def rank_snapshots(snapshots: DataFrame, snapshot: str, series: str, at: str) -> DataFrame:
    """Rank of each snapshot in its series, the one after it, and whether one precedes it.

    Snapshots of one series that carry the same time are ordered by their id.
    Rows without an id, a series or a time belong to no series and are left out.
    """
    w = Window.partitionBy("_series").orderBy(F.col("_at"), F.col("_snapshot"))
    return (
        snapshots.select(F.col(snapshot).alias("_snapshot"), F.col(series).alias("_series"), F.col(at).alias("_at"))
        .dropna()
        .groupBy("_snapshot")
        .agg(F.max(F.struct("_at", "_series")).alias("_m"))
        .select("_snapshot", "_m._series", "_m._at")
        .select(
            "_snapshot",
            "_series",
            F.row_number().over(w).cast("int").alias("_seq"),
            F.lead("_snapshot").over(w).alias("_next"),
        )
    )


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set differences of consecutive snapshots over one bucket of keys."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    k1, k2, value, seq = (t[c].to_numpy() for c in ("k1", "k2", "value", "seq"))
    at = t["at"].fill_null(np.iinfo(np.int64).min).to_numpy()
    this, last = t["snapshot"].to_numpy(), t["next"].is_null().to_numpy(zero_copy_only=False)
    nxt = t["next"].fill_null(0).to_numpy()

    # Dense key numbers, then for each key and snapshot the row received last.
    order = np.lexsort((value, at, seq, k2, k1))
    k1, k2, value, seq, this, nxt, last = (a[order] for a in (k1, k2, value, seq, this, nxt, last))
    fresh = np.empty(len(k1), bool)
    fresh[0] = True
    fresh[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    kid = np.cumsum(fresh) - 1
    code = kid * (int(seq.max()) + 2) + seq
    keep = np.append(code[1:] != code[:-1], True)
    k1, k2, value, seq, this, nxt, last, code = (a[keep] for a in (k1, k2, value, seq, this, nxt, last, code))

    def find(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(code, wanted), len(code) - 1)
        return at, code[at] == wanted

    before, had = find(code - 1)
    _, kept = find(code + 1)
    added = (~had) & (seq > 1)
    changed = had & (value != value[before])
    removed = (~kept) & (~last)
    for kind, rows, owner in ((0, added, this), (1, removed, nxt), (2, changed, this)):
        if rows.any():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(k1[rows]),
                    pa.array(k2[rows]),
                    pa.array(owner[rows]),
                    pa.array(np.full(int(rows.sum()), kind, np.int8)),
                ],
                names=["_k1", "_k2", "_owner", "_kind"],
            )


def snapshot_changes(
    snapshots: DataFrame,
    records: DataFrame,
    *,
    snapshot: str,
    series: str,
    at: str,
    key: str,
    values: list,
    received: str | None = None,
    bytes_per_task: int = 16_000_000,
) -> DataFrame:
    """Records added, removed or changed by each snapshot but the first of its series.

    ``snapshots`` has one row per delivery (``snapshot`` id, ``series``, time
    ``at``); ``records`` holds their rows.  ``values`` are columns or
    expressions whose change counts; null is a value of its own.  Among the
    rows of one snapshot and key the one with the latest ``received`` counts
    (null is earliest; exact ties: either, by row hash).  A snapshot without
    records removes everything.  Rows whose snapshot is unknown or whose key is
    null are left out; repeated rows count once; an empty table gives no rows;
    columns not named here are ignored, whatever their names.

    Returns ``(snapshot, key, change_kind)`` without duplicates.
    """
    ensure_checkpoint_dir(records.sparkSession)
    ranks = rank_snapshots(snapshots, snapshot, series, at)
    value_cols = [F.col(v) if isinstance(v, str) else v for v in values]
    hashed = F.xxhash64(*[x for v in value_cols for x in (v.isNull(), v)])
    rows = records.where(F.col(key).isNotNull()).select(
        F.col(snapshot).alias("_snapshot"),
        F.col(key).alias("_key"),
        hashed.alias("value"),
        (F.unix_micros(F.col(received).cast("timestamp")) if received else F.lit(0).cast("long")).alias("at"),
    )
    k1, k2 = F.xxhash64("_series", "_key"), F.xxhash64("_key", F.lit(7), "_series")
    joined = rows.join(ranks, "_snapshot")
    compact = joined.select(
        k1.alias("k1"), k2.alias("k2"), "value", "at",
        F.col("_seq").cast("long").alias("seq"),
        F.col("_snapshot").cast("long").alias("snapshot"), F.col("_next").cast("long").alias("next"),
    )
    # A bucket holds some hundred bytes for each dozen bytes of the (compressed) table.
    buckets = compact.repartition(tasks_for(rows, bytes_per_task), "k1")
    found = buckets.mapInArrow(_differences, "_k1 long, _k2 long, _owner long, _kind tinyint").checkpoint()
    # Full values only of keys that differ: the others' rows go no further than their scan.
    keys = found.select("_k1", "_k2").distinct()
    named = joined.select(k1.alias("_k1"), k2.alias("_k2"), "_key").join(small_side(keys, found.count()), ["_k1", "_k2"], "left_semi")
    names = named.groupBy("_k1", "_k2").agg(F.first("_key").alias("_key"))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("_kind").cast("int") + 1)
    return found.join(names, ["_k1", "_k2"]).select(
        F.col("_owner").alias(snapshot), F.col("_key").alias(key), kind.alias("change_kind")
    )
