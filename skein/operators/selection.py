"""Per-key results under heavy key skew: exact distinct counts and exact quantiles by selection.

A few keys may hold most rows.  No step gathers the values of a key: values are
counted in histograms per (key, bin) that keep a count and the least and
greatest value, all of which merge before and after a shuffle.  A bin whose
least and greatest value agree holds one value and is resolved; the bins that a
wanted rank may lie in are split again until every rank is resolved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.tables import ensure_checkpoint_dir, small_side

#: Bits of a value's name that tell its bin, round by round; the last round tells whole names apart.
PREFIXES = (20, 40, 64)
#: A key is hot if it holds more than this share of all rows, so there are never more than its inverse.
HOT_SHARE = 0.001


def _distinct_histogram(rows: DataFrame, bin_: list) -> DataFrame:
    """``(key, open, n)``: how many bins of each key hold one value (``open`` null), and each bin that holds several."""
    same = (F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2"))
    bins = rows.groupBy("key", *bin_).agg(F.min("h1").alias("a1"), F.max("h1").alias("b1"), F.min("h2").alias("a2"), F.max("h2").alias("b2"))
    return bins.withColumn("open", F.when(~same, F.col("bin"))).groupBy("key", "open").agg(F.count("*").alias("n"))


def distinct_per_key(df: DataFrame, key: Column, value: Column, *, prefixes: tuple[int, ...] = PREFIXES) -> DataFrame:
    """``(key, n)``: how many different non-null values each non-null key has, exactly.

    The count is the rank of a key's last value when each value counts once.
    Values are named by two 64-bit hashes and counted in a histogram over the
    first bits of the first; bins with several values are split by more bits,
    in a new pass over their rows only, until each holds one.  A bin's state is
    four numbers, so a hot key is merged before the shuffle and spread over its
    bins in it.  Repeated rows count once; an empty table gives no rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    named = df.select(key.alias("key"), value.alias("_v")).where(F.col("key").isNotNull() & F.col("_v").isNotNull())
    named = named.select("key", F.xxhash64("_v").alias("h1"), F.xxhash64(F.lit(11), "_v").alias("h2"))
    at = lambda bits: F.shiftrightunsigned("h1", 64 - bits) if bits < 64 else F.col("h1")
    rows, done = named, []
    for k, bits in enumerate(prefixes):
        found = _distinct_histogram(rows.withColumn("bin", at(bits)), ["bin"]).checkpoint()
        done.append(found.where("open is null").select("key", "n"))
        left = found.where("open is not null").select("key", F.col("open").alias("bin"))
        n_left = left.count()
        if not n_left:
            break
        # The bins of a key spread its rows, so that the join is even also where they are too many to send out.
        rows = named.withColumn("bin", at(bits)).join(small_side(left, n_left), ["key", "bin"], "left_semi").drop("bin")
        if k == len(prefixes) - 1:
            done.append(rows.groupBy("key", "h1", "h2").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("n")))
    counts = done[0]
    for d in done[1:]:
        counts = counts.unionByName(d)
    return counts.groupBy("key").agg(F.sum("n").alias("n"))


def _histograms(rows: DataFrame, targets: DataFrame, bins: int) -> DataFrame:
    """Bins of each target's interval that hold values: count, least and greatest value."""
    near = rows.join(targets.select("key", "lo", "hi"), "key").where("v between lo and hi")
    # Halved, so that the width of the widest interval is a BIGINT too.
    width = F.expr(f"hi div {bins} - lo div {bins} + 1")
    bin_ = F.expr("v div _w - lo div _w")
    return near.withColumn("_w", width).groupBy("key", "lo", "hi", bin_.alias("bin")).agg(F.count("*").alias("w"), F.min("v").alias("a"), F.max("v").alias("b"))


def quantiles_per_key(df: DataFrame, key: Column, value: Column, probs: list[float], *, bins: int = 1024, hot_share: float = HOT_SHARE) -> DataFrame:
    """``(key, n, q0, q1, ...)``: exact nearest-rank quantiles of an integral value for each key.

    The quantile of ``p`` is the value of rank ``max(1, ceil(p * n))`` in
    ascending order, repeated values counted as often as they occur.  Rows with
    a null key or value are left out, an empty table gives no rows, other
    columns are ignored.  ``value`` must fit a BIGINT.

    All keys take the same way.  A target is an interval of a key's values with
    the ranks wanted in it; first the whole range.  Each round counts the
    interval in ``bins`` bins and keeps those that hold a wanted rank, narrowed
    to their least and greatest value, until these agree.  An interval shrinks
    to at most a few ``bins``-ths a round, so the rounds are as many as digits,
    whatever the key's size; no window sees more than about twice ``bins`` rows.
    Rows of hot keys (more than ``hot_share`` of all, so fewer than its inverse)
    are counted where they lie; only others are shuffled by key.
    """
    if bins < 4:
        raise ValueError("fewer than four bins need not narrow an interval around zero")
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.select(key.alias("key"), value.cast("long").alias("v")).dropna()
    per_key = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).checkpoint()
    total = per_key.agg(F.sum("n")).first()[0] or 0
    ranks = [F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n") - 1e-9)).cast("long") for p in probs]
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), r.alias("r")) for i, r in enumerate(ranks)])
    is_hot = F.col("n") > F.lit(total * hot_share)
    hot_keys = F.broadcast(per_key.where(is_hot).select("key"))
    cold = rows.join(hot_keys, "key", "left_anti")
    targets = per_key.select("key", "lo", "hi", wanted.alias("ranks"), is_hot.alias("hot"))
    solved = []
    w = Window.partitionBy("key", "lo", "hi").orderBy("bin")
    while True:
        solved.append(targets.where("lo = hi").select("key", F.col("lo").alias("v"), F.explode("ranks.i").alias("i")))
        open_ = targets.where("lo < hi")
        if open_.isEmpty():
            break
        counted = _histograms(rows, F.broadcast(open_.where("hot")), bins).unionByName(_histograms(cold, open_.where("not hot"), bins))
        below = F.sum("w").over(w) - F.col("w")
        located = counted.withColumn("below", below).join(open_, ["key", "lo", "hi"])
        inside = F.filter("ranks", lambda x: (x["r"] > F.col("below")) & (x["r"] <= F.col("below") + F.col("w")))
        shifted = F.transform(inside, lambda x: F.struct(x["i"].alias("i"), (x["r"] - F.col("below")).alias("r")))
        targets = located.select("key", F.col("a").alias("lo"), F.col("b").alias("hi"), shifted.alias("ranks"), "hot").where(F.size("ranks") > 0).checkpoint()
    values = solved[0]
    for s in solved[1:]:
        values = values.unionByName(s)
    wide = values.groupBy("key").agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"q{i}") for i in range(len(probs))])
    return per_key.select("key", "n").join(wide, "key")
