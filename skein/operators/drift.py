"""Schemas that drift between batches of a feed.

Each batch gets a versioned fingerprint (its keys and their JSON types).
Consecutive fingerprints give explicit migration steps (rename, default, cast),
recorded as changes; every record is then routed through the chained steps of
its feed into one consistent table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.tables import ensure_checkpoint_dir, small_side

#: The consistent symbol table: field, type, value where a record lacks the field.
TARGET = [
    ("name", "string", None),
    ("type", "string", None),
    ("file", "string", None),
    ("line_start", "bigint", None),
    ("line_end", "bigint", None),
    ("signature", "string", None),
    ("docstring", "string", None),
    ("parent", "string", None),
    ("version", "string", None),
    ("truncated", "boolean", False),
    ("source", "string", None),
]


def json_type(value: Column) -> Column:
    """string, integer, fraction, boolean, list or object; null for JSON null and nothing."""
    t = F.schema_of_variant(value)
    return (
        F.when(t == "STRING", "string")
        .when(t == "BIGINT", "integer")
        .when(t == "BOOLEAN", "boolean")
        .when(F.startswith(t, F.lit("DECIMAL")) | t.isin("DOUBLE", "FLOAT"), "fraction")
        .when(F.startswith(t, F.lit("ARRAY")), "list")
        .when(F.startswith(t, F.lit("OBJECT")), "object")
    )


def open_records(raw: DataFrame, feed: str, batch: str, payload: str, identity: str) -> DataFrame:
    """One row per record: ``feed, batch, sid, m``, the fields of a record as one map from key to variant.

    Payloads that are no JSON object have no fields; ``sid`` is null where the
    record names none.
    """
    return raw.where(F.col(feed).isNotNull() & F.col(batch).isNotNull()).select(
        F.col(feed).alias("feed"), F.col(batch).alias("batch"),
        F.get_json_object(payload, f"$.{identity}").alias("sid"), F.from_json(payload, "map<string,variant>").alias("m"),
    )


def fingerprints(records: DataFrame) -> DataFrame:
    """The schema of each batch, as a map from key to its types, with the batch before it in the feed.

    Only (feed, batch, key, type) counts are shuffled: a feed that sends most
    of the records is merged before that.
    """
    fields = records.select("feed", "batch", F.explode("m").alias("key", "value")).select("feed", "batch", "key", json_type(F.col("value")).alias("kind"))
    per_type = fields.groupBy("feed", "batch", "key", "kind").agg(F.count("*").alias("n"))
    per_key = per_type.groupBy("feed", "batch", "key").agg(
        F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("types")
    )
    schema = per_key.groupBy("feed", "batch").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "types")))).alias("schema")
    )
    w = Window.partitionBy("feed").orderBy("batch")
    return schema.select(
        "feed", "batch", "schema", F.lag("batch").over(w).alias("before"), F.lag("schema").over(w).alias("was")
    )


def renames(records: DataFrame, prints: DataFrame) -> DataFrame:
    """``feed, batch, old, new``: a vanished key whose values a new key carries for the same records.

    At least one record must show the value under both keys and none another
    value.  Of several candidates the one seen on most records wins, then the
    first by name; a key takes part in one rename of a batch.  Only values of
    keys that came or went, in the batches where they did, leave the scan.
    """
    both = prints.where("was is not null").select(
        "feed",
        "batch",
        "before",
        F.array_except(F.map_keys("was"), F.map_keys("schema")).alias("gone"),
        F.array_except(F.map_keys("schema"), F.map_keys("was")).alias("come"),
    )
    both = both.where("size(gone) > 0 and size(come) > 0")
    sides = both.select(
        "feed",
        F.explode(F.array(F.struct(F.col("before").alias("at"), "batch", F.col("gone").alias("keys"), F.lit(True).alias("old")), F.struct(F.col("batch").alias("at"), "batch", F.col("come").alias("keys"), F.lit(False).alias("old")))).alias("s"),
    ).select("feed", F.col("s.at").alias("_at"), "s.batch", "s.keys", "s.old")
    # A row for each batch and side, as few as the batches.
    wanted = small_side(sides)
    shown = records.withColumnRenamed("batch", "_at").where("sid is not null").join(wanted, ["feed", "_at"])
    value = F.try_element_at("m", F.col("key"))
    kind = json_type(value)
    shown = shown.select("feed", "batch", "sid", "old", "m", F.explode("keys").alias("key")).select(
        "feed", "batch", "sid", "old", "key", F.when(kind.isNotNull(), F.concat_ws(":", kind, F.to_json(value))).alias("v")
    )
    shown = shown.where("v is not null")
    side = lambda old: F.collect_set(F.when(F.col("old") == old, F.struct("key", "v")))
    met = shown.groupBy("feed", "batch", "sid").agg(side(True).alias("o"), side(False).alias("n")).where("size(o) > 0 and size(n) > 0")
    pairs = met.select("feed", "batch", F.explode("o").alias("o"), "n").select("feed", "batch", "o", F.explode("n").alias("n"))
    agreed = (
        pairs.groupBy("feed", "batch", F.col("o.key").alias("old"), F.col("n.key").alias("new"))
        .agg(F.count_if(F.col("o.v") == F.col("n.v")).alias("same"), F.count_if(F.col("o.v") != F.col("n.v")).alias("other"))
        .where("same > 0 and other = 0")
    )
    by_old = Window.partitionBy("feed", "batch", "old").orderBy(F.desc("same"), "new")
    by_new = Window.partitionBy("feed", "batch", "new").orderBy(F.desc("same"), "old")
    return (
        agreed.withColumn("_o", F.row_number().over(by_old))
        .where("_o = 1")
        .withColumn("_n", F.row_number().over(by_new))
        .where("_n = 1")
        .select("feed", "batch", "old", "new")
    )


def schema_changes(records: DataFrame) -> DataFrame:
    """``feed, batch, change_kind, field_name, was``: each batch against the batch before it in its feed.

    ``added`` and ``removed`` keys occur in no record of the other batch;
    ``renamed`` ones (``was`` is the old key) are neither; ``retyped`` keys hold
    non-null values of another set of JSON types.  A key without a non-null
    value in either batch has no type to compare.
    """
    # Both are as small as the schemas (a row per batch, a row per renamed key), and read several times.
    ensure_checkpoint_dir(records.sparkSession)
    prints = fingerprints(records).checkpoint()
    moved = renames(records, prints).checkpoint()
    pairs = prints.where("was is not null")
    come = pairs.select("feed", "batch", F.explode(F.array_except(F.map_keys("schema"), F.map_keys("was"))).alias("k"))
    gone = pairs.select("feed", "batch", F.explode(F.array_except(F.map_keys("was"), F.map_keys("schema"))).alias("k"))
    came = come.join(moved.select("feed", "batch", F.col("new").alias("k"), "old"), ["feed", "batch", "k"], "left")
    added = came.select(
        "feed", "batch", F.when(F.col("old").isNull(), "added").otherwise("renamed").alias("change_kind"),
        F.col("k").alias("field_name"), F.coalesce("old", F.lit("")).alias("was"),
    )
    removed = gone.join(moved.select("feed", "batch", F.col("old").alias("k")), ["feed", "batch", "k"], "left_anti").select(
        "feed", "batch", F.lit("removed").alias("change_kind"), F.col("k").alias("field_name"), F.lit("").alias("was")
    )
    retyped = (
        pairs.select("feed", "batch", "was", F.explode("schema").alias("k", "now"))
        .withColumn("then", F.try_element_at("was", F.col("k")))
        .where("then <> '' and now <> '' and then <> now")
        .select("feed", "batch", F.lit("retyped").alias("change_kind"), F.col("k").alias("field_name"), F.lit("").alias("was"))
    )
    return added.unionByName(removed).unionByName(retyped)


def _chained(steps: DataFrame) -> DataFrame:
    """``(feed, routes)``: names each feed has used, in order: the first batch of their use and the name they began as.

    One array for each feed, as long as it has renamed keys.
    """
    ordered = steps.groupBy("feed").agg(F.array_sort(F.collect_list(F.struct("batch", "old", "new"))).alias("s"))
    none = F.array().cast("array<struct<batch:bigint,key:string,first_name:string>>")

    def add(known: Column, step: Column) -> Column:
        earlier = F.filter(known, lambda u: u["key"] == step["old"])
        origin = F.coalesce(F.get(earlier, F.size(earlier) - 1)["first_name"], step["old"])
        return F.concat(known, F.array(F.struct(step["batch"].alias("batch"), step["new"].alias("key"), origin.alias("first_name"))))

    return ordered.select("feed", F.aggregate("s", none, add).alias("routes"))


def consistent_records(raw: DataFrame, feed: str, batch: str, payload: str, identity: str, target=None) -> DataFrame:
    """One table of all records: ``feed, batch, sid``, the target's fields, and the rest as a map.

    Every key is routed through its feed's chained renames back to the name it
    began as (a key renamed from another in batch b means that field from b on),
    then through the target's cast (a value that cannot be cast is null) and
    default rules.  Fields outside the target stay under their first names in
    ``other``.  Where two keys of a record lead to one field, the renamed one
    counts.  A record delivered twice in a batch counts once; of different
    deliveries the greatest payload counts.  A record moves once, as it came:
    its fields are never rows of their own.
    """
    target = target or TARGET
    ensure_checkpoint_dir(raw.sparkSession)
    records = open_records(raw, feed, batch, payload, identity)
    steps = renames(records, fingerprints(records).checkpoint()).select("feed", F.col("batch").cast("long"), "old", "new")
    routes = _chained(steps).checkpoint()
    kept = raw.where(F.col(feed).isNotNull() & F.col(batch).isNotNull()).select(
        F.col(feed).alias("feed"), F.col(batch).alias("batch"), F.get_json_object(payload, f"$.{identity}").alias("sid"), F.col(payload).alias("p")
    )
    one = kept.where("sid is not null").repartition("feed", "batch", "sid").groupBy("feed", "batch", "sid").agg(F.max("p").alias("p"))
    routed = one.join(small_side(routes), "feed", "left").select("feed", "batch", "sid", "routes", F.from_json("p", "map<string,variant>").alias("m"))
    used = lambda key: F.filter("routes", lambda u: (u["key"] == key) & (u["batch"] <= F.col("batch")))
    latest = lambda key: F.get(used(key), F.size(used(key)) - 1)["first_name"]
    entry = lambda e: F.struct(F.coalesce(latest(e["key"]), e["key"]).alias("field"), latest(e["key"]).isNull().alias("own"), _text(e["value"]).alias("v"))
    entries = F.filter(F.array_sort(F.transform(F.map_entries("m"), entry)), lambda e: e["field"] != identity)
    routed = routed.withColumn("e", entries)
    first = F.filter("e", lambda e, i: (i == 0) | (F.get("e", i - 1)["field"] != e["field"]))
    mapped = routed.withColumn("m", F.map_from_entries(F.transform(first, lambda e: F.struct(e["field"], e["v"]))))
    cols = []
    for name, kind, default in target:
        value = F.try_element_at("m", F.lit(name))
        value = value if kind == "string" else value.try_cast(kind)
        cols.append((value if default is None else F.coalesce(value, F.lit(default))).alias(name))
    names = [n for n, _, _ in target]
    return mapped.select("feed", "batch", "sid", *cols, F.map_filter("m", lambda k, v: ~k.isin(names)).alias("other"))


def _text(value: Column) -> Column:
    """A string as it is, other values as their JSON text, JSON null as null."""
    kind = json_type(value)
    return F.when(kind == "string", value.cast("string")).when(kind.isNotNull(), F.to_json(value))
