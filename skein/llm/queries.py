"""Queries of the training-text operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import docpairs, generated, leakage, packing, repetition
from skein.sources.tables import ensure_checkpoint_dir, table


def p1_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signal of every file, with the reasons against it being hand-written."""
    found = generated.signals(table(spark, sf_dir, "files"), table(spark, sf_dir, "vendor_catalog"))
    return generated.verdicts(found).withColumn("kinds", F.array_join("kinds", "+")).distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that nobody wrote by hand here."""
    found = generated.signals(table(spark, sf_dir, "files"), table(spark, sf_dir, "vendor_catalog"))
    return generated.verdicts(found).where(F.size("kinds") > 0).select("file_path").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and methods with real documentation."""
    return docpairs.documented_functions(table(spark, sf_dir, "files"))


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code with its description."""
    return docpairs.code_doc_pairs(table(spark, sf_dir, "files"))


_SAID = "Moves the oldest entries to the archive."
#: Declarations and definitions apart, and the pairs they make: (definition, name, line, documentation from).
PLANTED_FILES = [
    ("r/include/x.h", f"/** {_SAID} */\nint f(int, const char*);\n/** {_SAID} */\nint f(long n);\n/** f */\nint g(void);\n"),
    ("r/src/x.c", "int f(int count, char const *s) {\n  return 1;\n}\n\nint f(long m) {\n  return 2;\n}\n\nint f(short m) {\n  return 3;\n}\n\nint g(void) {\n  return 4;\n}\n"),
    ("q/src/x.c", "int f(int count, char const *s) {\n  return 1;\n}\n"),
    ("r/api/Store.java", f"interface Store {{\n  /** {_SAID} */\n  int put(int key, List<String> rows);\n}}\n"),
    ("r/disk/Disk.java", "class Disk extends Base {\n  public int put(final int k, List<String> all) {\n    return 1;\n  }\n}\nclass Base implements Store {\n}\n"),
    ("r/own/a.go", f"// {_SAID}\nfunc Own(a int) int {{\n\treturn a\n}}\n"),
]
PLANTED_PAIRS = [
    ("r/src/x.c", "f", 1, "r/include/x.h"), ("r/src/x.c", "f", 5, "r/include/x.h"), ("r/disk/Disk.java", "put", 2, "r/api/Store.java"), ("r/own/a.go", "Own", 2, "r/own/a.go"),
]


def p5_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of declarations and definitions that stand apart, over a fixed table of such files."""
    files = spark.createDataFrame([(p, None, c) for p, c in PLANTED_FILES], "file_path string, language string, content string")
    return docpairs.code_doc_pairs(files).select("file_path", "name", "line_start", "doc", "doc_path")


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ensure_checkpoint_dir(spark)
    packs = table(spark, sf_dir, "pack_sizes").select("pack_id", "capacity").dropna().distinct()
    sizes = packing.token_counts(table(spark, sf_dir, "documents"))
    # One row for each kind of container; the table of capacities is fixed.
    return packing.pack(sizes, [(r[0], r[1]) for r in packs.orderBy("pack_id").collect()]), packs


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, or piece of one longer than a container, in its container."""
    return _packed(spark, sf_dir)[0]


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each capacity are."""
    packed, packs = _packed(spark, sf_dir)
    return packing.fill_report(packed, packs)


def p7_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a packing must not have: lost tokens, containers above capacity, needless cuts."""
    packed, packs = _packed(spark, sf_dir)
    return packing.packing_faults(packed, packing.token_counts(table(spark, sf_dir, "documents")), packs)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items they give away."""
    within = F.col("n_replaced") * leakage.ONE_IN <= F.col("n_words")
    return p8_leaks(spark, sf_dir).where(within).select("doc_id", "item_id").distinct()


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the longest passage's length, its replaced words, and whether its numbers were changed throughout."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that mostly repeat themselves."""
    documents = table(spark, sf_dir, "documents")
    return repetition.repetitive(documents, repetition.fit_model(documents)).select("doc_id").distinct()


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of repeated words of every document."""
    return repetition.repetition_shares(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_signals, p5_found, p5_pairs, p5_planted, p7_packed, p7_fill, p7_faults, p8_found, p8_leaks, p9_found, p9_shares)
}

_WORDS = """
with words as (
  select doc_id, regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+') as w from documents
), runs as (
  select doc_id, i, array_to_string(w[i:i + 4], ' ') as run from words, unnest(generate_series(1, len(w) - 4)) as g(i)
), again as (
  select doc_id, i from (select doc_id, i, min(i) over (partition by doc_id, run) as first from runs) where i > first
), hit as (
  select doc_id, count(distinct i + k) as n from again, generate_series(0, 4) as s(k) group by doc_id
), shares as (
  select doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) / greatest(len(w), 1) as repeated_share from words left join hit using (doc_id)
)
"""

ORACLE: dict[str, str] = {
    "p5_planted": "select file_path, name, line_start::int as line_start, '"
    + _SAID
    + "' as doc, doc_path from (values "
    + ", ".join(f"('{a}', '{b}', {c}, '{d}')" for a, b, c, d in PLANTED_PAIRS)
    + ") as t(file_path, name, line_start, doc_path)",
    "p7_faults": """select p.pack_id, (select count(distinct doc_id) from documents) as n_docs, 0::bigint as n_lost, 0::bigint as n_above_capacity, 0::bigint as n_cut_needlessly
from (select distinct pack_id from pack_sizes) p""",
    "p9_found": _WORDS + "select distinct doc_id from shares where repeated_share >= 0.4",
    "p9_shares": _WORDS + "select doc_id, n_words, repeated_share from shares",
}
