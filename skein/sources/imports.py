"""Raw imports found by patterns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.paths import extension
from skein.sources.languages import EXTENSIONS

_Q = "['\"]([^'\"\\n]+)['\"]"
#: Patterns by language; group 1 is what is imported.
PATTERNS = {
    "javascript": [
        rf"(?m)^\s*import\s+[^;\n]*?from\s+{_Q}", rf"(?m)^\s*import\s+{_Q}", rf"\brequire\s*\(\s*{_Q}\s*\)", rf"\bimport\s*\(\s*{_Q}\s*\)",
        rf"(?m)^\s*export\s+(?:[^;\n'\"]*?|(?:type\s+)?\{{[^}}]*\}}\s*)\bfrom\s*{_Q}", rf"(?m)^\s*export\s*(?:type\s*)?(?:\{{[^}}]*\}}|\*)\s*from\s*{_Q}",
    ],
    "python": [r"(?m)^[ \t]*from[ \t]+([\w.]+)[ \t]+import\b"],
    "go": [r'(?m)^\s*import\s+(?:\w+\s+)?"([^"\n]+)"'],
    "rust": [r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)", r"(?m)^\s*(?:pub\s+)?mod\s+(\w+)\s*;"],
    "java": [r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)"],
    "ruby": [rf"(?m)^\s*require(?:_relative)?\s*\(?\s*{_Q}"],
    "c": [r'(?m)^\s*#\s*include\s*[<"]([^>"\n]+)[>"]'],
}
PATTERNS["typescript"] = PATTERNS["javascript"]
PATTERNS["cpp"] = PATTERNS["c"]


def file_language(path: Column, language: Column) -> Column:
    """By the suffix, else as recorded."""
    known = F.create_map(*[F.lit(x) for e, name in EXTENSIONS.items() for x in (e, name)])
    return F.coalesce(known[extension(path)], F.lower(F.trim(language)))


def _python_names(text: Column) -> Column:
    """The modules of ``import a, b as c``, also over continued lines and several statements in a line."""
    lists = F.regexp_extract_all(F.regexp_replace(text, r"\\\r?\n", " "), F.lit(r"(?m)^[ \t]*import[ \t]+([^\n#]+)"), F.lit(1))
    plain = F.transform(lists, lambda x: F.split(F.regexp_replace(F.regexp_replace(x, r";[ \t]*import[ \t]+", ","), r";.*", ""), ","))
    names = F.transform(F.flatten(plain), lambda x: F.regexp_extract(x, r"^\s*([\w.]+)", 1))
    return F.filter(names, lambda x: x != "")


def raw_imports(files: DataFrame, languages: tuple[str, ...] | None = None) -> DataFrame:
    """``(file_path, raw_import)``, distinct, of files in the given languages (all that have patterns).

    The suffix tells the language; the recorded one counts where it does not.
    """
    wanted = languages or tuple(PATTERNS)
    language = F.col("lang")
    rows = files.where(F.col("content").isNotNull()).withColumn("lang", file_language(F.col("file_path"), F.col("language"))).where(language.isin(*wanted))
    text = F.col("content")
    found = None
    for name in wanted:
        all_of = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in PATTERNS[name]])
        if name == "python":
            all_of = F.concat(all_of, _python_names(text))
        if name == "go":
            # The first parenthesised block as well.
            block = F.regexp_extract(text, r"(?s)\bimport\s*\((.*?)\)", 1)
            all_of = F.concat(all_of, F.regexp_extract_all(block, F.lit(r'"([^"\n]+)"'), F.lit(1)))
        found = F.when(language == name, all_of) if found is None else found.when(language == name, all_of)
    return rows.select("file_path", F.explode(found).alias("raw_import")).distinct()
