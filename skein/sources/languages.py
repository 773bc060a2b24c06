"""Languages by file extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The extensions that the index maps, and their languages.
EXTENSIONS = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".java": "java", ".go": "go", ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp",
    ".cs": "csharp", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin", ".dart": "dart",
}


def language_table(spark: SparkSession, extra: dict[str, str] | None = None) -> DataFrame:
    """``(ext, language)``: small and fixed, fit to be broadcast."""
    return spark.createDataFrame(sorted({**EXTENSIONS, **(extra or {})}.items()), "ext string, language string")


def language_of(path: str) -> str | None:
    dot = path.rfind(".")
    return EXTENSIONS.get(path[dot:].lower()) if dot >= 0 else None
