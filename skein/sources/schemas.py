"""Schemas of the code index."""

SYMBOLS = (
    "file_path string, sym_ord int, name string, type string, line_start int, line_end int, signature string, docstring string, "
    "parent string, dependencies array<string>, decorators array<string>, truncated boolean, source string, visibility string, "
    "modifiers array<string>, mixins array<string>, return_type string"
)
FILES = (
    "file_ord long, file_path string, language string, content string, hash string, code_lines int, "
    "raw_imports array<string>, imports array<string>"
)
CALL_EDGES = "caller_file string, caller_name string, caller_type string, line_start int, line_end int, callee_name string"
IMPORT_EDGES = "src_file string, dst_file string"
#: Version of the JSON form of the index; another one forces a full rebuild.
INDEX_VERSION = "2"
