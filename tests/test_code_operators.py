"""Code-index operators on small fixtures with known answers."""

import io
import json
import os
import random
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from skein import api, cli
from skein.functions.patterns import glob_to_regex, java_regex, parse_line_spec, safe_pattern, safe_ref
from skein.operators import diff, graph, lines, resolve, rollup, search
from skein.render import text
from skein.sources import codec, config, listing, tables
from skein.sources.ignore import ignored_paths, is_ignored, parse_rules
from skein.sources.imports import raw_imports
from skein.sources.parse import LanguageSpec, parse_content, parse_files, register_language
from skein.sources.tables import ensure_checkpoint_dir, one_content, spread, table
from skein.streaming.watch import Watcher, poll_changes

SYMBOLS = [
    ("src/main.py", 0, "main", "function", 10, 20, None, "def main() -> None", ["setup", "run"]),
    ("src/main.py", 1, "setup", "function", 25, 35, None, "def setup(config: dict) -> None", ["load_config"]),
    ("src/api/handlers.py", 0, "UserHandler", "class", 5, 50, None, "class UserHandler(BaseHandler)", []),
    ("src/api/handlers.py", 1, "get", "method", 10, 25, "UserHandler", "def get(self, user_id: int)", []),
    ("src/api/handlers.py", 2, "post", "method", 30, 45, "UserHandler", "def post(self, data: dict)", None),
    ("src/utils/helpers.py", 0, "process_payment", "function", 1, 30, None, "def process_payment(amount: Decimal)", ["validate", "charge"]),
    ("src/utils/helpers.py", 1, "validate", "function", 35, 45, None, "def validate(data: dict) -> bool", []),
]


@pytest.fixture(scope="module")
def symbols(spark):
    rows = [(*s[:8], None, s[8]) for s in SYMBOLS]
    return spark.createDataFrame(rows * 2, "file_path string, sym_ord int, name string, type string, line_start int, line_end int, parent string, signature string, docstring string, dependencies array<string>")


@pytest.mark.parametrize(
    "query,options,want",
    [
        ("main", {}, [(1.0, "main")]),
        ("USERHANDLER", {}, [(1.0, "UserHandler")]),
        ("process", {}, [(0.893333, "process_payment"), (0.327273, "post")]),
        ("valdate", {"fuzzy": False}, [(0.56, "validate")]),
        ("postman", {}, [(0.5, "post"), (0.327273, "main")]),
        ("a", {}, [(0.85, "main"), (0.825, "validate"), (0.818182, "UserHandler"), (0.813333, "process_payment")]),
        ("", {}, [(0.8, n) for n in sorted(["main", "setup", "UserHandler", "get", "post", "process_payment", "validate"])]),
        ("main", {"fuzzy": False, "symbol_type": "class"}, []),
        ("", {"file_pattern": "HELPERS", "limit": 1}, [(0.8, "process_payment")]),
    ],
)
def test_search(symbols, query, options, want):
    got = [(round(r.score, 6), r.name) for r in search.search_symbols(symbols, query, **options).collect()]
    assert (got[:1] if query == "main" and want and not options else got) == want


def test_search_rejects_bad_patterns(symbols):
    with pytest.raises(ValueError):
        search.search_symbols(symbols, "x", file_pattern="(a+)+")


def test_calls_and_structure(symbols, rows):
    assert [r.name for r in search.callers_of(symbols, "validate").collect()] == ["process_payment"]
    assert {(r.direction, r.name) for r in search.dependencies_of(symbols, "VALIDATE").collect()} == set()
    assert {(r.direction, r.name) for r in search.dependencies_of(symbols, "Main").collect()} == {("calls", "setup"), ("calls", "run")}
    assert rows(search.file_structure(symbols).select("class_name", "member")) == [("UserHandler", "get"), ("UserHandler", "post")]
    assert rows(search.search_files(symbols, "helpers")) == [("src/utils/helpers.py", "function", 2, 2)]
    assert [r.name for r in search.completion_names(symbols, limit=3).collect()] == ["UserHandler", "get", "post"]
    assert rows(search.search_files_glob(search.search_symbols(symbols, "", limit=50), "*/api/*").select("name")) == [("UserHandler",), ("get",), ("post",)]


@pytest.mark.parametrize("pattern", ["(a+)+", "(a*)*", "(a+)*", "(.*)+", r"(\w+)+", "(a+b)+", r"(\d+){2,}", "(", "[a"])
def test_patterns_refused(pattern):
    with pytest.raises(ValueError):
        safe_pattern(pattern)


@pytest.mark.parametrize("pattern", ["process_payment", "def .*payment", "(foo)+", "(a|b)*", r"[A-Za-z_]\w*", "class|struct"])
def test_patterns_allowed(pattern):
    assert safe_pattern(pattern) == pattern


def test_regex_dialect(spark):
    df = spark.createDataFrame([("ÄB\rc",), ("a/b.py",)], "s string")
    assert df.where(F.col("s").rlike(java_regex("äb", ignore_case=True))).count() == 1
    assert df.where(F.col("s").rlike(java_regex("^c"))).count() == 0
    assert df.where(F.col("s").rlike(glob_to_regex("a/[!x]*.p?"))).count() == 1


def test_line_specs():
    assert parse_line_spec("1, 5-9") == [(1, 1), (5, 9)]
    for bad in ("", "0", "9-5", "a", "1-2-3"):
        with pytest.raises(ValueError):
            parse_line_spec(bad)
    assert safe_ref("HEAD~2") == "HEAD~2"
    for bad in ("--output=x", "a b", "a..b", ""):
        with pytest.raises(ValueError):
            safe_ref(bad)


@pytest.fixture(scope="module")
def numbered(spark):
    body = "\n".join(f"Line {i}" for i in range(1, 101)) + "\r\n"
    return lines.file_texts(spark.createDataFrame([("f", body), ("f", body), ("g", ""), ("h", None)], "file_path string, content string"))


def test_lines(spark, numbered, rows):
    assert rows(lines.line_counts(numbered)) == [("f", 100), ("g", 1)]
    ranges = lambda *r: spark.createDataFrame([("f", a, b) for a, b in r], "file_path string, first int, last int")
    sections = lambda *r, **o: [(x["first"], x["last"], x["n_ranges"]) for x in lines.merge_ranges(ranges(*r), **o).orderBy("first").collect()]
    assert sections((10, 15), (30, 35), (80, 85)) == [(10, 15, 1), (30, 35, 1), (80, 85, 1)]
    assert sections((10, 12), (15, 18), gap=5) == [(10, 18, 2)]
    assert sections((1, 50), (2, 3), (54, 60), (9, 8)) == [(1, 60, 3)]
    got = lines.read_merged(numbered, ranges((99, 200), (300, 301)), context=1).orderBy("num").collect()
    assert [r.num for r in got] == [98, 99, 100]
    long = spark.createDataFrame([("f", "s", 1, 100)], "file_path string, name string, line_start int, line_end int")
    body = lines.read_symbols(numbered, long, max_lines=50).orderBy("i").collect()
    assert len(body) == 50 and body[25].num is None and body[25].content == "... 51 lines skipped ..." and body[26].num == 77
    found = lines.grep_first(numbered, "line 9", max_matches=2, context=1).orderBy("num").collect()
    assert [(r.num, r.is_match) for r in found] == [(8, False), (9, True), (10, False), (89, False), (90, True), (91, False)]
    assert lines.grep_first(numbered, "nowhere").count() == 0
    cut = lines.lookup_bodies(numbered, long, chars=15).collect()
    assert [r.num for r in cut] == [1, 2]
    assert [r.num for r in lines.lookup_bodies(numbered, long, chars=1).collect()] == [1]
    assert [lines.lookup_budget(n) for n in (1, 150, 999, 5000)] == [(3, 1600), (4, 1800), (4, 1800), (6, 2400)]


MINI = [("utils", "config"), ("main", "config"), ("main", "utils"), ("main", "routes"), ("test_config", "config"), ("main", None)]


@pytest.mark.parametrize("block", [1, 5, 7])
def test_pagerank_golden(spark, block):
    ensure_checkpoint_dir(spark)
    edges = spark.createDataFrame(MINI + MINI[:2], "src_file string, dst_file string")
    nodes = spark.createDataFrame([(x,) for x in ("core", "api", "middleware", "tests", "config")], "path string")
    ranks = {r.path: r["rank"] for r in graph.pagerank(graph.import_graph(edges), nodes, tolerance=1e-9, block=block, iterations=25).collect()}
    want = {"config": 0.273447, "utils": 0.108842, "routes": 0.108842, "main": 0.084812, "core": 0.084812}
    assert sum(ranks.values()) == pytest.approx(1) and len(ranks) == 9
    for k, v in want.items():
        assert ranks[k] == pytest.approx(v, abs=2e-6)


@pytest.mark.parametrize("edges,want", [
    ([("0", "1"), ("1", "2"), ("2", "3")], [0.116156, 0.214888, 0.298811, 0.370145]),
    ([("0", "3"), ("1", "3"), ("2", "3")], [0.152672, 0.152672, 0.152672, 0.541985]),
    ([("0", "1"), ("1", "2"), ("2", "0")], [1 / 3] * 3),
])
def test_pagerank_shapes(spark, edges, want):
    g = graph.import_graph(spark.createDataFrame(edges, "src_file string, dst_file string"))
    got = [r["rank"] for r in graph.pagerank(g, tolerance=1e-10).orderBy("path").collect()]
    assert got == pytest.approx(want, abs=2e-6)


@pytest.mark.parametrize("iterations,tolerance", [(0, 0.0), (3, 0.0), (12, 0.0), (100, 1e-5)])
def test_pagerank_by_brute_force(spark, iterations, tolerance):
    rng = random.Random(iterations)
    pairs = sorted({(f"f{rng.randrange(80)}", f"f{int(rng.paretovariate(0.7)) % 90}") for _ in range(400)})
    names = sorted({x for p in pairs for x in p} | {"lone"})
    out = {x: [b for a, b in pairs if a == x] for x in names}
    ranks = dict.fromkeys(names, 1 / len(names))
    for _ in range(iterations):
        idle = sum(r for x, r in ranks.items() if not out[x])
        moved = dict.fromkeys(names, 0.15 / len(names) + 0.85 * idle / len(names))
        for x, to in out.items():
            for y in to:
                moved[y] += 0.85 * ranks[x] / len(to)
        delta, ranks = sum(abs(moved[x] - ranks[x]) for x in names), moved
        if delta < len(names) * tolerance:
            break
    g = graph.import_graph(spark.createDataFrame(pairs, "src_file string, dst_file string"))
    got = graph.pagerank(g, spark.createDataFrame([("lone",)], "path string"), iterations=iterations, tolerance=tolerance)
    assert {r.path: r["rank"] for r in got.collect()} == pytest.approx(ranks, abs=1e-12)


@pytest.mark.parametrize("limit", [0, 100])
def test_contents_of_repeated_paths(spark, rows, monkeypatch, limit):
    monkeypatch.setattr(tables, "BROADCAST_ROWS", limit)
    files = [("a", "x\ny"), ("b", "old"), ("b", "one"), ("b", None), ("c", "same"), ("c", "same"), ("d", None), ("d", None), ("e", ""), (None, "n")]
    df = spark.createDataFrame(files, "file_path string, content string")
    assert rows(one_content(df)) == sorted([("a", "x\ny"), ("b", "one"), ("c", "same"), ("e", ""), (None, "n")], key=repr)
    assert rows(lines.file_lines(df.where("file_path = 'a'"))) == [("a", 1, "x"), ("a", 2, "y")]
    assert one_content(df.where("false")).count() == 0


def test_graph(spark, rows):
    edges = spark.createDataFrame([("a", "./b"), ("b", "c"), ("c", "a"), ("d\\x", "a"), ("a", "a"), (None, "a")], "src_file string, dst_file string")
    g = graph.import_graph(edges)
    degree = graph.degrees(g, spark.createDataFrame([("lone",), ("a",), (None,)], "path string"))
    assert rows(degree) == [("a", 3, 2), ("b", 1, 1), ("c", 1, 1), ("d/x", 0, 1), ("lone", 0, 0)]
    assert rows(graph.connected(g, "a")) == [("b",), ("c",), ("d/x",)]
    start = spark.createDataFrame([("a",)], "path string")
    assert rows(graph.chains(g, start, depth=5)) == [("a", 1, "b", "a > b"), ("a", 2, "c", "a > b > c")]
    assert rows(graph.chains(g, start, depth=1, reverse=True)) == [("a", 1, "c", "a > c"), ("a", 1, "d/x", "a > d/x")]
    assert [tuple(r)[:4] for r in graph.graph_stats(degree).collect()] == [(5, 5, 1, 1)]
    assert rows(graph.hubs(degree).select("path", "level")) == [("a", "medium")]
    assert graph.pagerank(g.where("false")).count() == 0


TREE = ["src/index.ts", "src/app.ts", "src/components/Button.tsx", "src/components/index.ts", "src/utils/helpers.ts", "src/api/client.ts", "shared/types/index.ts", "lib/pkg/core.py", "lib/pkg/__init__.py", "lib/other/core.py", "top.py"]


@pytest.mark.parametrize("src,spec,language,want", [
    ("src/app.ts", "@/utils/helpers", "typescript", ("src/utils/helpers.ts", "alias")),
    ("src/api/client.ts", "../utils/helpers", "typescript", ("src/utils/helpers.ts", "relative")),
    ("src/app.ts", "./components", "typescript", ("src/components/index.ts", "index")),
    ("src/app.ts", "@components/Button", "typescript", ("src/components/Button.tsx", "alias")),
    ("src/app.ts", "~/types", "typescript", ("shared/types/index.ts", "alias")),
    ("src/app.ts", "nonexistent/module", "typescript", (None, "not_found")),
    ("top.py", "pkg.core", "python", ("lib/pkg/core.py", "suffix")),
    ("top.py", "core", "python", (None, "not_found")),
    ("top.py", "lib.pkg", "python", ("lib/pkg/__init__.py", "index")),
    ("lib/pkg/core.py", "..other.core", "python", ("lib/other/core.py", "relative")),
    ("lib/pkg/core.py", ".core", "python", (None, "not_found")),
])
def test_resolve(spark, src, spec, language, want):
    aliases = [resolve.Alias("@/*", ("src/*",)), resolve.Alias("@components/*", ("src/components/*",)), resolve.Alias("~/*", ("shared/*",))]
    paths = spark.createDataFrame([(p,) for p in TREE], "path string")
    got = resolve.resolve_imports(spark.createDataFrame([(src, spec, language)], "src string, spec string, language string"), paths, aliases=aliases).first()
    assert (got.path, got.strategy) == want


def test_resolve_leaves_the_importer_out(spark):
    tree = ["a/x/util.py", "b/x/util.py", "c/x/util.py", "d/x/util.ts", "x/util.py", "bin/run", "bin/run.sh", "m/index.js", "m/index.ts"]
    asked = [("a/x/util.py", "x.util"), ("z.py", "x.util"), ("bin/run.sh", "bin/run"), ("bin/run", "bin/run"), ("m/index.js", "m"), ("q.js", "m"), ("x/util.py", "x/util.py")]
    paths = spark.createDataFrame([(p,) for p in tree], "path string")
    got = resolve.resolve_imports(spark.createDataFrame([(a, b, "python" if "." in b and "/" not in b else "javascript") for a, b in asked], "src string, spec string, language string"), paths).collect()
    assert {(r.src, r.spec): (r.path, r.strategy, r.candidates) for r in got} == {
        ("a/x/util.py", "x.util"): ("x/util.py", "no_ext", 1), ("z.py", "x.util"): ("x/util.py", "no_ext", 1), ("bin/run.sh", "bin/run"): ("bin/run", "exact", 1), ("bin/run", "bin/run"): ("bin/run.sh", "no_ext", 1),
        ("m/index.js", "m"): ("m/index.ts", "index", 1), ("q.js", "m"): ("m/index.js", "index", 2), ("x/util.py", "x/util.py"): (None, "not_found", 0),
    }



def test_file_keys(spark, rows):
    keys = rows(resolve.file_keys(spark.createDataFrame([("a.py",), ("x/y/__init__.py",), (None,)], "path string")).select("kind", "key"))
    assert keys == [("exact", "a.py"), ("exact", "x/y/__init__.py"), ("index", "x/y"), ("no_ext", "a"), ("no_ext", "x/y/__init__"), ("suffix", "x/y/__init__"), ("suffix", "y/__init__")]


IGNORE = [
    ("**/generated\ndoc/**\na/**/z.txt", ["pkg/generated/x.go", "generated/y.go", "doc/api/index.html", "a/b/c/z.txt", "a/z.txt"], ["other/z.txt"]),
    ("*.log\n!important.log", ["app.log"], ["important.log", "logs/important.log"]),
    ("build/\n!build/keep.txt", ["build/keep.txt", "build/out.o"], ["xbuild/a", "build"]),
    ("file?.txt\n*.[oa]", ["fileA.txt", "main.o", "lib.a"], ["file10.txt", "lib.c"]),
    ("/top\n\\#x\n\\!y\nsp\\ \n[!a-c]z\nq[", ["top", "top/a", "a/#x", "!y", "sp ", "dz", "q["], ["a/top", "az", "sp"]),
]


@pytest.mark.parametrize("rules,out,kept", IGNORE)
def test_ignore(spark, rows, rules, out, kept):
    parsed = parse_rules("# comment\n\n" + rules)
    df = spark.createDataFrame([(p, 1) for p in out + kept] + [(None, 1)], "path string, ignored2 int")
    assert {r.path for r in ignored_paths(df, parsed).where("ignored").collect()} == set(out)
    assert [is_ignored(p, parsed) for p in out + kept] == [True] * len(out) + [False] * len(kept)


def test_nested_ignore():
    parsed = parse_rules("*.tmp") + parse_rules("!keep.tmp\nlocal.txt", "sub")
    assert [is_ignored(p, parsed) for p in ("root.tmp", "sub/other.tmp", "sub/local.txt", "sub/keep.tmp", "local.txt")] == [True, True, True, False, False]


@pytest.mark.skipif(not subprocess.run(["git", "--version"], capture_output=True).returncode == 0, reason="no git")
def test_ignore_agrees_with_git(tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    rules = "*.log\n!keep.log\n/only\nbuild/\na/**/b\n**/gen\nd?r\n[xy]z\nfoo/*.c\n!foo/main.c\nlast/**\n"
    (tmp_path / ".gitignore").write_text(rules)
    paths = ["x.log", "keep.log", "q/keep.log", "only", "s/only", "build/x", "a/b", "a/c/b", "a/c/d/b", "gen/x", "p/gen", "dir/f", "d/r", "xz", "zz", "foo/a.c", "foo/main.c", "foo/b/a.c", "last/x/y"]
    asked = subprocess.run(["git", "-C", str(tmp_path), "check-ignore", "--no-index", "--stdin"], input="\n".join(paths), capture_output=True, text=True).stdout.split()
    assert [p for p in paths if is_ignored(p, parse_rules(rules))] == asked


PYTHON = '''import os
LIMIT = 3
lower = 1

@deco(load())
def outer(a, b: int = default(), *rest) -> str:
    """First.

    Second.
    Third."""
    def inner():
        hidden()
    return helper(a).call()

class Color(enum.Enum):
    RED = 1

class Box(Base):
    async def open(self):
        pass
'''


def test_parse_python():
    got = {(s["name"], s["type"], s["parent"], s["line_start"]): s for s in parse_content("a.py", PYTHON.replace("\n", "\r\n"))}
    assert set(got) == {("LIMIT", "constant", None, 2), ("outer", "function", None, 6), ("inner", "function", "outer", 11), ("Color", "enum", None, 15), ("Box", "class", None, 18), ("open", "method", "Box", 19)}
    outer = got["outer", "function", None, 6]
    assert outer["signature"] == "def outer(a, b: int) -> str" and outer["docstring"] == "First.\n\nSecond...." and outer["decorators"] == ["deco(load())"]
    assert outer["dependencies"] == ["call", "deco", "default", "helper", "load"]
    assert parse_content("a.py", "def f(:") == [] and parse_content("a.unknown", "x") == []


@pytest.mark.parametrize("path,source,want", [
    ("a.go", "type Box struct {\n}\n\n// Opens it.\nfunc (b *Box) Open(x int) error {\n\treturn fill(x)\n}\n\nfunc help() {}\ntype Key string\n", [("Box", "struct", None), ("Open", "method", "Box"), ("help", "function", None), ("Key", "type_alias", None)]),
    ("a.rs", "pub struct P;\nimpl P {\n    pub fn new<'a>(c: char) -> P { if c == '{' { P } else { P } }\n}\nenum E { A }\nfn free() {}\n", [("P", "struct", None), ("P", "impl", None), ("new", "method", "P"), ("E", "enum", None), ("free", "function", None)]),
    ("a.ts", "export interface I { x: number }\nexport class A extends B {\n  private async run(a: string): Promise<void> {\n    if (a) { go(); }\n  }\n}\nexport const f = async (x: number) => {\n};\nconst s = 'class No {';\n", [("I", "interface", None), ("A", "class", None), ("run", "method", "A"), ("f", "arrow", None)]),
    ("A.java", "public class A {\n  public static <T> int m(Map<String, T> x) {\n    return n(x);\n  }\n}\n", [("A", "class", None), ("m", "method", "A")]),
    ("a.rb", "module M\n  class C\n    def self.go(x)\n      if x\n      end\n    end\n    def ok?\n    end\n  end\nend\n", [("M", "module", None), ("C", "class", "M"), ("go", "method", "C"), ("ok?", "method", "C")]),
    ("a.c", "struct S {\n  int a;\n};\nstatic int f(int a)\n{\n  return g(a);\n}\n", [("S", "struct", None), ("f", "function", None)]),
    ("a.kt", "class K {\n  fun go(a: Int): Int {\n    return a\n  }\n}\nobject O\n", [("K", "class", None), ("go", "method", "K"), ("O", "object", None)]),
    ("a.swift", "protocol P {}\nstruct S {\n  func go() {\n  }\n}\n", [("P", "protocol", None), ("S", "struct", None), ("go", "method", "S")]),
    ("a.php", "<?php\ntrait T {\n  public function go() {\n  }\n}\n", [("T", "trait", None), ("go", "method", "T")]),
    ("a.cs", "namespace N {\n  public class C {\n    public int Go(int a) {\n      return a;\n    }\n  }\n}\n", [("N", "namespace", None), ("C", "class", "N"), ("Go", "method", "C")]),
    ("a.dart", "class D {\n  void go() {\n  }\n}\nmixin X {}\n", [("D", "class", None), ("go", "method", "D"), ("X", "mixin", None)]),
    ("a.cpp", "namespace n {\nclass C {\n  int go() {\n    return 1;\n  }\n};\n}\n", [("n", "namespace", None), ("C", "class", "n"), ("go", "method", "C")]),
])
def test_parse_rules(path, source, want):
    got = parse_content(path, "/* ünïcode {{{ */\n" + source)
    assert [(s["name"], s["type"], s["parent"]) for s in got] == want
    assert len({(s["name"], s["type"], s["parent"], s["line_start"]) for s in got}) == len(got)


def test_parse_details(spark):
    go = {s["name"]: s for s in parse_content("a.go", "// Opens it.\n// Fast.\nfunc Open(x int) error {\n\treturn fill(x)\n}\nfunc lower() {\n" + "\n" * 30 + "}\n", max_lines=10)}
    assert go["Open"]["docstring"] == "Opens it.\nFast." and go["Open"]["dependencies"] == ["fill"] and go["Open"]["visibility"] is None and go["Open"]["line_end"] == 5
    assert go["lower"]["truncated"] and go["lower"]["visibility"] == "private"
    files = spark.createDataFrame([("a.py", PYTHON, 1), ("b.py", None, 1), (None, "x", 1), ("c.txt", "x", 1)], "file_path string, content string, name int")
    assert parse_files(files).count() == 6


def test_parse_members():
    ruby = {s["name"]: s for s in parse_content("a.rb", "class C\n  include A, B::C\n  def open\n  end\n  private\n  def shut\n  end\n  public\n  def free\n  end\nend\n")}
    assert ruby["C"]["mixins"] == ["A", "B::C"] and [ruby[n]["visibility"] for n in ("open", "shut", "free")] == [None, "private", None]
    back = lambda path, source: [(s["return_type"], s["modifiers"]) for s in parse_content(path, source) if s["type"] in ("function", "method", "arrow")]
    assert back("a.go", "func F(a int) (int, error) {\n}\nfunc G() *T {\n}\nfunc H() {\n}\n") == [("(int, error)", None), ("*T", None), (None, None)]
    assert back("a.rs", "pub async fn f(a: u8) -> Vec<u8> {\n}\n") == [("Vec<u8>", ["pub", "async"])]
    assert back("a.ts", "export async function f(a: number): Promise<void> {\n}\n") == [("Promise<void>", ["export", "async"])]


def test_register_language():
    from skein.sources import languages

    register_language(LanguageSpec("lua", functions=("function",), block="end", comment=r"--[^\n]*"))
    languages.EXTENSIONS[".lua"] = "lua"
    try:
        assert [s["name"] for s in parse_content("a.lua", "function go(x)\nend\n")] == ["go"]
    finally:
        del languages.EXTENSIONS[".lua"]


def test_diff(spark, rows):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", None)], "file_path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("e", "1")], "file_path string, hash string")
    assert rows(diff.incremental_status(old, new)) == [("a", "unchanged"), ("b", "modified"), ("c", "unchanged"), ("d", "deleted"), ("e", "added")]
    assert rows(diff.stale_files(old, new)) == [("b", "stale"), ("d", "missing"), ("e", "new")]
    assert rows(poll_changes(old, new)) == [("b", "modified"), ("d", "deleted"), ("e", "new")]


def test_coverage(spark, rows):
    code = "x = 1\n" * 12
    files = spark.createDataFrame([(f"{i}.py", "Python", code) for i in range(3)] + [("a.go", "go", code * 9), ("n", None, None)], "file_path string, language string, content string")
    none = spark.createDataFrame([("a.go", 0, "f", 1)], "file_path string, sym_ord int, name string, line_start int")
    cover = diff.coverage_by_language(files, none)
    assert {r.language: (r.files, r.files_with_symbols, r.symbols, r.code_lines) for r in cover.collect()} == {"python": (3, 0, 0, 36), "go": (1, 1, 1, 108), None: (1, 0, 0, 0)}
    assert [r.language for r in diff.coverage_gaps(cover).collect()] == ["python"]
    mapped = spark.createDataFrame([(".py",), (".go",)], "ext string")
    assert [tuple(r) for r in diff.coverage_percent(files, mapped).collect()] == [(4, 1, 80.0)]
    assert diff.coverage_percent(files.where("false"), mapped).first().percent == 100.0
    assert rows(diff.unmapped_extensions(files, mapped)) == [("<none>", 1)]


def test_rollup(spark, symbols, rows):
    files = symbols.select("file_path").distinct()
    got = rows(rollup.directory_rollup(files, symbols, spark.createDataFrame([("src/main.py",)], "path string")))
    assert got == [("src", 1, 3, 5, 1), ("src/api", 2, 1, 1, 0), ("src/utils", 2, 1, 2, 0)]
    assert [tuple(r) for r in rollup.summary(symbols).collect()] == [(3, 5)]
    assert ("src/api/handlers.py", "method", 2, "get, post") in rows(rollup.micro_meta(symbols))


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "proj"
    for path, body in {
        "src/main.py": "from src.util import helper\n\n\ndef main():\n    return helper()\n",
        "src/util.py": "def helper():\n    '''Does it.'''\n    return 1\n",
        "src/web/app.ts": "import { x } from '@/web/lib';\nexport class App {\n}\n",
        "src/web/lib.ts": "export const x = () => 1;\n",
        "node_modules/x.js": "function no() {}\n",
        "notes.txt": "text\n",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(body)
    (root / "tsconfig.json").write_text('{ // aliases\n "extends": "./base", "compilerOptions": {"paths": {"@/*": ["src/*"],}, "x": "http://a//b"} /* end */ }')
    (root / "base.json").write_text('{"extends": "./tsconfig.json", "compilerOptions": {"baseUrl": "."}}')
    (root / "pyproject.toml").write_text('[project]\nname = "demo"\n[tool.import_resolver.aliases]\n"core/*" = "src/*"\n')
    (root / "bad.py").write_bytes(b"NAME = 'x\xff'\r\n")
    return root


FURTHER = {
    'A.java': (
        '/** Doc. */\npublic class A extends B {\n  // no doc\n  private int x = f(1);\n  /** Makes one. */\n  public A(int a) throws E {\n    super(a);\n    init(a);\n  }\n  abstract int m(int a);\n  int n() {\n    return new C(1);\n  }\n}\ninterface I {\n  void run(String s);\n}\n',
        [(2, 'class', 'A', None), (6, 'constructor', 'A', 'A'), (10, 'method', 'm', 'A'), (11, 'method', 'n', 'A'), (15, 'interface', 'I', None), (16, 'method', 'run', 'I')],
    ),
    'a.go': (
        'package a\n\n// Kinds.\nconst (\n\tOne = iota\n\tTwo, Three = 2, 3\n)\n\nvar (\n\tcache map[string]int\n)\n\ntype Store interface {\n\t// Get it.\n\tGet(key string) (int, error)\n\tio.Closer\n}\n\n// Put it.\nfunc (s *T) Put(a int) error {\n\treturn s.save(a)\n}\n',
        [(5, 'const', 'One', None), (6, 'const', 'Two', None), (6, 'const', 'Three', None), (10, 'variable', 'cache', None), (13, 'interface', 'Store', None), (15, 'method', 'Get', 'Store'), (20, 'method', 'Put', 'T')],
    ),
    'a.swift': (
        '/// A box.\nclass Box: Base {\n    // plain\n    required init?(coder: NSCoder) {\n        super.init(coder: coder)\n        items.forEach { use($0) }\n    }\n    func go() -> Int { return 1 }\n}\n',
        [(2, 'class', 'Box', None), (4, 'constructor', 'init', 'Box'), (8, 'method', 'go', 'Box')],
    ),
    'a.c': (
        '#include <x.h>\ntypedef struct point point_t;\nint add(int a, int b);\nstatic char *name(void);\nstruct s { int a; };\nint add(int a, int b) {\n  int r = sum(a, b);\n  return r;\n}\n',
        [(2, 'struct', 'point', None), (2, 'type', 'point_t', None), (3, 'function', 'add', None), (4, 'function', 'name', None), (5, 'struct', 's', None), (6, 'function', 'add', None)],
    ),
    'a.cpp': (
        'namespace n {\nclass Foo : public B {\n public:\n  explicit Foo(int a);\n  ~Foo();\n  virtual int bar(int) const = 0;\n  int size() const { return n_; }\n};\n}\nn::Foo::Foo(int a) : a_(a) {\n  init();\n}\nint n::Foo::bar(int x) const {\n  Foo f(1);\n  return g(x);\n}\nusing Id = int;\n',
        [(1, 'namespace', 'n', None), (2, 'class', 'Foo', 'n'), (4, 'method', 'Foo', 'Foo'), (5, 'method', '~Foo', 'Foo'), (6, 'method', 'bar', 'Foo'), (7, 'method', 'size', 'Foo'), (10, 'method', 'Foo', 'Foo'), (13, 'method', 'bar', 'Foo'), (17, 'type', 'Id', None)],
    ),
    'a.dart': (
        '/// A box.\nclass Box extends W {\n  static const max = 3;\n  final int n;\n  const Box(this.n);\n  Box.empty() : n = 0;\n  factory Box.of(int k) => Box(k);\n  int get size => n;\n  set size(int k) {\n    n = k;\n  }\n  void run(int a) {\n    go(a);\n  }\n  void stop();\n}\nenum Color { red, green(1), blue }\n',
        [(2, 'class', 'Box', None), (3, 'const', 'max', 'Box'), (5, 'constructor', 'Box', 'Box'), (6, 'constructor', 'empty', 'Box'), (7, 'constructor', 'of', 'Box'), (8, 'method', 'size', 'Box'), (9, 'method', 'size', 'Box'), (12, 'method', 'run', 'Box'), (15, 'method', 'stop', 'Box'), (17, 'enum', 'Color', None), (17, 'enum_member', 'red', 'Color'), (17, 'enum_member', 'green', 'Color'), (17, 'enum_member', 'blue', 'Color')],
    ),
    'a.rb': (
        '# A user.\nclass User < Base\n  include Auth\n  NAMES = 1\n  attr_accessor :name, :age\n  belongs_to :team\n  has_many :posts, dependent: :destroy\n  scope :active, -> { where(on: true) }\n  delegate :title, :size, to: :team, prefix: true\n  def self.make(x)\n    reset\n    puts "a"\n    obj.save!\n    new(x)\n  end\n  private\n  def hid\n    1\n  end\nend\n',
        [(2, 'class', 'User', None), (4, 'constant', 'NAMES', 'User'), (5, 'method', 'name', 'User'), (5, 'method', 'age', 'User'), (6, 'method', 'team', 'User'), (7, 'method', 'posts', 'User'), (8, 'method', 'active', 'User'), (9, 'method', 'team_title', 'User'), (9, 'method', 'team_size', 'User'), (10, 'method', 'make', 'User'), (17, 'method', 'hid', 'User')],
    ),
    'a.cs': (
        '#region A\n/// <summary>Doc</summary>\npublic class A {\n#if X\n  public A(int a) : base(a) {\n    Init();\n  }\n#endif\n  public int M(int a) => a;\n}\ninterface I {\n  void Run(int a);\n}\n',
        [(3, 'class', 'A', None), (5, 'constructor', 'A', 'A'), (9, 'method', 'M', 'A'), (11, 'interface', 'I', None), (12, 'method', 'Run', 'I')],
    ),
    'a.kt': (
        '/** K. */\nclass K {\n  constructor(a: Int) {\n    go(a)\n  }\n  fun run(): Int {\n    xs.map { it }\n    return 1\n  }\n}\n',
        [(2, 'class', 'K', None), (3, 'constructor', 'constructor', 'K'), (6, 'method', 'run', 'K')],
    ),
}


@pytest.mark.parametrize("path", FURTHER)
def test_parse_further_declarations(path):
    text_, want = FURTHER[path]
    assert [(s["line_start"], s["type"], s["name"], s["parent"]) for s in parse_content(path, text_)] == want


def test_parse_calls_docs_and_modifiers():
    of = lambda path: {(s["name"], s["line_start"]): s for s in parse_content(path, FURTHER[path][0])}
    ruby, go, swift, java, cpp, cs = (of(p) for p in ("a.rb", "a.go", "a.swift", "A.java", "a.cpp", "a.cs"))
    assert ruby["make", 10]["dependencies"] == ["puts", "reset", "save!"] and ruby["hid", 17]["visibility"] == "private" and ruby["User", 2]["mixins"] == ["Auth"]
    assert ruby["posts", 7]["modifiers"] == ["association:has_many"] and ruby["team_title", 9]["modifiers"] == ["delegated"]
    assert go["Put", 20]["dependencies"] == ["save"] and go["Get", 15]["docstring"] == "Get it." and go["cache", 10]["visibility"] == "private"
    assert swift["init", 4]["dependencies"] == ["forEach", "use"] and swift["init", 4]["docstring"] is None and swift["Box", 2]["docstring"] == "A box."
    assert java["A", 6]["docstring"] == "Makes one." and java["A", 2]["docstring"] == "Doc."
    assert cpp["bar", 13]["parent"] == "Foo" and cs["A", 5]["dependencies"] == ["Init"]


def test_analyzers_come_first_and_fall_back(spark, rows):
    from skein.sources import parse

    def whole(text_):
        if "odd" in text_:
            raise RuntimeError
        return [{"name": "whole", "type": "file", "line_start": 1}] if "mine" in text_ else None

    parse.register_analyzer("kotlin", whole)
    try:
        files = spark.createDataFrame([("a.kt", "// mine\nfun a() {}\n"), ("b.kt", "fun b() {}\n"), ("c.kt", "// odd mine\nfun c() {}\n")], "file_path string, content string")
        assert [(r[0], r[2], r[12]) for r in rows(parse_files(files))] == [("a.kt", "whole", "analyser"), ("b.kt", "b", "rules"), ("c.kt", "c", "rules")]
    finally:
        parse.ANALYZERS.pop("kotlin")


def test_config(tree):
    assert config.tsconfig_aliases(str(tree)) == [resolve.Alias("@/*", ("src/*",))]
    assert config.pyproject_aliases(str(tree)) == [resolve.Alias("core/*", ("src/*",))]
    assert config.module_name(str(tree)) == "demo"
    assert config.tsconfig_aliases(str(tree / "src")) == []


def test_index_end_to_end(spark, tree, tmp_path):
    index = api.CodeIndex.scan(spark, str(tree))
    assert {r.file_path for r in index.files.collect()} == {"bad.py", "src/main.py", "src/util.py", "src/web/app.ts", "src/web/lib.ts"}
    assert {(r.src_file, r.dst_file) for r in index.import_edges().collect()} == {("src/main.py", "src/util.py"), ("src/web/app.ts", "src/web/lib.ts")}
    path = str(tmp_path / "map.json")
    saved = index.save(path)
    assert {k: saved["stats"][k] for k in ("files_processed", "symbols_found")} == {"files_processed": 5, "symbols_found": 5}
    assert saved["stats"]["files_unmapped"] == sum(saved["stats"]["unmapped_extensions"].values()) and "scan_timeout" not in saved["stats"]
    loaded = api.CodeIndex.load(spark, path)
    assert loaded.symbols.count() == 5 and loaded.import_edges().count() == 2
    assert loaded.to_map()["files"] == {k: {x: y for x, y in v.items()} for k, v in saved["files"].items()}
    assert [r.num for r in loaded.read("util.py", [(2, 2)], context=1).collect()] == [1, 2, 3]
    (tree / "src/util.py").write_text("def helper2():\n    pass\n")
    (tree / "src/new.py").write_text("def fresh():\n    pass\n")
    (tree / "src/web/lib.ts").unlink()
    assert {(r.file_path, r.status) for r in loaded.stale().collect()} == {("src/util.py", "stale"), ("src/new.py", "new"), ("src/web/lib.ts", "missing")}
    again = loaded.rescan(path)
    assert {r.name for r in again.symbols.collect()} == {"main", "helper2", "App", "NAME", "fresh"} and again.stats["files_unchanged"] == 3
    calls = api.tools(index)
    assert "main.py" in calls["scan"]() and json.loads(calls["stats"]())["files"] == 5
    assert json.loads(calls["lookup"]("helper"))[0]["callers"] == ["main"]
    assert json.loads(calls["dependencies"]("main.py"))["imports"][0]["node"] == "src/util.py"
    assert json.loads(calls["search"]("helper", pattern="*/util.py"))[0]["name"] == "helper"
    assert calls["read"]("src/main.py", 4, 4) == "4: def main():"
    assert "src/\n  main --> util" in index.flow()
    document = index.graph_document()
    assert document["stats"]["edges"] == 2 and ["src/main.py", "src/util.py"] in document["edges"] and document["critical"][0]["rank"] > 0
    with pytest.raises(ValueError):
        api.inside(str(tree), "../x")


def test_index_tables(spark, tmp_path, rows):
    source = spark.createDataFrame([("a.py", "def f():\n    return g()\n", "h")], "file_path string, content string, hash string")
    index = api.CodeIndex(spark, source, parse_files(source), "/r", {"files_skipped": 2})
    index.write(str(tmp_path / "index"))
    again = api.CodeIndex.open(spark, str(tmp_path / "index"))
    assert (again.root, again.stats) == ("/r", {"files_skipped": 2}) and rows(again.symbols.select("name", "dependencies")) == [("f", ["g"])]
    assert again.files.first()["hash"] == "h"


def test_scan_budget_and_causes(spark, tree):
    stats: dict = {}
    assert listing.list_tree(spark, str(tree), budget=-1.0, stats=stats).count() == 0 and stats["scan_timeout"] is True
    stats = {}
    listing.list_tree(spark, str(tree), ignore=["*.ts", "bad.py"], stats=stats)
    assert stats["skipped_ignored"] == 3 == stats["files_skipped"] and "scan_timeout" not in stats
    index = api.CodeIndex(spark, None, None, "", {**stats, "coverage_gaps": ["go"]})
    assert "3 files skipped (ignored:3)" in index.health_note() and "go" in index.health_note()
    assert api.CodeIndex(spark, None, None).health_note() == ""


def test_paths_stay_below_the_root(spark, tree, rows):
    (tree.parent / "secret.py").write_text("SECRET = 1\n")
    listed = spark.createDataFrame([(0, "../secret.py", "python"), (1, "src/util.py", "python"), (2, "/etc/hostname", "python")], "file_ord long, file_path string, language string")
    got = dict((r[1], r[3] is not None) for r in rows(listing.read_files(listed, str(tree))))
    assert got == {"../secret.py": False, "src/util.py": True, "/etc/hostname": False}
    with pytest.raises(ValueError):
        api.inside(str(tree), "../secret.py")


def test_import_name(tmp_path):
    (tmp_path / "pyproject.toml").write_text('[project]\nname = "my-tool"\n')
    assert config.import_name(str(tmp_path)) == "my_tool" and config.module_name(str(tmp_path)) == "my-tool"


def test_server(spark, tree):
    from skein.server import AssistantServer

    server = AssistantServer(spark, str(tree))
    ask = lambda method, **p: server.handle({"jsonrpc": "2.0", "id": 1, "method": method, "params": p})
    call = lambda name, **a: ask("tools/call", name=name, arguments=a)["result"]
    assert ask("initialize")["result"]["serverInfo"]["name"] == "skein" and server.handle({"method": "notifications/initialized"}) is None
    assert {t["name"] for t in ask("tools/list")["result"]["tools"]} == set(api.tools(api.CodeIndex(spark, None, None)))
    assert "main.py" in call("scan")["content"][0]["text"] and os.path.exists(server.map_path)
    assert json.loads(call("search", query="helper")["content"][0]["text"])[0]["name"] == "helper"
    assert call("read", path="../secret.py", first=1, last=2)["isError"] and call("read", path="a")["isError"] and call("nothing")["isError"]
    assert "main" in json.loads(json.loads(json.dumps(ask("resources/read", uri="skein://map")))["result"]["contents"][0]["text"])["index"]
    assert json.loads(ask("resources/read", uri="skein://imports")["result"]["contents"][0]["text"])["src/main.py"] == ["src/util.py"]
    assert ask("prompts/get", name="overview", arguments={"path": "x"})["result"]["messages"][0]["content"]["text"].startswith("Scan x")
    assert ask("no/such")["error"]["code"] == -32601 and ask("resources/read", uri="skein://x")["error"]["code"] == -32602
    out = io.StringIO()
    AssistantServer(spark, str(tree)).serve(io.StringIO('{"id": 1, "method": "ping"}\n\nnonsense\n'), out)
    assert [list(json.loads(x))[-1] for x in out.getvalue().splitlines()] == ["result", "error"]


def test_completion_and_flags(capsys):
    assert "--warn-stale" in cli.completion("bash") and "compadd" in cli.completion("zsh") and "--incremental" in cli.completion("zsh")
    with pytest.raises(SystemExit):
        cli.main(["--version"])
    assert capsys.readouterr().out.startswith("skein ")


def test_git(tree):
    if subprocess.run(["git", "init", "-q", str(tree)], capture_output=True).returncode:
        pytest.skip("no git")
    run = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.name=a", "-c", "user.email=b", *a], check=True, capture_output=True)
    assert listing.git_tracked(str(tree)) == set()
    run("add", "src")
    run("commit", "-qm", "x")
    (tree / "src/main.py").write_text("x = 1\n")
    assert listing.git_changed(str(tree), "HEAD") == ["src/main.py"]
    assert "src/main.py" in listing.git_uncommitted(str(tree)) and listing.git_tracked(str(tree)) >= {"src/util.py"}
    assert listing.git_tracked("/") is None


def test_scan_binary(spark, tree):
    got = {r.file_path: r.content for r in listing.scan_binary(spark, str(tree)).collect()}
    assert got["bad.py"] == "NAME = 'x'\n" and "src/web/app.ts" in got


MAP = {"root": "/p", "stats": {"files_processed": 2, "symbols_found": 3}, "index": {"main": [{"file": "a.py", "lines": [1, 2]}]}, "files": {
    "a.py": {"hash": "1", "symbols": [{"name": "main", "type": "function", "lines": [1, 2], "deps": ["setup", "run"], "signature": "def main() -> <x>"}]},
    "lib/b.py": {"hash": "2", "symbols": [{"name": "setup", "type": "function", "lines": [1, 2]}, {"name": "_Helper", "type": "class", "lines": [4, 9]}]},
}}


def test_render():
    assert text.export(MAP, "dot").count("->") == 1 and "n0 -> n1" in text.export(MAP, "GraphViz")
    assert "| function | 2 |" in text.export(MAP, "md") and "&lt;x&gt;" in text.export(MAP, "html")
    assert "_Helper" not in text.compact_index(MAP) and "_Helper" in text.compact_index(MAP, by="type", private=True)
    tree = text.skeleton(MAP, {"lib/b.py": 5})
    assert "b.py [high:5]" in tree and tree.endswith("2 files, 3 symbols, 1 hubs\n")
    assert text.table([{"a": 1, "bb": None}]).splitlines()[0] == "a  bb"
    assert text.coverage_line(3, {".a": 1, ".b": 2, ".c": 1, ".d": 1, ".e": 1}, {"ignored": 4}, ["lua"]) == "33.3% of 9 files mapped; unmapped: .b 2, .a 1, .c 1, .d 1; skipped: ignored 4; nothing found in: lua"
    with pytest.raises(ValueError):
        text.export(MAP, "pdf")


def test_map_is_replaced_in_one_step(tmp_path):
    path = tmp_path / "m.json"
    codec.write_map(MAP, str(path))
    with pytest.raises(TypeError):
        codec.write_map({"x": object()}, str(path))
    assert json.loads(path.read_text()) == MAP and os.listdir(tmp_path) == ["m.json"]


def test_old_maps_are_read(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps(MAP))
    _, symbols, about = codec.read_map(spark, str(path))
    assert {(r.name, r.line_start, r.parent) for r in symbols.collect()} == {("main", 1, None), ("setup", 1, None), ("_Helper", 4, None)}
    assert about.first()["version"] is None


def test_cli(spark, tree, tmp_path, capsys):
    path = str(tmp_path / "map.json")
    assert cli.main(["search", "x", "-m", path]) == 1
    assert cli.main(["map", str(tree), "-o", path]) == 0
    capsys.readouterr()
    assert cli.main(["search", "helper", "-m", path, "--compact"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["name"] == "helper"
    assert cli.main(["read", "src/util.py", "1-2", "-m", path, "-o", "code"]) == 0
    assert "def helper" in capsys.readouterr().out
    assert cli.main(["stats", "-m", path, "-o", "table"]) == 0
    assert cli.main(["export", "-m", path, "-f", "dot", "-o", str(tmp_path / "g.dot")]) == 0
    assert cli.main(["completion", "bash"]) == 0


def test_watch(spark, tmp_path):
    state = {"a": "1", "b": "1"}
    fired = []
    watcher = Watcher(spark, lambda: spark.createDataFrame(list(state.items()), "file_path string, hash string"), str(tmp_path), lambda c: fired.append({tuple(r) for r in c.collect()}), quiet=0.2)
    assert watcher.poll() == 0 and not fired
    state |= {"a": "2", "c": "1"}
    del state["b"]
    assert watcher.poll() == 3 and not fired
    time.sleep(0.3)
    query = watcher.start("0 seconds")
    for _ in range(100):
        if fired:
            break
        time.sleep(0.2)
    query.stop()
    assert fired == [{("a", "modified"), ("b", "deleted"), ("c", "new")}]


def test_spread_leaves_shuffles_alone(spark, small):
    df = table(spark, small, "files")
    assert spread(df).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert spread(df.groupBy("root").count()) is not None


@pytest.mark.parametrize(("path", "language", "text", "want"), [
    ("r/a.py", None, "import os\n", ["os"]),
    ("r/a.py", "java", "import os.path\n", ["os.path"]),
    ("r/hook", " Python", "import os\n", ["os"]),
    ("r/a.py", "python", "import a, b.c as d,e\r\nimport f; import g, h; call(i, j)\nimport k, \\\n    l  # , m\n", ["a", "b.c", "e", "f", "g", "h", "k", "l"]),
    ("r/a.ts", None, "export * from './a';\nexport {\n  b,\n} from './b';\nexport type { T } from './t';\nexport * as n from \"./n\";\nexport{c}from'./c';\nexport const from = 'x';\n", ["./a", "./b", "./c", "./n", "./t"]),
    ("r/a.js", None, "const a = require ('a');\nawait import ('b');\n", ["a", "b"]),
    ("r/a.cpp", "c", "#include <vector>\n", ["vector"]),
    ("r/a.txt", None, "import os\n", []),
])
def test_raw_imports(spark, path, language, text, want):
    df = spark.createDataFrame([(path, language, text)], "file_path string, language string, content string")
    assert sorted(r.raw_import for r in raw_imports(df).collect()) == want


def test_chains_start_at_hubs(spark, small):
    from skein.plans.code_queries import QUERIES

    hubs = {r.path for r in table(spark, small, "hub_nodes").select("path").dropna().distinct().collect()}
    first = QUERIES["importers_chain_hubs_d3"](spark, small).where("depth = 1")
    assert {r.start for r in first.select("start").distinct().collect()} == hubs
    edges = graph.import_graph(table(spark, small, "import_edges")).where(F.col("dst").isin(*hubs))
    assert first.count() == edges.count()
