"""Training-text operators against plain Python, on small and awkward inputs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import docpairs, generated, leakage, packing, repetition
from skein.llm.repair import Grammar
from skein.sources.tables import ensure_checkpoint_dir

# Grammars


def expand(g, first_new):
    rules = {}
    for first, left, right in g.rounds:
        for i, (a, b) in enumerate(zip(left, right)):
            rules[first + i] = (int(a), int(b))

    def full(s):
        return full(rules[s][0]) + full(rules[s][1]) if s in rules else [s]

    out = defaultdict(list)
    for s, o in zip(g.symbols, g.owner):
        out[int(o)] += full(int(s))
    return out


@pytest.mark.parametrize("shared", [False, True])
def test_grammar_expands_to_its_input(shared):
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, k, n).tolist() for k, n in ((2, 300), (5, 200), (1, 77), (50, 1), (9, 0), (3, 2), (4, 500))]
    symbols = np.array([x for t in texts for x in t])
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    g = Grammar(symbols.copy(), owner, 50, len(texts)).infer(shared=shared)
    got = expand(g, 50)
    assert [got[i] for i in range(len(texts))] == texts
    if not shared:
        for i in range(len(texts)):
            s = g.symbols[g.owner == i]
            runs = [(int(a), int(b)) for a, b in zip(s, s[1:])]
            counts = Counter(runs)
            # No pair is left twice, but for overlapping ones (a a a).
            assert all(n == 1 or (p[0] == p[1] and n == 2) for p, n in counts.items())


def test_repetition_makes_small_grammars():
    g = Grammar(np.tile(np.arange(10), 100), np.zeros(1000, int), 10, 1).infer()
    assert g.size_ratio(np.array([1000]))[0] < 0.06


# Generated files

HAND = "\n".join(f"def {a}_{b}({b}, {c}):\n    {c} = {b}.{a}({d!r})\n    return {d} if {c} > {n} else {a}\n" for n, (a, b, c, d) in enumerate([("load", "table", "rows", "north"), ("keep", "shelf", "books", "red"), ("walk", "trail", "miles", "late"), ("bind", "rope", "knots", "tight"), ("pour", "glass", "drops", "cold")]))
RULES = "\n".join(f"def rule_{i}(self):\n    return self.field[{i}]\n" for i in range(60))
DATA = "export const T = [\n" + "\n".join(f'  {{"id": {i}, "word": "w{i * 7919 % 1000}", "x": {i / 7:.3f}}},' for i in range(60)) + "\n];\n"
SQUEEZED = "(function(){" + "".join(f"function {c}({d},e){{return {d}&&e>{i}?{d}.q:null}}var {d}={c}({i});" for i, (c, d) in enumerate(zip("abcdfghijk", "klmnopqrst"))) + "})()"
OUTSIDE = HAND.replace("table", "desk").replace("rope", "wire") + RULES.replace("rule", "step").replace("field", "part")[:300] + "\nclass Keeper:\n    wide = 'open door'\n"


def kinds(spark, files, catalog=()):
    f = spark.createDataFrame([(*r, "x") for r in files], "file_path string, content string, kinds string")
    c = spark.createDataFrame(list(catalog), "item_id long, content string")
    return {r.file_path: sorted(r.kinds) for r in generated.verdicts(generated.signals(f, c)).collect()}


def test_generated_kinds(spark):
    changed = "# local copy\n" + OUTSIDE.replace("'open door'", "'shut door'")
    got = kinds(
        spark,
        [
            ("r/src/a.py", HAND), ("r/src/g.py", RULES), ("r/lib/d.ts", DATA), ("r/x/s.js", SQUEEZED), ("r/third_party/p/a.py", HAND), ("r/vendors/a.py", HAND),
            ("r/src/copy.py", changed), ("r/src/m.py", "# Code generated by loom. DO NOT EDIT.\n" + HAND), ("r/src/n.py", 'BANNER = "Code generated by loom. DO NOT EDIT."\n' + HAND),
            ("r/src/l.py", "# Copyright the authors.\n# Not generated: the old tool emitted a DO NOT EDIT banner.\n" + HAND), ("r/src/empty.py", ""), ("r/src/null.py", None), (None, RULES),
            ("r/src/b.c", "﻿/*\n * AUTO-GENERATED FILE - any manual change will be overwritten\n */\r\nint a;\r\n"),
        ],
        [(1, OUTSIDE), (2, None), (3, "")],
    )
    assert got == {
        "r/src/a.py": [], "r/src/g.py": ["generated"], "r/lib/d.ts": ["data"], "r/x/s.js": ["squeezed"], "r/third_party/p/a.py": ["outside"], "r/vendors/a.py": [], "r/src/copy.py": ["copied"],
        "r/src/m.py": ["stated"], "r/src/n.py": [], "r/src/l.py": [], "r/src/empty.py": [], "r/src/null.py": [], "r/src/b.c": ["stated"],
    }


def test_generated_empty_tables(spark):
    assert kinds(spark, []) == {}
    assert kinds(spark, [("a.py", HAND)]) == {"a.py": []}


def test_large_catalog_goes_out_in_blocks(spark, rows, monkeypatch):
    files = spark.createDataFrame([("r/a.py", OUTSIDE + "x = 1\n"), ("r/b.py", HAND), ("r/c.py", RULES), ("r/e.py", "")], "file_path string, content string")
    known = spark.createDataFrame([(1, RULES), (2, OUTSIDE), (3, SQUEEZED), (4, OUTSIDE + OUTSIDE)], "item_id long, content string")
    whole = rows(generated.signals(files, known))
    monkeypatch.setattr(generated, "CATALOG_BYTES", 10)
    assert rows(generated.signals(files, known)) == whole
    assert [(r[0], r[8]) for r in whole] == [("r/a.py", 2), ("r/b.py", 2), ("r/c.py", 1), ("r/e.py", -1)]


def test_ratios_do_not_depend_on_the_batch():
    texts = [HAND, RULES, DATA, SQUEEZED, OUTSIDE, "", "7 8 7 8 7 8", DATA.replace("7", "3")]
    names = [str(i) for i in range(len(texts))]
    whole = generated.file_signals(names, texts, [])
    for i, t in enumerate(texts):
        assert generated.file_signals(["x"], [t], []).drop(columns="file_path").iloc[0].tolist() == whole.drop(columns="file_path").iloc[i].tolist()
    both = generated.file_signals(names[::-1], texts[::-1], [(1, OUTSIDE)])
    assert both.grammar_ratio.tolist()[::-1] == whole.grammar_ratio.tolist()


@pytest.mark.parametrize("head,want", [
    ("// Code generated by loom. DO NOT EDIT.", True), ("# machine made from a.proto; edit that", True), ("// !! built by loom on every release", True), ("# This file was automatically created from x.idl", True),
    ("/* Diese Datei wurde automatisch erzeugt. */", True), ("# Ce fichier est produit par loom.", True), ("// @generated by loom v2", True), ("# source code generated by loom", True),
    ("// Written by hand, not generated: the old tool emitted a DO NOT EDIT banner.", False), ("// Keep in step with the auto-generated client by hand.", False), ("# Created by the authors, 2020", False),
    ("// The writer below puts the generated marker into its output.", False), ("# Reads tables produced by the scanner.", False), ("// Does not edit by itself", False),
])
def test_statements(head, want):
    assert bool(generated.STATED.search(generated.file_head(head + "\nint a;\n"))) == want


# Documentation

REAL = "Moves the oldest entries to the archive."


@pytest.mark.parametrize(
    "path,text,want",
    [
        ("a.py", f'def f(x):\n    """{REAL}"""\n\ndef g():\n    pass\n', [("f", 1)]),
        ("a.py", f"@deco\nasync def f(\n    x,\n):\n\n    r'''\n    {REAL}\n    '''\n", [("f", 2)]),
        ("a.py", f'# {REAL}\ndef f():\n    pass\n', []),
        ("a.py", f'T = """\ndef f():\n    \'\'\'{REAL}\'\'\'\n"""\n', []),
        ("a.py", f'class C:\n  """{REAL}"""\n  def m(self):\n    def inner():\n      "{REAL}"\n    return inner\n', [("inner", 4)]),
        ("a.py", f'def f(x):\n    """{REAL}"""\n    print "old"\n', [("f", 1)]),
        ("a.py", '\ufeffdef f(x):\r\n\t"""Args:\r\n\t    x:\r\n\t    y:\r\n\t    z:\r\n\t    w:\r\n\tReturns:\r\n\t"""\r\n', []),
        ("a.js", f"/**\n * {REAL}\n */\nexport const f = async (a, b) => {{\n}};\n", [("f", 4)]),
        ("a.js", f"/**\n * {REAL}\n */\n\nfunction f() {{}}\n", []),
        ("a.js", f"// {REAL}\n// eslint-disable-next-line\nfunction f() {{}}\n", [("f", 3)]),
        ("a.js", f"const s = `\n// {REAL}\nfunction f() {{}}\n`;\n/*\n// {REAL}\nfunction g() {{}}\n*/\n", []),
        ("a.ts", f"class A {{\n  /** {REAL} */\n  private async m<T>(a: (x: T) => void): Promise<T> {{\n    if (a) {{\n    }}\n  }}\n}}\n", [("m", 3)]),
        ("a.jsx", f"const RULE = 'x'\n\n/** {REAL} */\nfunction f() {{}}\n", [("f", 4)]),
        ("A.java", f"class A {{\n  /** {REAL} */\n  @Override\n  @Named(\"x\")\n  public <T> List<T> m(Map<String, T> a) throws E {{\n    return m(a);\n  }}\n}}\n", [("m", 5)]),
        ("A.java", f"class A {{\n  /** {REAL} */\n\n  @Override\n  public void m() {{}}\n}}\n", []),
        ("a.go", f"// {REAL}\nfunc (s *T) F(a int) error {{\n}}\n", [("F", 2)]),
        ("a.rs", f"impl T {{\n    /// {REAL}\n    #[inline]\n    pub(crate) async fn f<'a>(&'a self) -> char {{ 'x' }}\n}}\n", [("f", 4)]),
        ("a.rb", f"# {REAL}\ndef self.ok?(x)\nend\n", [("ok?", 2)]),
        ("a.c", f"/* {REAL} */\nstatic char *\nf(int a)\n{{\n  if (g(a)) {{ }}\n}}\n", [("f", 3)]),
        ("a.go", "// f\nfunc f() {}\n\n// Resets the worker pool.\nfunc resetWorkerPool() {}\n\n// TODO: say what this does\nfunc g() {}\n\n// -----------------\nfunc h() {}\n", []),
        ("a.go", "// @param a\n// @return\nfunc f() {}\n//nolint:all because of the old style\nfunc g() {}\n", []),
        ("a.go", "// Dieser Baum ordnet alle Blätter.\nfunc f() {}\n", [("f", 2)]),
        ("a.go", "// Native suffixes mark each expired marker.\nfunc f() {}\n", [("f", 2)]),
        ("a.txt", f"// {REAL}\nfunc f() {{}}\n", []),
        ("a.go", "", []),
        ("a.go", None, []),
    ],
)
def test_documented(path, text, want):
    found = docpairs.file_functions(path, None, text)
    assert sorted((r[0], r[1]) for r in found if r[5]) == want


def test_pairs_join_declarations(spark):
    files = [
        ("r/s.h", None, f"/** {REAL} */\nint f(int a, char *b);\n/** Counts the other kind of things here. */\nint f(long a);\n/** f */\nint g(void);\n"),
        ("r/s.c", None, "int f( int a, char *b ) {\n  return 1;\n}\n\nint f(long a) {\n  return 2;\n}\n\nint g(void) {\n  return 3;\n}\n"),
        ("q/s.c", None, "int f(int a, char *b) {\n  return 1;\n}\n"),
    ] * 2
    df = spark.createDataFrame([(*r, "x") for r in files], "file_path string, language string, content string, doc string")
    got = {(r.file_path, r.line_start): (r.doc, r.doc_path, r.code) for r in docpairs.code_doc_pairs(df).collect()}
    assert set(got) == {("r/s.c", 1), ("r/s.c", 5)}
    assert got["r/s.c", 1] == (REAL, "r/s.h", "int f( int a, char *b ) {\n  return 1;\n}")
    assert got["r/s.c", 5][0].startswith("Counts the other")


PAIRED = [
    # A header in another folder; names of parameters differ or are missing.
    ({"r/include/x.h": f"/** {REAL} */\nint f(int, const char*, void (*)(int));\n", "r/src/x.c": "int f(int count, char const *s, void (*done)(int code)) {\n  return 1;\n}\n"}, {("r/src/x.c", "f"): "r/include/x.h"}),
    ({"r/include/x.h": f"/** {REAL} */\nint f(int n);\n", "r/src/x.c": "int f(long n) {\n  return 1;\n}\n", "q/x.c": "int f(int n) {\n  return 1;\n}\n"}, {}),
    # The declaration of the same folder comes first.
    ({"r/a/x.h": f"/** {REAL} */\nint f(void);\n", "r/b/x.h": f"/** {REAL} */\nint f();\n", "r/b/x.c": "int f(void) {\n  return 1;\n}\n", "r/c/x.c": "int f() {\n  return 1;\n}\n"}, {("r/b/x.c", "f"): "r/b/x.h", ("r/c/x.c", "f"): "r/a/x.h"}),
    # Interfaces, also through another type.
    ({"r/i/I.java": f"interface I {{\n  /** {REAL} */\n  int m(int a, java.util.List<String> b);\n}}\n", "r/c/C.java": "class B extends C {\n  public int m(int x, List<String> y) {\n    return 1;\n  }\n}\nclass C implements I {\n  public int m(final int x, List<String> y) {\n    return 1;\n  }\n}\nclass D {\n  public int m(int x, List<String> y) {\n    return 1;\n  }\n}\n"}, {("r/c/C.java", "m"): "r/i/I.java"}),
    ({"r/t.rs": f"pub trait Store<T> {{\n    /// {REAL}\n    fn put(&self, key: &'a str, n: [u8; 4]) -> [u8; 4];\n}}\n", "r/m/s.rs": "impl<T: Fn(u8) -> u8> crate::Store<T> for Disk<T> {\n    fn put(&self, k: &str, bytes: [u8; 4]) -> [u8; 4] {\n        bytes\n    }\n}\n"}, {("r/m/s.rs", "put"): "r/t.rs"}),
    ({"r/i.ts": f"export interface Store {{\n  /** {REAL} */\n  put(key: string, n?: number): void;\n}}\n", "r/m/s.ts": "class Disk implements Store {\n  put(k: string, count: number): void {\n    call(k);\n  }\n}\n"}, {("r/m/s.ts", "put"): "r/i.ts"}),
    # Members of a C++ class, defined outside it or in a class below it.
    ({"r/include/f.hpp": f"namespace n {{\nclass Foo : public Base {{\n public:\n  /** {REAL} */\n  int bar(int, const std::string &);\n  /** {REAL} */\n  explicit Foo(int a);\n  /** {REAL} */\n  virtual int pure(int a) const = 0;\n}};\n}}\n", "r/src/f.cpp": "n::Foo::Foo(int b) : b_(b) {\n  use(b);\n  Foo other(1);\n}\nint n::Foo::bar(int count, const std::string &s) {\n  return 1;\n}\nclass Low : public n::Foo {\n  int pure(int z) const override {\n    return z;\n  }\n};\n"}, {("r/src/f.cpp", x): "r/include/f.hpp" for x in ("bar", "Foo", "pure")}),
]


@pytest.mark.parametrize("depth", [1, 3, 4, 9])
def test_parentheses_to_any_depth(depth):
    deep = "d" + "(" * depth + ")" * depth
    text = f"class A {{\n  /** {REAL} */\n  @Named(x)\n  public int m(@A(b = {deep}) int a, long b) {{\n    return 1;\n  }}\n  int open = g(;\n  /** {REAL} */\n  void n() {{\n  }}\n}}\n"
    assert [(r[0], r[1]) for r in docpairs.file_functions("A.java", None, text) if r[5]] == [("m", 4), ("n", 9)]
    assert docpairs._shallow("f(a(b(c(d)e)))") == "f(a(b(c[d]e)))" and docpairs._shallow(")((") == ")(("


def test_pairs_through_many_types(spark, rows):
    chain = "".join(f"class C{i} extends C{i + 1} {{\n  public int m(int a) {{\n    return {i};\n  }}\n}}\n" for i in range(12)) + "class C12 extends C0 implements I {}\n"
    files = [("r/I.java", None, f"interface I {{\n  /** {REAL} */\n  int m(int x);\n}}\n"), ("r/c/C.java", None, chain)]
    df = spark.createDataFrame(files, "file_path string, language string, content string")
    got = docpairs.code_doc_pairs(df).collect()
    assert sorted(r.line_start for r in got) == [2 + 5 * i for i in range(12)] and {r.doc_path for r in got} == {"r/I.java"}
    assert rows(docpairs.documented_functions(df)) == [("r/I.java", "m", 3)]
    assert docpairs.code_doc_pairs(df.where("false")).count() == 0


@pytest.mark.parametrize("k", range(len(PAIRED)))
def test_pairs_across_folders_and_types(spark, k):
    texts, want = PAIRED[k]
    df = spark.createDataFrame([(p, None, t) for p, t in texts.items()], "file_path string, language string, content string")
    got = [r for r in docpairs.code_doc_pairs(df).collect()]
    assert {(r.file_path, r.name): r.doc_path for r in got if r.file_path != r.doc_path} == want
    assert all(r.doc == REAL for r in got)
    assert k != 3 or sorted(r.line_start for r in got) == [2, 7]


# Packing


def test_packer_best_fit():
    p = packing.Packer(10, open_bins=2)
    assert p.place(7, "a") is None and p.place(5, "b") is None
    assert p.place(3, "c") == ["a", "c"]  # fills the fuller one
    assert p.place(8, "d") is None
    assert p.place(9, "e") == ["d"]  # too many open: the fullest closes
    assert sorted((r, b) for r, b in p.rest()) == [(1, ["e"]), (5, ["b"])]
    q = packing.Packer(10, open_bins=1)
    q.place(4, "a")
    assert q.place(10, "b") == ["a"] and q.late() == ["b"] and q.late() is None


@pytest.mark.parametrize("capacity", [1, 7, 64, 1000])
def test_pack_keeps_everything(spark, capacity):
    ensure_checkpoint_dir(spark)
    rng = random.Random(capacity)
    sizes = [(i % 290, rng.choice([0, 1, 3, 7, 20, 63, 64, 65, 150, 2500])) for i in range(300)] + [(999, None)]
    df = spark.createDataFrame([(*s, 1) for s in sizes], "doc_id long, n_tokens long, container int").repartition(3)
    got = packing.pack(df, [(4, capacity)], open_bins=5).collect()
    room, seen = Counter(), Counter()
    for r in got:
        assert r.pack_id == 4 and (r.container is None) == (r.n_tokens == 0)
        seen[r.doc_id] += r.n_tokens
        if r.container:
            room[r.container] += r.n_tokens
            assert r.first_token == r.piece * capacity
    want = Counter()
    for i, n in sizes:
        want[i] += n or 0
    assert seen == want
    assert max(room.values()) <= capacity
    for r in got:  # only items beyond the capacity are cut
        assert r.piece == 0 or max(n or 0 for i, n in sizes if i == r.doc_id) > capacity


def test_pack_edges(spark):
    ensure_checkpoint_dir(spark)
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long"), [(1, 5)]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long"), [(1, 0)])


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (None, "x")], "doc_id long, text string")
    got = dict(tuple(r) for r in packing.token_counts(df).collect())
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] > 1 and len(got) == 4


# Leakage


def brute_passage(item, doc):
    best = 0
    for shift in range(-len(item), len(doc)):
        a, b = max(0, -shift), min(len(item), len(doc) - shift)
        same = [item[k] == doc[k + shift] for k in range(a, b)]
        for i in range(len(same)):
            for j in range(i + 20, len(same) + 1):
                if (j - i) >= 10 * (j - i - sum(same[i:j])):
                    best = max(best, j - i)
    return best


def test_longest_passage_random():
    rng = np.random.default_rng(5)
    for _ in range(300):
        same = rng.random(rng.integers(1, 60)) < rng.choice([0.7, 0.85, 0.93])
        want = max([j - i for i in range(len(same)) for j in range(i + 20, len(same) + 1) if 10 * (~same[i:j]).sum() <= j - i] or [0])
        i, j = leakage.longest_passage(same)
        assert j - i == want
        assert j == i or 10 * (~same[i:j]).sum() <= j - i


def test_leaks(spark, rows):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "po", "ra") for b in ("ber", "dan", "fix", "gol", "hum", "jet")]
    item = lambda n: [rng.choice(words) for _ in range(n)]
    a, b = item(40), item(30)
    shared = a[5:30]
    items = [(1, " ".join(a)), (2, "In 5 ms " + " ".join(b)), (3, " ".join(["Other", "words", *shared])), (4, None), (5, ""), (6, "short one")]
    off = lambda w, *at: [("zz" if k in at else x) for k, x in enumerate(w)]
    docs = {
        1: " ".join(a[:20]),
        2: " ".join(a[:19]),
        3: " ".join(off(a[:20], 3, 11)),
        4: " ".join(off(a[:20], 3, 8, 15)),
        5: "Intro. <b>" + "</b>,\n **".join(w.upper() for w in a[8:32]) + "&amp; 17 end",
        6: " ".join(w[:2] + "​" + w[2:] for w in b[:22]),
        7: " ".join(off(b, 5, 15, 25)),
        8: None,
        9: "",
        10: "word " * 5000,
        11: " ".join(w + " 12" for w in shared),
    }
    df = spark.createDataFrame([(i, t, 1) for i, t in docs.items()] + [(1, docs[1], 1)], "doc_id long, text string, item_id int")
    got = set(rows(leakage.leaks(df, spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "item_id")))
    plain = lambda t: leakage.canonical(t or "")[0]
    want = {(d, i) for d, t in docs.items() if d != 10 for i, x in items if brute_passage(plain(x), plain(t)) >= 20}
    assert got == want
    assert {(1, 1), (3, 1), (5, 1), (5, 3), (6, 2), (7, 2), (11, 1), (11, 3)} <= got and (2, 1) not in got and (4, 1) not in got


def test_leaks_blocks_and_slots(spark, rows, monkeypatch):
    text = "when the pump takes {} litres in {} hours and the pipe lets {} litres out how long will the tank be full of water again"
    items = [(1, text.format(4, 7, 4)), (2, text.replace("pump", "hose").replace("pipe", "leak").replace("water", "oil").format(1, 2, 3))]
    docs = [(1, text.format(9, 7, 9)), (2, text.format(9, 7, 5)), (3, text.format(4, 7, 4))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = rows(leakage.leaks(d, i))
    assert {(r[0], r[5]) for r in whole if r[1] == 1} == {(1, True), (2, False), (3, False)}
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 10)
    assert rows(leakage.leaks(d, i)) == whole
    assert leakage.leaks(d, i.where("false")).count() == 0


def test_leaks_with_other_names(spark, rows, monkeypatch):
    text = "the worker calls {a} before the queue opens and {b} after it closes so that {a} can drain what {b} left behind in the old and dusty store room"
    items = spark.createDataFrame([(1, text.format(a="loadRows", b="save_rows"))], "item_id long, text string")
    docs = [(1, text.format(a="readLines", b="put_lines")), (2, text.format(a="readLines", b="put_lines").replace("readLines can", "otherThing can")), (3, text.format(a="loadRows", b="SAVE_ROWS")), (4, text.format(a="spoon", b="fork"))]
    docs += [(5, text.format(a="readLines", b="put_lines").replace("worker", "x").replace("queue", "y").replace("dusty", "z").replace("drain", "w").replace("behind", "v"))]
    docs += [(6, "Intro " + text.format(a="loadRows", b="save_rows").replace("queue", '<a href="' + "x" * 900 + '" title=\'long\'>queue</a>').replace("closes", "closes <br/>"))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r[0]: r for r in rows(leakage.leaks(d, items))}
    assert {k: (r[3] * 10 <= r[2], r[5]) for k, r in got.items()} == {1: (False, True), 3: (True, False), 6: (True, False)}
    assert got[1][2] == len(text.split()) and got[1][4] == 4 and got[6][2] == len(text.split())
    assert leakage.canonical("if a <b and c then d > e and 1 <2 <x y z " + "w " * 200 + ">")[0][:4] == ["if", "a", "e", "and"]


# Repetition


def test_features_are_hashed_ngrams():
    rng = random.Random(9)
    texts = ["", "one two", "A b c d e a B c d e", "x1y2z3 " * 40, "ü" * 9] + [" ".join(rng.choice("abcdefg") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    x = repetition.features(texts)
    assert x.shape == (len(texts), repetition.N_FEATURES) and np.isfinite(x).all()
    cells = x.reshape(len(texts), -1, 2, repetition.BUCKETS).sum(3) / repetition.BUCKETS
    for i, t in enumerate(texts):
        words = repetition.WORDS.findall(t.lower())
        for j, order in enumerate(repetition.WORD_ORDERS):
            grams = [tuple(words[k : k + order]) for k in range(len(words) - order + 1)]
            want = 1 - len(set(grams)) / len(grams) if grams else 0
            assert cells[i, j, 1] == pytest.approx(want) and cells[i, j].sum() == pytest.approx(float(bool(grams)))
        raw = t.lower().encode()
        for j, order in enumerate(repetition.CHAR_ORDERS, len(repetition.WORD_ORDERS)):
            grams = [raw[k : k + order] for k in range(len(raw) - order + 1)]
            want = 1 - len(set(grams)) / len(grams) if grams else 0
            # Two runs may meet in one place of the table.
            assert want <= cells[i, j, 1] + 1e-9 and (len(grams) < 50 or cells[i, j, 1] < want + 0.15)
    # A text has the same features in any batch.
    assert np.array_equal(x[3:9], repetition.features(texts[3:9]))
    assert np.array_equal(x[7], repetition.features([texts[7]])[0])
    assert repetition.exact_shares(texts)[2] == 0.5


def test_repetitive(spark, rows):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    plain = [" ".join(word() for _ in range(120)) for _ in range(150)]
    spam = [" ".join([" ".join(word() for _ in range(12))] * 9) for _ in range(40)]
    edge = []
    for k in range(20, 61, 2):  # k of 100 words repeat one earlier run after another, five words at a time
        base = [word() for _ in range(100 - k)]
        edge.append(" ".join(base + [w for i in range(0, k, 5) for w in base[i : i + min(5, k - i)]]))
    docs = list(enumerate(plain + spam + edge)) + [(9000, None), (9001, ""), (9002, "a b")]
    df = spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, share double")
    model = repetition.fit_model(df)
    got = {r[0] for r in rows(repetition.repetitive(df, model))}
    want = {i for i, t in docs if t and repetition.exact_shares([t])[0] >= repetition.SHARE}
    assert got == want and 150 < len(docs) and len(want) > 40
    assert (model.weights * repetition.SIGNS >= 0).all()
    # Held-out accuracy of the classifier alone, at even odds.
    p = model.probability(repetition.features(plain + spam))
    assert ((p >= 0.5) == (np.arange(190) >= 150)).mean() > 0.97


def test_model_without_both_classes_checks_everything(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    model = repetition.fit_model(df)
    assert model.probability(repetition.features(["x"]))[0] >= repetition.CANDIDATE
    assert repetition.fit_model(df.where("false")).probability(np.zeros((1, repetition.N_FEATURES)))[0] == 0.5


def test_shares_empty(spark):
    df = spark.createDataFrame([(1, None), (2, "Ünï ünÏ")], "doc_id long, text string")
    assert [tuple(r) for r in repetition.repetition_shares(df).orderBy("doc_id").collect()] == [(1, 0, 0.0), (2, 2, 0.0)]
