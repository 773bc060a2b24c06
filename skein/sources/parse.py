"""Source text to symbols: the one place where Python looks into files.

Python goes through its syntax tree, every other language through a
declarative rule table: which keywords open which kind of symbol, how blocks
end, where visibility and receivers stand.  ``register_language`` adds one.
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from skein.sources.languages import language_of
from skein.sources.tables import spread

SCHEMA = (
    "file_path string, sym_ord int, name string, type string, line_start int, line_end int, signature string, docstring string, "
    "parent string, dependencies array<string>, decorators array<string>, truncated boolean, source string, visibility string, modifiers array<string>, mixins array<string>, return_type string"
)
MAX_LINES, MAX_CALLS, SIGNATURE, DOC_LINES = 500, 50, 100, 3
ENUM_BASES = frozenset({"Enum", "IntEnum", "StrEnum", "Flag", "IntFlag"})
_ID = r"[A-Za-z_$][\w$]*+"


@dataclass(frozen=True)
class LanguageSpec:
    """Rules of one language.

    ``kinds`` maps an opening keyword to the kind it declares, ``functions``
    are keywords in front of a function's name, ``typed`` says that functions
    are declared as ``type name(...) {``, ``bare`` that methods stand as
    ``name(...) {`` inside a container.  ``private`` tells from a name and the
    text before it whether the symbol is private.
    """

    name: str
    kinds: dict[str, str] = field(default_factory=dict)
    functions: tuple[str, ...] = ()
    modifiers: tuple[str, ...] = ()
    typed: bool = False
    bare: bool = False
    block: str = "brace"
    comment: str = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
    strings: str = r'"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?'
    values: str | None = None
    private: Callable[[str, str], bool] = lambda name, before: bool(re.search(r"\bprivate\b", before))
    constants: str | None = None
    returns: str | None = None
    mixins: str | None = None
    #: Further declarations: kind, pattern (its last group the name, ``owner`` the type it belongs to) and where it may
    #: stand: ``own`` (named as the type around it), ``member``, ``outer`` (in no function) or ``any``.
    more: tuple[tuple[str, str, str], ...] = ()
    #: Blocks whose lines declare something each: what opens one, kind, and the names of a line.
    lists: tuple[tuple[str, str, str], ...] = ()
    #: How documentation begins; other comments above a declaration are none.
    doc: str = ""
    #: Calls besides ``name(``.
    calls: str | None = None


_JAVAISH = ("public", "private", "protected", "internal", "static", "final", "abstract", "sealed", "partial", "virtual", "override", "async", "readonly", "open", "data", "inner", "suspend", "default", "synchronized", "export", "declare", "const", "unsafe", "pub", "extern", "inline", "mutating", "required", "convenience", "fileprivate", "indirect", "annotation", "value")
_ARROW = rf"(?:export\s+)?(?:const|let|var)\s+({_ID})\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:function\b|\((?:[^()]|\([^()]*\))*\)\s*(?::[^=\n{{]+)?=>|{_ID}\s*=>)"
_JS_STRINGS = r'"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?|`(?:\\.|[^`\\])*`?'

_ARGS = r"\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\)"
_ANY = rf"(?:(?:{'|'.join(_JAVAISH)})\s++)*+"
_PROTOTYPE = rf"^[ \t]*+(?!(?:return|new|else|throw|case|goto|typedef|using|delete|if|while|for|switch)\b)[A-Za-z_][\w:<>,\[\]&* ]*?[\s*&]({_ID})\s*{_ARGS}\s*(?:const\s*|noexcept\s*|override\s*|=\s*(?:0|default|delete)\s*)*(?=;)"

SPECS: dict[str, LanguageSpec] = {}


def register_language(spec: LanguageSpec) -> None:
    """Add a language, or replace its rules."""
    SPECS[spec.name] = spec


#: Analysers by language, tried in order before the syntax tree or the rules.
ANALYZERS: dict[str, list[Callable[[str], list[dict] | None]]] = {}


def register_analyzer(language: str, analyse: Callable[[str], list[dict] | None]) -> None:
    """Put an analyser (a grammar's, say) before those of a language; where it gives None or fails, the next one is asked."""
    ANALYZERS.setdefault(language, []).insert(0, analyse)


for _spec in (
    LanguageSpec("javascript", {"class": "class"}, ("function", "function*"), _JAVAISH, bare=True, strings=_JS_STRINGS, values=_ARROW, private=lambda n, b: n.startswith("#")),
    LanguageSpec("typescript", {"class": "class", "interface": "interface", "type": "type", "enum": "enum", "namespace": "namespace"}, ("function", "function*"), _JAVAISH, bare=True, strings=_JS_STRINGS, values=_ARROW, returns=r"\)\s*:\s*([^{=]+?)\s*(?:\{|=>|$)"),
    LanguageSpec("java", {"class": "class", "interface": "interface", "enum": "enum", "record": "class", "@interface": "interface"}, (), _JAVAISH, typed=True, doc="/**", more=(("constructor", rf"^[ \t]++{_ANY}({_ID})\s*{_ARGS}\s*(?:throws\s+[\w., ]+)?(?=\{{)", "own"), ("method", rf"^[ \t]++{_ANY}(?!(?:return|new|throw|else|case)\b)[A-Za-z_][\w.<>,\[\]? ]*?\s({_ID})\s*{_ARGS}\s*(?:throws\s+[\w., ]+)?(?=;)", "outer"))),
    LanguageSpec("csharp", {"class": "class", "interface": "interface", "enum": "enum", "struct": "struct", "record": "class", "namespace": "namespace", "delegate": "type"}, (), _JAVAISH, typed=True, comment=r"//[^\n]*|/\*.*?(?:\*/|\Z)|^[ \t]*#[^\n]*", doc="///", more=(("constructor", rf"^[ \t]++{_ANY}({_ID})\s*{_ARGS}\s*(?::\s*(?:base|this)\s*{_ARGS}\s*)?(?=\{{|=>)", "own"), ("method", rf"^[ \t]++{_ANY}(?!(?:return|new|throw|else|case|await)\b)[A-Za-z_][\w.<>,\[\]? ]*?\s({_ID})\s*{_ARGS}\s*(?=;)", "outer"))),
    LanguageSpec("go", {}, ("func",), (), lists=((r"^(?:const)\s*\(", "const", r"^[ \t]+([A-Za-z_]\w*(?:[ \t]*,[ \t]*[A-Za-z_]\w*)*)[ \t]*(?:=|$|[\w.*\[\]]+[ \t]*(?:=|$))"), (r"^(?:var)\s*\(", "variable", r"^[ \t]+([A-Za-z_]\w*(?:[ \t]*,[ \t]*[A-Za-z_]\w*)*)[ \t]+\S"), (r"^type\s+(\w+)(?:\[[^\]]*\])?\s+interface\s*\{", "method", r"^[ \t]+([A-Za-z_]\w*)\(")), strings=r'"(?:\\.|[^"\\\n])*"?|`[^`]*`?|\'(?:\\.|[^\'\\\n])*\'', private=lambda n, b: n[:1].islower(), returns=r"\)\s*((?:\([^()]*\)|[\w*\[\].]+(?:\[[^\]]*\])?[\w*.]*))\s*(?:\{|$)"),
    LanguageSpec("rust", {"struct": "struct", "enum": "enum", "trait": "trait", "impl": "impl", "mod": "module", "type": "type", "union": "union"}, ("fn",), _JAVAISH, strings=r'r(?P<h>#*)"(?s:.*?)"(?P=h)|"(?:\\.|[^"\\])*"?|\'(?:\\[^\n]+?|[^\'\\\n])\'', private=lambda n, b: "pub" not in b, returns=r"->\s*([^{;]+?)\s*(?:where\b|\{|;|$)"),
    LanguageSpec("c", {"struct": "struct", "enum": "enum", "union": "union"}, (), ("typedef", "static", "extern", "inline", "const"), typed=True, more=(("function", _PROTOTYPE, "outer"), ("type", rf"^typedef\b[^;{{}}]*?\b({_ID})\s*;", "outer"), ("type", rf"^\}}\s*({_ID})\s*;", "outer"))),
    LanguageSpec("cpp", {"class": "class", "struct": "struct", "enum": "enum", "union": "union", "namespace": "namespace"}, (), ("typedef", "static", "extern", "inline", "const", "virtual", "template", "explicit"), typed=True, more=(("function", _PROTOTYPE, "outer"), ("method", rf"^[ \t]++(?:explicit\s+|inline\s+|virtual\s+|constexpr\s+)*+(~?{_ID})\s*{_ARGS}[^;{{}}()]*(?:\([^()]*\)[^;{{}}()]*)*(?=[;{{])", "own"), ("method", rf"^(?:\w+::)*(?P<owner>\w+)::(~?{_ID})\s*{_ARGS}[^;{{}}]*(?=\{{)", "outer"), ("type", rf"^[ \t]*using\s+({_ID})\s*=", "outer"), ("type", rf"^typedef\b[^;{{}}]*?\b({_ID})\s*;", "outer"))),
    LanguageSpec("ruby", {"class": "class", "module": "module"}, ("def",), (), block="end", comment=r"\#[^\n]*", doc="#", calls=r"(?:\.|&\.)([a-z_]\w*[?!]?)|^[ \t]*([a-z_]\w*[?!]?)(?=[ \t]*$|[ \t]+[:@\"'\[\w])", constants=r"^[ \t]*([A-Z][A-Z0-9_]*)\s*=[^=~]", mixins=r"^\s*(?:include|extend|prepend)\s+([\w:, ]+)"),
    LanguageSpec("php", {"class": "class", "interface": "interface", "trait": "trait", "enum": "enum", "namespace": "namespace"}, ("function",), _JAVAISH, comment=r"//[^\n]*|\#(?!\[)[^\n]*|/\*.*?(?:\*/|\Z)"),
    LanguageSpec("swift", {"class": "class", "struct": "struct", "enum": "enum", "extension": "extension", "protocol": "protocol", "typealias": "type_alias", "actor": "class"}, ("func",), _JAVAISH, doc="///", calls=r"\.([A-Za-z_]\w*)\s*\{", more=(("constructor", r"^[ \t]++(?:(?:public|private|internal|open|fileprivate|required|convenience|override)\s++)*+(init)[?!]?\s*(?:<[^>\n]*>)?\s*(?=\()", "member"),), returns=r"->\s*([^{]+?)\s*(?:where\b|\{|$)"),
    LanguageSpec("kotlin", {"class": "class", "interface": "interface", "object": "object", "typealias": "type_alias"}, ("fun",), _JAVAISH, doc="/**", calls=r"\.([A-Za-z_]\w*)\s*\{", more=(("constructor", r"^[ \t]++(?:(?:public|private|protected|internal)\s++)*+(constructor)\s*(?=\()", "member"),), returns=r"\)\s*:\s*([^{=]+?)\s*(?:\{|=|$)"),
    LanguageSpec("dart", {"class": "class", "mixin": "mixin", "enum": "enum", "extension": "extension", "typedef": "type_alias"}, (), _JAVAISH, typed=True, doc="///", more=(
        ("constructor", rf"^[ \t]++(?:(?:const|factory|external)\s++)*+(?P<owner>{_ID})(?:\.({_ID}))?\s*{_ARGS}\s*(?=[{{;:]|=>|=)", "own"), ("method", rf"^[ \t]++(?:static\s+)?(?:[A-Za-z_][\w<>?, ]*?\s+)?(?:get|set)\s+({_ID})\s*(?=\{{|=>|async|\()", "member"),
        ("method", rf"^[ \t]++(?:static\s+)?(?!(?:return|new|throw|await|const)\b)[A-Za-z_][\w<>?, ]*?\s({_ID})\s*{_ARGS}\s*(?=;)", "outer"), ("const", rf"^[ \t]*static\s+(?:final|const)\s+(?:[\w<>?, ]+?\s+)?({_ID})\s*=", "outer"),
    ), private=lambda n, b: n.startswith("_")),
):
    register_language(_spec)

_NOT_NAMES = frozenset("if for while switch catch return else do new throw sizeof when match with function await yield assert synchronized using lock foreach elif except typeof super this".split())
_CONTAINERS = frozenset({"class", "struct", "interface", "impl", "trait", "module", "enum", "mixin", "extension", "object", "protocol", "union", "namespace"})
_NO_CALLS = _NOT_NAMES | frozenset("func fn fun def end then unless until begin rescue ensure self nil true false yield raise and or not in base".split())
_CALL = re.compile(rf"\b({_ID})\s*[!?]?\(")


def _symbol(**x) -> dict:
    return {"docstring": None, "parent": None, "dependencies": [], "decorators": [], "truncated": False, "visibility": None, "modifiers": None, "mixins": None, "return_type": None, **x}


def _short_doc(text: str | None) -> str | None:
    if not text:
        return None
    lines = [x.rstrip() for x in text.strip().splitlines()]
    return "\n".join(lines[:DOC_LINES]) + ("..." if len(lines) > DOC_LINES else "") if lines else None


def parse_python(text: str) -> list[dict]:
    """Symbols of a Python module in order; none if it does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    lines = text.splitlines()
    out: list[dict] = []

    def callee(node: ast.AST) -> str | None:
        return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None

    def calls(node: ast.FunctionDef | ast.AsyncFunctionDef) -> list[str]:
        """Names called in the body, the decorators and the defaults, not in nested definitions."""
        found, stack = set(), [*node.body, *node.decorator_list, *node.args.defaults, *[d for d in node.args.kw_defaults if d]]
        while stack:
            at = stack.pop()
            if isinstance(at, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            if isinstance(at, ast.Call) and (name := callee(at.func)):
                found.add(name)
            stack.extend(ast.iter_child_nodes(at))
        return sorted(found)

    def visit(body: list, cls: str | None, func: str | None) -> None:
        for node in body:
            common = {"line_start": getattr(node, "lineno", 0), "line_end": getattr(node, "end_lineno", 0), "source": "ast"}
            if isinstance(node, ast.ClassDef):
                bases = [ast.unparse(b) for b in node.bases]
                kind = "enum" if any(b.rsplit(".", 1)[-1] in ENUM_BASES for b in bases) else "class"
                signature = f"class {node.name}" + (f"({', '.join(bases)})" if bases else "")
                out.append(_symbol(name=node.name, type=kind, signature=signature, docstring=_short_doc(ast.get_docstring(node)), parent=cls or func, decorators=[ast.unparse(d) for d in node.decorator_list], **common))
                visit(node.body, node.name, None)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                args = ", ".join(a.arg + (f": {ast.unparse(a.annotation)}" if a.annotation else "") for a in node.args.args)
                prefix = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
                returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
                out.append(_symbol(name=node.name, type="method" if cls else "function", signature=f"{prefix} {node.name}({args}){returns}", docstring=_short_doc(ast.get_docstring(node)), parent=cls or func, dependencies=calls(node), decorators=[ast.unparse(d) for d in node.decorator_list], **common))
                visit(node.body, None, node.name)
            elif isinstance(node, (ast.Assign, ast.AnnAssign)) and body is tree.body:
                for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if isinstance(target, ast.Name) and re.fullmatch(r"[A-Z][A-Z0-9_]*", target.id):
                        out.append(_symbol(name=target.id, type="constant", signature=lines[node.lineno - 1].strip()[:SIGNATURE], **common))
            else:
                for part in ("body", "orelse", "finalbody", "handlers"):
                    inner = getattr(node, part, None)
                    if isinstance(inner, list):
                        visit([s for h in inner for s in (h.body if isinstance(h, ast.ExceptHandler) else [h])], cls, func)

    visit(tree.body, None, None)
    return out


def _rules(spec: LanguageSpec) -> list[tuple[str, re.Pattern]]:
    mods = rf"(?:(?:{'|'.join(map(re.escape, spec.modifiers))})(?:\([^)]*\))?\s++)*+" if spec.modifiers else ""
    args = r"\((?:[^()]++|\([^()]*+\))*+\)"
    rules = [(kind, re.compile(rf"^[ \t]*+{mods}{re.escape(word)}(?:<[^>\n]*>)?\s+(?:class\s+)?(?:[\w<>]+\s+for\s+)?({_ID})", re.M)) for word, kind in spec.kinds.items()]
    if spec.name == "go":
        rules += [("method", re.compile(rf"^func\s+\(\s*(?:\w+\s+)?\*?(?P<owner>\w+)[^)]*\)\s*({_ID})", re.M))]
        rules += [(kind, re.compile(rf"^type\s+({_ID})(?:\[[^\]]*\])?\s+{word}", re.M)) for word, kind in (("struct\\b", "struct"), ("interface\\b", "interface"), ("(?!struct\\b|interface\\b)", "type_alias"))]
        rules += [("const", re.compile(rf"^const\s+({_ID})", re.M)), ("variable", re.compile(rf"^var\s+({_ID})", re.M))]
    for word in spec.functions:
        rules.append(("function", re.compile(rf"^[ \t]*+{mods}(?:async\s+)?{re.escape(word)}\s+(?:<[^>\n]*>\s*)?(?:self\.|[\w<>?]+\.)?({_ID}[?!=]?)(?=\s*(?:[<(\[]|$)|\s)", re.M)))
    if spec.typed:
        rules.append(("function", re.compile(rf"^[ \t]*+{mods}(?:<[^>\n]*>\s*)?(?!(?:return|new|else|throw|case|goto|typedef)\b)(?:[A-Za-z_][\w:<>,\[\]?&* ]*?[\s*&]+)(?:(?:\w+::)*(?P<owner>\w+)::)?(~?{_ID})\s*{args}\s*(?:const\s*|noexcept\s*|override\s*|async\*?\s*|throws\s+[\w., ]+)*(?=\{{|=>)", re.M)))
    if spec.bare:
        rules.append(("method", re.compile(rf"^[ \t]++{mods}(?:get\s+|set\s+|\*\s*)?(#?{_ID})\s*(?:<[^>\n(]*>)?{args}\s*(?::[^{{;=\n]+)?(?=\{{)", re.M)))
    if spec.values:
        rules.append(("arrow", re.compile(rf"^[ \t]*+{spec.values}", re.M)))
    if spec.constants:
        rules.append(("constant", re.compile(spec.constants, re.M)))
    return rules


_COMPILED: dict[str, tuple] = {}


def _compiled(spec: LanguageSpec) -> tuple:
    key = _COMPILED.get(spec.name)
    if key is None or key[0] is not spec:
        key = _COMPILED[spec.name] = (spec, re.compile(rf"({spec.comment})|{spec.strings}", re.S | re.M), _rules(spec))
    return key


_OPEN_END = re.compile(r"^\s*(?:(?:class|module|def|begin|case|if|unless|while|until|for)\b)|\bdo\b(?:\s*\|[^|]*\|)?\s*$")
_CLOSE_END = re.compile(r"^\s*end\b")


def _end(lines: list[str], first: int, block: str, most: int) -> tuple[int, bool]:
    """The last line of the block that opens on line ``first`` (from 0), and whether it was cut."""
    depth, seen = 0, False
    for i in range(first, len(lines)):
        if i > first + most:
            return first + most, True
        if block == "end":
            depth += len(_OPEN_END.findall(lines[i])) - bool(_CLOSE_END.match(lines[i]))
            if depth <= 0:
                return i, False
            continue
        for c in lines[i]:
            if c == "{":
                depth, seen = depth + 1, True
            elif c == "}":
                depth -= 1
        if seen and depth <= 0:
            return i, False
        if not seen and lines[i].rstrip().endswith(";"):
            return i, False
    return len(lines) - 1, False


def _members(spec: LanguageSpec, out: list[dict], lines: list[str]) -> None:
    """Return types, and where bodies say so: mixed-in modules, and members after a line that makes them private."""
    for s in out:
        if spec.returns and s["type"] in ("function", "method", "arrow") and (m := re.search(spec.returns, s["signature"] or "")):
            s["return_type"] = m[1].strip() or None
        if spec.block != "end" or s["type"] not in ("class", "module"):
            continue
        body = range(s["line_start"], s["line_end"])
        if spec.mixins:
            s["mixins"] = [x.strip() for i in body if (m := re.match(spec.mixins, lines[i])) for x in m[1].split(",")] or None
        inner = [(h["line_start"], h["line_end"]) for h in out if h is not s and h["type"] in ("class", "module") and s["line_start"] < h["line_start"] <= s["line_end"]]
        now = None
        members = {h["line_start"] - 1: h for h in out if h["type"] == "function"}
        for i in body:
            if any(a - 1 <= i < b for a, b in inner):
                continue
            if m := re.match(r"\s*(private|protected|public)\s*$", lines[i]):
                now = None if m[1] == "public" else m[1]
            elif i in members and now:
                members[i]["visibility"] = now


#: Class-body macros of Ruby that declare methods.
_RUBY_MACROS = {"attr_accessor": "attr", "attr_reader": "attr", "attr_writer": "attr", "scope": "scope", "delegate": "delegated", "define_method": "dynamic"} | {m: f"association:{m}" for m in ("belongs_to", "has_one", "has_many", "has_and_belongs_to_many")}
_MACRO = re.compile(rf"^[ \t]*({'|'.join(_RUBY_MACROS)})[ \t(]+((?::\w+[?!=]?|[^\n]*?)(?:[ \t]*,\s*[^\n]*)?)$", re.M)


def _ruby_macros(text: str) -> Iterator[tuple[int, str, str]]:
    """``(place, name, modifier)`` of the methods that macros of a class body declare."""
    for m in _MACRO.finditer(text):
        macro, rest = m[1], m[2]
        names = re.match(r"(?:[ \t]*:(\w+[?!=]?)\s*,?)+", rest)
        names = re.findall(r":(\w+[?!=]?)", names.group()) if names else []
        if macro not in ("attr_accessor", "attr_reader", "attr_writer", "delegate"):
            names = names[:1]
        front = ""
        if macro == "delegate" and (p := re.search(r"\bprefix:\s*:?(\w+)", rest)):
            to = re.search(r"\bto:\s*:?(\w+)", rest)
            front = f"{to[1] if to else ''}_" if p[1] == "true" else f"{p[1]}_"
        for name in names:
            yield m.start(1), front + name, _RUBY_MACROS[macro]


def _further(spec: LanguageSpec, plain: str, found: dict[tuple[int, str], dict], first_of: Callable[[int], int], add: Callable) -> None:
    """Declarations that depend on what stands around them."""
    at_lines = lambda kinds: [(s["line_start"], s["line_end"], s["name"]) for s in found.values() if s["type"] in kinds]
    holders, bodies = at_lines(_CONTAINERS), at_lines(("function", "method", "arrow"))

    def around(line: int) -> str | None:
        inside = [h for h in holders if h[0] < line <= h[1]]
        return max(inside)[2] if inside else None

    for kind, pattern, scope in spec.more:
        for m in re.compile(pattern, re.M).finditer(plain):
            owner = m.groupdict().get("owner")
            name = m.group(m.re.groups) or owner
            at = m.start(m.re.groups) if m.group(m.re.groups) else m.start("owner")
            line = first_of(at) + 1
            holder = around(line)
            if name in _NOT_NAMES or (line - 1, name) in found or any(a < line <= b for a, b, _ in bodies):
                continue
            if scope == "own" and (holder is None or holder != (owner or name.lstrip("~"))) or (scope == "member" and holder is None):
                continue
            add(kind if kind != "function" or holder is None else "method", name, m.start(), at, owner if scope == "outer" else holder, plain[m.end() : m.end() + 1] == ";" or kind in ("type", "const"))
    for opening, kind, names in spec.lists:
        for m in re.compile(opening, re.M).finditer(plain):
            close = plain.find("\n)" if m.group().endswith("(") else "\n}", m.end())
            for x in re.compile(names, re.M).finditer(plain, m.end(), close if close >= 0 else len(plain)):
                for n in re.finditer(r"\w+", x.group(1)):
                    add(kind, n.group(), x.start(), x.start(1) + n.start(), m.group(1) if m.re.groups else None, True)
    if spec.name == "ruby":
        for at, name, modifier in _ruby_macros(plain):
            line = first_of(at) + 1
            if around(line) and not any(a < line <= b for a, b, _ in bodies):
                add("method", name, at, at, around(line), True)["modifiers"] = [modifier]
    if spec.name == "dart":
        for a, b, name in at_lines(("enum",)):
            body = "\n".join(plain.split("\n")[a - 1 : b])
            start = plain.find(body)
            inner = re.compile(r"\{([^;}]*)").search(plain, start)
            if inner:
                flat = re.sub(_ARGS, lambda x: " " * len(x.group()), inner.group(1))
                for n in re.finditer(r"(?:^|,)\s*(\w+)", flat):
                    at = inner.start(1) + n.start(1)
                    add("enum_member", n.group(1), at, at, name, True)


def parse_text(text: str, spec: LanguageSpec, max_lines: int = MAX_LINES) -> list[dict]:
    """Symbols of a file by its language's rules, in order of their first line."""
    _, blanked, rules = _compiled(spec)
    comments: dict[int, str] = {}
    original = text.split("\n")

    def blank(m: re.Match) -> str:
        fill = " " if m.group(1) is not None else '"'
        return "".join(c if c == "\n" else fill for c in m.group())

    plain = blanked.sub(blank, text)
    lines = plain.split("\n")
    for i, line in enumerate(original):
        if line.strip() and not lines[i].strip():
            comments[i] = line.strip()
    starts = [0]
    for m in re.finditer("\n", plain):
        starts.append(m.end())
    found: dict[tuple[int, str], dict] = {}
    for rule, pattern in rules:
        for m in pattern.finditer(plain):
            kind = rule
            group = pattern.groups
            name = m.group(group)
            # Only forms without a keyword can be mistaken for a statement.
            if not name or (name in _NOT_NAMES and kind in ("method", "function") and (spec.typed or spec.bare)):
                continue
            first = bisect_right(starts, m.start(group)) - 1
            if (first, name) in found:
                continue
            last, cut = _end(lines, first, spec.block, max_lines) if kind not in ("constant", "const", "variable", "type_alias") else (first, False)
            owner = m.groupdict().get("owner")
            kind = "function" if kind == "arrow" and m.group().endswith("function") else kind
            before = plain[m.start() : m.start(group)]
            private = spec.private(name, before)
            found[first, name] = _symbol(
                name=name, type=kind, line_start=first + 1, line_end=last + 1, signature=original[first].strip().rstrip("{ ").rstrip()[:SIGNATURE],
                parent=owner, truncated=cut, source="rules", visibility="private" if private else None,
                modifiers=[w for w in re.findall(r"[\w#]+", before) if w in spec.modifiers] or None,
            )

    def add(kind: str, name: str, begin: int, at: int, owner: str | None, short: bool) -> dict:
        first = bisect_right(starts, at) - 1
        last, cut = (first, False) if short else _end(lines, first, spec.block, max_lines)
        private = spec.private(name, plain[begin:at])
        found[first, name] = _symbol(
            name=name, type=kind, line_start=first + 1, line_end=last + 1, signature=original[first].strip().rstrip("{ ").rstrip()[:SIGNATURE],
            parent=owner, truncated=cut, source="rules", visibility="private" if private else None, modifiers=[w for w in re.findall(r"[\w#]+", plain[begin:at]) if w in spec.modifiers or w in ("get", "set")] or None,
        )
        return found[first, name]

    _further(spec, plain, found, lambda at: bisect_right(starts, at) - 1, add)
    out = [found[k] for k in sorted(found, key=lambda k: k[0])]
    _members(spec, out, lines)
    holders = [s for s in out if s["type"] in _CONTAINERS]
    for s in out:
        if s["parent"] is None:
            inside = [h for h in holders if h is not s and h["line_start"] < s["line_start"] and s["line_end"] <= h["line_end"]]
            if inside:
                s["parent"] = max(inside, key=lambda h: h["line_start"])["name"]
        if s["type"] == "function" and s["parent"] is not None:
            s["type"] = "method"
        doc, i = [], s["line_start"] - 2
        while i >= 0 and re.match(r"\s*(?:@|#\[)", lines[i]) and lines[i].strip():
            i -= 1
        while i in comments and (spec.doc in ("", "/**") or comments[i].startswith(spec.doc)):
            doc.append(re.sub(r"^(?:/\*+|//[/!]*|\*+/?|\#+)\s?|\s*\*+/$", "", comments[i]).strip())
            i -= 1
        if spec.doc == "/**" and doc and not comments[i + 1].startswith("/**"):
            doc = []
        s["docstring"] = _short_doc("\n".join(reversed(doc))) if doc else None
        if s["type"] in ("function", "method", "arrow", "constructor") and s["line_end"] >= s["line_start"]:
            body = "\n".join(lines[s["line_start"] - 1 : s["line_end"]])
            called = set(_CALL.findall(body))
            if spec.calls:
                below = body.partition("\n")[2] if spec.block == "end" else body
                called |= {c for m in re.finditer(spec.calls, below, re.M) for c in m.groups() if c}
            s["dependencies"] = sorted({c for c in called if c not in _NO_CALLS and c != s["name"].lstrip("~")})[:MAX_CALLS]
    return [s for s in out if not (s["type"] == "method" and spec.bare and s["parent"] is None)]


def parse_content(path: str, content: str, max_lines: int = MAX_LINES) -> list[dict]:
    """Symbols of one file; a language without rules or a file that does not parse has none."""
    language = language_of(path)
    text = content.replace("\r\n", "\n").replace("\r", "\n")
    text = text[1:] if text.startswith("﻿") else text
    for analyse in ANALYZERS.get(language or "", ()):
        try:
            found = analyse(text)
        except Exception:  # noqa: BLE001
            found = None
        if found is not None:
            return [_symbol(**{"source": "analyser", "signature": None, "line_end": s.get("line_start"), **s}) for s in found]
    if language == "python":
        return parse_python(text)
    spec = SPECS.get(language or "")
    return parse_text(text, spec, max_lines) if spec else []


def parse_files(files: DataFrame, *, max_lines: int = MAX_LINES) -> DataFrame:
    """The symbols of ``files(file_path, content)``; of repeated paths the rows are repeated.

    Rows without path or content give none.  One pass over Arrow batches; a scan
    with fewer splits than cores is spread over them first.
    """
    specs, analyzers = dict(SPECS), {k: list(v) for k, v in ANALYZERS.items()}
    kinds = pa.schema(
        [("file_path", pa.string()), ("sym_ord", pa.int32()), ("name", pa.string()), ("type", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()),
         ("signature", pa.string()), ("docstring", pa.string()), ("parent", pa.string()), ("dependencies", pa.list_(pa.string())), ("decorators", pa.list_(pa.string())),
         ("truncated", pa.bool_()), ("source", pa.string()), ("visibility", pa.string()), ("modifiers", pa.list_(pa.string())), ("mixins", pa.list_(pa.string())), ("return_type", pa.string())]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The worker's own module, not the copy of its globals that travels with this function.
        from skein.sources import parse

        parse.SPECS.update(specs)
        parse.ANALYZERS.update(analyzers)
        for b in batches:
            rows: list[dict] = []
            for path, content in zip(b["file_path"].to_pylist(), b["content"].to_pylist(), strict=True):
                rows += [{"file_path": path, "sym_ord": i, **s} for i, s in enumerate(parse_content(path, content, max_lines))]
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kinds)

    rows = files.where("file_path is not null and content is not null").select("file_path", "content")
    return spread(rows).mapInArrow(scan, SCHEMA)
