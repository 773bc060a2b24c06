"""Functions paired with their documentation.

Each file is scanned once: comments and strings are blanked (so what stands in
them is no function), declarations are found in the rest, and the comment that
ends right above a declaration (or, in Python, the docstring) is its
documentation.  The rows form a qualified symbol table; documented
declarations are joined with definitions elsewhere in their root by owner, name
and parameter types, and trivial documentation is dropped last.
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.paths import parent_dir
from skein.sources.tables import ensure_checkpoint_dir, small_side, spread

SYMBOLS_SCHEMA = (
    "file_path string, version long, root string, family string, owner string, name string, types string, line_start int, "
    "top int, last int, has_body boolean, documented boolean, signature string, doc string, code string, supertype string"
)

LANGUAGES = {
    "py": "python", "pyi": "python", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "js", "tsx": "js",
    "go": "go", "java": "java", "rs": "rust", "rb": "ruby", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp",
}
NAMED = {"javascript": "js", "typescript": "js", "c++": "cpp"}

#: Possessive throughout: an unbalanced parenthesis fails at once.  Deeper parentheses are brackets by then (``_shallow``).
ARGS_DEPTH = 3
_ARGS = r"\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\)"
_ID = r"[A-Za-z_$][\w$]*+"
_ARGUMENTS = re.compile(_ARGS)
_CONTROL = frozenset(
    "if for while switch catch with return function new throw else do await yield typeof delete in of case assert synchronized sizeof".split()
)

#: What is blanked before declarations are looked for: comments first, then literals.
_C_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_DQ, _SQ = r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?"
_REGEX = r"(?:(?<=[=(,:!&|?{};\[])|(?<=[=(,:!&|?{};\[] ))/(?![/*\s])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
_BLANKED = {
    "js": rf"({_C_COMMENT})|{_DQ}|{_SQ}|`(?:\\.|[^`\\])*`?|{_REGEX}",
    "go": rf"({_C_COMMENT})|{_DQ}|`[^`]*`?|'(?:\\.|[^'\\\n])*'",
    "java": rf'({_C_COMMENT})|"""(?:\\.|[^\\])*?"""|{_DQ}|{_SQ}',
    "rust": rf'({_C_COMMENT})|r(?P<h>#*)"(?s:.*?)"(?P=h)|"(?:\\.|[^"\\])*"?|\'(?:\\[^\n]+?|[^\'\\\n])\'',
    "c": rf"({_C_COMMENT})|{_DQ}|{_SQ}",
    "ruby": rf"(\#[^\n]*|(?m:^)=begin\b.*?(?:(?m:^)=end[^\n]*|\Z))|<<[~-]?[\"'`]?(?P<t>[A-Z]\w*)[\"'`]?[^\n]*\n.*?\n[ \t]*(?P=t)\b|{_DQ}|{_SQ}|%[qQwWi]?(?:\([^)]*\)|\[[^\]]*\]|\{{[^}}]*\}})",
    "python": r"(\#[^\n]*)|[rbuRBUfF]{0,2}(?:\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z))|" + rf"{_DQ}|{_SQ}",
}
#: What any of them can begin with; one look spares most places the alternatives.
_FIRST = {"js": "[/\"'`]", "go": "[/\"'`]", "java": "[/\"']", "rust": "[/\"'r]", "c": "[/\"']", "cpp": "[/\"']"}
_BLANKED["cpp"] = _BLANKED["c"]
BLANKED = {k: re.compile(f"(?={_FIRST[k]})(?:{v})" if k in _FIRST else v, re.S) for k, v in _BLANKED.items()}

_MODS_JS = r"(?:(?:export|default|declare|public|private|protected|static|readonly|abstract|override|async|get|set)\s++)*+"
_VALUE_JS = rf"(?:async\s+)?(?:function\b|(?:<[^>\n]*>\s*)?{_ARGS}\s*(?::[^={{;]+)?=>|{_ID}\s*=>)"
_MODS_JAVA = r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s++)"
_AFTER_CPP = r"\s*+(?:(?:const|volatile|noexcept|override|final|&&?)\s*+)*+(?:->[^;{}=]+)?(?:=\s*(?:0|default|delete)\s*)?"
_DECLARED = {
    "js": [
        rf"^[ \t]*+{_MODS_JS}function\s*\*?\s*({_ID})\s*[<(]",
        rf"^[ \t]*+(?:export\s+)?(?:const|let|var)\s+({_ID})\s*(?::[^=\n]+)?=\s*{_VALUE_JS}",
        rf"^[ \t]*+{_MODS_JS}(?:\*[ \t]*+)?(#?{_ID})\s*+(?:<[^>(\n]*+>)?{_ARGS}\s*+(?::[^{{;=()]++)?\{{",
        rf"^[ \t]*+{_MODS_JS}(?:[\w$]++\.)*+(#?{_ID})\s*+(?::[^=\n(]+)?[=:]\s*{_VALUE_JS}",
    ],
    "go": [
        rf"^func\s+(?:\([^)]*\)\s*)?({_ID})\s*[\[(]",
        rf"^[ \t]*(?:var\s+)?({_ID})\s*(?::=|=)\s*func\s*\(",
    ],
    "java": [
        rf"^[ \t]*+{_MODS_JAVA}*(?:<[^>\n]+>\s*)?(?!(?:return|new|throw|else|case|assert|yield|await|package|import)\b){_ID}(?:\.{_ID})*(?:<[^;{{}}()=]*>)?(?:\[\])*\s+({_ID})\s*{_ARGS}\s*(?:throws\s+[\w.,\s]+)?(?=[{{;])",
        rf"^[ \t]*+{_MODS_JAVA}+({_ID})\s*{_ARGS}\s*(?:throws\s+[\w.,\s]+)?(?=\{{)",
        rf"^[ \t]*+{_MODS_JAVA}*{_ID}(?:<[^;{{}}()=]*>)?\s+({_ID})\s*=\s*(?:{_ARGS}|{_ID})\s*->",
    ],
    "rust": [
        rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern)[\s\x22]+)*fn\s+({_ID})",
        rf"^[ \t]*(?:let|static|const)\s+(?:mut\s+)?({_ID})\s*(?::[^=\n]+)?=\s*(?:move\s+)?\|",
    ],
    "ruby": [
        r"^[ \t]*(?:(?:private|public|protected|private_class_method|public_class_method|module_function)\s+)*def\s+(?:[\w]+\.)?([A-Za-z_]\w*[?!=]?)",
        r"^[ \t]*([A-Za-z_]\w*)\s*=\s*(?:lambda\b|proc\b|Proc\.new\b|->)",
    ],
    "c": [
        rf"^(?!(?:typedef|return|else|case|goto)\b)[A-Za-z_][\w \t*<>:,&\x22]*?[\s*&]\**({_ID})\s*{_ARGS}\s*(?:const\s*)?(?=[{{;])",
    ],
    "cpp": [
        rf"^[ \t]*+(?!(?:typedef|return|else|case|goto|using|throw|delete|new|co_return|co_await|co_yield)\b)(?:template\s*<[^;{{}}()]*>\s*)?[A-Za-z_][\w \t*<>:,&\x22]*?[\s*&](?:{_ID}(?:<[^;{{}}()]*>)?::)*+(~?{_ID})\s*{_ARGS}{_AFTER_CPP}(?=[{{;])",
        rf"^[ \t]*+(?:(?:explicit|inline|constexpr|virtual)\s++)*+(?:{_ID}(?:<[^;{{}}()]*>)?::)*+(~?{_ID})\s*{_ARGS}(?:{_AFTER_CPP}(?=[{{;])|\s*(?:noexcept\s*)?(?=:(?!:)))",
    ],
    "python": [rf"^[ \t]*(?:async\s+)?def\s+({_ID})\s*[\[(]"],
}
DECLARED = {k: [re.compile(p, re.M) for p in v] for k, v in _DECLARED.items()}
#: Methods that a TypeScript interface or abstract class only declares.
_MEMBER_TS = re.compile(rf"^[ \t]*+{_MODS_JS}(#?{_ID})\??\s*+(?:<[^>(\n]*+>)?{_ARGS}[ \t]*+(?::[^;{{}}=\n]++)?(?:[;,]|$)", re.M)
#: What only C++ has; headers of both have one suffix.
_CPP = re.compile(r"^\s*(?:class|namespace|template|public|private|protected)\b|\w::", re.M)
_HEADS = {
    "java": re.compile(rf"\b(class|interface|enum|record)\s+({_ID})"),
    "js": re.compile(rf"\b(class|interface|enum|namespace|module)\s+({_ID})"),
    "rust": re.compile(rf"\b(struct|enum|trait|mod)\s+({_ID})"),
    "cpp": re.compile(r"\b(class|struct|union|enum|namespace)\b(?:\s+(?:class|struct|alignas\([^)]*\)|\[\[[^\]]*\]\]|[A-Z_]+(?=\s+[A-Za-z_])))*\s*((?:[A-Za-z_]\w*::)*[A-Za-z_]\w*)?(?:\s*<[^;{}()]*>)?\s*(?:final\b)?\s*(?::(?!:)[^()]*)?$"),
}
_MARKS = re.compile(r"[;{}]")
_NOTES = re.compile(r"@\w[\w.]*(?:\([^()]*\))?|#!?\[[^\]]*\]")
#: To the brace of a Rust function's body or the semicolon in its place.
_TO_BODY = re.compile(r"(?:[^{;\[]|\[[^\]]*\])*+")
#: Languages with declarations that have no body; those of a family share declarations.
FAMILIES = {"c": "c", "cpp": "c", "java": "java", "rust": "rust", "js": "js"}
_ATTRIBUTE = re.compile(r"[ \t]*(?:@|#!?\[|\[\[)")

#: Lines that give tools orders.
DIRECTIVE = re.compile(
    r"^(?:eslint\b|tslint|prettier-|@ts-|ts-ignore|istanbul\b|c8 ignore|jshint|jslint|noinspection|nolint|NOSONAR|clang-format|rubocop|type:\s*ignore|noqa|pylint|flake8|mypy|pragma\b|fmt:|isort|yapf|"
    r"go:|\+build|cgo\b|nosec|lint:|checkstyle|@formatter|@suppress|coverage|sourceMappingURL|region\b|endregion\b|frozen_string_literal|encoding:|-\*-|vim:|clippy|rustfmt|swiftlint|sorbet|typed:|cppcheck|NOLINT\w*|@format\b|@flow\b|global\b|biome-)",
    re.I,
)
#: Tags and field lists; what follows a tag's name is its text.
TAG = re.compile(
    r"^(?:[@\\][A-Za-z]+(?:\{[^}]*\})?(?:\s+\{[^}]*\})?(?:\s+\[?[\w$.=]+\]?)?(?:\s*-\s*)?|:\w+(?:\s+[\w$.]+)*:|"
    r"(?:Args|Arguments|Parameters|Params|Returns?|Raises|Throws|Yields|Example|Examples|Note|Notes|Attributes|Panics|Errors|Safety|Todo|See also)\s*:?\s*$|#+\s*(?:Arguments|Returns|Errors|Panics|Examples?|Safety|Parameters)\s*$)",
    re.I,
)
#: An entry of a field list that says nothing about its field.
EMPTY_FIELD = re.compile(r"^\**[\w$.]+\s*(?:\([^()]*\))?\s*:\s*$")
#: Placeholders, whatever follows them in their sentence.
PLACEHOLDER = re.compile(r"^(?:(?:todo|fixme|xxx|tbd|tba|wip|n/a|undocumented|lorem ipsum|coming soon|see (?:above|below))\b|(?:not|no) (?:yet )?document(?:ed|ation)\b|no description\b|to be (?:documented|written|done)\b|add (?:a )?(?:description|documentation|docs)\b|document (?:this|me)\b|fill (?:this )?in\b)", re.I)
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힣]")
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_a-zA-Z]+")
#: Words of a name put into a sentence.
GLUE = frozenset("the a an this that it its is are of for to in on and or with from by function method procedure routine helper does do performs implements handles".split())


def name_words(name: str) -> set[str]:
    return {w.lower() for w in _SPLIT.findall(name)}


@lru_cache(100_000)
def _stem(word: str) -> str:
    """Without the endings of verbs and plurals, so that ``retries`` meets ``retry``."""
    for tail, put in (("ies", "y"), ("sses", "ss"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("ing", ""), ("ed", ""), ("es", "e"), ("s", ""), ("e", "")):
        if word.endswith(tail) and len(word) - len(tail) + len(put) >= 3:
            return _stem(word[: -len(tail)] + put) if tail not in ("e", "s") else (word[: -len(tail)] + put).rstrip("e")
    return word


_GLUE = GLUE | {_stem(g) for g in GLUE}


def description(lines: list[str]) -> str:
    """The prose of a documentation comment, its markers, tags, rulers and directives removed."""
    out = []
    for line in lines:
        s = line.strip()
        s = re.sub(r"^(?:/\*+!?|//[/!]*|\*+/|\*(?!\*)|#+!?(?![\w\[]))\s?", "", s)
        s = re.sub(r"\s*\*+/$", "", s).strip()
        if not re.search(r"\w", s) or EMPTY_FIELD.match(s):
            out.append("")
        elif DIRECTIVE.match(s):
            continue
        else:
            t = TAG.match(s)
            out.append("\n" + s[t.end() :].strip() + "\n" if t else s)
    return "\n".join(out).strip()


def is_real(text: str, name: str) -> bool:
    """Whether the text holds a sentence of four words or more that says more than the name does."""
    own = {_stem(w) for w in name_words(name)} | {name.lower()}
    for part in re.split(r"\n\s*\n|\n\s*(?=[*+\u2022-]\s|\d+[.)]\s)|(?<=[.!?;。！？])\s+", text):
        part = " ".join(part.split())
        if not part or PLACEHOLDER.match(part.strip(" *-_=~#`'\"([{<")):
            continue
        words = part.split()
        n = sum(1 for w in words if re.search(r"[^\W\d_]", w)) + len(_CJK.findall(part)) // 2
        if n < 4:
            continue
        said = {_stem(w) for w in name_words(part)} | {c for c in _CJK.findall(part)}
        if said - own - _GLUE:
            return True
    return False


def language_of(path: str, language: str | None) -> str | None:
    """By suffix, else by the recorded language."""
    known = LANGUAGES.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None
    said = (language or "").strip().lower()
    return known or NAMED.get(said, said if said in BLANKED else None)


def _shallow(plain: str) -> str:
    """The text with parentheses nested deeper than _ARGS follows written as brackets, place for place."""
    a = np.frombuffer(plain.encode("latin-1", "replace"), np.uint8)
    depth = np.cumsum((a == 40).astype(np.int32) - (a == 41))
    if not len(depth) or (depth - np.minimum(np.minimum.accumulate(depth), 0)).max() <= ARGS_DEPTH:
        return plain
    pairs, opened = [], []
    for m in re.finditer(r"[()]", plain):
        if m.group() == "(":
            opened.append(m.start())
        elif opened:
            pairs.append((opened.pop(), m.start()))
    out, around = list(plain), []
    for first, last in sorted(pairs):
        while around and around[-1] < first:
            around.pop()
        if len(around) >= ARGS_DEPTH:
            out[first], out[last] = "[", "]"
        around.append(last)
    return "".join(out)


def _normal_signature(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"\s*([(),:*<>&\[\]=])\s*", r"\1", text)).strip()


def _skip_angles(text: str, at: int) -> int:
    """Past the angle brackets that open at ``at``, if any do."""
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c == "<":
            depth += 1
        elif c == ">" and text[i - 1] not in "-=":
            depth -= 1
        elif depth == 0 and not c.isspace():
            return i
        i += 1
    return i if depth == 0 else at


def _without_angles(text: str) -> str:
    out, i = [], 0
    while i < len(text):
        if text[i] == "<":
            i = max(_skip_angles(text, i), i + 1)
            out.append(" ")
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def _split(text: str, mark: str = ",") -> list[str]:
    """At the marks that stand in no bracket."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or (c == ">" and text[i - 1 : i] not in ("-", "=")):
            depth -= 1
        elif c == mark and depth <= 0:
            out.append(text[last:i])
            last = i + 1
    return [x for x in (*out, text[last:]) if x.strip()]


_C_WORDS = frozenset("void bool char short int long float double signed unsigned auto wchar_t size_t ssize_t _Bool".split())
_C_DROPPED = frozenset("struct class union enum register static extern inline volatile restrict __restrict __restrict__ typename".split())
_C_TOKEN = re.compile(r"\.\.\.|::|\w+|[^\s\w]")


def _c_type(text: str) -> str:
    text = _split(text, "=")[0]
    pointer = re.search(r"\(\s*(?:\w+::)?[*&^]\s*(?:const\s*)?\w*\s*\)\s*(\(.*\))\s*$", text, re.S)
    if pointer:
        return f"{_c_type(text[: pointer.start()] + ' ')}(*)({','.join(_parameter_types(pointer.group(1), 'c', ''))})"
    text, arrays = re.subn(r"\[[^\]]*\]", "", text)
    tokens = [t for t in _C_TOKEN.findall(text) if t not in _C_DROPPED]
    words = [i for i, t in enumerate(tokens) if re.match(r"\w", t) and t != "const"]
    if len(words) > 1 and words[-1] == len(tokens) - 1 and tokens[-1] not in _C_WORDS and tokens[-2] != "::":
        tokens.pop()
    tokens += ["*"] * arrays
    # Const of the value itself is no part of the type.
    while tokens and tokens[-1] == "const":
        tokens.pop()
    if not {"*", "&"} & set(tokens):
        tokens = [t for t in tokens if t != "const"]
    if {"unsigned", "long", "short", "signed"} & set(tokens):
        tokens = [t for t in tokens if t != "int"]
    if "signed" in tokens and "char" not in tokens:
        tokens = [t for t in tokens if t != "signed"] if len({"long", "short"} & set(tokens)) else ["int" if t == "signed" else t for t in tokens]
    at = next((i for i, t in enumerate(tokens) if t in "*&<"), len(tokens))
    # ``char const *`` is ``const char *``, ``int unsigned`` is ``unsigned int``.
    if "::" not in tokens[:at]:
        tokens[:at] = sorted(tokens[:at])
    return " ".join(tokens)


def _parameter_types(args: str, lang: str, owner: str) -> list[str]:
    """The types in an argument list, names, defaults and annotations dropped."""
    out = []
    for part in _split(args.strip()[1:-1]):
        if lang in ("c", "cpp"):
            kind = _c_type(part)
            if kind != "void":
                out.append(kind)
            continue
        part = " ".join(_NOTES.sub(" ", part).split())
        if lang == "java":
            part = re.sub(r"\bfinal\s+", "", part)
            m = re.match(rf"(.*?)\s*\b({_ID})\s*((?:\[\s*\]\s*)*)$", part)
            kind = re.sub(r"\b[\w$]+\.(?=[A-Za-z_$])", "", (m.group(1) + m.group(3)) if m else part)
        elif lang == "rust":
            if re.match(r"(?:&\s*(?:'\w+\s+)?)?(?:mut\s+)?self\b", part):
                continue
            kind = re.sub(r"\b\w+::", "", re.sub(r"'\w+\b\s*,?", "", re.split(r"(?<!:):(?!:)", part, maxsplit=1)[-1])).replace("<>", "")
            kind = re.sub(rf"\b{re.escape(owner)}\b", "Self", kind) if owner else kind
        else:
            part = _split(part, "=")[0] if "=>" not in part else re.sub(r"=(?!>)[^>]*$", "", part)
            name, colon, kind = part.partition(":")
            if name.strip() == "this":
                continue
            kind = ("..." if name.strip().startswith("...") else "") + (kind if colon else "any")
        out.append(re.sub(r"\s*(\W)\s*", r"\1", kind.strip()))
    return out


def _types_in(text: str) -> list[str]:
    """Bare names of the types in a list of supertypes."""
    text = re.sub(r"\b(?:public|private|protected|virtual|typename)\b", " ", _without_angles(text))
    names = (re.split(r"::|\.", re.sub(r"\s+", "", re.sub(r"\(.*", "", x, flags=re.S)))[-1] for x in re.split(r"[,+]", text))
    return [n for n in names if re.fullmatch(r"[A-Za-z_$][\w$]*", n)]


def _head(text: str, lang: str) -> tuple[str, str, list[str]] | None:
    """``(kind, name, supertypes)`` of the type or namespace whose block the text opens."""
    text = _NOTES.sub(" ", text) if "@" in text or "#" in text else text
    if lang == "rust":
        m = re.search(r"\bimpl\b", text)
        if m and "(" not in text[: m.start()]:
            body = re.split(r"\bwhere\b", _without_angles(text[m.end() :]))[0]
            trait, of, kind = re.split(r"(\bfor\b)", body, maxsplit=1) if re.search(r"\bfor\b", body) else ("", "", body)
            named = _types_in(kind.replace("&", " ").replace("mut ", " "))
            return ("impl", named[0], _types_in(trait)) if named else None
    if lang == "cpp":
        text = re.sub(r"^\s*#[^\n]*$|\b(?:public|private|protected)\s*:(?!:)", " ", text, flags=re.M)
        if re.match(r"\s*extern\b[\s\x22C]*$", text):
            return ("namespace", "", [])
    m = _HEADS[lang].search(text)
    if not m or "(" in text[: m.start()]:
        return None
    name = (m.group(2) or "").split("::")[-1]
    rest = text[m.end(2) :] if m.group(2) else ""
    if lang == "rust":
        supers = _types_in(re.split(r"\bwhere\b", rest)[0].partition(":")[2]) if m.group(1) == "trait" else []
    elif lang == "cpp":
        supers = _types_in(re.split(r"(?<!:):(?!:)", rest, maxsplit=1)[1]) if re.search(r"(?<!:):(?!:)", rest) else []
    else:
        supers = _types_in(",".join(re.split(r"\b(?:extends|implements|permits)\b", _without_angles(re.sub(r"\bpermits\b.*", "", rest, flags=re.S)))[1:]))
    return m.group(1), name, supers


class _Blocks:
    """The blocks in braces of a text without comments and strings."""

    def __init__(self, plain: str, lang: str):
        self.blocks: list[tuple[int, tuple[str, str, list[str]] | None]] = []  # parent, head
        self.at, self.top, inner, last = [-1], [-1], -1, 0
        for m in _MARKS.finditer(plain):
            mark = m.group()
            if mark == "{":
                self.blocks.append((inner, _head(plain[last : m.start()], lang)))
                inner = len(self.blocks) - 1
            elif mark == "}" and inner >= 0:
                inner = self.blocks[inner][0]
            last = m.end()
            if mark != ";":
                self.at.append(m.start())
                self.top.append(inner)

    def head(self, offset: int) -> tuple[str, str, list[str]] | None:
        """The innermost block there; ('', '', []) outside all blocks."""
        i = self.top[bisect_right(self.at, offset) - 1]
        return self.blocks[i][1] if i >= 0 else ("", "", [])

    def owner(self, offset: int) -> str:
        i = self.top[bisect_right(self.at, offset) - 1]
        while i >= 0 and not (self.blocks[i][1] and self.blocks[i][1][1]):
            i = self.blocks[i][0]
        return self.blocks[i][1][1] if i >= 0 else ""

    def supers(self) -> set[tuple[str, str]]:
        return {(h[1], above) for _, h in self.blocks if h for above in h[2] if above != h[1]}


def _python(text: str) -> list[tuple] | None:
    """Functions by the syntax tree; None if the text has none."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out: list[tuple] = []
    stack: list[tuple[ast.AST, str]] = [(tree, "")]
    while stack:
        node, scope = stack.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.stmt) or isinstance(child, (ast.ExceptHandler, ast.match_case)):
                inner = scope
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    doc = ast.get_docstring(child, clean=True)
                    args = ",".join(a.arg for a in (*child.args.posonlyargs, *child.args.args, *child.args.kwonlyargs))
                    out.append((child.name, child.lineno, scope + child.name, f"{child.name}({args})", True, doc, child.lineno, child.end_lineno, "", ""))
                    inner = scope + child.name + "."
                elif isinstance(child, ast.ClassDef):
                    inner = scope + child.name + "."
                stack.append((child, inner))
    return out


def _scanned(text: str, lang: str) -> tuple[list[tuple], set[tuple[str, str]]]:
    """Functions by declarations in the text without comments and strings, and the ``(type, supertype)`` that its types name."""
    comments: list[tuple[int, int]] = []

    def blank(m: re.Match) -> str:
        s = m.group()
        if m.group(1) is not None:
            comments.append(m.span())
        # A literal must not read as white space between an assignment and the next statement.
        fill = '"' if m.group(1) is None else " "
        return fill * len(s) if "\n" not in s else "".join(c if c == "\n" else fill for c in s)

    plain = _shallow(BLANKED[lang].sub(blank, text))
    if lang == "c" and _CPP.search(plain):
        lang = "cpp"
    members = lang == "js" and ("interface" in plain or "abstract" in plain)
    owned = lang in FAMILIES
    blocks = _Blocks(plain, lang) if lang in _HEADS else None
    above_of = blocks.supers() if blocks else set()
    hits: dict[int, tuple[str, re.Match]] = {}
    for n, pattern in enumerate(DECLARED[lang]):
        for m in pattern.finditer(plain):
            if m.group(1) in _CONTROL or m.start(1) in hits:
                continue
            if lang == "cpp":
                # Inside a function, what looks like a declaration is a call or a variable.
                inner = blocks.head(m.start(1))
                if inner is None and (n or plain[m.start()] in " \t"):
                    continue
                if n:
                    of_class = re.findall(r"(\w+)(?:<[^;{}()]*>)?::", plain[m.start() : m.start(1)])
                    if m.group(1).lstrip("~") != (of_class[-1] if of_class else inner[1]):
                        continue
            hits[m.start(1)] = (m.group(1), m)
    declared: set[int] = set()
    if members:
        for m in _MEMBER_TS.finditer(plain):
            head = blocks.head(m.start(1))
            member = head and (head[0] == "interface" or (head[0] == "class" and "abstract" in plain[m.start() : m.start(1)]))
            if member and m.start(1) not in hits:
                hits[m.start(1)] = (m.group(1), m)
                declared.add(m.start(1))
    if not hits:
        return [], above_of
    starts = [0]
    for m in re.finditer("\n", text):
        starts.append(m.end())
    line_at = lambda offset: bisect_right(starts, offset) - 1
    of = lambda s, i: s[starts[i] : starts[i + 1] if i + 1 < len(starts) else len(s)]
    in_comment: dict[int, int] = {}
    for n, (a, b) in enumerate(comments):
        for i in range(line_at(a), line_at(max(a, b - 1)) + 1):
            in_comment[i] = n
    out = []
    order = sorted(hits)
    for k, at in enumerate(order):
        name, m = hits[at]
        top = line_at(m.start() + len(m.group()) - len(m.group().lstrip()))
        above = top - 1
        while above >= 0 and _ATTRIBUTE.match(plain, starts[above]):
            above -= 1
        last = above
        while above >= 0 and above in in_comment and not of(plain, above).strip():
            above -= 1
        doc = None
        if above < last:
            lines = [of(text, i) for i in range(above + 1, last + 1)]
            doc = "\n".join(x.rstrip("\r\n") for x in lines)
        end = m.end()
        tail = plain[end : end + 1]
        limit = starts[line_at(order[k + 1])] if k + 1 < len(order) else len(text)
        owner = blocks.owner(at) if blocks and owned else ""
        if lang == "cpp" and owned:
            of_class = re.findall(r"(\w+)(?:<[^;{}()]*>)?::(?=[\w:<>, ~]*$)", plain[max(m.start(), at - 200) : at])
            owner = of_class[-1] if of_class and plain[at - 2 : at] == "::" else owner
        args = _ARGUMENTS.search(plain, _skip_angles(plain, at + len(name)) if lang in ("rust", "js") else at, limit)
        has_body = not (lang in ("c", "cpp", "java") and tail == ";") and at not in declared
        if lang == "rust" and args and m.re is DECLARED["rust"][0]:
            stop = _TO_BODY.match(plain, args.end()).end()
            has_body = plain[stop : stop + 1] != ";"
        signature = _normal_signature(name + (args.group() if args else ""))
        types = ",".join(_parameter_types(args.group(), lang, owner)) if args and owned else ""
        out.append((name, line_at(at) + 1, f"{owner}.{name}" if owner else name, signature, has_body, doc, top + 1, line_at(max(at, limit - 1)) + 1, owner, types))
    return out, above_of


def file_functions(path: str, language: str | None, content: str) -> list[tuple]:
    """``(name, line, qualified, signature, has_body, documented, doc, first, last line, owner, types)`` of each function of a file."""
    return file_symbols(path, language, content)[0]


def _plain_text(content: str) -> str:
    text = content.replace("\r\n", "\n").replace("\r", "\n")
    return text[1:] if text.startswith("﻿") else text


def file_symbols(path: str, language: str | None, content: str) -> tuple[list[tuple], set[tuple[str, str]]]:
    """The functions of a file, and the ``(type, supertype)`` that its types name."""
    lang = language_of(path, language)
    if not lang or not content:
        return [], set()
    text, supers = _plain_text(content), set()
    found = _python(text) if lang == "python" else None
    if found is None:
        if lang == "python":
            found = _python_scanned(text)
        else:
            found, supers = _scanned(text, lang)
    out = []
    for name, line, qualified, signature, has_body, doc, first, last, owner, types in found:
        prose = description(doc.split("\n")) if doc else ""
        out.append((name, line, qualified, signature, has_body, bool(prose) and is_real(prose, name), prose, first, last, owner, types))
    return out, supers


def _python_scanned(text: str) -> list[tuple]:
    """Python that does not parse: ``def`` lines outside strings, and the literal that follows their colon."""
    strings: list[tuple[int, int]] = []

    def blank(m: re.Match) -> str:
        if m.group(1) is None:
            strings.append(m.span())
        return "".join(c if c == "\n" else " " for c in m.group())

    plain = BLANKED["python"].sub(blank, text)
    first_at = {a: (a, b) for a, b in strings}
    out = []
    for m in DECLARED["python"][0].finditer(plain):
        args = re.compile(_ARGS + r"[^:\n]*:[ \t]*").search(plain, m.end() - 1)
        doc = None
        if args:
            at = re.compile(r"\s*").match(text, args.end()).end()
            if at in first_at:
                doc = re.sub(r"^[a-zA-Z]*(?:\"\"\"|'''|\"|')|(?:\"\"\"|'''|\"|')$", "", text[slice(*first_at[at])])
        line = text.count("\n", 0, m.start(1)) + 1
        out.append((m.group(1), line, m.group(1), _normal_signature(m.group(1) + (args.group() if args else "")), True, doc, line, line, "", ""))
    return out


def symbol_table(files: DataFrame, *, with_text: bool = True) -> DataFrame:
    """The functions of all files, documented or not, and the supertypes their types name, from one scan of each file.

    ``files`` needs ``file_path``, ``language`` and ``content``; without a
    ``root`` the first part of the path is one.  Rows without a path or content
    and files of unknown languages give none; repeated rows give repeated
    functions; other columns are ignored.  ``with_text`` adds description and
    signature, and the code of documented functions, else they are null.  A row
    for a type has its name as ``owner``, a ``supertype`` and no ``name``.
    """
    first = F.substring_index("file_path", "/", 1)
    root = F.coalesce(F.col("root"), first) if "root" in files.columns else first
    rows = files.where("file_path is not null and content is not null").select(
        "file_path", "language", "content", root.alias("root"), F.xxhash64("content").alias("version")
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for path, language, content, root, version in zip(*(b[c].to_pylist() for c in ("file_path", "language", "content", "root", "version")), strict=True):
                found, supers = file_symbols(path, language, content)
                family = FAMILIES.get(language_of(path, language))
                lines = _plain_text(content).split("\n") if with_text and any(f[4] and f[5] for f in found) else []
                for name, line, _, signature, has_body, real, doc, top, last, owner, types in found:
                    code = "\n".join(lines[top - 1 : last]).rstrip() if with_text and has_body and real else None
                    text = (signature, doc, code) if with_text else (None, None, None)
                    out.append((path, version, root, family, owner, name, types, line, top, last, has_body, real, *text, None))
                for kind, above in supers:
                    out.append((path, version, root, family, kind, None, None, None, None, None, None, None, None, None, None, above))
                if len(out) > 20_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return spread(rows).mapInArrow(scan, SYMBOLS_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    names, types = zip(*(c.split(" ") for c in SYMBOLS_SCHEMA.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


KEY = ["root", "family", "owner", "name", "types"]


def _offered(table: DataFrame) -> DataFrame:
    """``(root, family, owner, name, types, folder, d)``: the documented declaration that each owner offers in each folder.

    A declaration is offered by its own type and, step by step, by all types
    below it; the nearest counts, then the first by path.  Each step is a join
    of what came last with the types, so no root is gathered anywhere.
    """
    best = F.min(F.struct("distance", "file_path", "line_start", "doc")).alias("d")
    declared = table.where("documented and not has_body").withColumns({"folder": parent_dir(F.col("file_path")), "distance": F.lit(0)})
    types = table.where("supertype is not null").select("root", "family", F.col("owner").alias("below"), F.col("supertype").alias("owner")).distinct()
    last = declared.groupBy(*KEY, "folder").agg(best).checkpoint()
    every = last
    while not last.isEmpty():
        step = last.join(types, ["root", "family", "owner"]).select(
            "root", "family", F.col("below").alias("owner"), "name", "types", "folder", (F.col("d.distance") + 1).alias("distance"), "d.file_path", "d.line_start", "d.doc"
        )
        last = step.groupBy(*KEY, "folder").agg(best).join(every, [*KEY, "folder"], "left_anti").checkpoint()
        every = every.unionByName(last)
    return every


def resolved_documentation(table: DataFrame) -> DataFrame:
    """The functions of a symbol table with documentation, their own or else that of a declaration: adds ``doc_path`` and ``doc_line``.

    A definition without documentation takes that of a declaration without body
    (a prototype, an interface's or trait's method, an abstract one) of the
    same root with the same owner, name and parameter types, which tell
    overloads apart; the owner is the type that holds it or stands before
    ``::``, or any type above that one.  Declarations of the same folder come
    first, then nearer types, then the first by path.
    """
    cols = ["file_path", "version", "name", "line_start", "top", "last", "signature", "has_body", "code", "doc", "doc_path", "doc_line"]
    own = table.where("documented").withColumns({"doc_path": F.col("file_path"), "doc_line": F.col("line_start")})
    near = _offered(table)
    far = near.groupBy(*KEY).agg(F.min("d").alias("far"))
    bare = table.where("not documented and has_body").withColumn("folder", parent_dir(F.col("file_path")))
    met = bare.join(small_side(far), KEY).join(small_side(near), [*KEY, "folder"], "left").withColumn("said", F.coalesce("d", "far"))
    taken = met.withColumns({"doc": F.col("said.doc"), "doc_path": F.col("said.file_path"), "doc_line": F.col("said.line_start")})
    return own.select(cols).unionByName(taken.select(cols))


def documented_functions(files: DataFrame) -> DataFrame:
    """``(file_path, name, line_start)`` of each function with real documentation of its own, without duplicates.

    Of the resolved functions those count whose documentation stands at the
    function itself, declarations without body among them.
    """
    ensure_checkpoint_dir(files.sparkSession)
    found = resolved_documentation(symbol_table(files, with_text=False).checkpoint())
    return found.where("doc_path = file_path and doc_line = line_start").select("file_path", "name", "line_start").distinct()


def code_doc_pairs(files: DataFrame) -> DataFrame:
    """``(file_path, name, line_start, signature, code, doc, doc_path)``: code with its description.

    A function documented where it is defined pairs with that text, another
    with that of its declaration (``resolved_documentation``).  Documentation
    that is empty or trivial pairs with nothing.  Type parameters are not
    replaced by their arguments, and Go's interfaces, which no type names, are
    not followed.
    """
    ensure_checkpoint_dir(files.sparkSession)
    found = resolved_documentation(symbol_table(files).checkpoint()).where("has_body")
    # Code of definitions that took a declaration's text: cut from their files, which are read again for those only.
    text = F.regexp_replace(F.regexp_replace("content", "\r\n?", "\n"), "^\ufeff", "")
    sources = files.select("file_path", F.xxhash64("content").alias("version"), F.split(text, "\n").alias("_lines"))
    taken = found.where("doc_path <> file_path or doc_line <> line_start").drop("code").checkpoint()
    cut = F.rtrim(F.array_join(F.slice("_lines", F.col("top"), F.col("last") - F.col("top") + 1), "\n"), F.lit(" \t\n\r\f\x0b"))
    wanted = small_side(taken.select("file_path", "version").distinct())
    coded = sources.join(wanted, ["file_path", "version"], "left_semi").dropDuplicates(["file_path", "version"]).join(taken, ["file_path", "version"]).withColumn("code", cut)
    cols = ["file_path", "name", "line_start", "signature", "code", "doc", "doc_path"]
    own = found.where("doc_path = file_path and doc_line = line_start")
    return own.select(cols).unionByName(coded.select(cols)).dropDuplicates(["file_path", "name", "line_start"])
