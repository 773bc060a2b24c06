"""Patterns given by users: guarded, and translated to the JVM's dialect."""

from __future__ import annotations

import re

#: A quantified group whose body is itself quantified backtracks without bound.
_NESTED = re.compile(r"\((?:[^()\\]|\\.)*[+*}](?:[^()\\]|\\.)*\)\s*(?:[+*]|\{\d+,)")


def safe_pattern(pattern: str) -> str:
    """The pattern itself; ValueError if it is invalid or nests quantifiers."""
    if _NESTED.search(pattern):
        raise ValueError(f"nested quantifiers in {pattern!r}")
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"invalid pattern {pattern!r}: {e}") from e
    return pattern


def java_regex(pattern: str, *, ignore_case: bool = False) -> str:
    """A Python pattern for ``rlike``: Unicode classes, only ``\\n`` ends a line, named groups respelled."""
    flags = "dU" + ("iu" if ignore_case else "")
    return f"(?{flags})" + re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern).replace(r"\Z", r"\z")


def glob_to_regex(pattern: str) -> str:
    """A shell glob over the whole text; ``*`` crosses slashes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (j := pattern.find("]", i + 1)) > 0:
            body = pattern[i:j]
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", r"\\") + "]")
            i = j + 1
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + "$"


def parse_line_spec(spec: str) -> list[tuple[int, int]]:
    """``10``, ``10-20`` or ``1,5-9`` as inclusive ranges; ValueError if a part is none."""
    out = []
    for part in spec.split(","):
        m = re.fullmatch(r"\s*(\d+)(?:\s*-\s*(\d+))?\s*", part)
        if not m:
            raise ValueError(f"not a line or a range of lines: {part!r}")
        a, b = int(m[1]), int(m[2] or m[1])
        if a < 1 or b < a:
            raise ValueError(f"lines run from 1 upwards: {part!r}")
        out.append((a, b))
    return out


_REF = re.compile(r"[A-Za-z0-9][\w./~^@{}-]*")


def safe_ref(ref: str) -> str:
    """A git revision that cannot be taken for an option."""
    if not _REF.fullmatch(ref) or ".." in ref:
        raise ValueError(f"not a revision: {ref!r}")
    return ref
