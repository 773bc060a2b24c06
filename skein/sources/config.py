"""Project configuration: import aliases and module names, read on the driver."""

from __future__ import annotations

import json
import os
import re

from skein.operators.resolve import Alias


def strip_comments(text: str) -> str:
    """JSON without comments and trailing commas; what looks like one inside a string stays."""
    out = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m.group(1) or " ", text, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m.group(1) or "", out)


def _load(path: str, seen: frozenset[str] = frozenset()) -> dict:
    """A tsconfig with the configs it extends below it; cycles and unreadable files end the chain."""
    path = os.path.abspath(path)
    if path in seen:
        return {}
    try:
        with open(path, encoding="utf-8") as f:
            own = json.loads(strip_comments(f.read()))
    except (OSError, ValueError):
        return {}
    options = dict(own.get("compilerOptions") or {})
    options["_base"] = os.path.join(os.path.dirname(path), options.get("baseUrl", "."))
    merged: dict = {}
    extended = own.get("extends") or []
    for name in [extended] if isinstance(extended, str) else extended:
        target = os.path.join(os.path.dirname(path), name)
        merged |= _load(target if target.endswith(".json") else target + ".json", seen | {path})
    paths = {**merged.get("paths", {}), **(options.get("paths") or {})}
    base = options["_base"] if "paths" in options or "baseUrl" in options or "_base" not in merged else merged["_base"]
    return {**merged, **options, "paths": paths, "_base": base}


def tsconfig_aliases(root: str) -> list[Alias]:
    """Aliases of ``tsconfig.json`` or ``jsconfig.json``, targets relative to the root."""
    for name in ("tsconfig.json", "jsconfig.json"):
        path = os.path.join(root, name)
        if os.path.exists(path):
            found = _load(path)
            to = lambda t: os.path.relpath(os.path.join(found["_base"], t), os.path.abspath(root)).replace(os.sep, "/")  # noqa: E731, B023
            return [Alias(k, tuple(to(t) for t in v)) for k, v in (found.get("paths") or {}).items()]
    return []


def pyproject_aliases(root: str) -> list[Alias]:
    """Aliases of ``[tool.import_resolver.aliases]``: a pattern to a target or several."""
    import tomllib

    try:
        with open(os.path.join(root, "pyproject.toml"), "rb") as f:
            found = tomllib.load(f).get("tool", {}).get("import_resolver", {}).get("aliases", {})
    except (OSError, ValueError):
        return []
    return [Alias(k, (v,) if isinstance(v, str) else tuple(v)) for k, v in found.items()]


def import_name(root: str) -> str:
    """The module's name as Python imports it: dashes are underscores."""
    name = module_name(root)
    return name if os.path.exists(os.path.join(root, "go.mod")) else name.replace("-", "_")


def module_name(root: str) -> str:
    """What the project calls itself: go.mod, pyproject, package.json, else its folder."""

    def first(name: str, pattern: str) -> str | None:
        try:
            with open(os.path.join(root, name), encoding="utf-8", errors="replace") as f:
                m = re.search(pattern, f.read(), re.M)
        except OSError:
            return None
        return m and m[1]

    return (
        first("go.mod", r"^module\s+(\S+)") or first("pyproject.toml", r"^name\s*=\s*[\"']([^\"']+)[\"']")
        or first("package.json", r'"name"\s*:\s*"([^"]+)"') or os.path.basename(os.path.abspath(root))
    )
