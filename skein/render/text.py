"""Markdown, HTML, GraphViz and tree renderings of a map (the nested form of one index)."""

from __future__ import annotations

import html
import json
from collections import Counter

HUBS = ((8, "critical"), (5, "high"), (3, "medium"), (2, "low"))
#: Names shown of each kind, and the width of a line.
SHOWN, WIDTH = {"class": 2, "method": 3, "function": 3}, 60


def _by_type(code_map: dict) -> Counter:
    return Counter(s["type"] for f in code_map["files"].values() for s in f["symbols"])


def markdown(code_map: dict) -> str:
    stats, kinds = code_map.get("stats", {}), _by_type(code_map)
    out = ["# Code map", "", f"Root: `{code_map.get('root', '')}`", "", f"Files: {stats.get('files_processed', 0)}, symbols: {stats.get('symbols_found', 0)}", "", "| type | count |", "| --- | ---: |"]
    out += [f"| {k} | {n} |" for k, n in sorted(kinds.items())] + ["", "## Files", ""]
    for path, f in sorted(code_map["files"].items()):
        out += [f"### {path}", ""]
        for s in sorted(f["symbols"], key=lambda s: s["lines"][0] or 0):
            parent = f" (in `{s['parent']}`)" if s.get("parent") else ""
            out.append(f"- `{s['name']}` {s['type']}, lines {s['lines'][0]}-{s['lines'][1]}{parent}" + (f": `{s['signature']}`" if s.get("signature") else ""))
        out.append("")
    out += ["## Names", ""] + [f"- `{n}`: " + ", ".join(f"{e['file']}:{e['lines'][0]}" for e in found) for n, found in sorted(code_map.get("index", {}).items())]
    return "\n".join(out) + "\n"


def page(code_map: dict) -> str:
    """One self-contained HTML page with a filter box."""
    e = html.escape
    rows = "".join(
        f"<details><summary>{e(path)} ({len(f['symbols'])})</summary><ul>"
        + "".join(f"<li data-name=\"{e(s['name'].lower(), quote=True)}\"><b>{e(s['name'])}</b> {e(s['type'])} {s['lines'][0]}-{s['lines'][1]} <code>{e(s.get('signature') or '')}</code></li>" for s in f["symbols"])
        + "</ul></details>"
        for path, f in sorted(code_map["files"].items())
    )
    script = "const q=document.getElementById('q');q.oninput=()=>{const v=q.value.toLowerCase();document.querySelectorAll('li').forEach(x=>x.hidden=!x.dataset.name.includes(v));document.querySelectorAll('details').forEach(d=>d.open=!!v)}"
    kinds = ", ".join(f"{e(k)}: {n}" for k, n in sorted(_by_type(code_map).items()))
    return f"<!doctype html><html><head><meta charset='utf-8'><title>Code map</title></head><body><h1>{e(str(code_map.get('root', '')))}</h1><p>{kinds}</p><input id='q' placeholder='filter'>{rows}<script>{script}</script></body></html>\n"


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def dot(code_map: dict) -> str:
    """Files as clusters, symbols as nodes, an edge for each call whose name some file defines (the first by path)."""
    ids: dict[tuple[str, str], str] = {}
    first: dict[str, str] = {}
    out = ["digraph code {", "  rankdir=LR;", "  node [shape=box];"]
    n = 0
    for k, (path, f) in enumerate(code_map["files"].items()):
        out.append(f"  subgraph cluster_{k} {{")
        out.append(f"    label={_quoted(path)};")
        for s in f["symbols"]:
            node = f"n{n}"
            n += 1
            ids[path, s["name"]] = node
            first.setdefault(s["name"], path)
            out.append(f"    {node} [label={_quoted(s['name'])}];")
        out.append("  }")
    edges = []
    for path, f in code_map["files"].items():
        for s in f["symbols"]:
            for d in s.get("deps", ()):
                if d in first:
                    edges.append(f"  {ids[path, s['name']]} -> {ids[first[d], d]};")
    return "\n".join(out + list(dict.fromkeys(edges)) + ["}"]) + "\n"


EXPORTERS = {"markdown": markdown, "md": markdown, "html": page, "graphviz": dot, "dot": dot, "json": lambda m: json.dumps(m, indent=2, ensure_ascii=False) + "\n"}


def register_exporter(name: str, render) -> None:
    EXPORTERS[name] = render


def export(code_map: dict, form: str) -> str:
    try:
        return EXPORTERS[form.lower()](code_map)
    except KeyError:
        raise ValueError(f"no export format {form!r}; known: {', '.join(sorted(EXPORTERS))}") from None


def hub_level(n: int) -> str:
    return next((name for least, name in HUBS if n >= least), "none")


def _meta(symbols: list[dict]) -> str:
    parts = []
    for kind, most in SHOWN.items():
        names = [s["name"] for s in symbols if s["type"] == kind]
        if names:
            parts.append(f"{kind[0].upper()}:" + ",".join(names[:most]) + (f"+{len(names) - most}" if len(names) > most else ""))
    text = " ".join(parts)
    return text if len(text) <= WIDTH else text[: WIDTH - 3] + "..."


def skeleton(code_map: dict, importers: dict[str, int] | None = None, *, depth: int = 10) -> str:
    """The tree of folders and files with a line about each file's symbols, hubs marked."""
    tree: dict = {}
    for path in sorted(code_map["files"]):
        at = tree
        *folders, name = path.split("/")
        for f in folders:
            at = at.setdefault(f + "/", {})
        at[name] = path
    out: list[str] = []

    def show(at: dict, indent: str, level: int) -> None:
        items = sorted(at.items(), key=lambda x: (not isinstance(x[1], dict), x[0]))
        for i, (name, inner) in enumerate(items):
            last = i == len(items) - 1
            line = indent + ("└── " if last else "├── ") + name
            if isinstance(inner, dict):
                out.append(line)
                if level < max(1, min(depth, 10)):
                    show(inner, indent + ("    " if last else "│   "), level + 1)
            else:
                n = (importers or {}).get(inner, 0)
                mark = f" [{hub_level(n)}:{n}]" if n >= HUBS[-1][0] else ""
                meta = _meta(code_map["files"][inner]["symbols"])
                out.append(line + mark + (f"  {meta}" if meta else ""))

    show(tree, "", 1)
    kinds = _by_type(code_map)
    out.append(f"{len(code_map['files'])} files, {kinds['class'] + kinds['function']} symbols, {sum(n >= 3 for n in (importers or {}).values())} hubs")
    return "\n".join(out) + "\n"


def compact_index(code_map: dict, *, by: str = "file", private: bool = False) -> str:
    """Names by file or by type, private ones left out unless asked for."""
    groups: dict[str, list[str]] = {}
    for path, f in sorted(code_map["files"].items()):
        for s in f["symbols"]:
            if private or not s["name"].startswith("_"):
                groups.setdefault(path if by == "file" else s["type"], []).append(s["name"] if by == "file" else f"{s['name']}@{path}")
    return "\n".join(f"{k}: {', '.join(v)}" for k, v in sorted(groups.items())) + "\n"


def dependency_flow(rows: list[dict], hubs: list[tuple[str, int]] = ()) -> str:
    """Folders with what their files import; files that many import have a double arrow."""
    stem = lambda path: path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    out, folder = [], None
    for r in rows:
        if r["dir"] != folder:
            folder = r["dir"]
            out += ([""] if out else []) + [f"{folder}/"]
        more = f" +{r['more']} more" if r["more"] > 0 else ""
        out.append(f"  {stem(r['path'])} {'==>' if r['in_degree'] >= 3 else '-->'} {', '.join(map(stem, r['imports']))}{more}")
    if hubs:
        out += ["", "hubs: " + ", ".join(f"{p} ({n})" for p, n in hubs)]
    return "\n".join(out) + "\n"


def coverage_line(mapped: int, unmapped: dict[str, int], skipped: dict[str, int] | None = None, gaps: list[str] = ()) -> str:
    """How much of a tree is mapped, in one line: the four commonest unmapped extensions, why files were skipped, and gaps."""
    left = sum(unmapped.values())
    percent = round(100 * mapped / (mapped + left), 1) if mapped + left else 100.0
    parts = [f"{percent}% of {mapped + left} files mapped"]
    if unmapped:
        parts.append("unmapped: " + ", ".join(f"{e} {n}" for e, n in sorted(unmapped.items(), key=lambda x: (-x[1], x[0]))[:4]))
    if skipped:
        parts.append("skipped: " + ", ".join(f"{c} {n}" for c, n in sorted(skipped.items())))
    if gaps:
        parts.append("nothing found in: " + ", ".join(gaps))
    return "; ".join(parts)


def table(rows: list[dict]) -> str:
    """Rows as aligned columns."""
    if not rows:
        return "(nothing found)\n"
    names = list(rows[0])
    cells = [[str("" if r[n] is None else r[n]) for n in names] for r in rows]
    width = [max(len(n), *(len(c[i]) for c in cells)) for i, n in enumerate(names)]
    fmt = lambda c: "  ".join(x.ljust(w) for x, w in zip(c, width, strict=True)).rstrip()
    return "\n".join([fmt(names), fmt(["-" * w for w in width]), *map(fmt, cells)]) + "\n"
