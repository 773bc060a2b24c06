"""The assistant's server: JSON-RPC 2.0 over lines of standard input and output, as the public Model Context Protocol has it.

Tools are the calls of ``skein.api.tools``; resources are the whole map and the
files' imports; prompts ask for an overview and for entry points.  Indexes are
kept by root; a scan is written to the root's map so that the command line
finds it.
"""

from __future__ import annotations

import json
import os
import sys
from typing import IO

from pyspark.sql import SparkSession

from skein import __version__
from skein.api import CodeIndex, tools
from skein.cli import MAP
from skein.sources.listing import inside

PROTOCOL = "2024-11-05"
_TEXT, _NUMBER, _YES = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}
#: Arguments of each tool, and which must be given.
TOOLS = {
    "scan": ("Scan a tree and show its skeleton", {"depth": _NUMBER}, ()),
    "search": ("Ranked symbols by name", {"query": _TEXT, "limit": _NUMBER, "symbol_type": _TEXT, "pattern": _TEXT}, ("query",)),
    "read": ("Exact lines of a file", {"path": _TEXT, "first": _NUMBER, "last": _NUMBER, "context": _NUMBER}, ("path", "first", "last")),
    "lookup": ("Symbols with body and callers", {"query": _TEXT}, ("query",)),
    "stats": ("What the index holds", {}, ()),
    "hubs": ("Files that many import", {"threshold": _NUMBER, "top": _NUMBER}, ()),
    "dependencies": ("What a file imports and what imports it", {"path": _TEXT, "depth": _NUMBER}, ("path",)),
    "structure": ("Classes and members of a file", {"path": _TEXT, "private": _YES}, ("path",)),
}
RESOURCES = {"skein://map": "The whole map", "skein://imports": "What each file imports"}
PROMPTS = {
    "overview": "Scan {path}, list its hubs, follow the imports of the greatest, then describe its parts, what each does, and how closely they depend on each other.",
    "entry_points": "Scan {path}, search it for main, cli and app, read what is found, then say how the program starts and how to run it.",
}
NOTHING = ("", "[]", "null")


class AssistantServer:
    """Answers requests about the tree at ``root``; ``handle`` takes and gives decoded messages."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, os.path.realpath(root)
        self._index: CodeIndex | None = None

    @property
    def map_path(self) -> str:
        return os.path.join(self.root, MAP)

    def index(self) -> CodeIndex:
        """The index in hand, else the stored map, else a fresh scan."""
        if self._index is None:
            self._index = CodeIndex.load(self.spark, self.map_path) if os.path.exists(self.map_path) else self.scan()
        return self._index

    def scan(self) -> CodeIndex:
        self._index = CodeIndex.scan(self.spark, self.root)
        self._index.save(self.map_path)
        return self._index

    def call(self, name: str, arguments: dict) -> str:
        if name not in TOOLS:
            raise ValueError(f"no tool {name!r}")
        _, known, needed = TOOLS[name]
        if missing := [a for a in needed if a not in arguments]:
            raise ValueError(f"{name} needs {', '.join(missing)}")
        if unknown := sorted(set(arguments) - set(known)):
            raise ValueError(f"{name} knows no {', '.join(unknown)}")
        if "path" in arguments:
            inside(self.root, arguments["path"])
        index = self.scan() if name == "scan" else self.index()
        out = tools(index)[name](**arguments)
        note = index.health_note() if out.strip() in NOTHING else ""
        return f"{out}\n{note}" if note else out

    def resource(self, uri: str) -> str:
        if uri not in RESOURCES:
            raise ValueError(f"no resource {uri!r}")
        if uri.endswith("map"):
            return json.dumps(self.index().to_map(), ensure_ascii=False)
        found: dict[str, list] = {}
        for r in self.index().import_edges().orderBy("src_file", "dst_file").toLocalIterator():
            found.setdefault(r["src_file"], []).append(r["dst_file"])
        return json.dumps(found, ensure_ascii=False)

    def _answer(self, method: str, params: dict):
        if method == "initialize":
            return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}, "resources": {}, "prompts": {}}, "serverInfo": {"name": "skein", "version": __version__}}
        if method == "ping":
            return {}
        if method == "tools/list":
            return {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": list(r)}} for n, (d, p, r) in TOOLS.items()]}
        if method == "tools/call":
            try:
                return {"content": [{"type": "text", "text": self.call(params.get("name", ""), params.get("arguments") or {})}]}
            except (ValueError, TypeError, OSError) as e:
                return {"content": [{"type": "text", "text": str(e)}], "isError": True}
        if method == "resources/list":
            return {"resources": [{"uri": u, "name": n, "mimeType": "application/json"} for u, n in RESOURCES.items()]}
        if method == "resources/read":
            return {"contents": [{"uri": params["uri"], "mimeType": "application/json", "text": self.resource(params["uri"])}]}
        if method == "prompts/list":
            return {"prompts": [{"name": n, "arguments": [{"name": "path", "required": True}]} for n in PROMPTS]}
        if method == "prompts/get":
            said = PROMPTS[params["name"]].format(path=(params.get("arguments") or {}).get("path", self.root))
            return {"messages": [{"role": "user", "content": {"type": "text", "text": said}}]}
        raise LookupError(method)

    def handle(self, message: dict) -> dict | None:
        """The answer to a request; None for a notification."""
        if "id" not in message:
            return None
        answer = {"jsonrpc": "2.0", "id": message["id"]}
        try:
            return answer | {"result": self._answer(message.get("method", ""), message.get("params") or {})}
        except LookupError as e:
            code = -32602 if isinstance(e, KeyError) else -32601
            return answer | {"error": {"code": code, "message": f"not known: {e}"}}
        except ValueError as e:
            return answer | {"error": {"code": -32602, "message": str(e)}}

    def serve(self, requests: IO[str] = sys.stdin, answers: IO[str] = sys.stdout) -> None:
        """One message a line until the input ends."""
        for line in requests:
            if not line.strip():
                continue
            try:
                answer = self.handle(json.loads(line))
            except (ValueError, AttributeError) as e:
                answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
            if answer is not None:
                answers.write(json.dumps(answer, ensure_ascii=False) + "\n")
                answers.flush()


def main(argv: list[str] | None = None) -> None:
    root = (argv or sys.argv[1:] or ["."])[0]
    AssistantServer(SparkSession.builder.appName("skein").getOrCreate(), root).serve()


if __name__ == "__main__":
    main()
