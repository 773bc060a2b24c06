"""Command line: map, search, read, stats, watch, export, completion."""

from __future__ import annotations

import argparse
import json
import sys

from skein import __version__

MAP = ".skein.json"
COMMANDS = ("map", "search", "read", "stats", "watch", "export", "completion")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skein")
    p.add_argument("-v", "--version", action="version", version=f"%(prog)s {__version__}")
    p.add_argument("--no-color", action="store_true", help="no effect: output is never coloured")
    sub = p.add_subparsers(dest="command", required=True)
    m = sub.add_parser("map", aliases=["scan"])
    w = sub.add_parser("watch")
    for q in (m, w):
        q.add_argument("path")
        q.add_argument("-o", "--output", default=MAP)
        q.add_argument("-i", "--ignore", nargs="*")
        q.add_argument("--git-only", action="store_true")
        q.add_argument("--use-gitignore", action="store_true")
        q.add_argument("--compact", action="store_true")
        q.add_argument("--max-symbol-lines", type=int, default=500)
    m.add_argument("--incremental", action="store_true")
    w.add_argument("--debounce", type=float, default=1.0)
    s = sub.add_parser("search")
    s.add_argument("query", nargs="?")
    s.add_argument("-t", "--type")
    s.add_argument("-f", "--file")
    s.add_argument("--files", action="store_true")
    s.add_argument("--structure")
    s.add_argument("--deps")
    s.add_argument("--stats", action="store_true")
    s.add_argument("--check-stale", action="store_true")
    s.add_argument("--warn-stale", action="store_true")
    s.add_argument("--since-commit")
    s.add_argument("-l", "--limit", type=int, default=10)
    s.add_argument("--no-fuzzy", action="store_true")
    t = sub.add_parser("stats")
    for q in (s, t):
        q.add_argument("-o", "--output", choices=["json", "table"], default="json")
        q.add_argument("--compact", action="store_true")
    r = sub.add_parser("read")
    r.add_argument("file")
    r.add_argument("lines", nargs="?")
    r.add_argument("-c", "--context", type=int, default=0)
    r.add_argument("-s", "--search")
    r.add_argument("-o", "--output", choices=["json", "code"], default="json")
    e = sub.add_parser("export")
    e.add_argument("-f", "--format", default="markdown")
    e.add_argument("-o", "--output")
    for q in (s, t, r, e):
        q.add_argument("-m", "--map", default=MAP)
    c = sub.add_parser("completion")
    c.add_argument("shell", choices=["bash", "zsh"])
    return p


def completion(shell: str) -> str:
    """A script that completes commands, and the flags of the command typed."""
    p = parser()
    commands = next(a for a in p._actions if isinstance(a, argparse._SubParsersAction)).choices
    flags = {name: sorted(o for a in q._actions for o in a.option_strings) for name, q in commands.items()}
    words = " ".join(commands)
    if shell == "bash":
        cases = "\n".join(f'    {name}) COMPREPLY=($(compgen -W "{" ".join(f)}" -- "$word"));;' for name, f in flags.items())
        return (
            "_skein() {\n  local word=${COMP_WORDS[COMP_CWORD]}\n"
            f'  if [ "$COMP_CWORD" -eq 1 ]; then COMPREPLY=($(compgen -W "{words}" -- "$word")); return; fi\n'
            f"  case ${{COMP_WORDS[1]}} in\n{cases}\n  esac\n}}\ncomplete -o default -F _skein skein\n"
        )
    cases = "\n".join(f"    {name}) compadd -- {' '.join(f)};;" for name, f in flags.items())
    return f"#compdef skein\nif (( CURRENT == 2 )); then\n  compadd -- {words}\nelse\n  case ${{words[2]}} in\n{cases}\n  esac\n  _files\nfi\n"


def _show(rows: list[dict], args) -> None:
    from skein.render.text import table

    print(table(rows) if args.output == "table" else json.dumps(rows, ensure_ascii=False, default=str, indent=None if args.compact else 2))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "completion":
        print(completion(args.shell), end="")
        return 0
    import os

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from skein.api import CodeIndex
    from skein.functions.patterns import parse_line_spec
    from skein.operators import diff, lines, search
    from skein.render.text import coverage_line, export
    from skein.sources.ignore import DEFAULT_RULES

    spark = SparkSession.builder.appName("skein").getOrCreate()
    if args.command in ("map", "scan", "watch"):
        options = {"ignore": (DEFAULT_RULES.split() + args.ignore) if args.ignore else None, "use_gitignore": args.use_gitignore, "git_only": args.git_only}

        def build() -> CodeIndex:
            if getattr(args, "incremental", args.command == "watch") and os.path.exists(args.output):
                return CodeIndex(spark, None, None, args.path).rescan(args.output, **options)
            return CodeIndex.scan(spark, args.path, max_symbol_lines=args.max_symbol_lines, **options)

        index = build()
        out = index.save(args.output, compact=args.compact)
        print(f"{out['stats']['files_processed']} files, {out['stats']['symbols_found']} symbols -> {args.output}", file=sys.stderr)
        if args.command == "watch":
            from skein.functions.paths import content_hash
            from skein.sources import listing
            from skein.sources.tables import ensure_checkpoint_dir
            from skein.streaming.watch import Watcher

            snapshot = lambda: listing.read_files(listing.list_tree(spark, args.path, **options), args.path).select("file_path", content_hash(F.col("content")).alias("hash"))
            state = f"{ensure_checkpoint_dir(spark)}/watch-{os.getpid()}"
            Watcher(spark, snapshot, state, lambda changes: build().save(args.output, compact=args.compact), quiet=args.debounce).start().awaitTermination()
            return 0
        gaps = diff.coverage_gaps(diff.coverage_by_language(index.files, index.symbols)).collect()
        for g in gaps:
            print(f"no symbols found in {g['files']} files of {g['language']}", file=sys.stderr)
        causes = {k.removeprefix("skipped_"): v for k, v in index.stats.items() if k.startswith("skipped_")}
        print(coverage_line(out["stats"]["files_processed"], index.stats.get("unmapped_extensions", {}), causes, [g["language"] for g in gaps]), file=sys.stderr)
        return 2 if gaps else 0
    if not os.path.exists(args.map):
        print(f"no map at {args.map}; make one with: skein map PATH", file=sys.stderr)
        return 1
    index = CodeIndex.load(spark, args.map)
    if args.command == "export":
        body = export(index.to_map(), args.format)
        if args.output:
            with open(args.output, "w", encoding="utf-8") as f:
                f.write(body)
        else:
            print(body, end="")
        return 0
    if args.command == "read":
        if args.search:
            path = index.path_of(args.file) or args.file
            found = lines.grep_first(lines.file_texts(index.contents().where(F.col("file_path") == path)), args.search, context=args.context).orderBy("num")
        else:
            found = index.read(args.file, parse_line_spec(args.lines or "1-50"), context=args.context)
        rows = [r.asDict() for r in found.collect()]
        print("\n".join(f"{r['num']:>5}  {r['content']}" for r in rows) if args.output == "code" else json.dumps(rows, ensure_ascii=False))
        return 0
    if getattr(args, "warn_stale", False):
        n = index.stale().count()
        if n:
            print(f"{n} files changed since the map was made", file=sys.stderr)
    if args.command == "stats" or args.stats:
        found = search.stats_by_type(index.symbols).orderBy("type")
    elif args.check_stale:
        found = index.stale().orderBy("file_path")
    elif args.since_commit:
        found = index.since(args.since_commit).select("file_path", "name", "type", "line_start").orderBy("file_path", "line_start")
    elif args.structure:
        found = index.structure(args.structure).orderBy("class_line", "member_line")
    elif args.deps:
        found = search.dependencies_of(index.symbols, args.deps).orderBy("direction", "file_path", "name")
    elif args.files:
        found = search.search_files(index.symbols, args.query or "", limit=args.limit).orderBy("file_path", "type")
    elif args.query is None and args.type:
        found = search.list_by_type(index.symbols, args.type, file_pattern=args.file, limit=args.limit)
    else:
        found = index.search(args.query or "", symbol_type=args.type, file_pattern=args.file, limit=args.limit, fuzzy=not args.no_fuzzy)
    _show([r.asDict() for r in found.collect()], args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
