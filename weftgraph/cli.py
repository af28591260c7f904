"""python -m weftgraph.cli COMMAND ...: index, outline, refs, callees, impact, hierarchy, deps, search, stats, watch, serve, rag."""

from __future__ import annotations

import argparse
import json
import sys
import time

from . import render, session
from .api import HINT, TOOLS, CodeGraph
from .operators.graph import outline_lines

SLOWEST = 8


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftgraph")
    p.add_argument("--root", default=".")
    p.add_argument("--store")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index").add_argument("--force", action="store_true")
    for name in ("outline", "deps"):
        sub.add_parser(name).add_argument("file")
    for name in ("refs", "callees", "hierarchy", "impact"):
        c = sub.add_parser(name)
        c.add_argument("name")
        if name == "refs":
            c.add_argument("--kind")
        if name == "impact":
            c.add_argument("--depth", type=int, default=3)
    c = sub.add_parser("search")
    c.add_argument("query")
    c.add_argument("--kind")
    c.add_argument("--file")
    c.add_argument("--limit", type=int, default=30)
    sub.add_parser("stats")
    w = sub.add_parser("watch")
    w.add_argument("--interval", type=float, default=2.0)
    w.add_argument("--rag-delay", type=float, default=30.0)
    sub.add_parser("serve")
    rag = sub.add_parser("rag").add_subparsers(dest="rag", required=True)
    rag.add_parser("setup")
    rag.add_parser("index").add_argument("--force", action="store_true")
    c = rag.add_parser("search")
    c.add_argument("query")
    c.add_argument("--kind")
    c.add_argument("--limit", type=int, default=10)
    return p


def serve(graph: CodeGraph, lines=sys.stdin, out=sys.stdout) -> None:
    """A line of JSON {"tool": ..., "options": {...}} in, a line of JSON out."""
    for line in lines:
        if line.strip():
            try:
                asked = json.loads(line)
                answer = graph.call(asked["tool"], **asked.get("options", {}))
            except Exception as e:
                answer = json.dumps({"error": str(e)})
            print(answer, file=out, flush=True)


def watch(graph: CodeGraph, interval: float, rag_delay: float, turns: int | None = None) -> None:
    """Re-indexes changed files every interval; embeds what is pending once nothing has changed for rag_delay seconds. The
    wait doubles, up to SLOWEST intervals, while nothing changes and nothing is pending."""
    pending, last, slow = False, time.monotonic(), 1
    try:
        while turns is None or turns > 0:
            done = graph.index()
            if done["indexed"] or done["removed"]:
                pending, last, slow = True, time.monotonic(), 1
                print(json.dumps(done), flush=True)
            elif pending and time.monotonic() - last >= rag_delay:
                graph.rag_index()
                pending = False
            elif not pending:
                slow = min(2 * slow, SLOWEST)
            turns = None if turns is None else turns - 1
            time.sleep(interval * slow if turns is None or turns else 0)
    except KeyboardInterrupt:
        pass
    finally:
        if pending:
            graph.rag_index()


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    graph = CodeGraph(spark or session.local(), a.root, a.store)
    options = {k: v for k, v in vars(a).items() if k not in ("root", "store", "json", "command", "rag")}
    if a.command == "watch":
        watch(graph, options["interval"], options["rag_delay"])
        return 0
    if a.command == "serve":
        serve(graph)
        return 0
    if a.command == "rag" and a.rag == "setup":
        print("The default embedder needs no download.")
        return 0
    tool = f"rag_{a.rag}" if a.command == "rag" else a.command
    assert tool in TOOLS
    if a.command == "outline" and not a.json:
        for r in outline_lines(graph.store.read("symbols"), a.file).collect():
            print(r["line"])
        return 0
    if a.json or tool not in render.LINES:
        print(json.dumps(json.loads(graph.call(tool, **options)), indent=2, ensure_ascii=False))
        return 0
    found = [r["text"] for r in render.lines(tool, graph.found(tool, **options)).select("text").collect()]
    asked = next(iter(options.values()), None)
    print("\n".join(found) if found else f"{render.EMPTY.get(tool, 'Nothing')} found for {asked!r}")
    if not found and graph.store.version() == 0:
        print(HINT)
    return 0


if __name__ == "__main__":
    sys.exit(main())
