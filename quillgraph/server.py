"""A tool server over standard input and output: one JSON-RPC message a line."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterable
from typing import Any, TextIO

from quillgraph.service import EXPLORE_MODES, SEARCH_MODES, KnowledgeBase

PROTOCOL = "2024-11-05"
_TEXT, _NUMBER = {"type": "string"}, {"type": "integer"}
TOOLS: dict[str, dict[str, Any]] = {
    "search": {"text": _TEXT, "embedding": {"type": "array"}, "mode": {"enum": list(SEARCH_MODES)}, "top_k": _NUMBER, "session_id": _TEXT},
    "explore": {"mode": {"enum": list(EXPLORE_MODES)}, "entity_type": _TEXT, "name": _TEXT, "pattern": _TEXT, "depth": _NUMBER, "max_depth": _NUMBER},
    "read": {"doc_id": _TEXT, "chapter": _TEXT, "regex": _TEXT, "concept": _TEXT, "top_k": _NUMBER},
    "status": {"scope": _TEXT, "top_n": _NUMBER, "session_id": _TEXT},
    "ingest": {"path": _TEXT},
    "remove_document": {"doc_id": _TEXT},
    "clean_logs": {"days": _NUMBER, "most": _NUMBER},
}


def _rows(result: Any, most: int = 1000) -> list[dict]:
    """The rows of a result; a table with more than ``most`` ends with a row that says so."""
    frames = result if isinstance(result, tuple) else [result] if result is not None else []
    out: list[dict] = []
    for frame in frames:
        lines = frame.limit(most + 1).toJSON().collect()
        out += [json.loads(line) for line in lines[:most]]
        if len(lines) > most:
            out.append({"truncated": True, "shown": most})
    return out


def call(kb: KnowledgeBase, tool: str, arguments: dict[str, Any]) -> list[dict]:
    """Run a tool; at most a thousand rows of a table are shown, and a last row says if there are more."""
    given = dict(arguments)
    if tool not in TOOLS:
        raise ValueError(f"unknown tool {tool}")
    if tool == "search":
        queries = kb.spark.createDataFrame([(0, given.pop("text"), given.pop("embedding", None))], "qid long, text string, embedding array<float>")
        return _rows(kb.search(queries, **given))
    if tool == "ingest":
        files = kb.spark.read.text(given["path"], wholetext=True).selectExpr("input_file_name() AS source_path", "value AS text")
        return _rows(kb.ingest(files))
    return _rows(getattr(kb, tool)(**given))


def answer(kb: KnowledgeBase, message: dict[str, Any]) -> dict[str, Any] | None:
    """The answer to a message; None to a notification."""
    if "id" not in message:
        return None
    methods: dict[str, Callable[[dict], Any]] = {
        "initialize": lambda p: {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "quillgraph", "version": "0.1.0"}},
        "ping": lambda p: {},
        "tools/list": lambda p: {"tools": [{"name": n, "inputSchema": {"type": "object", "properties": s}} for n, s in TOOLS.items()]},
        "tools/call": lambda p: {"content": [{"type": "text", "text": json.dumps(call(kb, p["name"], p.get("arguments", {})), ensure_ascii=False)}]},
    }
    base = {"jsonrpc": "2.0", "id": message["id"]}
    run = methods.get(message.get("method", ""))
    if run is None:
        return base | {"error": {"code": -32601, "message": f"no method {message.get('method')}"}}
    try:
        return base | {"result": run(message.get("params") or {})}
    except Exception as e:  # a failed tool is an answer, not the end of the server
        return base | {"result": {"content": [{"type": "text", "text": str(e)[:2000]}], "isError": True}}


def serve(kb: KnowledgeBase, lines: Iterable[str] = sys.stdin, out: TextIO = sys.stdout) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError:
            reply: dict[str, Any] | None = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
        else:
            reply = answer(kb, message)
        if reply is not None:
            print(json.dumps(reply, ensure_ascii=False), file=out, flush=True)


def main(argv: list[str]) -> None:
    """``python -m quillgraph.server PATH``"""
    from quillgraph.session import get_session

    serve(KnowledgeBase(get_session(), argv[0]))


if __name__ == "__main__":
    main(sys.argv[1:])
