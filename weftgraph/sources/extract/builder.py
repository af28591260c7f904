"""What extractors fill: rows in the shape of the symbols, edges and symbol_content tables."""

from __future__ import annotations

import bisect

import numpy as np

MOST_BYTES, LEAST_BYTES = 2048, 50


class Builder:
    def __init__(self, source: str, path: str):
        self.source, self.path = source, path
        self.symbols: list[dict] = []
        self.edges: list[dict] = []
        self._ascii = source.isascii()
        self._data = None if self._ascii else source.encode()
        self._bytes = None
        if not self._ascii:
            codes = np.frombuffer(source.encode("utf-32-le", "surrogatepass"), np.uint32)
            self._bytes = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))])
        self._lines = [0, *(i + 1 for i, c in enumerate(source) if c == "\n")]

    def line(self, at: int) -> int:
        return bisect.bisect_right(self._lines, at)

    def byte(self, at: int) -> int:
        return at if self._ascii else int(self._bytes[min(at, len(self.source))])

    def symbol(self, name: str, kind: str, start: int, end: int, parent: str | None = None, signature: str | None = None, visibility: str = "public", is_async: bool = False, doc: str | None = None, end_line: int | None = None) -> str:
        """Places are in characters; the row holds lines and UTF-8 bytes. Returns the symbol's id."""
        line = self.line(start)
        found = f"{self.path}:{name}:{line}"
        last = end_line or (line if kind == "import" else self.line(max(start, end - 1)))
        self.symbols.append(
            {"id": found, "name": name, "kind": kind, "file_path": self.path, "start_line": line, "end_line": last, "start_byte": self.byte(start), "end_byte": self.byte(end), "parent_id": parent, "signature": signature, "visibility": visibility, "is_async": is_async, "docstring": doc or None}
        )
        return found

    def edge(self, source: str | None, target: str, kind: str, line: int) -> None:
        if source and target:
            self.edges.append({"source_id": source, "target_name": target, "target_id": None, "kind": kind, "file_path": self.path, "line": line})

    def contents(self, normalize) -> list[dict]:
        """A row for every symbol but imports: its text, at most MOST_BYTES bytes of whole characters."""
        data, out = self._data if self._data is not None else self.source.encode(), []
        for s in self.symbols:
            if s["kind"] != "import":
                cut = data[s["start_byte"] : min(s["end_byte"], s["start_byte"] + MOST_BYTES)].decode("utf-8", "ignore")
                if len(cut.strip().encode()) >= LEAST_BYTES:
                    head = f"// File: {self.path}\n// Type: {s['kind']}\n// Name: {s['name']}"
                    out.append({"symbol_id": s["id"], "content": cut, "header": head, "normalized_name": normalize(s["name"])})
        return out
