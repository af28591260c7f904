"""Rust."""

from __future__ import annotations

from .builder import Builder
from .lexer import Lexed

_NOT_CALLED = {"if", "while", "for", "match", "return", "fn", "loop", "in", "as", "move", "let", "where", "impl"}
_HEAD = {"pub", "async", "const", "unsafe", "extern", "default"}
_JOINS = (".", "::", "?")


class _Rust:
    def __init__(self, source: str, path: str):
        self.x, self.out = Lexed(source, "rust"), Builder(source, path)
        self.items(0, len(self.x.tokens), None)

    def line(self, i: int) -> int:
        return self.out.line(self.x.tokens[i].start)

    def doc(self, first: int) -> str | None:
        at = first
        while self.x.text(at - 1) == "]":  # attributes stand between
            opened = next((o for o, c in self.x.close.items() if c == at - 1), None)
            if opened is None or self.x.text(opened - 1) != "#":
                break
            at = opened - 1
        rows = self.x.comments_before(self.x.tokens[at].start) or self.x.comments_before(self.x.tokens[first].start)
        return " ".join(r[3:].strip() for r in rows if r.startswith("///")) or None

    def add(self, name: str, kind: str, first: int, last: int, parent: str | None, **more) -> str:
        visibility = "public" if self.x.text(first) == "pub" else "private"
        last = min(last, len(self.x.tokens) - 1)
        return self.out.symbol(name, kind, self.x.tokens[first].start, self.x.tokens[last].end, parent, **({"visibility": visibility, "doc": self.doc(first)} | more))

    def end(self, i: int, stop: int) -> int:
        """The ; or closing brace that ends the item."""
        while i < stop:
            if self.x.text(i) == ";":
                return i
            if self.x.text(i) == "{":
                return self.x.close[i]
            i = self.x.close.get(i, i) + 1
        return stop - 1

    def semicolon(self, i: int, stop: int) -> int:
        while i < stop and self.x.text(i) != ";":
            i = self.x.close.get(i, i) + 1
        return min(i, stop - 1)

    def type_name(self, i: int, stop: int) -> tuple[str, int]:
        """The last segment of a path, without references and generics, and the token after it."""
        while i < stop and (self.x.text(i) in ("&", "*", "mut", "dyn", "const") or self.x.text(i).startswith("'")):
            i += 1
        name = ""
        while i < stop and self.x.is_word(i):
            name = self.x.text(i)
            i = self.x.after_generics(i + 1)
            if self.x.text(i) != "::":
                break
            i += 1
        return name, i

    def items(self, i: int, stop: int, parent: str | None, kind: str = "function") -> None:
        while i < stop:
            if self.x.text(i) == "#":
                k = i + 1 + (self.x.text(i + 1) == "!")
                i = self.x.close.get(k, k) + 1
                continue
            first = i
            while self.x.text(i) in _HEAD and not (self.x.text(i) == "const" and self.x.text(i + 1) not in ("fn", "unsafe", "async", "extern")):
                i += 1
                i = self.x.close[i] + 1 if self.x.text(i) == "(" and i in self.x.close else i
                i += i < stop and self.x.tokens[i].kind == "string"
            t = self.x.text(i)
            if t == "fn":
                i = self.function(first, i, stop, parent, kind)
            elif t in ("struct", "enum", "trait", "union") and self.x.is_word(i + 1):
                last = self.end(i, stop)
                found = self.add(self.x.text(i + 1), "class", first, last, parent)
                brace = next((k for k in range(i, last) if self.x.text(k) == "{"), None)
                if t == "trait" and brace is not None:
                    self.items(brace + 1, self.x.close[brace], found, "method")
                i = last + 1
            elif t == "impl":
                i = self.impl(first, i, stop)
            elif t == "use":
                i = self.use(first, i, stop, parent)
            elif t == "mod" and self.x.is_word(i + 1):
                if self.x.text(i + 2) == "{":
                    last = self.x.close[i + 2]
                    found = self.add(self.x.text(i + 1), "class", first, last, parent)
                    self.items(i + 3, last, found, "method")
                    i = last + 1
                else:
                    i += 3
            elif t in ("const", "static"):
                last = self.semicolon(i, stop)
                at = i + 1 + (self.x.text(i + 1) == "mut")
                found = self.add(self.x.text(at), "variable", first, last, parent)
                self.uses(at, last, found)
                i = last + 1
            elif t == "type" and self.x.is_word(i + 1):
                last = self.semicolon(i, stop)
                self.add(self.x.text(i + 1), "variable", first, last, parent)
                i = last + 1
            else:
                i = self.end(i, stop) + 1

    def function(self, first: int, i: int, stop: int, parent: str | None, kind: str) -> int:
        name, opened = self.x.text(i + 1), self.x.after_generics(i + 2)
        last = self.end(opened, stop)
        brace = next((k for k in range(opened, last) if self.x.text(k) == "{" and k in self.x.close and self.x.close[k] == last), last)
        where = next((k for k in range(opened, brace) if self.x.text(k) == "where"), brace)
        head = self.x.span(opened, where - 1) if self.x.text(opened) == "(" else "()"
        is_async = "async" in (self.x.text(k) for k in range(first, i))
        found = self.add(name, "method" if parent else "function", first, last, parent, signature=head, is_async=is_async)
        for k in range(opened, where):
            if self.x.is_word(k) and self.x.text(k)[:1].isupper() and self.x.text(k + 1) != "::" and self.x.text(k) != "Self":
                self.out.edge(found, self.x.text(k), "references", self.line(k))
        if brace < last:
            self.uses(brace + 1, last, found)
        return last + 1

    def impl(self, first: int, i: int, stop: int) -> int:
        last = self.end(i, stop)
        brace = next((k for k in range(i, last) if self.x.text(k) == "{"), last)
        name, k = self.type_name(self.x.after_generics(i + 1), brace)
        trait = ""
        if self.x.text(k) == "for":
            trait = name
            name, _ = self.type_name(k + 1, brace)
        if name:
            found = self.add(name, "class", first, last, None, visibility="public", doc=None)
            self.out.edge(found, trait, "inherits", self.line(first))
            k = brace + 1
            while k < last:  # functions only; consts and types of an impl are no symbols
                start = k
                while self.x.text(k) == "#":
                    k = self.x.close.get(k + 1, k + 1) + 1
                    start = k
                while self.x.text(k) in _HEAD:
                    k += 1
                    k = self.x.close[k] + 1 if self.x.text(k) == "(" and k in self.x.close else k
                k = self.function(start, k, last, found, "method") if self.x.text(k) == "fn" else self.end(k, last) + 1
        return last + 1

    def use(self, first: int, i: int, stop: int, parent: str | None) -> int:
        last = self.semicolon(i, stop)
        brace = next((k for k in range(i, last) if self.x.text(k) == "{"), None)
        leaves: list[int] = []
        for k in range(i + 1, last):
            if self.x.is_word(k) and self.x.text(k + 1) != "::" and self.x.text(k - 1) != "as" and self.x.text(k) != "as":
                leaves.append(k)
        stop_at = brace - 1 if brace is not None else last
        path = "".join(self.x.text(k) for k in range(i + 1, stop_at)).removesuffix("::")
        if brace is None:
            words = [k for k in range(i + 1, last) if self.x.text(k) == "as"]
            if words:
                path = "".join(self.x.text(k) for k in range(i + 1, words[0]))
            path = path.removesuffix("::*")
        if path:
            found = self.add(path, "import", first, last, parent, signature=self.x.span(first, last), visibility="public", doc=None)
            for k in leaves:
                self.out.edge(found, self.x.text(k), "imports", self.line(first))
        return last + 1

    def uses(self, i: int, stop: int, source: str) -> None:
        """Calls and macros; closures and nested functions are not entered."""
        k = i
        while k < stop:
            t = self.x.text(k)
            if t in ("|", "||") and self.x.text(k - 1) in ("(", ",", "=", "move", "return", "{", ";", "=>"):
                k += 1
                if t == "|":
                    while k < stop and self.x.text(k) != "|":
                        k = self.x.close.get(k, k) + 1
                    k += 1
                k = self.x.close[k] + 1 if self.x.text(k) == "{" else self.closure_end(k, stop)
                continue
            if t == "fn" and self.x.is_word(k + 1):
                k = self.end(k, stop) + 1
                continue
            if t == "!" and self.x.is_word(k - 1) and self.x.text(k + 1) in ("(", "[", "{"):
                self.out.edge(source, self.x.text(k - 1) + "!", "calls", self.line(k - 1))
            elif t == "(" and k > i and self.x.is_word(k - 1) and self.x.text(k - 1) not in _NOT_CALLED:
                at = self.x.chain_before(k - 1, _JOINS)
                self.out.edge(source, self.x.span(at, k - 1), "calls", self.line(at))
            elif t == "(" and self.x.text(k - 1) == ">" and k > i:  # a turbofish
                opened = k - 1
                depth = 0
                while opened > i:
                    depth += {">": 1, "<": -1}.get(self.x.text(opened), 0)
                    if depth == 0:
                        break
                    opened -= 1
                if self.x.text(opened - 1) == "::" and self.x.is_word(opened - 2):
                    at = self.x.chain_before(opened - 2, _JOINS)
                    self.out.edge(source, self.x.span(at, opened - 2), "calls", self.line(at))
            k += 1

    def closure_end(self, k: int, stop: int) -> int:
        while k < stop and self.x.text(k) not in (",", ";", ")", "]", "}"):
            k = self.x.close.get(k, k) + 1
        return k


def extract_rust(source: str, path: str) -> Builder:
    return _Rust(source, path).out
