"""Go."""

from __future__ import annotations

from .builder import Builder
from .lexer import Lexed

_NOT_CALLED = {"if", "for", "switch", "select", "return", "func", "range", "go", "defer", "case", "var", "const", "type", "map", "chan", "interface", "struct"}


class _Go:
    def __init__(self, source: str, path: str):
        self.x, self.out = Lexed(source, "go"), Builder(source, path)
        i, stop = 0, len(self.x.tokens)
        while i < stop:
            t = self.x.text(i)
            if t == "func":
                i = self.function(i, stop)
            elif t in ("type", "import", "const", "var"):
                i = self.group(t, i, stop)
            else:
                i = self.x.close.get(i, i) + 1

    def line(self, i: int) -> int:
        return self.out.line(self.x.tokens[i].start)

    def doc(self, first: int) -> str | None:
        return " ".join(r[2:].strip() for r in self.x.comments_before(self.x.tokens[first].start) if r.startswith("//")) or None

    def add(self, name: str, kind: str, first: int, last: int, parent: str | None = None, **more) -> str:
        last = min(last, len(self.x.tokens) - 1)
        visibility = "public" if name[:1].isupper() else "private"
        return self.out.symbol(name, kind, self.x.tokens[first].start, self.x.tokens[last].end, parent, **({"visibility": visibility, "doc": self.doc(first)} | more))

    def row_end(self, i: int, stop: int) -> int:
        """The last token of a spec: before ; or a line's end outside brackets."""
        while i + 1 < stop:
            if i in self.x.close:
                i = self.x.close[i]
            if i + 1 >= stop or self.x.text(i + 1) in (";", ")"):
                return min(i, stop - 1)
            joined = self.x.tokens[i].kind == "mark" and self.x.text(i) not in (")", "]", "}")
            if self.line(i + 1) > self.out.line(self.x.tokens[i].end - 1) and not joined:
                return i
            i += 1
        return stop - 1

    def function(self, i: int, stop: int) -> int:
        first, k, receiver, parent = i, i + 1, "", None
        if self.x.text(k) == "(":
            close = self.x.close[k]
            receiver = self.x.span(k, close) + " "
            words = [self.x.text(q) for q in range(k, close) if self.x.is_word(q)]
            kind_at = next((q for q in range(k + 1, close) if self.x.text(q) == "["), close)
            words = [self.x.text(q) for q in range(k, kind_at) if self.x.is_word(q)] or words
            parent = f"{self.out.path}:{words[-1]}" if words else None
            k = close + 1
        name = self.x.text(k)
        opened = self.x.close[k + 1] + 1 if self.x.text(k + 1) == "[" else k + 1
        if self.x.text(opened) != "(":
            return k + 1
        end = self.x.close[opened]
        brace = end + 1
        while brace < stop and not (self.x.text(brace) == "{" and self.x.text(brace - 1) not in ("interface", "struct")) and self.line(brace) <= self.out.line(self.x.tokens[brace - 1].end - 1):
            brace = self.x.close.get(brace, brace) + 1
        has_body = self.x.text(brace) == "{"
        last = self.x.close[brace] if has_body else brace - 1
        found = self.add(name, "method" if receiver else "function", first, last, parent, signature=receiver + self.x.span(opened, max(end, brace - 1)))
        for q in range(opened, brace):
            if self.x.is_word(q) and self.x.text(q)[:1].isupper():
                self.out.edge(found, self.x.text(q), "references", self.line(q))
        if has_body:
            self.uses(brace + 1, last, found)
        return last + 1

    def group(self, kind: str, i: int, stop: int) -> int:
        if self.x.text(i + 1) == "(":
            close, k = self.x.close[i + 1], i + 2
            while k < close:
                if self.x.text(k) == ";":
                    k += 1
                    continue
                end = self.row_end(k, close)
                getattr(self, f"{kind}_spec")(k, k, end)
                k = end + 1
            return close + 1
        end = self.row_end(i + 1, stop)
        getattr(self, f"{kind}_spec")(i, i + 1, end)
        return end + 1

    def import_spec(self, first: int, k: int, end: int) -> None:
        path = next((self.x.text(q).strip("\"`") for q in range(k, end + 1) if self.x.tokens[q].kind == "string"), "")
        if path:
            found = self.add(path, "import", k, end, None, signature=self.x.span(k, end), visibility="public", doc=None)
            self.out.edge(found, path.rsplit("/", 1)[-1], "imports", self.line(k))

    def type_spec(self, first: int, k: int, end: int) -> None:
        if not self.x.is_word(k):
            return
        at = k + 1
        if self.x.text(at) == "[" and self.x.is_word(at + 1) and self.x.text(at + 2) != "]":
            at = self.x.close[at] + 1
        shape = self.x.text(at)
        found = self.add(self.x.text(k), "class" if shape in ("struct", "interface") else "variable", first, end)
        if shape in ("struct", "interface") and self.x.text(at + 1) == "{":
            q, close = at + 2, self.x.close[at + 1]
            while q < close:
                row = self.row_end(q, close)
                alone = q + (self.x.text(q) == "*")
                last = alone
                while self.x.text(last + 1) == ".":
                    last += 2
                if self.x.is_word(alone) and (last == row or last < row and self.x.tokens[last + 1].kind == "string"):
                    self.out.edge(found, self.x.span(alone, last), "inherits", self.line(q))
                q = row + 1

    def const_spec(self, first: int, k: int, end: int) -> None:
        equals = next((q for q in range(k, end + 1) if self.x.text(q) == "="), end + 1)
        q, found = k, None
        while q <= end and self.x.is_word(q):
            found = self.add(self.x.text(q), "variable", first, end)
            if self.x.text(q + 1) != ",":
                break
            q += 2
        if found:
            self.uses(equals + 1, end + 1, found)

    var_spec = const_spec

    def uses(self, i: int, stop: int, source: str) -> None:
        """Calls and composite literals; function literals are not entered."""
        k = i
        while k < stop:
            t = self.x.text(k)
            if t == "func":
                while k < stop and self.x.text(k) != "{":
                    k = self.x.close.get(k, k) + 1 if self.x.text(k) != "{" else k
                k = self.x.close.get(k, k) + 1
                continue
            if t == "(" and k > i and self.x.is_word(k - 1) and self.x.text(k - 1) not in _NOT_CALLED:
                at = self.x.chain_before(k - 1, (".",))
                name = self.x.span(at, k - 1)
                self.out.edge(source, name, "calls", self.line(at))
            elif t == "{" and k > i and self.x.is_word(k - 1) and self.x.text(k - 1)[:1].isupper():
                self.out.edge(source, self.x.text(k - 1), "references", self.line(k - 1))
            k += 1


def extract_go(source: str, path: str) -> Builder:
    return _Go(source, path).out
