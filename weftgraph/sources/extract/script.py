"""JavaScript, TypeScript and TSX."""

from __future__ import annotations

from .builder import Builder
from .lexer import Lexed

_NOT_CALLED = {"if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "super", "import", "with", "void", "delete", "in", "of", "constructor"}
_MODIFIERS = {"export", "default", "declare", "abstract", "public", "private", "protected", "static", "readonly", "async", "override", "get", "set", "accessor"}
_JOINS = (".", "?.", "!")


class _Script:
    def __init__(self, source: str, path: str):
        self.x, self.out = Lexed(source, "script"), Builder(source, path)
        self.block(0, len(self.x.tokens), None)

    def doc(self, i: int) -> str | None:
        found = self.x.comments_before(self.x.tokens[i].start)
        if found and found[-1].startswith("/**"):
            rows = (r.strip().lstrip("*").strip() for r in found[-1][3:-2].splitlines())
            return " ".join(r for r in rows if r and not r.startswith("@")) or None
        return None

    def end_of(self, i: int, stop: int) -> int:
        """The last token of the statement that begins at i."""
        line = self.out.line
        while i < stop:
            t = self.x.text(i)
            if t == ";":
                return i
            if i in self.x.close:
                i = self.x.close[i]
            following = i + 1
            if following >= stop:
                return i
            a, b = self.x.tokens[i], self.x.tokens[following]
            if line(b.start) > line(a.end - 1) and not (a.kind == "mark" and a.text not in ")]}") and not (b.kind == "mark" and b.text not in "({[@#" or b.text in ("from", "extends", "as")):
                return i
            i = following
        return stop - 1

    def block(self, i: int, stop: int, parent: str | None) -> None:
        while i < stop:
            first, words = i, set()
            while self.x.text(i) == "@":  # decorators
                i += 2
                while self.x.text(i) == ".":
                    i += 2
                if self.x.text(i) == "(":
                    i = self.x.close[i] + 1
            while self.x.text(i) in _MODIFIERS and (self.x.is_word(i + 1) or self.x.text(i + 1) == "*"):
                words.add(self.x.text(i))
                i += 1
            t = self.x.text(i)
            if t == "import" and self.x.text(i + 1) not in ("(", "."):
                i = self.imports(i, stop, parent)
            elif t == "function":
                i = self.function(first, i, stop, parent, words)
            elif t == "class" and self.x.is_word(i + 1):
                i = self.klass(first, i, stop, parent)
            elif t == "interface" and self.x.is_word(i + 1):
                i = self.interface(first, i, stop, parent)
            elif t == "enum" or t == "const" and self.x.text(i + 1) == "enum":
                at = i + 1 + (t == "const")
                end = self.x.close.get(at + 1, at)
                self.symbol(self.x.text(at), "class", first, end, parent)
                i = end + 1
            elif t == "type" and self.x.is_word(i + 1) and self.x.text(self.x.after_generics(i + 2)) == "=":
                end = self.end_of(i, stop)
                self.symbol(self.x.text(i + 1), "variable", first, end, parent)
                i = end + 1
            elif t in ("const", "let", "var"):
                i = self.declared(first, i, stop, parent)
            elif t in ("namespace", "module") and self.x.is_word(i + 1) and self.x.text(i + 2) == "{":
                self.block(i + 3, self.x.close[i + 2], parent)
                i = self.x.close[i + 2] + 1
            else:
                i = max(self.end_of(i, stop), i) + 1

    def symbol(self, name: str, kind: str, first: int, last: int, parent: str | None, **more) -> str:
        last = min(last, len(self.x.tokens) - 1)
        return self.out.symbol(name, kind, self.x.tokens[first].start, self.x.tokens[last].end, parent, doc=self.doc(first), **more)

    def imports(self, i: int, stop: int, parent: str | None) -> int:
        end = self.end_of(i, stop)
        module = next((self.x.tokens[k].text.strip("'\"`") for k in range(end, i, -1) if self.x.tokens[k].kind == "string"), "")
        if not module:
            return end + 1
        names, k = [], i + 1
        while k <= end and self.x.tokens[k].kind != "string" and self.x.text(k) != "from":
            if self.x.text(k) == "{":
                inside, take = self.x.close[k], True
                for j in range(k + 1, inside):
                    if self.x.text(j) == ",":
                        take = True
                    elif take and self.x.is_word(j) and not (self.x.text(j) == "type" and self.x.is_word(j + 1)):
                        names.append(self.x.text(j))
                        take = False
                k = inside
            elif self.x.is_word(k) and self.x.text(k) not in ("type", "as"):
                names.append(self.x.text(k))
            k += 1
        found = self.symbol(module, "import", i, end, parent, signature=self.x.span(i, end))
        for name in names:
            self.out.edge(found, name, "imports", self.out.line(self.x.tokens[i].start))
        return end + 1

    def signature(self, opened: int) -> tuple[str, int, int]:
        """Text of (params): result, and the tokens of its end and of the body's brace or -1."""
        close = self.x.close[opened]
        k, end = close + 1, close
        if self.x.text(k) == ":":
            k += 1
            while k < len(self.x.tokens) and self.x.text(k) not in ("{", "=>", ";", "="):
                k = self.x.close.get(k, k) + 1
            if self.x.text(k) == "{" and self.x.text(k - 1) in (":", "|", "&"):
                k = self.x.close[k] + 1
            end = k - 1
        return self.x.span(opened, end), end, k

    def types(self, start: int, stop: int, source: str) -> None:
        after = False
        for k in range(start, stop):
            t = self.x.text(k)
            after = after or t == ":" or t == "<"
            if t == ",":
                after = self.x.text(k - 1) != ":" and after
            if after and self.x.is_word(k) and t[:1].isupper() and self.x.text(k - 1) != ".":
                self.out.edge(source, t, "references", self.out.line(self.x.tokens[k].start))

    def function(self, first: int, i: int, stop: int, parent: str | None, words: set[str]) -> int:
        at = i + 1 + (self.x.text(i + 1) == "*")
        if not self.x.is_word(at):
            return self.end_of(i, stop) + 1
        opened = self.x.after_generics(at + 1)
        if self.x.text(opened) != "(":
            return at + 1
        return self.callable(self.x.text(at), "function", first, opened, parent, "async" in words, "public")

    def callable(self, name: str, kind: str, first: int, opened: int, parent: str | None, is_async: bool, visibility: str) -> int:
        text, end, body = self.signature(opened)
        last = self.x.close[body] if self.x.text(body) == "{" else end
        found = self.symbol(name, kind, first, last, parent, signature=text, is_async=is_async, visibility=visibility)
        self.types(opened, end + 1, found)
        if self.x.text(body) == "{":
            self.uses(body + 1, last, found)
            self.nested(body + 1, last, found)
        return last + 1

    def nested(self, i: int, stop: int, parent: str) -> None:
        """Functions declared in a body are symbols of their own."""
        while i < stop:
            if self.x.text(i) == "function" and self.x.is_word(i + 1):
                i = self.function(i, i, stop, parent, {"async"} if self.x.text(i - 1) == "async" else set())
            elif self.x.text(i) == "class" and self.x.is_word(i + 1):
                i = self.klass(i, i, stop, parent)
            else:
                i += 1

    def arrow(self, i: int) -> int | None:
        """The opening parenthesis, or single word, of the arrow function that begins at token i."""
        i += self.x.text(i) == "async"
        i = self.x.after_generics(i)
        if self.x.text(i) == "(":
            _, _, k = self.signature(i)
            return i if self.x.text(k) == "=>" else None
        return i if self.x.is_word(i) and self.x.text(i + 1) == "=>" else None

    def declared(self, first: int, i: int, stop: int, parent: str | None) -> int:
        end = self.end_of(i, stop)
        k = i + 1
        while k <= end and self.x.is_word(k):
            name, j = self.x.text(k), k + 1
            if self.x.text(j) in (":", "!"):
                while j <= end and self.x.text(j) not in ("=", ",", ";"):
                    j = self.x.close.get(j, j) + 1
            last = j
            while last <= end and self.x.text(last) not in (",", ";"):
                last = self.x.close.get(last, last) + 1
            head = self.arrow(j + 1) if self.x.text(j) == "=" else None
            plain = self.x.text(j) == "=" and "function" in (self.x.text(j + 1), self.x.text(j + 2)) and self.x.text(j + 1) in ("function", "async")
            if head is not None or plain:
                opened = head if head is not None else next((q for q in range(j, end) if self.x.text(q) == "("), j)
                is_param = self.x.is_word(opened)
                text, params_end, body = (self.x.text(opened), opened, opened + 1) if is_param else self.signature(opened)
                found = self.symbol(name, "function", first, min(last, end), parent, signature=text, is_async=self.x.text(j + 1) == "async")
                self.types(opened, params_end + 1, found)
                self.uses(params_end + 1, min(last, end + 1), found, enter=True)
            else:
                self.symbol(name, "variable", first, min(last, end), parent)
            k = last + 1
        return end + 1

    def bases(self, i: int, brace: int, source: str) -> None:
        k = i
        while k < brace:
            if self.x.text(k) in ("extends", "implements", ","):
                at = k + 1
                if self.x.is_word(at):
                    end = at
                    while self.x.text(end + 1) == ".":
                        end += 2
                    self.out.edge(source, self.x.span(at, end), "inherits", self.out.line(self.x.tokens[at].start))
                    k = self.x.after_generics(end + 1) - 1
            k = self.x.close.get(k, k) + 1

    def brace(self, i: int, stop: int) -> int:
        while i < stop and self.x.text(i) != "{":
            i = self.x.after_generics(i) if self.x.text(i) == "<" else i + 1
        return i

    def interface(self, first: int, i: int, stop: int, parent: str | None) -> int:
        brace = self.brace(i, stop)
        last = self.x.close.get(brace, brace)
        found = self.symbol(self.x.text(i + 1), "class", first, last, parent)
        self.bases(self.x.after_generics(i + 2), brace, found)
        return last + 1

    def klass(self, first: int, i: int, stop: int, parent: str | None) -> int:
        brace = self.brace(i, stop)
        last = self.x.close.get(brace, brace)
        found = self.symbol(self.x.text(i + 1), "class", first, last, parent)
        self.bases(self.x.after_generics(i + 2), brace, found)
        k = brace + 1
        while k < last:
            start, words = k, set()
            while self.x.text(k) == "@":
                k += 2
                k = self.x.close[k] + 1 if self.x.text(k) == "(" else k
            while self.x.text(k) in _MODIFIERS and (self.x.is_word(k + 1) or self.x.text(k + 1) in ("*", "[")):
                words.add(self.x.text(k))
                k += 1
            k += self.x.text(k) == "*"
            if not self.x.is_word(k):
                k = self.x.close.get(k, k) + 1
                continue
            name = self.x.text(k)
            visibility = "private" if "private" in words or name.startswith("#") else "protected" if "protected" in words or name.startswith("_") else "public"
            opened = self.x.after_generics(k + 1 + (self.x.text(k + 1) in ("?", "!")))
            if self.x.text(opened) == "(":
                k = self.callable(name, "method", start, opened, found, "async" in words, visibility)
                continue
            end = self.end_of(k, last)
            self.symbol(name, "variable", start, end, found, visibility=visibility)
            k = end + 1
        return last + 1

    def uses(self, i: int, stop: int, source: str, enter: bool = False) -> None:
        """Calls and throws; functions inside are not entered. `enter`: the first => opens the body itself."""
        k = i
        while k < stop:
            t = self.x.text(k)
            if t == "=>" and not enter:
                k = self.x.close[k + 1] + 1 if self.x.text(k + 1) == "{" else self.expression_end(k + 1, stop)
                continue
            if t == "=>":
                enter = False
            elif t in ("function", "class"):
                brace = self.brace(k, stop)
                k = self.x.close.get(brace, brace) + 1
                continue
            elif t == "throw":
                at = k + 1 + (self.x.text(k + 1) == "new")
                if self.x.is_word(at):
                    end = at
                    while self.x.text(end + 1) == ".":
                        end += 2
                    self.out.edge(source, self.x.span(at, end), "raises", self.out.line(self.x.tokens[k].start))
            elif t == "(" and self.x.is_word(k - 1) and k > i and self.x.text(k - 1) not in _NOT_CALLED:
                at = self.x.chain_before(k - 1, _JOINS)
                self.out.edge(source, self.x.span(at, k - 1), "calls", self.out.line(self.x.tokens[at].start))
            k += 1

    def expression_end(self, k: int, stop: int) -> int:
        while k < stop and self.x.text(k) not in (",", ";", ")", "]", "}"):
            k = self.x.close.get(k, k) + 1
        return k


def extract_script(source: str, path: str) -> Builder:
    return _Script(source, path).out
