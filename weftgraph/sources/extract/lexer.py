"""Tokens of languages with braces: words, numbers, strings and punctuation, with brackets matched and comments aside."""

from __future__ import annotations

import re
from dataclasses import dataclass

OPEN, CLOSE = "([{", ")]}"
_WORD = re.compile(r"[^\W\d][\w$]*|\$[\w$]*")
_NUMBER = re.compile(r"\d[\w.]*")
_MARKS = ("...", "===", "!==", "=>", "->", "::", "?.", ":=", "&&", "||", "==", "!=", "<=", ">=")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")


@dataclass(slots=True)
class Token:
    kind: str  # word, number, string, mark
    text: str
    start: int
    end: int


class Lexed:
    def __init__(self, source: str, language: str):
        self.source = source
        self.tokens: list[Token] = []
        self.comments: list[tuple[int, int]] = []  # start, end
        self._lex(language)
        self.close = self._match()

    def _lex(self, language: str) -> None:
        s, n, i = self.source, len(self.source), 0
        add = self.tokens.append
        while i < n:
            c = s[i]
            if c.isspace():
                i += 1
                continue
            if s.startswith("//", i):
                end = s.find("\n", i)
                end = n if end < 0 else end
                self.comments.append((i, end))
                i = end
                continue
            if s.startswith("/*", i):
                end = self._block(i, language == "rust")
                self.comments.append((i, end))
                i = end
                continue
            if language == "rust" and (m := re.compile(r'b?r(#*)"').match(s, i)):
                end = s.find('"' + m[1], m.end())
                end = n if end < 0 else end + 1 + len(m[1])
                add(Token("string", s[i:end], i, end))
                i = end
                continue
            if language == "rust" and c == "'":
                m = re.compile(r"'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'").match(s, i)
                if m:
                    add(Token("string", m[0], i, m.end()))
                    i = m.end()
                else:  # a lifetime
                    m = _WORD.match(s, i + 1)
                    end = m.end() if m else i + 1
                    add(Token("mark", s[i:end], i, end))
                    i = end
                continue
            if c in "\"'" or c == "`" and language != "rust":
                end = self._string(i, c, language)
                add(Token("string", s[i:end], i, end))
                i = end
                continue
            if c == "/" and language == "script" and self._regex_here() and (m := _REGEX.match(s, i)):
                add(Token("string", m[0], i, m.end()))
                i = m.end()
                continue
            if (m := _WORD.match(s, i)) or (language == "script" and c == "#" and (m := re.compile(r"#[^\W\d][\w$]*").match(s, i))):
                add(Token("word", m[0], i, m.end()))
            elif m := _NUMBER.match(s, i):
                add(Token("number", m[0], i, m.end()))
            else:
                mark = next((x for x in _MARKS if s.startswith(x, i)), c)
                add(Token("mark", mark, i, i + len(mark)))
            i = self.tokens[-1].end

    def _block(self, i: int, nested: bool) -> int:
        depth, n = 0, len(self.source)
        while i < n:
            if self.source.startswith("/*", i) and (nested or depth == 0):
                depth += 1
                i += 2
            elif self.source.startswith("*/", i):
                depth -= 1
                i += 2
                if depth == 0:
                    return i
            else:
                i += 1
        return n

    def _string(self, i: int, quote: str, language: str) -> int:
        s, n, j = self.source, len(self.source), i + 1
        raw = quote == "`" and language == "go"
        while j < n:
            c = s[j]
            if c == "\\" and not raw:
                j += 2
                continue
            if c == quote:
                return j + 1
            if c == "\n" and quote in "\"'" and language != "rust":
                return j
            if quote == "`" and language == "script" and s.startswith("${", j):
                depth, j = 1, j + 2
                while j < n and depth:
                    depth += {"{": 1, "}": -1}.get(s[j], 0)
                    j += 1
                continue
            j += 1
        return n

    def _regex_here(self) -> bool:
        if not self.tokens:
            return True
        t = self.tokens[-1]
        return t.kind == "mark" and t.text not in (")", "]", "}") or t.text in ("return", "typeof", "case", "in", "of")

    def _match(self) -> dict[int, int]:
        """Index of an opening bracket -> of its closing one; an unclosed one closes at the end."""
        out, stack = {}, []
        for i, t in enumerate(self.tokens):
            if t.kind == "mark" and t.text in OPEN:
                stack.append(i)
            elif t.kind == "mark" and t.text in CLOSE and stack:
                at = next((k for k in range(len(stack) - 1, -1, -1) if OPEN.index(self.tokens[stack[k]].text) == CLOSE.index(t.text)), None)
                if at is not None:
                    for k in stack[at:]:
                        out[k] = i
                    del stack[at:]
        for k in stack:
            out[k] = len(self.tokens) - 1
        return out

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def is_word(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "word"

    def span(self, i: int, j: int) -> str:
        """Source text of tokens i to j, both included."""
        return self.source[self.tokens[i].start : self.tokens[j].end]

    def after_generics(self, i: int) -> int:
        """Past a <...> that begins at token i, if one does."""
        if self.text(i) != "<":
            return i
        depth = 0
        while i < len(self.tokens):
            t = self.text(i)
            depth += {"<": 1, ">": -1}.get(t, 0)
            if t in OPEN and t:
                i = self.close[i]
            i += 1
            if depth == 0 or t in (";", "{"):
                return i
        return i

    def comments_before(self, start: int) -> list[str]:
        """The run of comments that ends just before `start`, with only white space between, first to last."""
        out, at = [], start
        for s, e in reversed(self.comments):
            if e <= at and not self.source[e:at].strip() and self.source[e:at].count("\n") <= 1:
                out.append(self.source[s:e])
                at = s
            elif e <= at:
                break
        return out[::-1]

    def chain_before(self, i: int, joins: tuple[str, ...]) -> int:
        """The first token of the a.b().c chain that ends with the word at i."""
        while self.text(i - 1) in joins:
            k = i - 2
            if self.text(k) in (")", "]"):
                opened = next((o for o, c in self.close.items() if c == k), None)
                if opened is None:
                    break
                k = opened
                if self.is_word(k - 1) or self.text(k - 1) in (")", "]"):
                    k -= 1
                i = k
            elif k >= 0 and (self.is_word(k) or self.tokens[k].kind == "string" or self.text(k) == ">"):
                i = k
            else:
                break
        return i
