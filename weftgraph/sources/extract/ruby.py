"""Ruby, by lines: strings, comments and here-documents are blanked out first, then keywords and `end` are matched."""

from __future__ import annotations

import re

from .builder import Builder

_NAME = r"[A-Za-z_]\w*"
_DEF = re.compile(rf"def\s+(self\.|{_NAME}\.)?({_NAME}[?!=]?|[+\-*/%<>=!~\[\]&|^]+)\s*(\([^)]*\))?")
_CLASS = re.compile(r"class\s+([A-Z][\w:]*)\s*(?:<\s*([A-Z][\w:]*))?")
_MODULE = re.compile(r"module\s+([A-Z][\w:]*)")
_REQUIRE = re.compile(r"(require|require_relative)\b\s*\(?\s*(['\"])([^'\"]+)\2")
_MIX = re.compile(r"(?:include|extend|prepend)\s+([A-Z][\w:]*(?:\s*,\s*[A-Z][\w:]*)*)")
_ASSIGN = re.compile(rf"({_NAME})\s*(?:\|\|)?=(?![=~>])")
_OPENS = re.compile(r"(?:^|[;=(]|&&|\|\||\breturn\b)\s*(?:if|unless|while|until|case|begin|for)\b|\bdo\b(?=\s*(?:\||$|;))")
_CALL = re.compile(rf"((?:(?:@{{0,2}}{_NAME}[?!]?|\)|\]|self)(?:\.|&\.|::))*)({_NAME}[?!]?)(\s*\(|(?=\s+[\w:'\"@\[{{]))?")
_RAISE = re.compile(r"\b(?:raise|fail)\s+([A-Z][\w:]*)(\.new)?")
_RESCUE = re.compile(r"\brescue\s+([A-Z][\w:]*(?:\s*,\s*[A-Z][\w:]*)*)")
_KEYWORDS = set("if unless while until case when then else elsif end begin rescue ensure do def class module return yield self nil true false and or not in for next break redo retry super raise fail require require_relative include extend prepend attr_accessor attr_reader attr_writer private public protected puts alias undef defined".split()) - {"puts"}
_STRING = re.compile(r"""'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*"|#[^\n]*""")


def _blanked(source: str) -> str:
    """The same length, with comments and strings' insides replaced by blanks."""
    text = re.sub(r"^=begin\b.*?^=end\b[^\n]*", lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.M | re.S)

    def blank(m: re.Match) -> str:
        return " " * len(m[0]) if m[0][0] == "#" else m[0][0] + " " * (len(m[0]) - 2) + m[0][-1]

    text = _STRING.sub(blank, text)

    def here(m: re.Match) -> str:
        return m[0][: m.start(2) - m.start()] + re.sub(r"[^\n]", " ", m[2])

    return re.sub(r"<<[~-]?['\"]?([A-Z_]+)['\"]?[^\n]*\n(.*?^\s*\1\s*$)", here, text, flags=re.M | re.S)


def extract_ruby(source: str, path: str) -> Builder:
    out, plain = Builder(source, path), _blanked(source)
    rows, raw = plain.splitlines(keepends=True), source.splitlines(keepends=True)
    # what each `end` closes: (row, symbol or None)
    stack: list[dict] = []
    at = 0

    def doc(i: int) -> str | None:
        found = []
        for r in reversed(raw[:i]):
            if not r.strip().startswith("#"):
                break
            found.append(r.strip().lstrip("#").strip())
        return " ".join(reversed(found)) or None

    def context() -> dict | None:
        return next((s for s in reversed(stack) if s["id"]), None)

    def close(entry: dict, end: int) -> None:
        if entry["row"] is not None:
            s = entry["row"]
            s["end_byte"], s["end_line"] = out.byte(end), out.line(max(entry["start"], end - 1))

    for i, row in enumerate(rows):
        text = row.strip()
        indent = len(row) - len(row.lstrip())
        start = at + indent
        owner = context()
        parent = owner["id"] if owner else None
        visibility = lambda n: "private" if n.startswith("_") else "public"
        opened = None
        if m := re.match(rf"(?:(?:private|public|protected|private_class_method)\s+)?{_DEF.pattern}", text):
            name = m[2]
            found = out.symbol(name, "method" if parent else "function", start, at + len(row.rstrip("\n")), parent, m[3], visibility(name), False, doc(i))
            opened = {"id": found, "row": out.symbols[-1], "start": start, "def": True}
            if re.search(r"\)\s*=(?!=)|^def\s+[\w.?!]+\s*=\s", text):  # an endless definition
                _uses(out, found, text[m.end() :], i + 1)
                opened = None
        elif m := _CLASS.match(text):
            found = out.symbol(m[1], "class", start, at + len(row), parent, doc=doc(i))
            out.edge(found, m[2] or "", "inherits", i + 1)
            opened = {"id": found, "row": out.symbols[-1], "start": start, "def": False}
        elif text.startswith("class <<"):
            opened = {"id": None, "row": None, "start": start, "def": False}
        elif m := _MODULE.match(text):
            found = out.symbol(m[1], "class", start, at + len(row), parent, doc=doc(i))
            opened = {"id": found, "row": out.symbols[-1], "start": start, "def": False}
        elif m := _REQUIRE.match(raw[i].strip()):
            found = out.symbol(m[3], "import", start, at + len(raw[i].rstrip()), parent, raw[i].strip())
            out.edge(found, m[3].rsplit("/", 1)[-1], "imports", i + 1)
        elif (m := _MIX.match(text)) and owner:
            for name in m[1].split(","):
                out.edge(parent, name.strip(), "inherits", i + 1)
        elif not text.startswith("attr_"):
            if owner is None or not owner["def"]:
                if (m := _ASSIGN.match(text)) and m[1] not in _KEYWORDS:
                    out.symbol(m[1], "variable", start, at + len(row.rstrip()), parent, visibility=visibility(m[1]))
            if owner is not None:
                _uses(out, parent, text, i + 1)
        if opened is not None and re.search(r";\s*end\s*$", text):
            close(opened, at + len(row.rstrip()))
            opened = None
        if opened is not None:
            stack.append(opened)
        else:
            for _ in range(len(_OPENS.findall(text)) if not re.search(r"\bend\b.*$", text) or re.match(r"end\b", text) else 0):
                stack.append({"id": None, "row": None, "start": start, "def": False})
        if re.match(r"end\b", text) and stack:
            # blocks opened on this very line stay open
            extra = len(_OPENS.findall(text))
            entry = stack.pop(-1 - extra) if len(stack) > extra else stack.pop()
            close(entry, at + indent + 3)
        at += len(row)
    for entry in stack:
        close(entry, len(source))
    return out


def _uses(out: Builder, source: str | None, text: str, line: int) -> None:
    for m in _RAISE.finditer(text):
        out.edge(source, m[1], "raises", line)
        if m[2]:
            out.edge(source, f"{m[1]}.new", "calls", line)
    for m in _RESCUE.finditer(text):
        for name in m[1].split(","):
            out.edge(source, name.strip(), "references", line)
    rest = _RESCUE.sub(" ", _RAISE.sub(" ", text))
    for m in _CALL.finditer(rest):
        if m[2] in _KEYWORDS or rest[m.start() - 1 : m.start()] in ("@", ":", "$", "."):
            continue
        if not m[1] and not m[3]:  # a bare word is a call only with arguments
            if not (m[3] is not None and m.start() == 0):
                continue
        if m[1].endswith("::") and m[2][:1].isupper() and not m[3]:
            continue
        out.edge(source, (m[1].replace("&.", ".") + m[2]).lstrip(")]."), "calls", line)
