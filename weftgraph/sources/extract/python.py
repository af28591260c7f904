"""Python, by the standard library's syntax tree; text it rejects is scanned by lines for definitions and imports."""

from __future__ import annotations

import ast
import re
from itertools import accumulate

from .builder import Builder

#: The lines of the language: a form feed or a Unicode separator ends none.
LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")


def _visibility(name: str) -> str:
    if name.startswith("__"):
        return "public" if name.endswith("__") else "private"
    return "protected" if name.startswith("_") else "public"


class _Walk:
    def __init__(self, source: str, path: str, tree: ast.Module):
        self.out, self.source = Builder(source, path), source
        self.rows = LINE.findall(source)
        self.starts = [0, *accumulate(map(len, self.rows))]
        self.block(tree.body, None)

    def place(self, line: int, byte: int) -> int:
        row = self.rows[line - 1] if line <= len(self.rows) else ""
        return self.starts[line - 1] + (byte if row.isascii() else len(row.encode()[:byte].decode("utf-8", "ignore")))

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.place(node.lineno, node.col_offset), self.place(node.end_lineno, node.end_col_offset)

    def text(self, node: ast.AST) -> str:
        start, end = self.span(node)
        return self.source[start:end]

    def block(self, body: list[ast.stmt], parent: str | None, variables: bool = True) -> None:
        for node in body:
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                self.function(node, parent)
            elif isinstance(node, ast.ClassDef):
                self.klass(node, parent)
            elif isinstance(node, ast.Import | ast.ImportFrom):
                self.imports(node, parent)
            elif variables and isinstance(node, ast.Assign | ast.AnnAssign | ast.AugAssign):
                target = node.targets[0] if isinstance(node, ast.Assign) else node.target
                if isinstance(target, ast.Name) and not isinstance(node, ast.AugAssign):
                    self.out.symbol(target.id, "variable", *self.span(node), parent, visibility=_visibility(target.id))
            else:
                for inner in ("body", "orelse", "finalbody"):
                    self.block(getattr(node, inner, None) or [], parent, variables)
                for handler in getattr(node, "handlers", []):
                    self.block(handler.body, parent, variables)
                for case in getattr(node, "cases", []):
                    self.block(case.body, parent, variables)

    def doc(self, node) -> str | None:
        first = node.body[0] if node.body else None
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
            raw = self.text(first.value).lstrip("rRbBuU")
            if raw[:3] in ('"""', "'''"):
                return raw[3:-3].strip() or None
        return None

    def decorators(self, node, source: str) -> None:
        for d in node.decorator_list:
            called = d.func if isinstance(d, ast.Call) else d
            self.out.edge(source, self.text(called), "references", d.lineno)

    def function(self, node, parent: str | None) -> None:
        start, end = self.span(node)
        is_async = isinstance(node, ast.AsyncFunctionDef)
        head = self.source[start : self.span(node.body[0])[0]]
        params = _parenthesised(head)
        returned = f" -> {self.text(node.returns)}" if node.returns else ""
        found = self.out.symbol(node.name, "method" if parent else "function", start, end, parent, params + returned, _visibility(node.name), is_async, self.doc(node))
        self.decorators(node, found)
        args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, node.args.vararg, node.args.kwarg]
        for annotation in [*(a.annotation for a in args if a is not None), node.returns]:
            if annotation is not None:
                self.types(annotation, found)
        for inner in node.body:
            self.uses(inner, found)
        self.block(node.body, found, variables=False)

    def klass(self, node: ast.ClassDef, parent: str | None) -> None:
        found = self.out.symbol(node.name, "class", *self.span(node), parent, visibility=_visibility(node.name), doc=self.doc(node))
        self.decorators(node, found)
        for base in node.bases:
            self.out.edge(found, self.text(base), "inherits", node.lineno)
        for keyword in node.keywords:
            self.out.edge(found, f"{keyword.arg}={self.text(keyword.value)}" if keyword.arg else self.text(keyword.value), "inherits", node.lineno)
        for inner in node.body:
            self.uses(inner, found)
        self.block(node.body, found)

    def imports(self, node, parent: str | None) -> None:
        if isinstance(node, ast.Import):
            module, names = node.names[0].name, [a.name for a in node.names]
        else:
            module = "." * node.level + (node.module or "")
            names = [a.name for a in node.names if a.asname] or [a.name for a in node.names if a.name != "*"]
        found = self.out.symbol(module, "import", *self.span(node), parent, self.text(node))
        for name in names:
            self.out.edge(found, name, "imports", node.lineno)

    def types(self, annotation: ast.AST, source: str) -> None:
        for node in [annotation] if isinstance(annotation, ast.Name | ast.Attribute) else ast.walk(annotation):
            if isinstance(node, ast.Name) and node.id[:1].isupper() or isinstance(node, ast.Attribute):
                self.out.edge(source, self.text(node), "references", node.lineno)

    def uses(self, node: ast.AST, source: str) -> None:
        """Calls, raises and caught types below node, not inside definitions of its own."""
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            return
        if isinstance(node, ast.Call):
            self.out.edge(source, self.text(node.func), "calls", node.lineno)
        elif isinstance(node, ast.Raise) and node.exc is not None:
            raised = node.exc.func if isinstance(node.exc, ast.Call) else node.exc
            self.out.edge(source, self.text(raised), "raises", node.lineno)
        elif isinstance(node, ast.ExceptHandler) and node.type is not None:
            if isinstance(node.type, ast.Tuple):
                for x in node.type.elts:
                    self.out.edge(source, self.text(x), "references", x.lineno)
            elif (name := self.text(node.type))[:1].isupper() or isinstance(node.type, ast.Attribute):
                self.out.edge(source, name, "references", node.type.lineno)
        for inner in ast.iter_child_nodes(node):
            self.uses(inner, source)


def _parenthesised(head: str) -> str:
    start, depth = head.find("("), 0
    for i in range(max(start, 0), len(head)):
        depth += {"(": 1, ")": -1}.get(head[i], 0)
        if depth == 0 and i >= start >= 0:
            return head[start : i + 1]
    return "()"


_DEF = re.compile(r"^([ \t]*)(async\s+)?(def|class)\s+(\w+)\s*(\([^)\n]*\))?")
_IMPORT = re.compile(r"^[ \t]*(?:from\s+([.\w]+)\s+import\s+(.+)|import\s+([\w.]+).*)$")


def _by_lines(source: str, path: str) -> Builder:
    """What indentation tells of a broken file: a definition lasts until a line that isn't deeper."""
    out, at, open_defs = Builder(source, path), 0, []
    rows = source.splitlines(keepends=True)
    for i, row in enumerate(rows):
        if m := _DEF.match(row):
            depth = len(m[1].expandtabs())
            open_defs = [d for d in open_defs if d[0] < depth]
            end = at + len(row)
            for following in rows[i + 1 :]:
                if following.strip() and len(following.expandtabs()) - len(following.expandtabs().lstrip()) <= depth:
                    break
                end += len(following)
            parent = open_defs[-1][1] if open_defs else None
            kind = "class" if m[3] == "class" else "method" if parent else "function"
            found = out.symbol(m[4], kind, at + len(m[1]), end, parent, m[5] if kind != "class" else None, _visibility(m[4]), bool(m[2]))
            open_defs.append((depth, found))
            if kind == "class":
                for base in (m[5] or "()")[1:-1].split(","):
                    out.edge(found, base.strip(), "inherits", i + 1)
        elif m := _IMPORT.match(row):
            found = out.symbol(m[1] or m[3], "import", at, at + len(row.rstrip()), None, row.strip())
            for name in (m[2] or m[3]).strip("()").split(","):
                out.edge(found, name.split(" as ")[0].strip(), "imports", i + 1)
        at += len(row)
    return out


def extract_python(source: str, path: str) -> Builder:
    try:
        return _Walk(source, path, ast.parse(source)).out
    except (SyntaxError, ValueError, RecursionError, IndexError):
        return _by_lines(source, path)
