import io
import json
import os
import time

import pytest

from weftgraph import cli
from weftgraph.api import CodeGraph
from weftgraph.sources import tree

FILES = {
    "shop/__init__.py": "from .cart import Cart\n",
    "shop/cart.py": 'import os\n\n\nclass Base:\n    """Things that cost something, and are counted in carts."""\n\n\nclass Cart(Base):\n    def total(self, items: list) -> int:\n        return price_of(items) + len(os.sep)\n',
    "shop/price.py": "def price_of(items):\n    # The sum of all prices, rounded to cents.\n    return sum(i.price for i in items)\n\n\ndef unused():\n    return price_of([])\n",
    "web/main.ts": "export function main(): void { total(1); }\n",
    "node_modules/x/a.js": "function hidden() {}\n",
    "notes.txt": "no code",
}


@pytest.fixture
def root(tmp_path):
    for name, content in FILES.items():
        path = tmp_path / "src" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    (tmp_path / "src/bad.py").write_bytes(b"\xff\xfe")
    return str(tmp_path / "src")


def test_tree(spark, root):
    got = {r.path: r for r in tree.read_tree(spark, root).collect()}
    assert set(got) == {"shop/__init__.py", "shop/cart.py", "shop/price.py", "web/main.ts"}
    assert got["web/main.ts"].language == "typescript" and got["shop/cart.py"].last_modified > 0
    with pytest.raises(ValueError):
        tree.confined("../x", root)
    assert tree.confined("shop/cart.py", root).endswith("cart.py")


def test_index_and_queries(spark, root, tmp_path):
    g = CodeGraph(spark, root, str(tmp_path / "store"))
    assert "hint" in json.loads(g.call("search", query="x"))
    first = g.index()
    assert first["indexed"] == 4 and first["removed"] == 0 and first["resolved"] > 0
    assert g.index()["indexed"] == 0
    assert [r.name for r in g.outline("shop/price.py").collect()] == ["price_of", "unused"]
    assert {r.source_name for r in g.refs("price_of").collect()} == {"total", "unused"}
    assert {r.target_name for r in g.callees("total").collect()} >= {"price_of"}
    assert [tuple(r) for r in g.hierarchy("Base").collect()] == [("Cart", "Base")]
    assert [r.target_name for r in g.deps("shop/cart.py").collect()] == ["os"]
    assert {(r.source_name, r.depth) for r in g.impact("price_of", 2).collect()} >= {("total", 1), ("unused", 1)}
    assert {(r.metric, r.key): r.value for r in g.stats().collect()}[("files", "")] == 4
    assert g.rag_index()["embedded"] > 0 and g.rag_index()["embedded"] == 0
    assert g.rag_search("sum of prices").first().symbol["name"] == "price_of"
    # edit one file, drop another: the result equals a full run
    time.sleep(0.01)
    with open(os.path.join(root, "shop/price.py"), "w") as f:
        f.write("def price_of(items, tax=0):\n    return tax\n")
    os.remove(os.path.join(root, "web/main.ts"))
    second = g.index()
    assert second["indexed"] == 1 and second["removed"] == 1
    whole = CodeGraph(spark, root, str(tmp_path / "other"))
    whole.index(force=True)
    for table in ("symbols", "edges", "files", "symbol_content"):
        rows = [{tuple(str(x) for x in r) for r in c.store.read(table).collect()} for c in (g, whole)]
        assert rows[0] == rows[1], table
    assert g.store.version() >= 2


def test_cli_and_serve(spark, root, tmp_path, capsys):
    store = ["--root", root, "--store", str(tmp_path / "s")]
    assert cli.main([*store, "index"], spark) == 0
    capsys.readouterr()
    cli.main([*store, "outline", "shop/price.py"], spark)
    assert "function price_of(items)" in capsys.readouterr().out
    cli.main([*store, "--json", "search", "cart"], spark)
    assert json.loads(capsys.readouterr().out)["results"][0]["name"] == "Cart"
    out = io.StringIO()
    cli.serve(CodeGraph(spark, root, str(tmp_path / "s")), ['{"tool": "refs", "options": {"name": "price_of"}}\n', '{"tool": "nope"}\n', '{"tool": "outline", "options": {"file": "../../x"}}\n'], out)
    lines = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(lines[0]["results"]) == 2 and "error" in lines[1] and "error" in lines[2]
    cli.watch(CodeGraph(spark, root, str(tmp_path / "s")), 0, 0, turns=1)


def test_git(tmp_path):
    assert tree.git_changed(str(tmp_path), "deadbeef") is None and tree.git_changed(str(tmp_path), None) is None
