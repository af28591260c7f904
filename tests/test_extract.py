import pytest

from weftgraph.sources.extract import EXTRACTORS, register_extractor
from weftgraph.sources.extract.builder import Builder


def run(language, source):
    b = EXTRACTORS[language](source, "f")
    return {(s["kind"], s["name"]): s for s in b.symbols}, {(e["source_id"].split(":", 1)[1].rsplit(":", 1)[0], e["kind"], e["target_name"]) for e in b.edges}, b


@pytest.mark.parametrize("language", sorted(EXTRACTORS))
@pytest.mark.parametrize("source", ["", "\n\n", "((((", "}}}}", "class {", "def f(:\n  x", "\"unclosed", "/* open", "é ü 中", "func (", "impl", "use ;", "end\nend", "import", "@", "fn f<", "const x = (a"])
def test_broken_text_is_survived(language, source):
    EXTRACTORS[language](source, "f")


def test_python():
    s, e, b = run("python", 'import os\nfrom m import A, B as C\n\nX = 1\n\nclass K(Base, metaclass=M):\n    """Doc."""\n\n    async def _go(self, a: Item) -> m.Out:\n        """One."""\n        try:\n            raise Err(a)\n        except Bad:\n            self.run(make())\n\n        def inner():\n            hidden()\n')
    assert s["class", "K"]["docstring"] == "Doc." and s["method", "_go"]["visibility"] == "protected" and s["method", "_go"]["is_async"]
    assert s["method", "_go"]["signature"] == "(self, a: Item) -> m.Out" and s["method", "inner"]["parent_id"] == s["method", "_go"]["id"]
    assert {("K", "inherits", "Base"), ("K", "inherits", "metaclass=M"), ("_go", "raises", "Err"), ("_go", "calls", "Err"), ("_go", "references", "Bad"), ("_go", "calls", "self.run"), ("_go", "calls", "make"), ("_go", "references", "Item"), ("_go", "references", "m.Out"), ("m", "imports", "B")} <= e
    assert ("_go", "calls", "hidden") not in e and ("inner", "calls", "hidden") in e and ("m", "imports", "A") not in e


def test_python_bytes_and_broken():
    s, _, b = run("python", 'é = "ü"\ndef f(): pass\n')
    assert b.source.encode()[s["function", "f"]["start_byte"] : s["function", "f"]["end_byte"]] == b"def f(): pass"
    s, e, _ = run("python", "class A(B):\n  def f(self):\n    x(\n\nimport os\n")
    assert s["method", "f"]["parent_id"] == "f:A:1" and ("A", "inherits", "B") in e and ("import", "os") in s


def test_typescript():
    s, e, _ = run("typescript", "import { A as B } from './a';\n/** Doc. */\nexport class K extends P.Q implements R {\n  private n = 1;\n  async go(x: Item): Promise<Out> { const f = () => hidden(); throw new Err(this.run()); }\n}\nexport const add = async (a: T) => plus(a);\ninterface I extends J {}\ntype U = string;\nenum C { X }\n")
    assert s["class", "K"]["docstring"] == "Doc." and s["variable", "n"]["visibility"] == "private" and s["method", "go"]["is_async"] and s["function", "add"]["is_async"]
    assert {("./a", "imports", "A"), ("K", "inherits", "P.Q"), ("K", "inherits", "R"), ("go", "raises", "Err"), ("go", "calls", "Err"), ("go", "calls", "this.run"), ("go", "references", "Item"), ("add", "calls", "plus"), ("I", "inherits", "J")} <= e
    assert ("go", "calls", "hidden") not in e and ("variable", "U") in s and ("class", "C") in s


def test_rust():
    s, e, _ = run("rust", "use a::{B, C as D};\nuse x::*;\n/// Doc.\npub struct S;\nimpl T for S { pub async fn go(&self, i: Item) -> Out { let f = |x| hidden(x); mac!(1); a::run(self.b()) } }\nconst N: u8 = make();\nmod m { fn inner() {} }\n")
    assert s["class", "S"]["start_line"] == 5 and s["method", "go"]["visibility"] == "public" and s["method", "go"]["is_async"]
    assert {("a", "imports", "B"), ("a", "imports", "C"), ("S", "inherits", "T"), ("go", "calls", "mac!"), ("go", "calls", "a::run"), ("go", "calls", "self.b"), ("go", "references", "Item"), ("N", "calls", "make")} <= e
    assert ("go", "calls", "hidden") not in e and ("import", "x") in s and s["class", "m"]["visibility"] == "private"


def test_go():
    s, e, _ = run("go", 'package p\nimport (\n\t"fmt"\n\tm "a/b/money"\n)\n// Doc.\ntype K struct {\n\tBase\n\tn int\n}\ntype R interface { io.Reader }\nconst N = 1\nvar v = load()\nfunc (k *K) Go(i Item) (Out, error) {\n\tgo func() { hidden() }()\n\treturn m.Sum(Item{}), nil\n}\nfunc low() {}\n')
    assert s["class", "K"]["docstring"] == "Doc." and s["method", "Go"]["parent_id"] == "f:K" and s["method", "Go"]["signature"] == "(k *K) (i Item) (Out, error)" and s["function", "low"]["visibility"] == "private"
    assert {("a/b/money", "imports", "money"), ("K", "inherits", "Base"), ("R", "inherits", "io.Reader"), ("v", "calls", "load"), ("Go", "calls", "m.Sum"), ("Go", "references", "Item")} <= e
    assert ("Go", "calls", "hidden") not in e


def test_ruby():
    s, e, _ = run("ruby", "require 'lib/json'\n# Doc.\nclass K < B::C\n  include M\n  MAX = 1\n  def go(x)\n    if x.nil?\n      raise Err.new('a')\n    end\n    help(x)\n  rescue Bad, Worse => e\n    fail Oops\n  end\n  def self.make; end\nend\nmodule U\nend\n")
    assert s["class", "K"]["docstring"] == "Doc." and s["class", "K"]["end_line"] == 15 and s["method", "go"]["end_line"] == 13 and s["method", "make"]["parent_id"] == s["class", "K"]["id"]
    assert {("lib/json", "imports", "json"), ("K", "inherits", "B::C"), ("K", "inherits", "M"), ("go", "raises", "Err"), ("go", "calls", "Err.new"), ("go", "references", "Bad"), ("go", "references", "Worse"), ("go", "raises", "Oops"), ("go", "calls", "help")} <= e


def test_content_is_cut_at_a_character():
    b = Builder("a" * 2047 + "é" + "x", "f")
    b.symbol("f", "function", 0, 2049)
    b.symbol("i", "import", 0, 2049)
    b.symbol("s", "function", 0, 10)
    found = b.contents(str)
    assert [len(c["content"].encode()) for c in found] == [2047] and found[0]["header"] == "// File: f\n// Type: function\n// Name: f"


def test_registry():
    register_extractor("none", lambda source, path: Builder(source, path))
    assert EXTRACTORS.pop("none")("", "f").symbols == []
