from quillspan.operators import codeast as C

SOURCE = '''"""Module."""
import os
from .a import b as c, d


@deco
def f(x: int, *, y: "S" = 1,
      z: List[T] = ()) -> Out:
    """Doc."""
    import late
    return os.path.join(x)


class K(Base, m.Other, Gen[T], Exception):
    """Doc."""

    n: Field = 1

    def go(self): ...

A = B = 1
c, d = 1, 2
E: int = 3
'''


def test_imports_are_breadth_first():
    assert [(i["module"], i["names"], i["level"]) for i in C.imports(SOURCE)] == [("os", [], 0), ("a", ["b", "d"], 1), ("late", [], 0)]


def test_imports_by_pattern_when_nothing_parses():
    found = C.imports("from ..x import (a, b as q)\nimport m as n, o\nfun main() { val x = }")
    assert [(i["module"], i["names"], i["level"], i["is_relative"]) for i in found] == [("x", ["(a", "b"], 2, True), ("m", [], 0, False), ("o", [], 0, False)]


def test_cut_off_sources_are_parsed():
    assert C.used_symbols("x = (\ndef f(a):\n    return g.h(a)") >= {"g", "h", "a"}
    assert C.base_classes("class Q(P):") == {"P"}
    assert C.parse_leniently("val x = }{") is None
    head = "import os\nfrom .a import b\nX = 1\n\ndef f(a):\n    if a ==\n        return [\n\nimport late\n"
    assert [i["module"] for i in C.imports(head)] == ["os", "a"]  # the lines before the first definition are parsed


def test_standard_library():
    assert all(map(C.is_stdlib, ("os", "os.path", "collections.abc", "imp", "__future__", "_thread")))
    assert not any(map(C.is_stdlib, ("numpy", "osx", "pkg.os", "")))


def test_skeleton_of_a_class():
    source = "import os\nclass K(Base):\n    a = 1\n    b: int = 2\n    @deco\n    def go(self,\n           x):\n        return x\n    async def wait(self): pass\nclass E: pass\nV = [\n  1]\n"
    assert C.skeleton(source) == "import os\n\nclass K(Base):\n    a = 1\n    def go(self,\n        ...\n    async def wait(self): pass\n        ...\n\nclass E: pass\n\nV = [\n  1]\n"


def test_hints_and_bases():
    assert C.type_hints(SOURCE) == {"int", "List", "Out", "Field"}
    assert C.base_classes(SOURCE) == {"Base", "Other"}
    assert C.base_classes("class A(ValueError, ABC, dict, m.str): pass") == {"ValueError", "ABC"}


def test_definitions():
    found = [(d.name, d.kind) for d in C.definitions(SOURCE)]
    assert found == [("f", "function"), ("K", "class"), ("A", "assignment"), ("B", "assignment")]
    first = C.definitions(SOURCE)[0]
    assert SOURCE.splitlines()[first.start].startswith("def f(") and SOURCE.splitlines()[first.end - 1].strip().startswith("return")
    assert ("go", "method") in [(d.name, d.kind) for d in C.definitions(SOURCE, methods=True)]
    assert not C.definitions(SOURCE)[0].source.startswith("@deco")
    assert C.definitions("def f(:") == []


def test_skeleton_and_docstrings():
    bones = C.skeleton(SOURCE).split("\n")
    assert "def f(x: int, *, y: \"S\" = 1," in bones and "    ..." in bones and "        ..." in bones and not any("E: int" in x for x in bones)
    assert C.skeleton("x + 1") == "x + 1"
    assert C.skeleton("not python {") == "not python {"
    bare = C.without_docstrings(SOURCE)
    assert '"""' not in bare and "def go" not in bare  # a one-line stub's `...` is a first constant too
    assert C.without_docstrings("def f(:") == "def f(:"


def test_snippets():
    assert C.relevant_snippets(SOURCE, {"A"}) == "A = B = 1"
    assert C.relevant_snippets(SOURCE, {"nothing"}) == C.skeleton(SOURCE)
    both = C.relevant_snippets(SOURCE, {"K", "go"}, methods=True)
    assert both.startswith("class K") and both.count("def go") == 1
    assert C.relevant_snippets(SOURCE, {"go"}, methods=True).strip() == "def go(self): ..."
    assert C.relevant_snippets(SOURCE, {"A", "B"}, methods=True) == "A = B = 1"


def test_chunks():
    assert C.chunks("a/__init__.py", SOURCE) == []
    assert [c["kind"] for c in C.chunks("a.py", SOURCE)] == ["function", "class"]
    assert C.chunks("a.py", "print(1)" * 10)[0]["kind"] == "file" and C.chunks("a.py", "x") == []


def test_form_feed_shifts_lines():
    """Lines are split at form feeds too, line numbers aren't: the snippet is a line early."""
    source = "x = 1\n\x0c\ny = 2\n"
    assert [d.source for d in C.definitions(source)] == ["x = 1", ""]
