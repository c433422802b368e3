from collections import Counter

from quillspan.operators import retrieve as R

FILES = {
    "main.py": "import lib",
    "pkg/__init__.py": "",
    "pkg/util.py": 'import os\n\ndef helper(a):\n    """Doc."""\n    return os.path.join(a, "some longer text here")\n\ndef other():\n    return 1\n',
    "pkg/shapes.py": "class Shape:\n    def area(self):\n        return 0\n\n    def scale_by(self, factor):\n        return self.area() * factor\n",
    "deep/barfoo.py": "def lonely_function_of_the_file():\n    return 'barfoo'\n",
}
POINT = {"path": "main.py", "prefix": "from pkg.util import helper\nfrom foo import x\n\nclass Mine(Shape):\n    def go(self, s: Shape):\n        return helper", "suffix": "\n", "modified": ["shapes.py"]}


def test_resolution():
    at = lambda m, level=0, path="main.py": R.resolve_module({"module": m, "level": level}, path, FILES)
    assert at("pkg.util") == "pkg/util.py" and at("pkg") == "pkg/__init__.py"
    assert at("foo") == "deep/barfoo.py"  # a suffix need not begin at a folder
    assert at("util", 1, "pkg/a.py") == "pkg/util.py" and at("util", 2, "pkg/sub/a.py") == "pkg/util.py"
    assert at("", 1) == "main.py" and at("missing.mod") is None
    assert R.resolve_module({"module": "os", "level": 0}, "a.py", {"macos.py": ""}) is None
    assert R.resolve_module({"module": "os", "level": 1}, "a.py", {"os.py": ""}) == "os.py"


def test_line_counts():
    assert [R.line_count(t) for t in ("", "a", "a\n", "a\nb", "a\r\nb\r\n", "\n" * 9, "x\n" * 9 + "x")] == [0, 1, 1, 2, 2, 9, 10]
    nine = {"a.py": "x\n" * 9, "b.py": "x\n" * 10}
    assert R.baseline_path({"prefix": "x", "modified": ["a.py"]}, nine, "recent") == "b.py"


LONG = "def {0}():\n    return '{0} and the rest of a long enough body of its own'\n"
REPO = {
    "a/bases.py": "class Parent:\n    size = 1\n    def grow(self):\n        return self.size\n\ndef unrelated():\n    return 0\n",
    "a/used.py": 'import sys\n\ndef tool(x):\n    """Doc."""\n    return x\n\ndef spare():\n    return 2\n',
    "b/__init__.py": LONG.format("river"),
    "c/changed.py": LONG.format("tool") + LONG.format("fresh"),
    "c/small.py": "tool = 1\n",
    "d/ranked.py": LONG.format("river") + "RIVER_STONES = [1, 2, 3, 4, 5, 6, 7, 8, 9]\n",
    "d/tiny.py": "river = 1\n",
    "macos.py": LONG.format("macos"),
}
ASKED = {"path": "main.py", "prefix": "import os\nfrom a.used import tool\n\nclass Mine(Parent):\n    def go(self):\n        y = tool\n", "suffix": "\nriver = 1\n", "modified": ["small.py", "changed.py", "main.py"]}
TOOL = "<|file_sep|>a/used.py\ndef tool(x):\n    return x"
PARENT = "<|file_sep|>a/bases.py\nclass Parent:\n    size = 1\n    def grow(self):\n        return self.size"
CHANGED = "<|file_sep|>c/changed.py\ndef tool():\n    return 'tool and the rest of a long enough body of its own'"
BONES = "<|file_sep|>d/ranked.py\ndef river():\n\nRIVER_STONES = [1, 2, 3, 4, 5, 6, 7, 8, 9]"
CHUNK = "<|file_sep|>d/ranked.py\ndef river():\n    return 'river and the rest of a long enough body of its own'"


def entries(variant, repo=REPO, **changed):
    text = R.context_of(ASKED | changed, repo, R.VARIANTS[variant])
    return ["<|file_sep|>" + e.strip() for e in text.split("<|file_sep|>")[1:]]


def test_contexts_by_hand():
    """Snippets of changed files (30 characters), retrieved skeletons (50, no package files; their `...` go as docstrings do), then the import and the base class."""
    v1 = entries("v1")
    assert v1[0] == CHANGED and v1[-2:] == [TOOL, PARENT] and BONES in v1
    v2 = entries("v2")
    assert v2 == [TOOL, PARENT.rsplit("\n", 1)[0] + "\n\ndef unrelated():"]  # two of the three best files are too short
    v5 = entries("v5")
    assert v5[0] == CHANGED and v5[-2:] == [TOOL, PARENT] and CHUNK in v5
    for e in v1 + v2 + v5:
        assert not any(name in e for name in ("small.py", "tiny.py", "__init__", "main.py"))


def test_the_first_included_file_ends_the_class_lookup():
    late = {"a/used.py": REPO["a/used.py"], "z/bases.py": REPO["a/bases.py"]}
    assert entries("v1", late, modified=[], suffix="")[-1] == TOOL
    assert entries("v1", late, prefix="class M(Parent):\n    x", modified=[], suffix="") == [PARENT.replace("a/bases", "z/bases")]
    assert entries("v1", late, prefix="x = 1", suffix="class M(Parent):\n    x = 2\n", modified=[]) == [PARENT.replace("a/bases", "z/bases")]
    hinted = entries("v2", late, prefix="def f(x: Parent):\n    return", suffix="")
    assert hinted == ["<|file_sep|>z/bases.py\nclass Parent:\n    size = 1\n    def grow(self):\n\ndef unrelated():"]


def test_bm25_prefers_shared_rare_words():
    docs = [Counter("a a b".split()), Counter("b c".split()), Counter("d".split())]
    s = R.rank(Counter("c b".split()), docs)
    assert s[1] > s[0] > s[2] == 0


def test_contexts():
    for v in R.VARIANTS.values():
        text = R.context_of(POINT, FILES, v)
        assert "<|file_sep|>pkg/util.py\n" in text and "def helper" in text and "def other" not in text
        assert "main.py" not in text
        assert text.count("class Shape") == 1
    assert R.context_of(POINT | {"prefix": "", "suffix": "", "modified": None}, {}, R.VARIANTS["v1"]) == ""


def test_budget_is_kept():
    big = {f"m{i}.py": f"def f{i}(helper):\n    return '{'x' * 9000}'\n" for i in range(20)}
    for v in R.VARIANTS.values():
        assert len(R.context_of(POINT, big | FILES, v)) <= v.extended


def test_baselines():
    long = {p: c + "\n" * 10 for p, c in FILES.items()}
    assert R.baseline_path(POINT, long, "bm25") in long
    assert R.baseline_path(POINT | {"modified": ["pkg/util.py"]}, long, "recent") == "pkg/util.py"
    assert R.baseline_path(POINT, long, "random") == R.baseline_path(POINT, dict(reversed(long.items())), "random")
    assert R.baseline_path(POINT, {}, "bm25") is None


def test_spark_plan(spark):
    points = spark.createDataFrame([(1, "o/r", "v", *(POINT[k] for k in ("path", "prefix", "suffix", "modified")))], "point_id long, repo string, revision string, path string, prefix string, suffix string, modified array<string>")
    files = spark.createDataFrame([("o/r", "v", p, c) for p, c in FILES.items()], "repo string, revision string, path string, content string")
    found = R.contexts(points, files, "v2")
    assert found.collect()[0]["context"] == R.context_of(POINT, FILES, R.VARIANTS["v2"])
    out = R.submission(points, found, prefix_lines=2, suffix_lines=5).first()
    assert out["prefix"].count("\n") == 1 and out["suffix"] is None
