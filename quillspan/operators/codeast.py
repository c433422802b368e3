"""Facts about Python source: imports, symbols, definitions, skeletons.

The Arrow UDF at the end (analyse) hands all facts of a file to Spark as one struct. The last trees are kept, so a file is
parsed once however many of its facts are asked for one after the other.
"""

from __future__ import annotations

import ast
import re
import sys
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Base classes that are never looked up.
BUILTIN_BASES = frozenset("object Exception BaseException type dict list set tuple str int float bool".split())
# Modules of older standard libraries; the present ones come from the interpreter.
OLD_MODULES = frozenset("aifc asynchat asyncore audioop binhex cgi cgitb chunk crypt distutils formatter imghdr imp lib2to3 mailcap nis nntplib ossaudiodev pipes smtpd sndhdr sunau telnetlib test uu xdrlib".split())
_WORD = re.compile(r"[a-zA-Z_]\w*")
_FROM = re.compile(r"^from\s+(\.*)(\S*)\s+import\s+(.+)")
_IMPORT = re.compile(r"^import\s+(.+)")
_DEF = (ast.FunctionDef, ast.AsyncFunctionDef)


def is_stdlib(module: str) -> bool:
    """Whether the first part of a module's name is the standard library's."""
    top = module.split(".")[0]
    return top in sys.stdlib_module_names or top in OLD_MODULES


@lru_cache(maxsize=8)
def _strict(source: str) -> ast.Module | None:
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


@lru_cache(maxsize=8)
def parse_leniently(source: str) -> ast.Module | None:
    """The tree of a source that may be cut off: as it is, with a body added, or of the lines before its first definition."""
    tree = _strict(source) or _strict(source + "\n    pass\n")
    if tree is None:
        lines = source.split("\n")
        starts = (i for i, x in enumerate(lines) if x.strip().startswith(("class ", "def ", "async def ")))
        tree = _strict("\n".join(lines[: next(starts, len(lines))]))
    return tree


def imports(source: str) -> list[dict]:
    """Import records, outer ones first (breadth first); by pattern where the source can't be parsed."""
    tree = parse_leniently(source)
    out = []
    if tree is None:
        for line in map(str.strip, source.split("\n")):
            if m := _FROM.match(line):
                names = [p.strip().split(" as ")[0] for p in m[3].split(",")]
                out.append({"module": m[2], "names": names, "is_relative": bool(m[1]), "level": len(m[1])})
            elif m := _IMPORT.match(line):
                out += [{"module": p.strip().split(" as ")[0].strip(), "names": [], "is_relative": False, "level": 0} for p in m[1].split(",")]
        return out
    for node in ast.walk(tree):
        match node:
            case ast.Import(names=names):
                out += [{"module": a.name, "names": [], "is_relative": False, "level": 0} for a in names]
            case ast.ImportFrom(module=module, names=names, level=level):
                out.append({"module": module or "", "names": [a.name for a in names], "is_relative": bool(level), "level": level or 0})
    return out


def used_symbols(source: str) -> set[str]:
    tree = parse_leniently(source)
    if tree is None:
        return set(_WORD.findall(source))
    return {n.id if isinstance(n, ast.Name) else n.attr for n in ast.walk(tree) if isinstance(n, (ast.Name, ast.Attribute))}


def _plain_names(node: ast.AST | None) -> set[str]:
    """Names of an annotation; of a subscript only what is subscripted."""
    match node:
        case ast.Name(id=name) | ast.Attribute(attr=name):
            return {name}
        case ast.Subscript(value=value):
            return _plain_names(value)
    return set()


def type_hints(source: str) -> set[str]:
    tree = parse_leniently(source)
    out: set[str] = set()
    for node in ast.walk(tree) if tree else ():
        if isinstance(node, _DEF):
            a = node.args
            for arg in (*a.posonlyargs, *a.args, *a.kwonlyargs):
                out |= _plain_names(arg.annotation)
            out |= _plain_names(node.returns)
        elif isinstance(node, ast.AnnAssign):
            out |= _plain_names(node.annotation)
    return out


def base_classes(source: str) -> set[str]:
    tree = parse_leniently(source)
    found = (b for n in ast.walk(tree) if isinstance(n, ast.ClassDef) for b in n.bases) if tree else ()
    return {b.id if isinstance(b, ast.Name) else b.attr for b in found if isinstance(b, (ast.Name, ast.Attribute))} - BUILTIN_BASES


@dataclass(frozen=True)
class Definition:
    name: str
    kind: str
    start: int
    end: int
    source: str
    owner: str = field(default="", compare=False)


def definitions(source: str, methods: bool = False) -> list[Definition]:
    """Top-level functions, classes and assigned names; decorators are left out. methods: those of the classes too."""
    tree, lines, out = _strict(source), source.splitlines(), []

    def add(name: str, kind: str, node: ast.stmt, owner: str = "") -> None:
        out.append(Definition(name, kind, node.lineno - 1, node.end_lineno, "\n".join(lines[node.lineno - 1 : node.end_lineno]), owner))

    for node in tree.body if tree else ():
        if isinstance(node, _DEF):
            add(node.name, "function", node)
        elif isinstance(node, ast.ClassDef):
            add(node.name, "class", node)
            for inner in node.body if methods else ():
                if isinstance(inner, _DEF):
                    add(inner.name, "method", inner, node.name)
        elif isinstance(node, ast.Assign):
            for target in node.targets:
                if isinstance(target, ast.Name):
                    add(target.id, "assignment", node)
    return out


def skeleton(source: str) -> str:
    """Imports, plain assignments (those of classes too) and headers with `...` for bodies, a line end between them; a header has its first line only.

    The source if it can't be parsed or nothing is left.
    """
    tree, lines = _strict(source), source.splitlines(keepends=True)
    if tree is None:
        return source

    def header(node: ast.stmt) -> str:
        return f"{lines[node.lineno - 1].rstrip()}\n{' ' * (node.col_offset + 4)}..."

    def whole(node: ast.stmt) -> str:
        return "".join(lines[node.lineno - 1 : node.end_lineno])

    def bones(node: ast.stmt) -> str | None:
        match node:
            case ast.Import() | ast.ImportFrom() | ast.Assign():
                return whole(node)
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                return header(node) + "\n"
            case ast.ClassDef(body=body):
                inner = [header(n) if isinstance(n, _DEF) else whole(n).rstrip() for n in body if isinstance(n, (*_DEF, ast.Assign))]
                return "\n".join([lines[node.lineno - 1].rstrip(), *inner]) + "\n"
        return None

    kept = "\n".join(x for n in tree.body if (x := bones(n)) is not None)
    return kept if kept.strip() else source


def without_docstrings(source: str) -> str:
    """Drops the lines of a first statement that is a constant (`...` too) from modules, classes and functions."""
    tree = _strict(source)
    if tree is None:
        return source
    gone: set[int] = set()
    for node in ast.walk(tree):
        if isinstance(node, (ast.Module, ast.ClassDef, *_DEF)) and node.body:
            first = node.body[0]
            if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant):
                gone.update(range(first.lineno - 1, first.end_lineno))
    return "\n".join(x for i, x in enumerate(source.splitlines()) if i not in gone)


def relevant_snippets(source: str, needed: set[str], methods: bool = False) -> str:
    """Definitions of the needed names, a blank line between; the skeleton if there are none. A method goes with its class."""
    found = [d for d in definitions(source, methods) if d.name in needed]
    if not found:
        return skeleton(source)
    classes = {d.name for d in found if d.kind == "class"}
    kept: dict[tuple[int, int], Definition] = {}
    for d in found:
        if d.kind != "method" or d.owner not in classes:
            kept.setdefault((d.start, d.end) if methods else (d.start, d.end, d.name), d)
    return "\n\n".join(d.source for d in kept.values())


def chunks(path: str, source: str, least: int = 30, least_file: int = 50) -> list[dict]:
    """Definitions (methods too) of at least `least` characters with a token; a file without any is a chunk if longer than `least_file`."""
    if path.rsplit("/", 1)[-1] == "__init__.py":
        return []
    found = definitions(source, methods=True)
    if not found:
        return [{"name": path, "kind": "file", "text": source}] if len(source) > least_file else []
    return [{"name": d.name, "kind": d.kind, "text": d.source} for d in found if len(d.source) >= least and _WORD.search(d.source.lower())]


FACTS = (
    "imports array<struct<module:string,names:array<string>,is_relative:boolean,level:int>>, symbols array<string>, hints array<string>, bases array<string>, "
    "definitions array<struct<name:string,kind:string,start:int,end:int,source:string>>, skeleton string, stripped string"
)


def _facts(source: pd.Series) -> pd.DataFrame:
    rows = []
    for s in source.fillna(""):
        rows.append((imports(s), sorted(used_symbols(s)), sorted(type_hints(s)), sorted(base_classes(s)), [vars(d) | {"end": d.end} for d in definitions(s, True)], skeleton(s), without_docstrings(s)))
    frame = pd.DataFrame(rows, columns=["imports", "symbols", "hints", "bases", "definitions", "skeleton", "stripped"])
    frame["definitions"] = [[{k: d[k] for k in ("name", "kind", "start", "end", "source")} for d in ds] for ds in frame["definitions"]]
    return frame


def analyse(source: str | Column) -> Column:
    """All facts of a source in one struct."""
    return F.pandas_udf(_facts, FACTS)(F.col(source) if isinstance(source, str) else source)


def snippets_of(source: str | Column, names: str | Column) -> Column:
    """relevant_snippets() of a column of sources and a column of arrays of names."""

    @F.pandas_udf("string")
    def found(source: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([relevant_snippets(s or "", set(n) if n is not None else set()) for s, n in zip(source, names, strict=True)], dtype=object)

    return found(source, names)


def chunks_of(path: str | Column, source: str | Column) -> Column:
    """chunks() of columns of paths and sources."""

    @F.pandas_udf("array<struct<name:string,kind:string,text:string>>")
    def found(path: pd.Series, source: pd.Series) -> pd.Series:
        return pd.Series([chunks(p or "", s or "") for p, s in zip(path, source, strict=True)], dtype=object)

    return found(path, source)
