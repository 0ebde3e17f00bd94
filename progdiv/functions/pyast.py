"""Syntax subtrees of Python programs, and scope-aware renaming.

A program's subtrees are, of each node, its whole tree and that tree cut at every smaller height; two are equal
if their dumps are. One walk hashes every node at every height asked for; no tree is ever copied or cut.
"""

from __future__ import annotations

import ast
import builtins
import hashlib
import io
import tokenize
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from progdiv.operators.overlap import dealt

VARIANTS = ("plain", "stripped", "obfuscated")


def height(node: ast.AST) -> int:
    return 1 + max(map(height, ast.iter_child_nodes(node)), default=0)


class _Hasher:
    def __init__(self, heights: tuple[int, ...], stripped: bool) -> None:
        self.heights, self.stripped, self.found = heights, stripped, Counter()
        self.tall: dict[int, int] = {}
        self.memo: dict[tuple[int, int], bytes] = {}

    def value(self, name: str, value: object) -> object:
        if self.stripped:
            if name in ("id", "name", "arg") and isinstance(value, str):
                return "x"
            if name == "value" and isinstance(value, (int, float)):
                return 1
            if name == "value" and isinstance(value, str):
                return "s"
        return value

    def hash(self, node: ast.AST, levels: int) -> bytes:
        """Of the node's tree cut to so many levels; fields that are empty don't count, as in a dump."""
        levels = min(levels, self.tall[id(node)])
        key = (id(node), levels)
        if key not in self.memo:
            h = hashlib.blake2b(type(node).__name__.encode(), digest_size=16)
            for name, value in ast.iter_fields(node):
                items = value if isinstance(value, list) else [value]
                parts = [self.hash(v, levels - 1) if isinstance(v, ast.AST) else repr(self.value(name, v)).encode() for v in items if not isinstance(v, ast.AST) or levels > 1]
                if parts and (isinstance(value, list) or value is not None or isinstance(node, ast.Constant) and name == "value"):
                    h.update(b"|" + name.encode() + b"=" + b",".join(str(len(p)).encode() + b":" + p for p in parts))
            self.memo[key] = h.digest()
        return self.memo[key]

    def measure(self, node: ast.AST) -> int:
        self.tall[id(node)] = 1 + max((self.measure(c) for c in ast.iter_child_nodes(node)), default=0)
        return self.tall[id(node)]

    def walk(self, node: ast.AST, depth: int) -> None:
        for r in self.heights:
            if r == self.tall[id(node)] or (r < self.tall[id(node)] and depth + r >= 2):
                self.found[r, self.hash(node, r)] += 1
        for child in ast.iter_child_nodes(node):
            self.walk(child, depth + 1)


def subtrees(code: str, variant: str, heights: tuple[int, ...]) -> Counter | None:
    """Counts of (height, hash); null if the code doesn't parse; none if it can't be renamed."""
    try:
        tree = _parsed(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    if variant == "obfuscated":
        try:
            tree = Renamer().run(tree)
        except RecursionError:
            tree = ast.parse("")
    hasher = _Hasher(heights, variant == "stripped")
    try:
        hasher.measure(tree)
        hasher.walk(tree, 0)
    except RecursionError:
        return None
    return hasher.found


def _parsed(code: str) -> ast.AST:
    """Contexts and operators are shared objects in a parsed tree; every place gets its own."""
    tree = ast.parse(code)
    for node in ast.walk(tree):
        for name, value in ast.iter_fields(node):
            if isinstance(value, (ast.expr_context, ast.operator, ast.unaryop, ast.boolop)):
                setattr(node, name, type(value)())
            elif isinstance(value, list):
                setattr(node, name, [type(v)() if isinstance(v, ast.cmpop) else v for v in value])
    return tree


class Renamer:
    """VAR_i, FUNC_i and CLASS_i for names the program defines, by scope, in order of first definition.

    Kept: builtins, names with double underscores at both ends, imports, arguments with defaults, and attributes of
    anything but self. Docstrings become pass. Comprehensions share the scope around them.
    """

    SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda, ast.Module)

    def __init__(self) -> None:
        self.counts: Counter = Counter()
        self.scopes: dict[int, dict] = {}

    def _define(self, scope: dict, name: str, kind: str | None) -> None:
        target = scope["links"].get(name, scope)
        if name in target["names"] or name.startswith("__") and name.endswith("__"):
            return
        if kind is None or hasattr(builtins, name) and kind == "VAR":
            target["names"][name] = name
            return
        target["names"][name] = f"{kind}_{self.counts[kind]}"
        self.counts[kind] += 1

    def _collect(self, node: ast.AST, scope: dict | None) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            self._define(scope, node.name, "FUNC")
        elif isinstance(node, ast.ClassDef):
            self._define(scope, node.name, "CLASS")
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            for a in node.names:
                self._define(scope, (a.asname or a.name).partition(".")[0], None)
        elif isinstance(node, ast.Name) and isinstance(node.ctx, ast.Store):
            self._define(scope, node.id, "VAR")
        elif isinstance(node, ast.ExceptHandler) and node.name:
            self._define(scope, node.name, "VAR")
        elif isinstance(node, (ast.Global, ast.Nonlocal)):
            top = scope
            while isinstance(node, ast.Global) and top["parent"]:
                top = top["parent"]
            for n in node.names:
                scope["links"][n] = top if isinstance(node, ast.Global) else scope["parent"]
        elif isinstance(node, ast.Attribute) and isinstance(node.ctx, ast.Store) and isinstance(node.value, ast.Name) and node.value.id == "self":
            owner = self._class_of(scope)
            if owner:
                self._define(owner, node.attr, "VAR")
        if isinstance(node, self.SCOPES):
            scope = {"names": {}, "links": {}, "parent": scope, "node": node}
            self.scopes[id(node)] = scope
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
                a = node.args
                plain = a.posonlyargs + a.args
                kept = plain[len(plain) - len(a.defaults) :] + [x for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True) if d]
                for x in [*plain, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]:
                    self._define(scope, x.arg, None if x in kept or x.arg == "self" else "VAR")
        for child in ast.iter_child_nodes(node):
            self._collect(child, scope)

    def _class_of(self, scope: dict | None) -> dict | None:
        while scope and not isinstance(scope["node"], ast.ClassDef):
            scope = scope["parent"]
        return scope

    def _lookup(self, scope: dict | None, name: str) -> str:
        while scope:
            target = scope["links"].get(name, scope)
            if name in target["names"]:
                return target["names"][name]
            scope = target["parent"]
        return name

    def _rename(self, node: ast.AST, scope: dict | None) -> None:
        outer, scope = scope, self.scopes.get(id(node), scope)
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            node.name = self._lookup(outer, node.name)
        elif isinstance(node, ast.Name):
            node.id = self._lookup(scope, node.id)
        elif isinstance(node, ast.arg):
            node.arg = self._lookup(scope, node.arg)
        elif isinstance(node, ast.ExceptHandler) and node.name:
            node.name = self._lookup(scope, node.name)
        elif isinstance(node, (ast.Global, ast.Nonlocal)):
            node.names = [self._lookup(scope, n) for n in node.names]
        elif isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id == "self":
            owner = self._class_of(scope)
            node.attr = owner["names"].get(node.attr, node.attr) if owner else node.attr
        body = getattr(node, "body", None)
        if isinstance(body, list) and isinstance(node, self.SCOPES) and ast.get_docstring(node, clean=False) is not None:
            node.body[0] = ast.Pass()
        for child in ast.iter_child_nodes(node):
            self._rename(child, scope)

    def run(self, tree: ast.AST) -> ast.AST:
        self._collect(tree, None)
        self._rename(tree, None)
        return tree


def obfuscate(code: str | None) -> str | None:
    """The program with its own names replaced; null if it doesn't parse."""
    try:
        return None if code is None else ast.unparse(Renamer().run(_parsed(code)))
    except (SyntaxError, ValueError, RecursionError):
        return None


def lexer_tokens(code: str, comments: bool = True) -> list[str] | None:
    """Tokens of Python's own lexer, strings and comments split at blanks, dedents as DEDENT; null for bad code."""
    out: list[str] = []
    skipped = {tokenize.ENCODING, tokenize.ENDMARKER, tokenize.INDENT, tokenize.NL} | (set() if comments else {tokenize.COMMENT})
    try:
        for t in tokenize.generate_tokens(io.StringIO(code).readline):
            if t.type in skipped:
                continue
            if t.type in (tokenize.STRING, tokenize.COMMENT):
                out += t.string.split(" ")
            else:
                out.append("DEDENT" if t.type == tokenize.DEDENT else t.string)
    except (tokenize.TokenError, SyntaxError, IndentationError):
        return None
    return out


def with_lexer_tokens(frame: DataFrame, code: str, out: str, comments: bool = True) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [None if c is None else lexer_tokens(c, comments) for c in b.column(code).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tokens, pa.list_(pa.string()))], names=[*b.schema.names, out])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    return frame.mapInArrow(run, f"{ddl}, {out} array<string>")


def subtree_rows(programs: DataFrame, keys: list[str], member: str, code: str, heights: tuple[int, ...] = (3, 4, 5, 6), variants: tuple[str, ...] = VARIANTS) -> DataFrame:
    """Rows (keys, member, variant, height, g, c) of every program that parses; g is 64 bits of the subtree's hash.

    A program without subtrees of a height has one row with null g, so that it still counts as a member.
    """
    piece = "struct<variant:string,height:int,g:bigint,c:bigint>"
    kind = pa.list_(pa.struct([("variant", pa.string()), ("height", pa.int32()), ("g", pa.int64()), ("c", pa.int64())]))

    def rows_of(text: str | None) -> list[dict]:
        rows: list[dict] = []
        for variant in variants:
            found = subtrees(text, variant, heights) if text is not None else None
            if found is not None:
                rows += [{"variant": variant, "height": k, "g": int.from_bytes(g[:8], "little", signed=True), "c": n} for (k, g), n in found.items()]
                rows += [{"variant": variant, "height": k, "g": None, "c": 0} for k in set(heights) - {k for k, _ in found}]
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [rows_of(text) for text in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["code", "found"])

    # Equal programs are parsed once.
    distinct = programs.select(programs[code].alias("code")).distinct().mapInArrow(run, f"code string, found array<{piece}>")
    frame = dealt(programs.select(*keys, member, programs[code].alias("code")), "code").join(distinct, "code")
    return frame.select(*keys, member, F.explode("found").alias("_f")).select(*keys, member, "_f.*")
