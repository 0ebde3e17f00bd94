"""Python code out of generated text: fences, prose and code mixed."""

from __future__ import annotations

import ast
import dataclasses
import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What opens a block, what is an import or decorator, and one-line compound statements.
BLOCK = re.compile(
    r'def\s+\w+\s*\(|class\s+\w+|if\s+__name__\s*==\s*"__main__":|while\s*.*:\s*$|for\s+.*in\s+.*:\s*$|if\s*.*:\s*$|elif\s*.*:\s*$'
    r"|else\s*:\s*$|try\s*:\s*$|except\s*.*:\s*$|finally\s*:\s*$|with\s*.*:\s*$|async\s+def\s+\w+\s*\("
)
IMPORT = re.compile(r"from\s+[\w\.]+\s+import\s+[\w\.,\s*]+|import\s+[\w\.,\s*]+|@")
FENCE = "`" * 3


@dataclasses.dataclass
class Line:
    """A line, its code (without comment and indent), what the code lacks of the line's length, and its kind: opener (of a
    block), blank, import or other."""

    raw: str
    code: str
    depth: int
    kind: str


def classify(raw: str) -> Line:
    code = raw.split("#", 1)[0].lstrip()
    kind = "opener" if BLOCK.match(code) else "blank" if not code else "import" if IMPORT.match(code) else "other"
    return Line(raw, code, len(raw) - len(code), kind)


def segments(lines: list[Line]) -> Iterator[tuple[int, int]]:
    """Bounds of the parts of a text: blocks, from an opener over openers, blank and deeper lines, and other lines alone."""
    at = 0
    while at < len(lines):
        end = at + 1
        if lines[at].kind == "opener":
            while end < len(lines) and (lines[end].kind in ("opener", "blank") or lines[end].depth > lines[at].depth):
                end += 1
        yield at, end
        at = end


#: Lines of up to so many characters whose answer is remembered, and how many of them.
SHORT, REMEMBERED = 200, 1 << 15


def is_statement(code: str, only_expression: bool = False) -> bool:
    """Whether code parses to something that begins with another statement than a bare name. Short lines that come again are not
    parsed again."""
    return (_remembered if len(code) <= SHORT else _is_statement)(code, only_expression)


def _is_statement(code: str, only_expression: bool) -> bool:
    try:
        first = next(iter(ast.parse(code).body), None)
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return False
    if isinstance(first, ast.Expr):
        return not isinstance(first.value, ast.Name)
    return first is not None and not only_expression


_remembered = functools.lru_cache(REMEMBERED)(_is_statement)


def is_one_liner(line: Line, following: list[Line]) -> bool:
    """A compound statement on one line: an expression comes after its last colon, and no deeper line after it."""
    return is_statement(line.code.rpartition(":")[2], only_expression=True) and all(f.depth <= line.depth for f in following)


def code_of(lines: list[Line]) -> str:
    """What is code of classified lines: blocks without their first line's indent, blank lines, imports and statements."""
    out = []
    for at, end in segments(lines):
        line, ends = lines[at], "\n"
        if line.kind == "opener":
            kept = "\n".join(x.raw[line.depth :] for x in lines[at:end]).strip()
            ends = "\n" if end == len(lines) else "\n\n"
        elif line.kind == "import":
            kept = line.code
        elif line.kind == "blank" or is_statement(line.code) or is_one_liner(line, lines[end : end + 1]):
            kept = line.raw
        else:
            continue
        out.append(kept + ends)
    return "".join(out)


def extract_python(text: str | None) -> str | None:
    """The Python in a text; null for null. Triple-quoted strings are hoisted into one leading docstring."""
    if text is None:
        return None
    doc = []
    for quote in ('"""', "'''"):
        pattern = re.compile(f"{quote}(.*?){quote}", re.DOTALL)
        doc += pattern.findall(text)
        text = pattern.sub("", text)
    head = '"""\n' + "\n".join(doc) + '\n"""' if doc else ""
    text = text.replace(f"{FENCE}Python\n", f"{FENCE}\n").replace(FENCE, f"{FENCE}\n")
    return (head + "\n" + code_of([classify(x) for x in text.splitlines()])).strip()


def extract_python_code(text: Column) -> Column:
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(extract_python)

    return F.pandas_udf(run, "string")(text)
