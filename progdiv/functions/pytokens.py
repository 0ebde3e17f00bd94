"""Tokens of Python programs that need not parse.

A state machine over characters with a stack of indentations, one of open brackets and one of strings with replacement
fields. Programs that parse give the tokens of Python's own lexer. Where that would stop, tokens go on by these rules:

* a string in single quotes that its line doesn't end: its opening is a token, what follows is code; in triple quotes: all the rest;
* a closing bracket closes the nearest of its kind that is open, or nothing; brackets open at the end count as closed;
* a line inside brackets that starts with a word that only starts statements closes all brackets and begins a new line of code;
* a line less indented than the ones before but like none of them has its own indentation from there on;
* any other character is a token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Operators of more than one character, and words that only start statements.
_OPERATORS = "**= //= >>= <<= ... != -> := == <= >= += -= *= /= %= &= |= ^= @= ** // << >>".split()
_STATEMENTS = frozenset("assert break class continue def del elif except finally global import nonlocal pass raise return try while with".split())

_OPENING = {")": "(", "]": "[", "}": "{"}
_DIGITS, _EXPONENT = r"[0-9](?:_?[0-9])*", r"[eE][-+]?[0-9](?:_?[0-9])*"
_NUMBER = re.compile(rf"0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:{_DIGITS})?\.{_DIGITS}|{_DIGITS}\.?)(?:{_EXPONENT})?[jJ]?")
_NAME, _BLANK, _COMMENT, _END = re.compile(r"[^\W\d]\w*"), re.compile(r"(?:[ \t\f]|\r(?!\n))+"), re.compile(r"#[^\r\n]*"), re.compile(r"\r?\n")
_OPERATOR = re.compile("|".join(map(re.escape, _OPERATORS)) + r"|[-+*/%@&|^~<>()\[\]{},:.;=!]")
_STRING = re.compile(r"""([rRbBuU]|[bB][rR]|[rR][bB])?('''|\"\"\"|'|")""")
_FIELDS = re.compile(r"""([fF][rR]?|[rR][fF])('''|\"\"\"|'|")""")
_REST = {
    "'": re.compile(r"[^\\'\r\n]*(?:\\(?:\r\n|.)[^\\'\r\n]*)*'", re.S), '"': re.compile(r'[^\\"\r\n]*(?:\\(?:\r\n|.)[^\\"\r\n]*)*"', re.S),
    "'''": re.compile(r"[^\\']*(?:(?:\\.|'(?!''))[^\\']*)*'''", re.S), '"""': re.compile(r'[^\\"]*(?:(?:\\.|"(?!""))[^\\"]*)*"""', re.S),
}


class _Lexer:
    """(kind, text) of tokens; kinds: comment, string, dedent, newline and code."""

    def __init__(self, code: str) -> None:
        self.code, self.at, self.found = code, 0, []
        self.indents, self.brackets = [0], []
        #: Strings with fields and fields in them: ("text", quote, raw), ("field", number of brackets outside of it), ("format", quote, raw).
        self.inside: list[tuple] = []
        self.empty = True  # the line has no token yet

    def add(self, kind: str, text: str) -> None:
        self.found.append((kind, text))
        self.empty = False

    def eat(self, pattern: re.Pattern, kind: str | None = "code") -> str | None:
        hit = pattern.match(self.code, self.at)
        if not hit:
            return None
        self.at = hit.end()
        if kind:
            self.add(kind, hit[0])
        return hit[0]

    def run(self) -> list[tuple[str, str]]:
        self.begin_line()
        while self.at < len(self.code):
            if self.inside and self.inside[-1][0] != "field":
                self.text()
            else:
                self.step()
        if not self.empty:
            self.add("newline", "")
        self.found += [("dedent", "")] * (len(self.indents) - 1)
        return self.found

    def begin_line(self) -> None:
        """Indentation of the next line that has code; comments before it."""
        while self.at < len(self.code):
            column = 0
            while self.at < len(self.code) and (c := self.code[self.at]) in " \t\f":
                column = column + 1 if c == " " else (column // 8 + 1) * 8 if c == "\t" else 0
                self.at += 1
            if self.eat(_COMMENT, "comment"):
                self.empty = True
            if not self.eat(_END, None):
                break
        if self.at >= len(self.code):
            return
        if column > self.indents[-1]:
            self.indents.append(column)
        while column < self.indents[-1]:
            self.indents.pop()
            self.found.append(("dedent", ""))
        if column > self.indents[-1]:  # like none of the lines before
            self.indents.append(column)

    def step(self) -> None:
        """One token of code."""
        code, c = self.code, self.code[self.at]
        base = self.inside[-1][1] if self.inside else 0
        if self.eat(_BLANK, None) or self.eat(_COMMENT, "comment"):
            return
        if end := self.eat(_END, None):
            if self.brackets or self.inside:
                blank = _BLANK.match(code, self.at)
                word = _NAME.match(code, blank.end() if blank else self.at)
                if not word or word[0] not in _STATEMENTS:
                    return
                self.brackets, self.inside = [], []
            if not self.empty:
                self.add("newline", end)
            self.empty = True
            self.begin_line()
        elif c == "\\" and _END.match(code, self.at + 1):
            self.at = _END.match(code, self.at + 1).end()
        elif hit := _FIELDS.match(code, self.at):
            if len(hit[2]) == 1 and not self.closed(hit.end(), hit[2]) and self.ends_outer(hit[2]):
                return
            self.at = hit.end()
            self.add("code", hit[0])
            self.inside.append(("text", hit[2], "r" in hit[1].lower()))
        elif hit := _STRING.match(code, self.at):
            rest = _REST[hit[2]].match(code, hit.end())
            if rest:
                self.at = rest.end()
                self.add("string", code[hit.start() : self.at])
            elif len(hit[2]) == 3:
                self.at = len(code)
                self.add("string", code[hit.start() :])
            elif hit[1] or not self.ends_outer(hit[2]):
                self.at = hit.end()
                self.add("code", hit[0])
        elif self.eat(_NAME) or self.eat(_NUMBER):
            pass
        elif self.inside and len(self.brackets) == base and c in "}:!" and not (c == "!" and code[self.at + 1 : self.at + 2] == "="):
            self.at += 1
            self.add("code", c)
            if c == "}":
                self.inside.pop()
            elif c == ":":
                self.inside.append(("format", *next(x for x in reversed(self.inside) if x[0] == "text")[1:]))
        elif op := self.eat(_OPERATOR):
            if op in "([{":
                self.brackets.append(op)
            elif op in _OPENING:
                opening, above = _OPENING[op], self.brackets[base:]
                if opening in above:
                    del self.brackets[base + len(above) - 1 - above[::-1].index(opening) :]
        else:
            self.at += 1
            self.add("code", c)

    def closed(self, at: int, quote: str) -> bool:
        """Whether the line goes on to another such quote."""
        end = _END.search(self.code, at)
        return quote in self.code[at : end.start() if end else len(self.code)]

    def ends_outer(self, quote: str) -> bool:
        """Lets a quote that begins nothing end the string whose field it stands in."""
        text = next((x for x in reversed(self.inside) if x[0] == "text"), None)
        if not text or text[1] != quote or self.code[self.at] != quote:
            return False
        self.end_text()
        self.at += 1
        self.add("code", quote)
        return True

    def end_text(self) -> None:
        """Closes the innermost string with fields, with what is open in it."""
        while (last := self.inside.pop())[0] != "text":
            if last[0] == "field":
                del self.brackets[last[1] :]

    def text(self) -> None:
        """The literal part of a string with fields up to a field, its end, or where the lexer parts it."""
        kind, quote, raw = self.inside[-1]
        code, start, at = self.code, self.at, self.at
        while at < len(code):
            c = code[at]
            if code.startswith(quote, at):
                self.literal(kind, start, at, always=False)
                self.at = at + len(quote)
                self.end_text()
                self.add("code", quote)
                return
            if c in "\r\n" and len(quote) == 1 and (c == "\n" or code[at + 1 : at + 2] == "\n"):
                self.literal(kind, start, at, always=False)
                self.end_text()
                return
            if c == "\\":
                after = code[at + 1 : at + 2]
                if after == "N" and not raw and code[at + 2 : at + 3] == "{" and (end := code.find("}", at)) >= 0:
                    self.literal(kind, start, end + 1)
                    return
                at += 1 if after in ("{", "}") else 3 if code.startswith("\r\n", at + 1) else 2
            elif c == "{" or c == "}" and kind == "format":
                if c == "{" and kind == "text" and code.startswith("{", at + 1):
                    self.literal(kind, start, at + 1)
                    self.at = at + 2
                    return
                self.literal(kind, start, at, always=c == "}" or kind == "format" and code.startswith("{", at + 1))
                self.at = at + 1
                self.add("code", c)
                if c == "{":
                    self.inside.append(("field", len(self.brackets)))
                else:
                    del self.inside[-2:]
                return
            elif c == "}" and code.startswith("}", at + 1):
                self.literal(kind, start, at + 1)
                self.at = at + 2
                return
            else:
                at += 1
        self.literal(kind, start, len(code), always=False)
        self.end_text()

    def literal(self, kind: str, start: int, end: int, always: bool = False) -> None:
        self.at = end
        if end > start or always:
            self.add("code", self.code[start:end])


def kinds_and_tokens(code: str, comments: bool = True) -> list[tuple[str, str]]:
    """(kind, token): strings and comments parted at blanks, line ends, DEDENT where a block ends, and all other tokens, of any text."""
    out: list[tuple[str, str]] = []
    for kind, text in _Lexer(code).run():
        if kind in ("string", "comment"):
            out += [(kind, part) for part in text.split(" ")] if comments or kind == "string" else []
        else:
            out.append((kind, "DEDENT" if kind == "dedent" else text))
    return out


def tolerant_tokens(code: str, comments: bool = True) -> list[str]:
    return [token for _, token in kinds_and_tokens(code, comments)]


def with_tokens(frame: DataFrame, code: str, out: str, comments: bool = True) -> DataFrame:
    """Adds tolerant_tokens of a column of programs; null for null. Equal programs are read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [tolerant_tokens(c, comments) for c in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens, pa.list_(pa.string()))], names=["_code", out])

    programs = frame.select(F.col(code).alias("_code")).where("_code IS NOT NULL").distinct().mapInArrow(run, f"_code string, `{out}` array<string>")
    return frame.join(programs, F.col(code) == F.col("_code"), "left").drop("_code")
