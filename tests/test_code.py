"""Extraction, tokens, subtrees and renaming."""

import ast
import copy
from collections import Counter

import pytest

from progdiv.functions.extract import FENCE, extract_python
from progdiv.functions.pyast import Renamer, lexer_tokens, obfuscate, subtrees


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("Sure! Here it is:\n\ndef f(x):\n    return x\n\nHope it helps.", "def f(x):\n    return x"),
        (f"Text\n{FENCE}python\nimport os\nprint(1)\n{FENCE}\nbye", "import os\nprint(1)"),
        (f"{FENCE}Python\na = 1\n{FENCE}", "a = 1"),
        ("I cannot help with that today", ""),
        ("@cache\ndef f():\n    pass", "@cache\ndef f():\n    pass"),
        ("x = 1\nif x:print(x)\nok", "x = 1\nif x:print(x)"),
        ('def f():\n    """doc"""\n    return 1', '"""\ndoc\n"""\ndef f():\n    \n    return 1'),
        ("The idea:\n\ndef outer(n):\n    def inner(k):\n        return k * n\n    return inner\n\nIt nests.", "def outer(n):\n    def inner(k):\n        return k * n\n    return inner"),
        ('import sys\nfrom os import path\n\nif __name__ == "__main__":\n    print(path)', 'import sys\nfrom os import path\n\nif __name__ == "__main__":\n    print(path)'),
        ("def f(a):\n    return a + \\\n        1\nThanks!", "def f(a):\n    return a + \\\n        1"),
        ("@total\nclass Item:\n    size = 1\nYou may use it.", "@total\nclass Item:\n    size = 1"),
        (f"First {FENCE}x = 1{FENCE} then\n{FENCE}\ny = 2\n{FENCE}", "y = 2"),
        ("if a > 1:\n    b = 1\nThen the other branch comes\nelse:\n    b = 2", "if a > 1:\n    b = 1\n\nelse:\n    b = 2"),
        ("def f():\n    # größer als früher\n    return 1", "def f():\n    # größer als früher\n    return 1"),
        ("# only a remark\nNothing to run here", "# only a remark"),
        ("    for i in range(3):\n        print(i)\n    print(4)", "for i in range(3):\n        print(i)".replace("        ", "    ") + "\n\n    print(4)"),
        ("while True:\n    break\nelse:\n    pass", "while True:\n    break\nelse:\n    pass"),
        ("x: int = 1\nname\nname.method()", "x: int = 1\nname.method()"),
        ("result is:f(x)\nanswer is:g(x)\n    more", "result is:f(x)"),
        ("async def go():\n    await it\n\n\nz = 1", "async def go():\n    await it\n\nz = 1"),
        ("from a import b  # why\nimport c", "from a import b  \nimport c"),
        ("", ""),
        ("\n\n", ""),
    ],
)
def test_extract(text, code):
    assert extract_python(text) == code


def test_extract_null():
    assert extract_python(None) is None


def test_lexer_tokens():
    assert lexer_tokens("x = 'a b' # c d") == ["x", "=", "'a", "b'", "#", "c", "d", ""]
    assert lexer_tokens("if x:\n  y\nz") == ["if", "x", ":", "\n", "y", "\n", "DEDENT", "z", ""]
    assert lexer_tokens("x = (") is None


def cut(node, depth):
    """A copy without nodes deeper than depth."""
    for name, value in list(ast.iter_fields(node)):
        if isinstance(value, list):
            setattr(node, name, [cut(v, depth - 1) if isinstance(v, ast.AST) else v for v in value if not isinstance(v, ast.AST) or depth > 1])
        elif isinstance(value, ast.AST):
            if depth > 1:
                cut(value, depth - 1)
            else:
                delattr(node, name)
    return node


def tall(node):
    return 1 + max(map(tall, ast.iter_child_nodes(node)), default=0)


@pytest.mark.parametrize("code", ["x", "", "def f(a, b=1):\n    return [a + i for i in range(b)]", "class A:\n    def g(self):\n        self.x = 'q'\n        return self.x if self.x else None", "import os\nfor k in {1: 2, **z}:\n    print(f'{k}')"])
def test_subtrees_are_dumps_of_cut_trees(code):
    """Every node whole and cut at each smaller height (the root's cut at height 1 is left out)."""
    want = Counter()

    def walk(node, depth):
        full = tall(node)
        for r in range(1, full + 1):
            if r == full or depth + r >= 2:
                want[r, ast.dump(cut(copy.deepcopy(node), r))] += 1
        for child in ast.iter_child_nodes(node):
            walk(child, depth + 1)

    walk(ast.parse(code), 0)
    got = subtrees(code, "plain", tuple(range(1, 30)))
    assert Counter(got.values()) == Counter(want.values()) and len(got) == len(want)
    assert Counter({h: sum(n for (k, _), n in got.items() if k == h) for h in range(1, 8)}) == Counter({h: sum(n for (k, _), n in want.items() if k == h) for h in range(1, 8)})


def test_variants():
    h = (3, 4, 5)
    assert subtrees("a = b + 1", "plain", h) != subtrees("x = y + 2", "plain", h)
    assert subtrees("a = b + 1", "stripped", h) == subtrees("x = y + 2", "stripped", h)
    assert subtrees("def f(p):\n  q = p\n  return q", "obfuscated", h) == subtrees("def g(s):\n  t = s\n  return t", "obfuscated", h)
    assert subtrees("def (", "plain", h) is None


def test_renaming():
    code = "import os\ndef outer(a, b=2):\n    '''doc'''\n    total = len(a) + b\n    def inner():\n        nonlocal total\n        total += 1\n    return os.path.join(total)\nclass C:\n    def m(self):\n        self.v = 1\n        return self.v\n"
    new = obfuscate(code)
    assert "outer" not in new and "inner" not in new and "total" not in new and "doc" not in new
    assert "os.path.join" in new and "b=2" in new and "len(" in new and "class CLASS_0" in new and "self.v" not in new
    compile(new, "x", "exec")
    assert obfuscate("def (") is None and isinstance(Renamer().run(ast.parse("x = 1")), ast.Module)


def test_lines_that_come_again_are_parsed_once(monkeypatch):
    from progdiv.functions import extract

    parsed, parse = [], extract.ast.parse
    monkeypatch.setattr(extract.ast, "parse", lambda code: parsed.append(code) or parse(code))
    texts = ["again = 1\nno code at all, again", "again = 1\n" + "x" * 300]
    assert [extract_python(t) for t in texts * 3] == [extract_python(t) for t in texts] * 3
    assert parsed.count("again = 1") == 1
