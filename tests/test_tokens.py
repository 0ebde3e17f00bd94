"""Tokens of programs that need not parse, and subwords."""

import ast
import glob
import os
import random
import warnings

import pytest

from progdiv.functions.pyast import lexer_tokens
from progdiv.functions.pytokens import tolerant_tokens, with_tokens
from progdiv.functions.subwords import Merges, default_vocabulary, with_subwords


def test_standard_library_has_the_lexers_tokens():
    files = sorted(glob.glob(os.path.dirname(os.__file__) + "/*.py"))
    seen = 0
    for path in files[::3]:
        with open(path, encoding="utf-8", newline="") as f:
            code = f.read()
        for comments in (True, False):
            want = lexer_tokens(code, comments)
            if want is not None:
                seen += 1
                assert tolerant_tokens(code, comments) == want, path
    assert seen > 50


@pytest.mark.parametrize("seed", range(4))
def test_strings_with_fields_have_the_lexers_tokens(seed):
    r = random.Random(seed)
    bits = ["{", "}", "{{", "}}", ":", "a", "!r", " ", "x", "'", '"', "\\n", "\\N{DASH}", "=", "[0]", "(", ")", ".2f", "{w}", ",", "lambda y: 1", "!=", "\\", "\n"]
    seen = 0
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for _ in range(20000):
            q = r.choice(["'", '"', "'''", '"""'])
            code = r.choice(["f", "rf", "F"]) + q + "".join(r.choice(bits) for _ in range(r.randint(0, 7))) + q
            code = f"x = ({code}\n)\nif x:\n\ty = {code} # c d" if r.random() < 0.2 else code
            got = tolerant_tokens(code)  # never fails
            try:
                ast.parse(code)
            except (SyntaxError, ValueError):
                continue
            seen += 1
            assert got == lexer_tokens(code), code
    assert seen > 1000


BROKEN = [
    ("", []), (" ", []), ("\n\n", []), ("x", ["x", ""]), ("\x00$?`", ["\x00", "$", "?", "`", ""]),
    ("y = 'it\nz = 1\n", ["y", "=", "'", "it", "\n", "z", "=", "1", "\n"]),
    ('s = """a b\nc', ["s", "=", '"""a', "b\nc", ""]),
    ("f(1, [2\ndef g():\n  pass\n", ["f", "(", "1", ",", "[", "2", "\n", "def", "g", "(", ")", ":", "\n", "pass", "\n", "DEDENT"]),
    ("f(1,\n  default\n", ["f", "(", "1", ",", "default", ""]),
    ("a) + ]b{c)\n", ["a", ")", "+", "]", "b", "{", "c", ")", ""]),
    ("(a]b)\nc\n", ["(", "a", "]", "b", ")", "\n", "c", "\n"]),
    ("([a)\nb\n", ["(", "[", "a", ")", "\n", "b", "\n"]),
    ("if a:\n      b\n   c\nd\n", ["if", "a", ":", "\n", "b", "\n", "DEDENT", "c", "\n", "DEDENT", "d", "\n"]),
    ('f"a {b\nreturn 1\n', ['f"', "a ", "{", "b", "\n", "return", "1", "\n"]),
    ('f"a {v" + c\n', ['f"', "a ", "{", "v", '"', "+", "c", "\n"]),
    ('f"a\nb\n', ['f"', "a", "\n", "b", "\n"]), ("a \\ b\\", ["a", "\\", "b", "\\", ""]), ("0x 1__2 é²", ["0", "x", "1", "__2", "é²", ""]),
]


@pytest.mark.parametrize(("code", "tokens"), BROKEN)
def test_broken_programs(code, tokens):
    assert tolerant_tokens(code) == tokens


def test_any_text_ends():
    """No text stops the lexer or loses characters other than blanks, comments apart."""
    r = random.Random(5)
    bits = ["def ", "f", "(", ")", "[", "]", "{", "}", "'", '"', '"""', "f'", "rf'''", "\\", "\n", "\r\n", "\t", "  ", "#c", ":", "=", "1.5e", "0x", "é", "\x0c", "return"]
    for _ in range(5000):
        code = "".join(r.choice(bits) for _ in range(r.randint(0, 25)))
        tokens = [t for t in tolerant_tokens(code) if t != "DEDENT"]
        left = "".join(tokens)
        assert set(left) <= set(code) and len(left) <= len(code)


def test_long_programs_take_linear_time():
    deep = "(" * 20000 + ")" * 20000 + "\n" + "x = 'a'\n" * 20000 + "if x:\n" + " y = [\n" * 3000
    assert len(tolerant_tokens(deep)) > 100000


def test_with_tokens(spark):
    rows = [(1, "x = 1 # a b\n"), (2, None), (3, "x = 1 # a b\n"), (4, "")]
    frame = spark.createDataFrame(rows, "id int, code string")
    got = {r.id: r.t for r in with_tokens(frame, "code", "t", comments=False).collect()}
    assert got == {1: ["x", "=", "1", "\n"], 2: None, 3: ["x", "=", "1", "\n"], 4: []}
    assert with_tokens(frame.limit(0), "code", "t").collect() == []


def test_subwords_equal_the_library():
    from tokenizers import Tokenizer

    t, merges = Tokenizer.from_file(default_vocabulary()), Merges(default_vocabulary(), most=100)
    r = random.Random(2)
    alphabet = "abcdefeeee  'stll12._-é日😀\n\t"
    texts = ["", "def f(x):\n    return x * 10", "aaaaaaaaaaaaaaaaaaaaaaa", "it's we'll"] + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(2000)]
    for text in texts:
        assert merges(text) == t.encode(text, add_special_tokens=False).tokens, text


def test_merges_equal_brute_force(tmp_path):
    """Least rank first, then from the left, over the whole piece."""
    import json

    r = random.Random(3)
    pairs = [["a", "b"], ["b", "a"], ["ab", "a"], ["a", "a"], ["aa", "b"], ["ab", "ab"], ["ba", "ab"], ["c", "ab"], ["abab", "a"]]
    path = tmp_path / "v.json"
    path.write_text(json.dumps({"model": {"merges": [" ".join(p) if i % 2 else p for i, p in enumerate(pairs)]}}))
    merges = Merges(str(path))
    for _ in range(500):
        piece = "".join(r.choice("abc") for _ in range(r.randint(0, 30)))
        symbols = list(piece)
        while found := sorted((pairs.index([x, y]), i) for i, (x, y) in enumerate(zip(symbols, symbols[1:], strict=False)) if [x, y] in pairs):
            i = found[0][1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        assert merges.merged(piece) == symbols


def test_with_subwords(spark):
    frame = spark.createDataFrame([(1, "ab ab"), (2, None), (3, "")], "id int, code string")
    got = {r.id: r.t for r in with_subwords(frame, "code", "t", ends=("<s>", "</s>")).collect()}
    assert got == {1: ["<s>", "ab", "Ġab", "</s>"], 2: None, 3: ["<s>", "</s>"]}
