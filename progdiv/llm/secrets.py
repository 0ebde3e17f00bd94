"""Secret scans with DataFrame functions alone.

Base patterns find assignments, access keys and long hexadecimal runs. Further tokens are found by a battery of
randomness tests: the encoding is inferred from the characters, then symbols are tested for a uniform alphabet
(chi-squared), for the number of runs about the alphabet's middle and for serial correlation. The chi-squared
statistic is held against what ordinary writing of the same length would give, so short tokens need
to look more uniform. Hexadecimal and base32 have too few symbols for that; there the likelihood of the token under ordinary
shares of letters and digits is held against the uniform one, and its ratio bounds p. The false discovery rate is
controlled over all tokens of the table.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from progdiv.llm.common import materialize

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A maximal run of at least 20 or 24 characters; shorter runs are never part of such a match.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/=_-]{20,}"
#: Kinds in the order that breaks ties of a start.
KINDS = ("assign", "access", "hex", "random")

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Shares of letters in ordinary writing, in percent; 1 at least, as languages differ.
_SHARES = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 1.0, 1.0, 4.0, 2.4, 6.7, 7.5, 1.9, 1.0, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 1.0, 2.0, 1.0)


def _gains(alphabet: str, *letters: float) -> list[list[float]]:
    """log10 of each symbol's share in ordinary tokens with such a share of letters, over its uniform share."""
    shares = [_SHARES[UPPER.index(c.upper())] if c.isalpha() else 0.0 for c in alphabet]
    digits = sum(not c.isalpha() for c in alphabet)
    return [[math.log10(len(alphabet) * (x * w / sum(shares) if w else (1 - x) / digits)) for w in shares] for x in letters]


#: Encodings in the order they are tried: pattern of the whole token, alphabet, the sum of squared symbol
#: shares of ordinary (not random) tokens in it, which are mostly digits in the first two and letters else, and for small
#: alphabets what ordinary tokens in it look like: nearly all digits or nearly all letters, and in base32 also half of each.
ENCODINGS = (
    (r"^[0-9a-f]+$", DIGITS + "abcdef", 0.1, _gains(DIGITS + "abcdef", 0.05, 0.95)),
    (r"^[0-9A-F]+$", DIGITS + "ABCDEF", 0.1, _gains(DIGITS + "ABCDEF", 0.05, 0.95)),
    (r"^[A-Z2-7]+$", UPPER + "234567", 0.065, _gains(UPPER + "234567", 0.05, 0.5, 0.95)),
    (r"^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS, 0.065, None),
    (r"^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/", 0.065, None),
    (r"", UPPER + LOWER + DIGITS + "-_", 0.065, None),
)
_SPAN = "array<struct<start:int,end:int,kind:int,text:string>>"


def _scan(items: Column, value: Callable[[Column], Column], combine: Callable[[Column, Column], Column], zero: Column, emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """emit(combined values of the items before, item) for each item of an array, where combine is associative.

    An array that an aggregate appends to is copied each time, so the n items go in blocks of about the root of n: values of
    blocks first, then what is before each block, then the items of each block by themselves.
    """

    def over(a: Column) -> Column:
        n = F.size(a)
        width = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("int"), F.lit(1))
        first = F.when(n > 0, F.sequence(F.lit(0), n - 1, width)).otherwise(F.array().cast("array<int>"))
        inside = lambda lo: F.sequence(lo, F.least(lo + width, n) - 1)
        totals = F.transform(first, lambda lo: F.struct(lo.alias("lo"), F.aggregate(inside(lo), zero, lambda c, i: combine(c, value(F.get(a, i)))).alias("value")))
        start = F.struct(zero.alias("c"), F.array().cast("array<struct<lo:int,c:int>>").alias("out"))
        before = F.aggregate(totals, start, lambda s, t: F.struct(combine(s["c"], t["value"]).alias("c"), F.array_append(s["out"], F.struct(t["lo"].alias("lo"), s["c"].alias("c"))).alias("out")), lambda s: s["out"])
        nothing = F.array().cast(f"array<{kind}>")

        def block(t: Column) -> Column:
            step = lambda s, i: F.struct(combine(s["c"], value(F.get(a, i))).alias("c"), F.array_append(s["out"], emit(s["c"], F.get(a, i)).cast(kind)).alias("out"))
            return F.aggregate(inside(t["lo"]), F.struct(t["c"].alias("c"), nothing.alias("out")), step, lambda s: s["out"])

        return F.flatten(F.transform(before, block))

    return F.element_at(F.transform(F.array(items), over), 1)  # items are made once


def find_spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0, keep_text: bool = False) -> Column:
    """Leftmost non-overlapping matches as (start, end, kind, text), in code points, from gaps and matches."""
    p = F.lit(pattern)
    none = F.array().cast(_SPAN)
    matches = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0)), lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m")))
    if group:
        matches = F.zip_with(matches, F.regexp_extract_all(text, p, F.lit(group)), lambda x, g: F.struct(x["gap"].alias("gap"), x["m"].alias("m"), F.length(g).alias("n")))
    else:
        matches = F.transform(matches, lambda x: F.struct(x["gap"].alias("gap"), x["m"].alias("m"), F.length(x["m"]).alias("n")))

    def span(before: Column, x: Column) -> Column:
        start = before + x["gap"]
        out = F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), F.lit(kind).alias("kind"), (x["m"] if keep_text else F.lit("")).alias("text"))
        return F.when(x["n"] >= least, out)  # the last gap has no match behind it

    taken = lambda x: x["gap"] + F.coalesce(F.length(x["m"]), F.lit(0))
    found = F.array_compact(_scan(matches, taken, lambda a, b: a + b, F.lit(0), span, _SPAN[len("array<") : -1]))
    return F.when(text.rlike(pattern), found).otherwise(none)


def _pick(token: Column, values: list) -> Column:
    out = F.lit(values[-1])
    for (pattern, *_), v in reversed(list(zip(ENCODINGS[:-1], values[:-1], strict=True))):
        out = F.when(token.rlike(pattern), F.lit(v)).otherwise(out)
    return out


def normal_tail(z: Column) -> Column:
    """P(N(0, 1) < z), by the rational form of Abramowitz and Stegun, 7.1.26."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = 0.5 * poly * F.exp(-x * x)
    return F.when(z < 0, tail).otherwise(1.0 - tail)


def battery(spans: Column) -> Column:
    """(start, end, p, random) of each token. p: that ordinary writing of this length looks as uniform (at most);
    random: neither the runs nor the serial correlation contradict random symbols (3 standard deviations)."""
    x1 = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.rtrim(s["text"], F.lit("=")).alias("t")))
    x2 = F.transform(
        F.filter(x1, lambda s: F.length(s["t"]) >= 8),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["t"].alias("t"), F.length(s["t"]).cast("double").alias("n"), *(_pick(s["t"], [e[k] for e in ENCODINGS]).alias(name) for k, name in ((1, "alphabet"), (2, "q"), (3, "gains")))),
    )
    zero = F.struct(*(F.lit(0.0).alias(k) for k in ("prev", "runs", "high", "n", "sx", "sxx", "sxy")))

    def walk(k: Column):
        def step(a: Column, v: Column) -> Column:
            first = a["n"] == 0
            turn = first | ((v >= k / 2) != (a["prev"] >= k / 2))
            return F.struct(
                v.alias("prev"), (a["runs"] + turn.cast("double")).alias("runs"), (a["high"] + (v >= k / 2).cast("double")).alias("high"), (a["n"] + 1).alias("n"),
                (a["sx"] + v).alias("sx"), (a["sxx"] + v * v).alias("sxx"), (a["sxy"] + F.when(first, 0.0).otherwise(a["prev"] * v)).alias("sxy"),
            )

        return step

    def measure(s: Column) -> Column:
        k = F.length(s["alphabet"]).cast("double")
        symbols = F.transform(F.filter(F.split(s["t"], ""), lambda c: c != ""), lambda c: F.greatest(F.instr(s["alphabet"], c) - 1, F.lit(0)).cast("double"))
        squares = F.aggregate(F.filter(F.split(s["alphabet"], ""), lambda c: c != ""), F.lit(0.0), lambda a, c: a + F.pow(s["n"] - F.length(F.replace(s["t"], c, F.lit(""))), F.lit(2)))
        ordinary = F.transform(s["gains"], lambda g: F.aggregate(symbols, F.lit(0.0), lambda a, v: a + F.element_at(g, v.cast("int") + 1)))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["n"].alias("n"), s["q"].alias("q"), k.alias("k"), F.aggregate(symbols, zero, walk(k)).alias("w"), squares.alias("sq"), ordinary.alias("ordinary"))

    def judge(s: Column) -> Column:
        n, k, w = s["n"], s["k"], s["w"]
        chi = k / n * s["sq"] - n
        far = n * (k * s["q"] - 1)
        ratio = F.aggregate(s["ordinary"], F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x)) / F.size(s["ordinary"])
        p = F.when(s["ordinary"].isNull(), normal_tail((chi - (k - 1 + far)) / F.sqrt(2 * (k - 1 + 2 * far)))).otherwise(F.least(ratio, F.lit(1.0)))
        both = 2 * w["high"] * (n - w["high"])
        runs = F.try_divide(w["runs"] - both / n - 1, F.sqrt(F.greatest(both * (both - n) / (n * n * (n - 1)), F.lit(0.0))))
        mean = w["sx"] / n
        serial = F.try_divide(w["sxy"] - (n - 1) * mean * mean, w["sxx"] - n * mean * mean) * F.sqrt(n)
        fine = (F.abs(runs) <= 3) & (F.abs(serial) <= 3) & (chi <= k - 1 + 4 * F.sqrt(2 * (k - 1)))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), p.alias("p"), F.coalesce(fine, F.lit(False)).alias("random"))

    return F.transform(F.transform(x2, measure), judge)


#: Steps of -log10 p in the histogram of the false discovery control, and their number, down to the least p of 1e-30.
_STEP, _STEPS = 0.05, 600


def _discovery_level(tokens: DataFrame, rate: float) -> float:
    """Least -log10 p that keeps the false discovery rate (Benjamini-Hochberg), from a histogram of at most
    _STEPS bins; each p counts as its bin's upper edge, so the rate is never exceeded. Tokens that fail
    the other tests have p = 1."""
    p = F.when(F.col("t.random"), F.col("t.p")).otherwise(1.0)
    step = F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) / _STEP), F.lit(_STEPS - 1)).cast("int")
    bins = {r["bin"]: r["n"] for r in tokens.groupBy(step.alias("bin")).count().withColumnRenamed("count", "n").collect()}
    m, above, level = sum(bins.values()), 0, float("inf")
    for b in sorted(bins, reverse=True):
        above += bins[b]
        if 10 ** (-b * _STEP) <= rate * above / m:
            level = b * _STEP
    return level


def _clear(base: Column, added: Column) -> Column:
    """The added spans that overlap none of base: in the order of all starts, none of base before reaches into them and none
    behind starts in them."""
    far, kind = F.lit((1 << 31) - 1), "int"
    of_base = lambda x, field, other: F.when(x["kind"] < 3, x[field]).otherwise(other)

    def over(x: Column) -> Column:
        reach = _scan(x, lambda s: of_base(s, "end", F.lit(0)), lambda a, b: F.greatest(a, b), F.lit(0), lambda c, s: c, kind)
        next_ = F.reverse(_scan(F.reverse(x), lambda s: of_base(s, "start", far), lambda a, b: F.least(a, b), far, lambda c, s: c, kind))
        marked = F.zip_with(F.zip_with(x, reach, lambda s, r: F.struct(s.alias("s"), r.alias("r"))), next_, lambda s, n: F.when((s["s"]["kind"] == 3) & (s["r"] <= s["s"]["start"]) & (n >= s["s"]["end"]), s["s"]))
        return F.array_compact(marked)

    return F.element_at(F.transform(F.array(F.array_sort(F.concat(base, added))), over), 1)


def scan_secrets(docs: DataFrame, rate: float = 0.05, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """base and added, arrays of (start, kind, end) by start then kind, beside the kept columns; one row a document.

    A null or empty text has none; texts are scanned whole, in time that grows with their length times the root of the number of
    their matches at most; rows that repeat a doc_id are scanned each;
    an empty table gives no rows. Tokens that overlap a base span are not added again.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(*(F.col(c).alias(f"k_{c}") for c in keep), t.alias("text"))
    kept = [f"k_{c}" for c in keep]
    found = docs.select(
        *kept,
        find_spans(F.col("text"), ASSIGN, 0, group=2, least=6).alias("assign"),
        find_spans(F.col("text"), ACCESS, 1).alias("access"),
        find_spans(F.col("text"), HEX, 2).alias("hex"),
        find_spans(F.col("text"), TOKEN, 3, keep_text=True).alias("token"),
    )
    plain = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    base = F.array_sort(F.concat(plain(F.col("assign")), plain(F.col("access")), plain(F.col("hex"))))
    found = materialize(found.select(*kept, base.alias("base"), battery(F.col("token")).alias("tests")), "secrets")
    level = _discovery_level(found.select(F.explode("tests").alias("t")), rate)
    chosen = F.filter("tests", lambda s: s["random"] & (-F.log10(F.greatest(s["p"], F.lit(1e-30))) >= F.lit(level)))
    added = F.transform(chosen, lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end")))
    added = F.when((F.size("base") > 0) & (F.size(chosen) > 0), _clear(F.col("base"), added)).otherwise(added)
    return found.select(*(F.col(f"k_{c}").alias(c) for c in keep), "base", added.alias("added"))


def joined(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with its spans (sorted by start) replaced; overlapping ones by one mark.

    Pieces are cut from the text in an encoding of four bytes a code point, where no cut has to count from the start."""

    def over(x: Column) -> Column:
        raw, s = x["raw"], x["spans"]
        cut = lambda a, b: F.decode(F.substring(raw, 4 * a + 1, 4 * (b - a)), "UTF-32")
        piece = lambda at, span: F.when(span["start"] >= at, F.concat(cut(at, span["start"]), F.lit(mark))).otherwise(F.lit(""))
        pieces = _scan(s, lambda span: span["end"], lambda a, b: F.greatest(a, b), F.lit(0), piece, "string")
        last = F.coalesce(F.array_max(F.transform(s, lambda span: span["end"])), F.lit(0))
        return F.concat(F.array_join(pieces, ""), cut(last, (F.octet_length(raw) / 4).cast("int")))

    return F.element_at(F.transform(F.array(F.struct(F.encode(text, "UTF-32").alias("raw"), spans.alias("spans"))), over), 1)
