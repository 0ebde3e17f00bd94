"""Functions on programs for queries written in SQL: table functions that a LATERAL join calls, and scalar ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from progdiv.functions import pyast, pytokens
from progdiv.functions.extract import extract_python_code


def _string(name: str, argument: AnalyzeArgument) -> None:
    if argument.isTable or not isinstance(argument.dataType, StringType):
        raise ValueError(f"{name} has to be a string, not {argument.dataType.simpleString()}")


def _constant(name: str, argument: AnalyzeArgument | None, kind: type, default: object) -> object:
    """What a named argument is, known before the query runs as it shapes the result."""
    if argument is None:
        return default
    if not argument.isConstantExpression or not isinstance(argument.value, kind):
        raise ValueError(f"{name} has to be a constant {kind.__name__}")
    return argument.value


class PythonTokens:
    """python_tokens(code [, comments => true] [, kinds => false]): a row for each token, at (from 0) and token; with kinds also kind.
    No row for null."""

    @staticmethod
    def analyze(code: AnalyzeArgument, comments: AnalyzeArgument | None = None, kinds: AnalyzeArgument | None = None) -> AnalyzeResult:
        _string("code", code)
        _constant("comments", comments, bool, True)
        schema = StructType().add("at", IntegerType()).add("token", StringType())
        return AnalyzeResult(schema.add("kind", StringType()) if _constant("kinds", kinds, bool, False) else schema)

    def eval(self, code: str | None, comments: bool = True, kinds: bool = False) -> Iterator[tuple]:
        found = [] if code is None else pytokens.kinds_and_tokens(code, comments)
        for at, (kind, token) in enumerate(found):
            yield (at, token, kind) if kinds else (at, token)


class Subtrees:
    """subtrees(code, variant [, lowest => 3] [, highest => 6]): height, subtree (64 bits of its hash) and count of every different
    subtree of a program; none if it doesn't parse or is null."""

    @staticmethod
    def analyze(code: AnalyzeArgument, variant: AnalyzeArgument, lowest: AnalyzeArgument | None = None, highest: AnalyzeArgument | None = None) -> AnalyzeResult:
        _string("code", code)
        if _constant("variant", variant, str, None) not in pyast.VARIANTS:
            raise ValueError(f"variant is none of {', '.join(pyast.VARIANTS)}")
        if _constant("lowest", lowest, int, 3) > _constant("highest", highest, int, 6):
            raise ValueError("lowest is above highest")
        return AnalyzeResult(StructType().add("height", IntegerType()).add("subtree", LongType()).add("count", LongType()))

    def eval(self, code: str | None, variant: str, lowest: int = 3, highest: int = 6) -> Iterator[tuple]:
        found = pyast.subtrees(code, variant, tuple(range(lowest, highest + 1))) if code is not None else None
        for (height, digest), n in (found or {}).items():
            yield height, int.from_bytes(digest[:8], "little", signed=True), n


@F.pandas_udf(StringType())
def renamed_program(code: pd.Series) -> pd.Series:
    return code.map(pyast.obfuscate, na_action="ignore")


@F.pandas_udf(BooleanType())
def parses(code: pd.Series) -> pd.Series:
    return code.map(lambda c: pyast.subtrees(c, "plain", ()) is not None, na_action="ignore").astype(object).where(code.notna(), None)


def register(spark: SparkSession) -> None:
    """python_tokens and subtrees as table functions, renamed_program, parses and extracted_code as scalar ones."""
    spark.udtf.register("python_tokens", F.udtf(PythonTokens))
    spark.udtf.register("subtrees", F.udtf(Subtrees))
    spark.udf.register("renamed_program", renamed_program)
    spark.udf.register("parses", parses)
    spark.udf.register("extracted_code", extract_python_code)
