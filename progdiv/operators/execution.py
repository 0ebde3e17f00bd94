"""Running programs on test cases through a callable, and what finished runs stand for."""

from __future__ import annotations

import resource
import subprocess
import sys
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from progdiv.functions.text import clean_output
from progdiv.operators.records import fail_fast, map_status

#: (program, input) -> (return code, stdout, stderr, timed out)
Runner = Callable[[str, str], tuple[int, str, str, bool]]


def local_runner(directed: bool = True, timeout: float = 60.0, memory: int = 1 << 30) -> Runner:
    """Runs Python programs as child processes with limits on time and memory. This is no sandbox: use it for trusted
    programs only. A directed program reads its input from stdin; another gets its path as argument."""

    def limit() -> None:
        resource.setrlimit(resource.RLIMIT_AS, (memory, memory))

    def run(program: str, data: str) -> tuple[int, str, str, bool]:
        with tempfile.NamedTemporaryFile("w", suffix=".txt") as f:
            f.write(data)
            f.flush()
            try:
                done = subprocess.run([sys.executable, "-I", "-c", program, *([] if directed else [f.name])], input=data if directed else None, capture_output=True, text=True, timeout=timeout, preexec_fn=limit)
            except subprocess.TimeoutExpired:
                return 0, "", "", True
        return done.returncode, done.stdout, done.stderr, False

    return run


def execute(cases: DataFrame, runner: Runner) -> DataFrame:
    """Rows (problem_id, generation_id, testcase_id, pos, program, input, expected) with their outputs.

    Outputs are stripped and cut at 5000 characters; failed runs become sentinels, and after a generation's first failure
    in the order of testcase_id (as text) all later outputs are Error.
    """
    kept = [f for f in cases.schema if f.name != "program"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [runner(p or "", i or "") for p, i in zip(b.column("program").to_pylist(), b.column("input").to_pylist(), strict=True)]
            cols = [pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *cols], names=[*(f.name for f in kept), "rc", "stdout", "stderr", "late"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    ran = cases.mapInArrow(run, f"{ddl}, rc int, stdout string, stderr string, late boolean")
    output = map_status(F.col("rc"), F.col("stderr"), F.col("late"), clean_output(F.col("stdout")))
    ran = ran.select(*(f.name for f in kept), output.alias("output"))
    return fail_fast(ran, ["problem_id", "generation_id"], ["testcase_id"])
