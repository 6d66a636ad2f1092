"""Pass ratios of programs by their tests, through a sandbox server per task."""

from __future__ import annotations

import contextlib
import json
import os
import subprocess
import sys

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seconds: of each input and of a whole input-output program, of each step of an assert, and of all asserts together.
IO_TIMEOUT, IO_DEADLINE, ASSERT_TIMEOUT = 4.0, 11.0, 2.0
MODES = ("io", "per_test", "shared")
#: Programs of one process, where they may share it.
TOGETHER = 100


def usable_tests(tests_json: str | None) -> list | dict | None:
    """Tests given as JSON; None where any program's ratio is 0."""
    if not tests_json:
        return None
    try:
        tests = json.loads(tests_json)
        if isinstance(tests, list):
            return tests if tests and all(isinstance(t, str) for t in tests) else None
        return tests if len(tests["inputs"]) and isinstance(tests["outputs"], list) else None
    except (ValueError, TypeError, KeyError):
        return None


def _request(tests: list | dict, code: str, isolation: str, io_timeout: float, io_deadline: float, assert_timeout: float, whole: bool) -> tuple[dict, int]:
    """What the server is asked for, and the number of tests."""
    if isinstance(tests, list):
        deadline = assert_timeout * 2 * len(tests) + 1 if isolation == "per_test" else assert_timeout + 1
        return {"mode": isolation, "code": code, "tests": tests, "timeout": assert_timeout, "deadline": deadline, "whole": whole}, len(tests)
    return {"mode": "io", "code": code, "tests": tests, "timeout": io_timeout, "deadline": io_deadline, "whole": whole}, len(tests["inputs"])


class Sandbox:
    """A running sandbox server; a context manager. A lazy one starts with the first question."""

    def __init__(self, lazy: bool = False):
        self.lazy, self.server = lazy, None

    def __enter__(self) -> Sandbox:
        if not self.lazy:
            self.start()
        return self

    def start(self) -> None:
        env = {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p), "PATH": os.environ.get("PATH", ""), "OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1"}
        self.server = subprocess.Popen([sys.executable, "-m", "quernlab.functions.sandbox_server"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, env=env)

    def __exit__(self, *_) -> None:
        if self.server is None:
            return
        self.server.stdin.close()
        try:
            self.server.wait(5)
        except subprocess.TimeoutExpired:
            self.server.kill()
            self.server.wait()

    def ask(self, request: dict | list[dict]) -> list | None:
        """What the server answers; None if it died with its child: the next request gets a new one."""
        if self.server is None:
            self.start()
        try:
            self.server.stdin.write(json.dumps(request) + "\n")
            self.server.stdin.flush()
            line = self.server.stdout.readline()
        except (BrokenPipeError, OSError):
            line = ""
        if not line:
            self.server.kill()
            self.server.wait()
            self.start()
            return None
        return json.loads(line)

    def results(self, mode: str, code: str, tests, timeout: float, deadline: float, imports: list[str] | None = None, whole: bool = False) -> list[int]:
        return self.ask({"mode": mode, "code": code, "tests": tests, "timeout": timeout, "deadline": deadline, "imports": imports, "whole": whole}) or []

    def ratio(self, tests_json: str | None, code: str | None, isolation: str = "per_test", io_timeout: float = IO_TIMEOUT, io_deadline: float = IO_DEADLINE, assert_timeout: float = ASSERT_TIMEOUT, whole: bool = False) -> float:
        """The share of tests that a program passes.

        Tests are JSON: a list of asserts, or an object of inputs and outputs. Null or broken tests, no
        tests, a null or blank program, and anything that goes wrong are 0. With ``whole`` the first
        failure ends a program, for callers that ask for 1 only: other ratios are then too low.
        """
        tests = usable_tests(tests_json)
        if tests is None or not code or not code.strip():
            return 0.0
        try:
            request, total = _request(tests, code, isolation, io_timeout, io_deadline, assert_timeout, whole)
            results = self.ask(request) or []
        except (ValueError, TypeError, KeyError):
            return 0.0
        return sum(r == 1 for r in results) / total

    def passing(self, programs: list[tuple[list | dict, str, bool]], isolation: str = "per_test") -> list[bool]:
        """Whether each of (usable tests, code, whether it leaves no trace) passes all its tests.

        Those that leave no trace run in processes of up to TOGETHER, and end where they enter an endless loop.
        """
        passed = [False] * len(programs)
        asked = {}
        for i, (tests, code, _) in enumerate(programs):
            with contextlib.suppress(ValueError, TypeError, KeyError):
                asked[i] = _request(tests, code, isolation, IO_TIMEOUT, IO_DEADLINE, ASSERT_TIMEOUT, True)
        shared = [i for i in asked if programs[i][2]]
        for i in shared:
            asked[i][0]["cut"] = True
        found = {}
        for at in range(0, len(shared), TOGETHER):
            some = shared[at : at + TOGETHER]
            found |= zip(some, self.ask([asked[i][0] for i in some]) or [])
        for i, (request, total) in asked.items():
            results = found[i] if i in found else self.ask(request) or []
            passed[i] = sum(r == 1 for r in results) / total == 1.0
        return passed


def pass_ratios(df: DataFrame, keys: list[str], tests: str = "tests", code: str = "code", isolation: str = "per_test", whole: bool = False, **limits: float) -> DataFrame:
    """(keys, ratio) of every row, each program run once, in a process of its own.

    ``isolation`` is for asserts: ``per_test`` gives each its own globals and time, ``shared`` runs all
    in one go. ``whole`` is for callers that ask for a ratio of 1 only. Filter before this: nothing is pushed through it.
    """
    if isolation not in MODES[1:]:
        raise ValueError(f"isolation must be per_test or shared: {isolation!r}")
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("ratio", T.DoubleType())])

    def run(batches):
        with Sandbox() as sandbox:
            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    part = batch.slice(at, 200)
                    ratios = [sandbox.ratio(t, c, isolation, whole=whole, **limits) for t, c in zip(part.column(tests).to_pylist(), part.column(code).to_pylist())]
                    yield pa.RecordBatch.from_arrays([part.column(k) for k in keys] + [pa.array(ratios, pa.float64())], names=[*keys, "ratio"])

    return df.select(*dict.fromkeys([*keys, tests, code])).mapInArrow(run, schema)


def pass_ratio(tests: Column | str, code: Column | str, isolation: str = "per_test") -> Column:
    """The same as a column, evaluated once where it stands; put cheap filters before it."""

    @F.pandas_udf(T.DoubleType())
    def run(t: pd.Series, c: pd.Series) -> pd.Series:
        with Sandbox() as sandbox:
            return pd.Series([sandbox.ratio(a, b, isolation) for a, b in zip(t, c)], dtype="float64")

    return run.asNondeterministic()(tests, code)
