"""Rewrites of programs that pass their tests, made and run in one stage."""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlab.functions.prospects import hopeless, leaves_no_trace, open_to_view
from quernlab.functions.rewrite import parsed, variants
from quernlab.functions.sandbox import Sandbox, usable_tests


def to_try(source: str | None, tests_json: str | None, isolation: str = "per_test") -> list[tuple[str, list | dict, str, bool]]:
    """(rewrite, tests, code, whether it leaves no trace) of the changed variants of a source that aren't known to fail their tests."""
    tests = usable_tests(tests_json)
    tree = None if tests is None else parsed(source)
    if tree is None:
        return []
    seen = open_to_view(source)
    if seen and hopeless(source, tree, tests, isolation):
        return []
    traceless = seen and leaves_no_trace(source, tree, tests)
    return [(name, tests, code, traceless) for name, code in variants(source)]


def passing_variants(df: DataFrame, key: str = "idx", code: str = "solutions", tests: str = "tests", isolation: str = "per_test") -> DataFrame:
    """(key, transform, code): the changed variants of every row's code that pass all its tests."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        with Sandbox(lazy=True) as sandbox:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    gc.disable()  # trees have no cycles, and collections would walk through them
                    try:
                        tried = [(i, *v) for i, (c, t) in enumerate(zip(part.column(code).to_pylist(), part.column(tests).to_pylist())) for v in to_try(c, t, isolation)]
                    finally:
                        gc.enable()
                    rows = [(i, name, new) for (i, name, _, new, _), passed in zip(tried, sandbox.passing([x[2:] for x in tried], isolation)) if passed]
                    keys = part.column(key).take(pa.array([r[0] for r in rows], pa.int64()))
                    yield pa.RecordBatch.from_arrays([keys, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=[key, "transform", "code"])

    return df.select(key, code, tests).where(F.col(code).isNotNull() & F.col(tests).isNotNull()).mapInArrow(run, f"{key} {kind}, transform string, code string")
