"""The tests of a sample."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tests_of(dataset: Column | str = "dataset", input_output: Column | str = "input_output", test_list: Column | str = "test_list") -> Column:
    """A sample's tests as JSON text: the asserts of mbpp, else the input and output object as it stands.

    Broken JSON is handed on unchanged, as what runs the tests decides what to make of it; no tests are null.
    """
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.when(c(dataset) == "mbpp", F.to_json(c(test_list))).otherwise(c(input_output))


def decoded(tests: Column | str) -> Column:
    """struct(fn_name, inputs, outputs) of an input and output object; arguments of any nesting stay variants; null where broken."""
    c = F.col(tests) if isinstance(tests, str) else tests
    return F.from_json(c, "fn_name string, inputs variant, outputs variant", {"mode": "PERMISSIVE"})
