import json
import time

import pytest

from quernlab.functions.compare import call_matches, stdout_matches
from quernlab.functions.sandbox import Sandbox, pass_ratio, pass_ratios

IO = json.dumps({"inputs": ["3\n4\n"], "outputs": ["7\n"]})
CALL = json.dumps({"fn_name": "add", "inputs": [[1, 2]], "outputs": [[3]]})
ASSERTS = json.dumps(["assert add(1,2)==3", "assert add(0,0)==1"])


@pytest.fixture(scope="module")
def box():
    with Sandbox() as sandbox:
        yield sandbox


@pytest.mark.parametrize(
    "tests,code,ratio",
    [
        (IO, "print(int(input()) + int(input()))", 1.0),
        (IO, "import sys\nprint(sum(map(int, sys.stdin.read().split())))", 1.0),
        (IO, 'def main():\n    print(int(input()) + int(input()))\nif __name__ == "__main__":\n    main()', 1.0),
        (IO, "print(7)\nexit()", 0.0),
        (IO, "import sys\nprint(7)\nsys.exit()", 1.0),
        (IO, "print(8)", 0.0),
        (IO, "while True: pass", 0.0),
        (IO, "1 / 0", 0.0),
        (IO, "def (", 0.0),
        (CALL, "def add(a, b): return a + b", 1.0),
        (CALL, "class Solution:\n    def add(self, a, b): return a + b", 1.0),
        (CALL, "def sub(a, b): return a - b", 0.0),
        (ASSERTS, "def add(a, b): return a + b", 0.5),
        (ASSERTS, "import sys\nsys.exit()", 0.0),
        (ASSERTS, "import os\nos.system('true')", 0.0),
        (None, "x", 0.0), (IO, None, 0.0), (IO, " ", 0.0), ("{", "x", 0.0), ('{"inputs": [], "outputs": []}', "x", 0.0), ("[]", "x", 0.0), ("[1]", "x", 0.0), ("3", "x", 0.0), ("null", "x", 0.0),
    ],
)
def test_ratio(box, tests, code, ratio):
    assert box.ratio(tests, code, io_timeout=0.5, io_deadline=2, assert_timeout=0.5) == ratio


def test_a_program_that_swallows_its_alarm_ends(box):
    stubborn = "while True:\n    try:\n        while True: pass\n    except BaseException: pass"
    assert box.ratio(IO, stubborn, io_timeout=0.2, io_deadline=1) == 0.0
    assert box.ratio(IO, "print(7)") == 1.0


@pytest.mark.parametrize("tests", [["assert f(1) == 2", "assert f(0)", "assert f(0)"], {"fn_name": "f", "inputs": [[1], [0], [0]], "outputs": [2, 1, 1]}])
def test_whole_ends_at_the_first_failure(box, tests):
    code = "import time\ndef f(x):\n    time.sleep(0 if x else 30)\n    return x"
    began = time.monotonic()
    assert box.ratio(json.dumps(tests), code, whole=True) == 0.0 and time.monotonic() - began < 2
    assert box.ratio(json.dumps(tests).replace("2", "1"), code.replace("30", "0").replace("return x", "return 1"), whole=True) == 1.0


def test_isolation(box):
    leaky = json.dumps(["assert bump() == 1", "assert bump() == 1"])
    code = "n = 0\ndef bump():\n    global n\n    n += 1\n    return n"
    assert box.ratio(leaky, code, "per_test") == 1.0 and box.ratio(leaky, code, "shared") == 0.5
    late = json.dumps(["assert True", "while True: pass"])
    assert box.ratio(late, "x = 1", "per_test", assert_timeout=0.3) == 0.5 and box.ratio(late, "x = 1", "shared", assert_timeout=0.3) == 0.0


def test_integer_keys(box):
    tests = json.dumps({"fn_name": "f", "inputs": [[{"1": 2}]], "outputs": [{"1": 2}]})
    assert box.ratio(tests, "def f(d): return [d] if 1 in d else 0") == 1.0


@pytest.mark.parametrize(
    "printed,expected,ok",
    [
        (["7"], "7\n", True), (["7", ""], "7", True), (["1 ", "2"], "1\n2", True), (["1", "", "2"], "1\n2", True), (["1.0"], "1.0000001", True), (["b a"], "a b", True),
        (["2", "1"], "1\n2", True), (["0.1234"], "0.12341", True), (["0.2"], "0.1", False), ([], "", True), ([], "x", False), (["yes"], "no", False),
    ],
)
def test_stdout(printed, expected, ok):
    assert stdout_matches(printed, expected) is ok


@pytest.mark.parametrize("result,expected,ok", [(3, [3], True), ((1, 2), [1, 2], True), ([(1, 2)], [[[1, 2]]], True), (3, 4, False), (None, [], False), ([], [], True)])
def test_call(result, expected, ok):
    assert call_matches(result, expected) is ok


def test_in_spark(spark):
    df = spark.createDataFrame([(1, IO, "print(7)"), (2, IO, None), (3, None, "x"), (1, IO, "print(7)")], "idx long, tests string, code string")
    assert sorted((r["idx"], r["ratio"]) for r in pass_ratios(df, ["idx"]).collect()) == [(1, 1.0), (1, 1.0), (2, 0.0), (3, 0.0)]
    assert df.withColumn("r", pass_ratio("tests", "code")).where("r = 1.0").count() == 2
    assert pass_ratios(df.limit(0), ["idx"]).count() == 0
    with pytest.raises(ValueError):
        pass_ratios(df, ["idx"], isolation="none")
