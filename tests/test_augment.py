import ast
import json
import time

import pytest

from quernlab.functions.augment import passing_variants, to_try
from quernlab.functions.endless import without_endless_loops
from quernlab.functions.prospects import hopeless, leaves_no_trace, open_to_view
from quernlab.functions.rewrite import variants
from quernlab.functions.sandbox import Sandbox, usable_tests
from quernlab.plans.techniques import augmentation

ASSERT = json.dumps(["assert f(1, 2) == 3"])
CALL = json.dumps({"fn_name": "f", "inputs": [[1, 2]], "outputs": [3]})
TEXT = json.dumps({"fn_name": "f", "inputs": [[1, "x"]], "outputs": [3]})
SCRIPT = json.dumps({"inputs": ["3\n"], "outputs": ["3\n"]})
ADD = "def f(a, b):\n    c = 0\n    c += a\n    c += b\n    return c\n"
GUARD = "if __name__ == '__main__':\n    print(3)\n"


@pytest.fixture(scope="module")
def box():
    with Sandbox() as sandbox:
        yield sandbox


def plain(box, source, tests):
    return [name for name, code in variants(source) if box.ratio(tests, code, whole=True) == 1.0]


HOPELESS = [
    ("def g(a, b):\n    return a + b\n", ASSERT),
    ("def g(a, b):\n    return a + b\n", CALL),
    ("class A:\n    def f(a, b):\n        return a + b\n", ASSERT),
    ("def f(a, b, c):\n    return a + b\n", ASSERT),
    ("def f(a):\n    return a + 2\n", CALL),
    ("def f(a, b):\n    return a + b\nn = int(input())\n", ASSERT),
    ("def f(a, b):\n    return a + b\nn = 1\nprint(m + 36)\n", CALL),
    ("n = int(input())\nprint(m + n)\n", SCRIPT),
    ("import sys\ndef f(a, b):\n    print(3)\n    return a + b\n", SCRIPT),
    ("def f(a, b):\n    x = a + 1\n    print(3)\n" + GUARD, SCRIPT),
    ("def f(a, b):\n    c = 3\n    c += 0\n    return max(c, b - 1)\n", TEXT),
    ("def f(a, b):\n    x = abs((b + 1) * a)\n    if x:\n        a += 1\n    return b\n", TEXT),
    ("def f(a, b):\n    if b > 3:\n        a = 1\n    else:\n        a = 2\n    print(a, b)\n", TEXT),
    ("def f(a, b):\n    for i in range(b):\n        b = 1\n    return b\n", TEXT),
    ("def f(a, b):\n    x = [i for i in range(b)]\n    return len(x) + len(b)\n", TEXT),
    ("def f(a, b):\n    x = a + b\n    a = 3\n    b = 1\n    return a * b\n", TEXT),
    ("def f(a, b):\n    for i in range(9):\n        b += i\n    return b\n", TEXT),
    ("def f(a, b):\n    d = {}\n    d[1] = d.get(1, 0) + b\n    return a + d[1]\n", TEXT),
    ("def f(a, b):\n    x = 3\n    for i in range(3):\n        for j in range(4):\n            x = b - j\n    return x\n", TEXT),
    ("def f(a, b):\n    x = 1\n    return abs(y - x) + a\n", CALL),
    ("def f(a, b):\n    c = d + a\n    d = 1\n    return c + d\n", CALL),
    ("def f(a, b):\n    for i in range(3):\n        a += i\n        c += i\n    return a + c\n", CALL),
    ("def f(a, b):\n    x = 3\n    b -= x\n    return b\n", TEXT),
    ("def f(a, b):\n    x = 3\n    y = b // x\n    return 3 + y\n", json.dumps(["assert f(1, [2]) == 3"])),
]


@pytest.mark.parametrize("source,tests", HOPELESS)
def test_hopeless_sources_have_no_passing_variant(box, source, tests):
    assert open_to_view(source) and hopeless(source, ast.parse(source), usable_tests(tests))
    assert to_try(source, tests) == [] and plain(box, source, tests) == []


PASSING = [
    (ADD, ASSERT),
    (ADD, CALL),
    (ADD.replace("(a, b)", "(a, b, d=0)"), CALL),
    (ADD.replace("(a, b)", "(a, *rest, b=2)"), ASSERT),
    (ADD.replace("def f", "def g") + "f = g\n", ASSERT),
    (ADD.replace("def f", "def g") + "for f in [g]:\n    pass\n", CALL),
    ("def h(a):\n    return a\n" + ADD.replace("def f", "def g") + "globals()['f'] = g\n", ASSERT),
    ("import builtins\n" + ADD.replace("def f", "def g") + "setattr(builtins, 'f', g)\n", ASSERT),
    (ADD.replace("def f", "def \\\nf"), ASSERT),
    ("if True:\n    def f(a, b):\n        c = a + b\n        return c\n", CALL),
    ("class A:\n    def f(a, b):\n        c = a + b\n        return c\nf = A.f\n", CALL),
    ("def f(a):\n    return a\n" + ADD, ASSERT),
    ("def input():\n    return 3\nn = int(input())\n" + ADD, ASSERT),
    ("n = int(input())\nn += 0\nprint(n)\n", SCRIPT),
    ("import sys\nn = sys.stdin.read()\nn += ''\nsys.stdout.write(n)\n", SCRIPT),
    ("def g(n=print(3)):\n    n += 1\n", SCRIPT),
    ("class A:\n    print(3)\nx = 1\ny = 2\n", SCRIPT),
    ("def p(n):\n    x = 1\n    y = 2\n    print(3)\n@p\ndef g(n):\n    n += 1\n", SCRIPT),
    ("def g(n):\n    n += 1\n" + GUARD, json.dumps({"inputs": [""], "outputs": [""]})),
    ("def g(n):\n    n += 1\n" + GUARD.replace("__name__", "'__main__'"), SCRIPT),
    ("def f(a, b):\n    c = 0\n    while a > 5:\n        c -= 1\n    c += a\n    return c + b\n", CALL),
    ("def f(a, b):\n    def g():\n        d = [0]\n        while a < 5:\n            x = d[7]\n    try:\n        g()\n    except IndexError:\n        c = 0\n        c += a\n        return c + b\n", CALL),
    ("def f(a, b):\n    d = {}\n    try:\n        while a < 5:\n            x = d[7]\n    except (KeyError, ValueError):\n        c = 0\n        c += a\n        return c + b\n", CALL),
    ("def f(a, b):\n    s = '%z'\n    try:\n        while a < 5:\n            x = s % 1\n    except (KeyError, ValueError):\n        c = 0\n        c += a\n        return c + b\n", CALL),
    ("def f(a, b):\n    d = {}\n    try:\n        while a < 5:\n            d[1] += 1\n    except KeyError:\n        c = 0\n        c += a\n        return c + b\n", ASSERT),
    ("def f(a, b):\n    while a > 0:\n        a -= 1\n    while a < 3:\n        a += 1\n    return a\n", CALL),
    ("def f(a, b):\n    while b > 0:\n        for i in range(-3, 1):\n            b += i\n    return 3\n", CALL),
    ("def f(a, b):\n    while b > 0:\n        for i in range(3):\n            i = -1\n            b += i\n    return 3\n", CALL),
    ("def f(a, b):\n    while b > 0:\n        b += 1\n        if b > 2:\n            b = 0\n    return 3\n", CALL),
    ("def range(n):\n    return [-n]\ndef f(a, b):\n    while b > 0:\n        for i in range(3):\n            b += i\n    return 3\n", CALL),
    ("def f(a, b):\n    while b > 0:\n        for b in range(-3, 0):\n            a += 1\n    return 3\n", CALL),
    ("def f(a, b):\n    while a < 5:\n        a += b\n    c = 3\n    c += 0\n    return c\n", ASSERT),
    ("def f(a, b):\n    x = b - 1\n    return 3\n", TEXT),
    ("def f(a, b):\n    x = 1\n    while x < 3:\n        x += 1\n    y = b - 1\n    return 3 if b else y\n", TEXT),
    ("def f(a, b):\n    d = {'y': 1}\n    d['y'] += 1\n    return 2 + len(b - d.keys())\n", TEXT),
    ("def f(a, b):\n    b = 1\n    a += 3 - b\n    return a + b - 1\n", TEXT),
    ("def f(a, b):\n    c = 3\n    c += 0\n    if c:\n        return c\n    return b - 1\n", TEXT),
    ("def f(a, b):\n    a += 2\n    return a or b - 1\n", TEXT),
    ("def f(a, b):\n    a += 2\n    return a if a else b - 1\n", TEXT),
    ("def f(a, b):\n    a += 2\n    g = lambda: b - 1\n    return a\n", TEXT),
    ("def f(a, b):\n    a += 2\n    try:\n        a = b - 1\n    except TypeError:\n        pass\n    return a\n", TEXT),
    ("def f(a, b):\n    (a,) = (3, b - 1)\n    return a if b else a\n", TEXT),
    ("def f(a, b):\n    b = 2\n    c = a + b\n    return c\n", TEXT),
    ("def f(a, b):\n    a = 'y'\n    c = a + b\n    return 3 if c else a\n", TEXT),
    ("def range(x):\n    return [1, 2]\ndef f(a, b):\n    for i in range(b):\n        a += 1\n    return a\n", TEXT),
    ("def f(a, b):\n    a += 2\n    for i in range(0):\n        b += i\n    return a\n", TEXT),
    ("def f(a, b):\n    a += 2\n    for i in range(3):\n        if a:\n            break\n        b += i\n    return a\n", TEXT),
    ("def f(a, b):\n    a += 2\n    for i in range(3):\n        i = 'y'\n        b += i\n    return a\n", TEXT),
    ("def f(a, b):\n    d = {}\n    d[1] = 'y'\n    a += 2\n    x = d.get(1, 0) + b\n    return a\n", TEXT),
    ("def f(a, b):\n    x = 1\n    y = 2\n    z = b - x\n    return 3\n", TEXT),
    ("def f(a, b):\n    i = 'y'\n    x = 1\n    for i in range(3):\n        x = b + i\n    return 3 if x else b\n", TEXT),
    ("def f(a, b):\n    d = {1: 'y'}\n    for i in range(3):\n        d = {}\n        x = d.get(1, 0) + b\n    return 3 if x else b\n", TEXT),
    ("y = 2\nz = 1\ndef f(a, b):\n    return a + y\n", CALL),
    ("def f(a, b):\n    if a:\n        y = 2\n    a += y\n    return a\n", CALL),
    ("def f(a, b):\n    x = [y for y in [2]]\n    a += len(x)\n    return a + 1\n", CALL),
    ("def f(a, b):\n    a += 2\n    z = y if b > 5 else a\n    return a\n", CALL),
    ("def f(a, b):\n    while n < 9:\n        n += 1\n    n = 0\n    n = 3\n    return n\n", CALL),
    ("def f(a, b):\n    a += 2\n    for i in range(3):\n        try:\n            a = y\n        except NameError:\n            pass\n    return a\n", CALL),
    ("def y(a):\n    return 2\ndef f(a, b):\n    a += y(a)\n    return a\n", CALL),
    ("import numpy as np\ndef f(a, b):\n    b += ''\n    return 3\n", TEXT),
    ("def g(it, a):\n    while a < 5:\n        yield next(it)\ndef f(a, b):\n    c = 0\n    c += sum([1, 2])\n    return c\n", ASSERT),
]


@pytest.mark.parametrize("source,tests", PASSING)
def test_what_passes_is_kept(box, source, tests):
    tried = to_try(source, tests)
    kept = [x[0] for x, passed in zip(tried, box.passing([x[1:] for x in tried])) if passed]
    assert kept == plain(box, source, tests) and kept


def test_a_later_assert_counts_if_the_earlier_can_not_define_what_it_calls():
    tests = ["def f(a, b): return 3", "assert f(1, 2) == 3"]
    assert hopeless("x = 1\n", ast.parse("x = 1\n"), tests)
    assert not hopeless("x = 1\n", ast.parse("x = 1\n"), tests, "shared")


@pytest.mark.parametrize(
    "source", ["import os\n", "import math\nmath.pi = 3\n", "import random\nrandom.seed(1)\n", "try:\n    pass\nexcept:\n    pass\n", "import re\nre._cache.clear()\n", "def f():\n    global x\n", "exec('1')\n", "for math.pi in [3]: pass\n"]
)
def test_what_may_leave_traces_runs_alone(source):
    assert not (open_to_view(source) and leaves_no_trace(source, ast.parse(source), usable_tests(CALL)))


def test_a_loop_that_only_fails_is_left_at_once(box):
    loops = ["while a > 0:\n        b -= 1", "try:\n        while a > 0:\n            b -= 1\n    except (KeyError, ValueError):\n        b = 2", "for i in range(9):\n        while i > 3:\n            b -= 1", "while a > 0:\n        for i in range(9):\n            a += i", "while a < 9:\n        a = a - 2"]
    programs = [(usable_tests(CALL), f"def f(a, b):\n    {loop}\n    return 3\n", True) for loop in loops]
    began = time.monotonic()
    assert box.passing([*programs, (usable_tests(CALL), ADD, True)]) == [False] * 5 + [True] and time.monotonic() - began < 2
    assert all(without_endless_loops(code) for _, code, _ in programs)


def test_one_that_ends_its_process_spoils_no_other(box):
    deep = "def f(a, b):\n    return f(a, b)\n"
    grown = "def f(a, b):\n    x = [0] * 80000000\n    return 3\n"
    programs = [(usable_tests(CALL), code, True) for code in (ADD, deep, ADD, grown, ADD, "import os\nos._exit(0)\n", ADD, "def f(a, b):\n    raise KeyboardInterrupt\n", ADD)]
    assert box.passing(programs) == [True, False, True, True, True, False, True, False, True]


def test_on_table(spark):
    rows = [(i, "apps" if i % 2 else "mbpp", s, t if t[0] == "{" else None, json.loads(t) if t[0] == "[" else None) for i, (s, t) in enumerate([*PASSING, *HOPELESS]) if (t[0] == "{") == bool(i % 2)]
    df = spark.createDataFrame([*rows, (900, "apps", None, CALL, None), (901, "apps", ADD, None, None), (902, "apps", ADD, "{", None)], "idx long, dataset string, solutions string, input_output string, test_list array<string>")
    made = augmentation(df, order=False).where("transform is not null").select("idx", "transform").collect()
    with Sandbox() as sandbox:
        plainly = {(i, name) for i, _, s, io, asserts in rows for name in plain(sandbox, s, io or json.dumps(asserts))}
    assert {(r["idx"], r["transform"]) for r in made} == plainly and len(made) == len(plainly) >= 25
    assert passing_variants(df.selectExpr("idx", "solutions", "input_output tests").limit(0)).count() == 0
