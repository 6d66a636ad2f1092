import ast

import pytest

from quernlab.functions.formatters import apply_formatter, formatted, refactor
from quernlab.functions.quality import lint_rating, maintainability, score_column


@pytest.mark.parametrize(
    "name,source,result",
    [
        ("unused", "import os, sys\nprint(sys.path)\n", "import sys\nprint(sys.path)\n"),
        ("unused", "def f():\n    x = 1\n    return 2\n", "def f():\n    return 2\n"),
        ("unused", "def f():\n    x = g()\n", "def f():\n    x = g()\n"),
        ("unused", "def f():\n    import os\n", "def f():\n    pass\n"),
        ("layout", "x=1\nif x == None:\n\ty=[1,2]\n", "x = 1\nif x is None:\n\ty = [1, 2]\n"),
        ("layout", "def f(a=1): pass\ndef g(): pass   \n\n\n\n", "def f(a=1): pass\n\n\ndef g(): pass\n"),
        ("docstrings", "def f():\n    'adds'\n", 'def f():\n    """Adds."""\n'),
        ("docstrings", 'def f():\n    """Adds\n    more."""\n', 'def f():\n    """Adds\n\n    more.\n    """\n'),
        ("quotes", 'x = "a"\ny = "it\'s"\n', "x = 'a'\ny = \"it's\"\n"),
        ("quotes", "def (", "def ("),
    ],
)
def test_formatter(name, source, result):
    assert apply_formatter(source, name) == result


def test_chain_keeps_meaning(spark, small):
    for row in spark.read.parquet(f"{small}/samples.parquet").where("solutions is not null").select("solutions").collect():
        try:
            ast.parse(row["solutions"])
        except SyntaxError:
            assert formatted(row["solutions"]) == row["solutions"]
        else:
            ast.parse(formatted(row["solutions"]))


def test_refactor_on_table(spark):
    df = spark.createDataFrame([(1, 'x = "a"\n', "old"), (2, None, "old"), (3, "def (", "old"), (4, "", "old")], "idx long, solutions string, code string")
    assert {r["idx"]: r["code"] for r in refactor(df).collect()} == {1: "x = 'a'\n", 2: None, 3: "def (", 4: ""}
    assert refactor(df, into="solutions").first()["solutions"] == "x = 'a'\n"
    assert refactor(df.limit(0)).count() == 0


def test_scores(spark):
    good, bad = "def f(x):\n    return x\n", "def (\n"
    assert maintainability("") == 100.0 and maintainability(bad) == 0.0 and maintainability(None) == 100.0
    assert 0 < maintainability("def f(x):\n" + "".join(f"    x = x * {i} + 3 if x > {i} else x - 1\n" for i in range(40))) < maintainability(good) <= 100
    assert lint_rating(bad) == lint_rating("") == lint_rating(None) == 0.0 and 0 <= lint_rating(good) <= 10
    assert lint_rating('"""Doc."""\n\n\ndef f(x):\n    """Doc."""\n    return x\n') == 10.0
    assert spark.createDataFrame([(good,), (None,)], "code string").select(score_column("code", maintainability).alias("m")).count() == 2
