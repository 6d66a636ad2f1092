import os
from pathlib import Path

import duckdb
import pytest

from quernlab.plans import catalog

QUICK = [n for n in catalog.oracle_sql()]
#: Held against the plain functions below.
TESTED = ("aug_variants", "refactor", "mi_score", "lint_rating", "scan_code", "cle_split", "mbpp_ratio", "io_ratio", "minhash_pairs")


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(small):
        connection.execute(f"CREATE VIEW {Path(name).stem} AS SELECT * FROM '{small}/{name}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 9))
    return str(int(value)) if isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, small, duck, name):
    frame = catalog.queries()[name](spark, small)
    columns = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    result = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())


# What SQL can't say: the same function applied row by row to the table's rows must give what the query gives.


def rows_of(spark, small, name, key):
    return {r[key]: r for r in spark.read.parquet(f"{small}/{name}.parquet").collect()}


def python_files(spark, small):
    return {k: r["code"] for k, r in rows_of(spark, small, "all_code", "id").items() if r["path"].endswith(".py")}


def test_aug_variants(spark, small):
    from quernlab.functions.rewrite import variants

    expected = {(k, name, code) for k, r in rows_of(spark, small, "samples", "idx").items() for name, code in variants(r["solutions"])}
    assert {(r["idx"], r["transform"], r["code"]) for r in catalog.queries()["aug_variants"](spark, small).collect()} == expected and expected


def test_refactor(spark, small):
    from quernlab.functions.formatters import formatted

    got = {r["idx"]: r["code"] for r in catalog.queries()["refactor"](spark, small).collect()}
    assert got == {k: formatted(r["solutions"]) for k, r in rows_of(spark, small, "samples", "idx").items()}
    assert any(code and code != r["solutions"] for (k, r), code in zip(sorted(rows_of(spark, small, "samples", "idx").items()), [got[k] for k in sorted(got)]))


@pytest.mark.parametrize("name, column", [("mi_score", "mi"), ("lint_rating", "rating")])
def test_code_scores(spark, small, name, column):
    from quernlab.functions.quality import lint_rating, maintainability

    rate = {"mi_score": maintainability, "lint_rating": lint_rating}[name]
    got = {r["id"]: r[column] for r in catalog.queries()[name](spark, small).collect()}
    assert got == {k: rate(code) for k, code in python_files(spark, small).items()} and any(got.values())


def test_scan(spark, small):
    from quernlab.functions.scan import findings_of

    expected, errors = set(), set()
    for path, code in ((r["path"], r["code"]) for r in rows_of(spark, small, "all_code", "id").values() if r["path"].endswith(".py") and (r["code"] or "").strip()):
        try:
            expected |= {(path, rule.check_id, line) for rule, line in findings_of(code)}
        except (SyntaxError, ValueError):
            errors.add(path)
    got = catalog.queries()["scan_code"](spark, small).collect()
    assert {r["path"] for r in got if r["is_error"]} == errors and errors
    assert {(r["path"], r["check_id"], r["line"]) for r in got if not r["is_error"]} == expected and expected
    buckets = {r["bucket"]: r["n"] for r in catalog.queries()["cle_split"](spark, small).collect()}
    assert buckets["syntax_error"] == len(errors) and buckets["defective"] == len({p for p, *_ in expected})


@pytest.mark.parametrize("name, mbpp", [("mbpp_ratio", True), ("io_ratio", False)])
def test_pass_ratios(spark, small, name, mbpp):
    import json

    from quernlab.functions.sandbox import Sandbox

    samples = {k: r for k, r in rows_of(spark, small, "samples", "idx").items() if (r["dataset"] == "mbpp") == mbpp}
    got = {r["idx"]: r["ratio"] for r in catalog.queries()[name](spark, small).collect()}
    with Sandbox() as sandbox:
        assert got == {k: sandbox.ratio(json.dumps(r["test_list"]) if mbpp and r["test_list"] is not None else r["input_output"] if not mbpp else None, r["solutions"]) for k, r in samples.items()}


def test_minhash_finds_most_links(spark, small):
    exact = {(r["a"], r["b"]) for r in catalog.queries()["near_dup_pairs"](spark, small).collect()}
    found = {(r["a"], r["b"]) for r in catalog.queries()["minhash_pairs"](spark, small).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in QUICK and n not in TESTED])
def test_runs(spark, small, name):
    assert catalog.queries()[name](spark, small).columns


def test_selection_survives_scale_switch(spark, small, monkeypatch):
    from quernlab.operators import ranking

    before = catalog.queries()["select_ratio"](spark, small).collect()
    monkeypatch.setattr(ranking, "RANGE_ROWS", 7)
    assert sorted(before) == sorted(catalog.queries()["select_ratio"](spark, small).collect())
