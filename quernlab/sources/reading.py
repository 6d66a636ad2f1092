"""Readers for the JSON files that training-set tools exchange."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_SCHEMA = "idx long, dataset string, split string, source string, question string, solutions string, input_output string, test_list array<string>"
REPORT_SCHEMA = (
    "errors array<struct<path:string>>, results array<struct<path:string, check_id:string, extra:struct<severity:string, "
    "metadata:struct<category:string, cwe:variant, owasp:variant, impact:string, confidence:string>>>>, paths struct<scanned:array<string>>"
)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON object per line; blank lines are skipped, a line that is no object gives a row of nulls."""
    return spark.read.schema(schema).json(path)


def read_raw_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """(value, parsed): every line as it stands, stripped, beside its fields.

    With ``strict`` a blank or malformed line fails the read, else its ``parsed`` is null.
    """
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("value"))
    parsed = F.from_json("value", schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    whole = lines.where(F.length("value") > 0) if not strict else lines
    if strict:
        checked = F.when(F.length("value") == 0, F.raise_error(F.lit("blank line"))).otherwise(parsed)
        return whole.select("value", checked.alias("parsed"))
    return whole.select("value", parsed.alias("parsed"))


def read_json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The elements of a file that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_score_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, score) of files that are one JSON object of numbers each."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "map<string,double>")).alias("key", "score"))


def list_or_scalar(column: str) -> F.Column:
    """A variant that is a list, a scalar or null, as array<string>; null stays null."""
    kind = F.schema_of_variant(column)
    return F.when(F.col(column).isNull() | (kind == "VOID"), F.lit(None)).when(kind.startswith("ARRAY"), F.col(column).cast("array<string>")).otherwise(
        F.array(F.col(column).cast("string"))
    )


def read_reports(spark: SparkSession, paths: str | list[str]) -> dict[str, DataFrame]:
    """The ``errors`` (path), ``findings`` and ``scanned`` (path) of any number of scan reports, concatenated."""
    reports = spark.read.schema(REPORT_SCHEMA).option("multiLine", True).json(paths)
    results = reports.select(F.explode("results").alias("r")).select(
        "r.path", "r.check_id", "r.extra.severity", "r.extra.metadata.category", "r.extra.metadata.cwe", "r.extra.metadata.owasp", "r.extra.metadata.impact", "r.extra.metadata.confidence"
    )
    return {
        "errors": reports.select(F.explode("errors").alias("e")).select("e.path"),
        "findings": results.withColumns({"cwe": list_or_scalar("cwe"), "owasp": list_or_scalar("owasp")}),
        "scanned": reports.select(F.explode("paths.scanned").alias("path")),
    }


def list_checkpoints(spark: SparkSession, folder: str, prefix: str = "checkpoint-") -> DataFrame:
    """(name, step) of the checkpoint folders, by step; other entries are left out."""
    names = [n for n in os.listdir(folder) if re.fullmatch(re.escape(prefix) + r"\d+", n)]
    rows = sorted(((n, int(n[len(prefix):])) for n in names), key=lambda r: r[1])
    return spark.createDataFrame(rows, "name string, step int")


def code_of_items(items: DataFrame, field: str = "output", value: str = "value") -> DataFrame:
    """(idx, code): the field of items that are objects, else the item itself."""
    return items.select("idx", F.coalesce(F.col(field), F.col(value)).alias("code"))
