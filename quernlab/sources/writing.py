"""Writers; a directory of JSON lines is the form that scales, single files are for small results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that the single-file writers take.
EXPORT_LIMIT = 1_000_000
SUMMARY_FIELDS = ("dataset", "model", "tech", "best_ckpt", "val_pass1", "test_pass1", "avg_pass_ratio", "avg_code_smell_score", "avg_mi_score")


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object per line; nulls are written as null."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def _bounded(df: DataFrame, limit: int) -> list[dict]:
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; use write_jsonl")
    return [r.asDict(recursive=True) for r in rows]


def export_json_array(df: DataFrame, path: str, limit: int = EXPORT_LIMIT) -> int:
    """A single local file with one JSON array; the number of its elements."""
    rows = _bounded(df, limit)
    with open(path, "w", encoding="utf-8") as out:
        json.dump(rows, out, ensure_ascii=False, default=str)
    return len(rows)


def last_scores(scores: DataFrame) -> DataFrame:
    """(key, score): of repeated keys of (idx, key, score) the last by ``idx``."""
    return scores.groupBy("key").agg(F.max_by("score", "idx").alias("score"))


def export_score_map(scores: DataFrame, path: str, limit: int = EXPORT_LIMIT) -> int:
    rows = _bounded(last_scores(scores), limit)
    with open(path, "w", encoding="utf-8") as out:
        json.dump({r["key"]: r["score"] for r in rows}, out, ensure_ascii=False)
    return len(rows)


def write_line_list(lines: DataFrame, path: str, mode: str = "error") -> None:
    """Sorted 0-based line numbers, one JSON object each."""
    lines.select("idx").distinct().orderBy("idx").write.mode(mode).json(path)


def summary_lines(summary: DataFrame) -> DataFrame:
    """(value): the key=value lines of each summary row; the two pass@1 figures have four decimals, nulls are None."""
    shown = [F.when(F.col(c).isNotNull(), F.format_string("%.4f", c)) if c.endswith("pass1") else F.col(c).cast("string") for c in SUMMARY_FIELDS]
    pairs = F.array(*[F.concat(F.lit(f"{c}="), F.coalesce(v, F.lit("None"))) for c, v in zip(SUMMARY_FIELDS, shown)])
    return summary.select(F.array_join(pairs, "\n").alias("value"))


def write_summary(summary: DataFrame, path: str, mode: str = "error") -> None:
    summary_lines(summary).write.mode(mode).text(path)


def run_report(df: DataFrame, name: str, counters: dict[str, F.Column]):
    """(df, observation): ``df`` with counters that are filled by the action that runs it, at no extra pass."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.sum(c.cast("long")).alias(n) for n, c in counters.items()]), seen
