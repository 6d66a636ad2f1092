"""Metrics over generations and their pass ratios.

``items`` is (idx), ``runs`` is (idx, j, ratio): the ratio of tests that generation j of item idx
passes, null where it could not be run. Items count once however often they occur; generations of
other items don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_generation_id(generations: DataFrame, id_: str = "id") -> DataFrame:
    """``generations`` with idx and j of an id ``idx_j``; both null for other ids."""
    parts = F.split(id_, "_")
    good = F.regexp_like(F.col(id_), F.lit(r"^\d+_\d+$"))
    return generations.withColumns({"idx": F.when(good, parts[0].cast("long")), "j": F.when(good, parts[1].cast("int"))})


def best_ratios(items: DataFrame, runs: DataFrame, k: int | None = None) -> DataFrame:
    """(idx, best): the best ratio of each item's first ``k`` generations, 0 without any."""
    kept = runs if k is None else runs.where(F.col("j") < k)
    best = kept.groupBy("idx").agg(F.max(F.coalesce("ratio", F.lit(0.0))).alias("best"))
    return items.where("idx is not null").select("idx").distinct().join(best, "idx", "left").select("idx", F.coalesce("best", F.lit(0.0)).alias("best"))


def pass_at_k(items: DataFrame, runs: DataFrame, k: int = 1) -> DataFrame:
    """(n_items, pass_at_k): the share of items that one of k generations passes wholly; 0 without items."""
    return best_ratios(items, runs, k).agg(F.count("*").alias("n_items"), F.coalesce(F.avg((F.col("best") == 1.0).cast("double")), F.lit(0.0)).alias("pass_at_k"))


def average_pass_ratio(items: DataFrame, runs: DataFrame, k: int | None = None) -> DataFrame:
    """(n_items, avg_pass_ratio): the mean over items of the best ratio of k generations; 0 without items."""
    return best_ratios(items, runs, k).agg(F.count("*").alias("n_items"), F.coalesce(F.avg("best"), F.lit(0.0)).alias("avg_pass_ratio"))


def checkpoint_step(name: Column | str) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return F.regexp_extract(c, r"-(\d+)$", 1).try_cast("int")


def best_checkpoint(scores: DataFrame, by: list[str], checkpoint: str = "checkpoint", score: str = "pass1") -> DataFrame:
    """(by, checkpoint, score): of each group the checkpoint of the best score, among equals the lowest step; null scores lose."""
    ordered = scores.where(F.col(score).isNotNull()).groupBy(*by).agg(
        F.max_by(F.struct(checkpoint, score), F.struct(F.col(score), -checkpoint_step(checkpoint))).alias("best")
    )
    return ordered.select(*by, F.col(f"best.{checkpoint}"), F.col(f"best.{score}"))


def quality_averages(scores: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """The mean of each score by group; null scores count as 0."""
    return scores.groupBy(*by).agg(*[F.avg(F.coalesce(c, F.lit(0.0))).alias(f"avg_{c}") for c in columns])


def first_passing(attempts: DataFrame) -> DataFrame:
    """(idx, attempts, passed, code) of (idx, attempt, code, passed): the code of the first attempt that
    passes, else of the last one; ``attempts`` counts those that were needed."""
    ok = F.coalesce("passed", F.lit(False))
    return attempts.groupBy("idx").agg(
        F.coalesce(F.min(F.when(ok, F.col("attempt"))) + 1, F.max("attempt") + 1).alias("attempts"),
        F.max(ok).alias("passed"),
        F.min_by(F.when(ok, F.struct("code")), F.when(ok, F.col("attempt"))).alias("_first"),
        F.max_by(F.struct("code"), "attempt").alias("_last"),
    ).select("idx", "attempts", "passed", F.when(F.col("passed"), F.col("_first.code")).otherwise(F.col("_last.code")).alias("code"))


def failure_ratio(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("n"), F.count(F.when(~F.col("passed"), 1)).alias("n_failed")).withColumn(
        "failure_ratio", F.when(F.col("n") > 0, F.col("n_failed") / F.col("n")).otherwise(0.0)
    )
