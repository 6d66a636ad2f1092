"""The techniques as functions from DataFrame to DataFrame, so that any order of them is a chain.

    chain(samples, "ref", "aug")        # or samples.transform(refactoring).transform(augmentation)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlab.functions.augment import passing_variants
from quernlab.functions.cases import tests_of
from quernlab.functions.formatters import refactor
from quernlab.functions.quality import lint_rating, maintainability, score_column
from quernlab.functions.sandbox import pass_ratios
from quernlab.functions.scan import scan_code
from quernlab.functions.text import normalize_dataset
from quernlab.operators import evaluate, findings, generate, selection
from quernlab.session import materialise, spread


def training_path(root: str, dataset: str, technique: str | None = None) -> str:
    """Where a dataset's training table lies, after a technique or as it was."""
    name = normalize_dataset(dataset)
    return f"{root}/{name}/train{'_' + normalize_technique(technique) if technique else ''}"


def augmentation(samples: DataFrame, isolation: str = "per_test", seed: int = 42, order: bool = True) -> DataFrame:
    """The samples and every changed variant of their code that passes all their tests, in a seeded order.

    Original rows stay as they are, repeats included; a variant is its sample's row with other
    ``solutions``; ``transform`` says which rewrite, null for originals. Changed variants are told apart
    before anything is run, and what must fail by its source alone isn't.
    """
    own = samples.withColumn("transform", F.lit(None).cast("string"))
    unique = samples.dropDuplicates(["idx"]).withColumn("tests", tests_of())
    kept = materialise(passing_variants(spread(unique.select("idx", "solutions", "tests")), isolation=isolation)).withColumnRenamed("code", "_code")
    new = unique.drop("tests").join(kept, "idx").withColumn("solutions", F.col("_code")).drop("_code")
    both = own.unionByName(new.select(own.columns))
    key = F.xxhash64(F.lit(seed), "idx", F.coalesce("transform", F.lit("")))
    return both.orderBy(key, "idx") if order else both


def cleaning(samples: DataFrame, code: str = "solutions") -> DataFrame:
    """``samples`` with ``bucket``: clean, defective or syntax_error by the scanner."""
    scanned = materialise(scan_code(spread(samples.select(F.col("idx").alias("path"), F.col(code).alias("code")).dropDuplicates(["path"]))))
    split = findings.split_three_way(samples.withColumn("path", F.col("idx")), scanned.where("not is_error"), scanned.where("is_error"))
    return split.drop("path")


def cleaned(samples: DataFrame, code: str = "solutions") -> DataFrame:
    return cleaning(samples, code).where("bucket = 'clean'").drop("bucket")


def refactoring(samples: DataFrame, overwrite: bool = True) -> DataFrame:
    """Formatted code in place of the old, or with ``overwrite`` off beside it as ``code``."""
    return refactor(samples, into="solutions" if overwrite else "code")


def selecting(samples: DataFrame, load=selection.overlap_scorer, ratio: float = 0.2) -> DataFrame:
    """The best fifth of the samples with all their columns, for chaining."""
    return selection.select(samples, load, ratio=ratio, keep_columns=True).drop("score")


def synthesis(samples: DataFrame, load: Callable[[], generate.Client] | None = None, attempts: int = generate.ATTEMPTS) -> DataFrame:
    """``samples`` with solutions of a model, tried against their tests, and whether they ``passed``."""
    if load is None:
        raise ValueError("synthesis needs a client")

    def passes(tests: str | None, code: str) -> bool:
        from quernlab.functions.sandbox import Sandbox

        with Sandbox() as sandbox:
            return sandbox.ratio(tests, code) == 1.0

    return generate.synthesise(samples.withColumn("tests", tests_of()), load, passes, attempts).drop("tests")


TECHNIQUES: dict[str, Callable[..., DataFrame]] = {"aug": augmentation, "cle": cleaned, "ref": refactoring, "sel": selecting, "syn": synthesis}
_LONG_NAMES = {"augmentation": "aug", "cleaning": "cle", "refactoring": "ref", "selection": "sel", "synthesis": "syn"}


def normalize_technique(name: str | None) -> str:
    plain = (name or "").strip().lower()
    plain = _LONG_NAMES.get(plain, plain)
    if plain not in TECHNIQUES:
        raise ValueError(f"technique must be one of {', '.join(TECHNIQUES)}: {name!r}")
    return plain


def chain(samples: DataFrame, *names: str, **options: dict) -> DataFrame:
    """The techniques applied one after the other; ``options`` are keyword arguments by technique."""
    for name in map(normalize_technique, names):
        samples = TECHNIQUES[name](samples, **options.get(name, {}))
        samples = samples.drop("transform") if name == "aug" else samples
    return samples


def generation_runs(items: DataFrame, generations: DataFrame, isolation: str = "shared", **limits: float) -> DataFrame:
    """(idx, j, ratio): generations (id, code) run once against the tests of their items; for all metrics to read."""
    named = evaluate.split_generation_id(generations.dropDuplicates(["id"])).where("idx is not null")
    tests = items.dropDuplicates(["idx"]).select("idx", tests_of().alias("tests"))
    return materialise(pass_ratios(spread(named.join(tests, "idx")), ["idx", "j"], isolation=isolation, **limits))


def evaluation(items: DataFrame, generations: DataFrame, k: int = 1, isolation: str = "shared") -> DataFrame:
    """One row: pass@1, average pass ratio, lint rating and maintainability of the generations of items, each id once."""
    generations = generations.dropDuplicates(["id"])
    runs = generation_runs(items, generations, isolation)
    scores = spread(generations).select(score_column("code", lint_rating).alias("lint"), score_column("code", maintainability).alias("mi"))
    means = scores.agg(F.coalesce(F.avg("lint"), F.lit(0.0)).alias("avg_code_smell_score"), F.coalesce(F.avg("mi"), F.lit(0.0)).alias("avg_mi_score"))
    first = evaluate.pass_at_k(items, runs, 1).select(F.col("pass_at_k").alias("test_pass1"))
    best = evaluate.average_pass_ratio(items, runs, k).select("avg_pass_ratio")
    parts = first.unionByName(best, allowMissingColumns=True).unionByName(means, allowMissingColumns=True)
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])
