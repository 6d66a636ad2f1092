"""Scoring, ranking and keeping instruction-answer pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlab.operators.ranking import distributed_rank

#: The input limit of a scorer that doesn't state its own by an attribute ``max_length`` (None: none), and the rows it gets at once.
MAX_LENGTH, BATCH = 512, 32
Scorer = Callable[[list[str], list[str]], list[float]]


def score_pairs(pairs: DataFrame, load: Callable[[], Scorer], instruction: str = "question", answer: str = "solutions", max_length: int | None = None, batch: int = BATCH, name: str = "score") -> DataFrame:
    """``pairs`` with a score per row.

    ``load`` runs once per Python worker and returns a function from batches of instructions and
    answers to scores. Texts are cut to ``max_length`` white-space tokens, if given, else to the scorer's
    own limit, for the scorer only, as a model's input is; nulls are empty texts.
    """

    @F.pandas_udf("double")
    def scored(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = load()
        most = getattr(scorer, "max_length", MAX_LENGTH) if max_length is None else max_length
        cut = lambda t: (t or "") if most is None else " ".join((t or "").split(maxsplit=most)[:most])
        for left, right in columns:
            out: list[float] = []
            for at in range(0, len(left), batch):
                out += scorer([cut(t) for t in left[at : at + batch]], [cut(t) for t in right[at : at + batch]])
            yield pd.Series(out, dtype="float64")

    return pairs.withColumn(name, scored(F.col(instruction), F.col(answer)))


def overlap_scorer() -> Scorer:
    """A scorer that needs no model: the share of an answer's distinct words that its instruction has. Its input has no limit."""

    def run(instructions: list[str], answers: list[str]) -> list[float]:
        out = []
        for asked, given in zip(instructions, answers):
            words = set(given.lower().split())
            out.append(len(words & set(asked.lower().split())) / len(words) if words else 0.0)
        return out

    run.max_length = None
    return run


def max_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The greatest value of each dimension over the unmasked positions of (batch, position, dimension)."""
    return np.where(mask[..., None] == 0, -1e9, states).max(axis=1)


def mean_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mean over the unmasked positions; a row that is all masked gives nan."""
    weight = mask[..., None].astype(float)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (states * weight).sum(axis=1) / weight.sum(axis=1)


Encoder = Callable[[list[str], list[str]], tuple[np.ndarray, np.ndarray]]


def encoder_scorer(load: Callable[[], Encoder], weights: np.ndarray, bias: float = 0.0, pool=mean_pool, max_length: int | None = MAX_LENGTH) -> Callable[[], Scorer]:
    """A ``load`` for ``score_pairs`` from a model: its states (pair, position, dimension) and mask are pooled, and a linear head makes the score.

    ``load`` makes the encoder once per worker; it gets texts already cut to ``max_length``. A pair without a position scores nothing.
    """

    def make() -> Scorer:
        encode = load()

        def run(instructions: list[str], answers: list[str]) -> list[float]:
            states, mask = (np.asarray(x) for x in encode(instructions, answers))
            scores = pool(states, mask) @ np.asarray(weights) + bias
            return [float(s) if some else None for s, some in zip(scores, mask.any(axis=1))]

        run.max_length = max_length
        return run

    return make


def rank_pairs(scored: DataFrame, key: str = "idx", score: str = "score", rows: int | None = None) -> DataFrame:
    """``scored`` with ``rank``: by score from high to low, ties by key, null scores last."""
    return distributed_rank(scored, F.desc_nulls_last(score), F.asc(key), rows=rows)


def filter_pairs(scored: DataFrame, *, topk: int | None = None, threshold: float | None = None, ratio: float | None = None, key: str = "idx", score: str = "score") -> DataFrame:
    """The best ``topk`` pairs, those of at least ``threshold``, or the best ``ratio`` of them; exactly one must be given.

    A ratio keeps int(n * ratio) rows, in floating point: 0.29 of 100 keeps 28. Ties go by key.
    """
    if sum(x is not None for x in (topk, threshold, ratio)) != 1:
        raise ValueError("give exactly one of topk, threshold and ratio")
    if threshold is not None:
        return scored.where(F.col(score) >= F.lit(float(threshold)))
    if topk is not None:
        return scored.orderBy(F.desc_nulls_last(score), F.asc(key)).limit(max(0, topk))
    n = scored.count()
    return rank_pairs(scored, key, score, rows=n).where(F.col("rank") <= int(n * ratio)).drop("rank")


def select(samples: DataFrame, load: Callable[[], Scorer] = overlap_scorer, ratio: float | None = 0.2, topk: int | None = None, threshold: float | None = None, keep_columns: bool = False) -> DataFrame:
    """Score, rank and filter samples; the three fields of the report, or with ``keep_columns`` all."""
    scored = score_pairs(samples, load)
    kept = filter_pairs(scored, ratio=ratio, topk=topk, threshold=threshold)
    return kept if keep_columns else kept.select("question", "solutions", "score")
