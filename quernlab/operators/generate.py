"""Calls of an external model through an injected client, and recorded replies in its place.

``load`` makes a client once per Python worker: a function from a prompt to a reply. Nothing here
knows a service; a failing call never fails the job, its error is in the row.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlab.functions.text import clean_code, clean_reply, judge_prompt, judge_score, style_prompt, synthesis_prompt
from quernlab.session import materialise

Client = Callable[[str], str]
ATTEMPTS = 5


def complete(prompts: DataFrame, load: Callable[[], Client], n: int = 1) -> DataFrame:
    """(idx, j, reply, error) of (idx, prompt): n replies each; a failed call has a null reply and its error."""

    def run(batches):
        client = load()
        for batch in batches:
            rows = []
            for idx, prompt in zip(batch.column("idx").to_pylist(), batch.column("prompt").to_pylist()):
                for j in range(n):
                    try:
                        rows.append((idx, j, client(prompt or ""), None))
                    except Exception as error:
                        rows.append((idx, j, None, f"Error: {error}"))
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.string()))], names=["idx", "j", "reply", "error"])

    return prompts.select("idx", "prompt").mapInArrow(run, "idx long, j int, reply string, error string")


def generation_ids(replies: DataFrame) -> DataFrame:
    """(id, code): generations named idx_j."""
    return replies.select(F.concat_ws("_", "idx", "j").alias("id"), F.col("reply").alias("code"))


def judge(pairs: DataFrame, load: Callable[[], Client], aspect: str) -> DataFrame:
    """(idx, score, content): the judge's score of each (idx, instruction, output), null with the error as content if the call failed."""
    prompts = pairs.select("idx", judge_prompt(aspect, "instruction", "output").alias("prompt"))
    replies = materialise(complete(prompts, load))
    return replies.select("idx", F.when(F.col("error").isNull(), judge_score("reply", F.lit(aspect))).alias("score"), F.coalesce("error", "reply").alias("content"))


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: str = "idx") -> DataFrame:
    """n rows that the seed and the key fix."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def rewrite_style(pairs: DataFrame, load: Callable[[], Client], mode: str = "referenced") -> DataFrame:
    """``pairs`` (idx, instruction, output, ...) with ``output`` rewritten; a failed call leaves it as it was.

    Every row comes back once, whatever the order in which the replies come in: an idx that is null
    or not unique, which would pair a row with another's reply, is an error.
    """
    keyed = pairs.groupBy("idx").agg(F.count("*").alias("n")).where("idx is null or n > 1").limit(1).collect()
    if keyed:
        raise ValueError(f"idx must tell rows apart: {keyed[0]['idx']!r}")
    prompts = pairs.select("idx", style_prompt(mode, "instruction", "output").alias("prompt"))
    replies = complete(prompts, load).select("idx", "reply")
    return pairs.join(replies, "idx", "left").withColumn("output", F.coalesce("reply", "output")).drop("reply")


def synthesise(samples: DataFrame, load: Callable[[], Client], passes: Callable[[str | None, str], bool], attempts: int = ATTEMPTS) -> DataFrame:
    """``samples`` (idx, question, tests, solutions, ...) with new ``solutions``, and whether they passed.

    Each sample is tried up to ``attempts`` times in its task, stopping at the first code that
    ``passes`` (tests, code); without one the last code is kept. A failed call is an empty code.
    """

    def run(batches):
        client = load()
        for batch in batches:
            codes, passed = [], []
            for prompt, tests in zip(batch.column("prompt").to_pylist(), batch.column("tests").to_pylist()):
                code, ok = "", False
                for _ in range(attempts):
                    try:
                        code = clean_reply(client(prompt))
                        ok = passes(tests, code)
                    except Exception:
                        code, ok = "", False
                    if ok:
                        break
                codes.append(code)
                passed.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column("idx"), pa.array(codes, pa.string()), pa.array(passed)], names=["idx", "_code", "passed"])

    made = samples.select("idx", synthesis_prompt("question").alias("prompt"), "tests").mapInArrow(run, "idx long, _code string, passed boolean")
    return samples.join(made, "idx").withColumn("solutions", F.col("_code")).drop("_code")


def recorded_attempts(replies: DataFrame, ratio) -> DataFrame:
    """(idx, attempt, code, passed) of recorded replies (idx, j, reply), cleaned and run by ``ratio`` (a column function of the code)."""
    cleaned = replies.select("idx", F.col("j").alias("attempt"), clean_code("reply").alias("code"))
    return cleaned.withColumn("passed", ratio(F.col("code")) == 1.0)
