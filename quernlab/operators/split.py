"""Joins of scores, seeded shuffles and splits, and the tables that training reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlab.operators.ranking import distributed_rank

#: The filters of pairs by two scores.
MODES = ("abs", "abs_pos", "diff", "abs_diff", "none")


def latest_scores(judged: DataFrame) -> DataFrame:
    """(idx, aspect, score): of repeated (idx, aspect) the last read; a null score counts as 0."""
    return judged.groupBy("idx", "aspect").agg(F.max_by(F.coalesce("score", F.lit(0.0)), F.struct("loaded_at", "judged_at")).alias("score"))


def quality(correct: DataFrame, help_: DataFrame, strict: bool = True) -> DataFrame:
    """(idx, correct, help, score): the mean of two score tables (idx, score), driven by the first.

    With ``strict`` a key of the first that the second lacks is an error; else such rows are left out.
    """
    a, b = correct.select("idx", F.col("score").alias("correct")), help_.select("idx", F.col("score").alias("help"))
    joined = a.join(b, "idx", "left" if strict else "inner")
    if strict:
        message = F.concat(F.lit("no second score for "), F.col("idx").cast("string"))
        joined = joined.withColumn("help", F.when(F.col("help").isNull(), F.raise_error(message).cast("double")).otherwise(F.col("help")))
    return joined.select("idx", "correct", "help", ((F.col("correct") + F.col("help")) / 2).alias("score"))


def pair_filter(pairs: DataFrame, mode: str, least: float, most: float) -> DataFrame:
    """The rows of (idx, answer1, answer2, score1, score2) that meet a constraint and whose answers differ.

    ``abs``: both scores between; ``abs_pos``: the first between; ``diff``: less than ``most`` apart;
    ``abs_diff``: so, and both above ``least``; ``none``: all. Null scores meet none of the first four.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}: {mode!r}")
    low, high = F.least("score1", "score2"), F.greatest("score1", "score2")
    near = F.abs(F.col("score1") - F.col("score2")) < most
    met = {"abs": (low > least) & (high < most), "abs_pos": (F.col("score1") > least) & (F.col("score1") < most), "diff": near, "abs_diff": near & (low > least), "none": F.lit(True)}[mode]
    both = F.col("score1").isNotNull() & F.col("score2").isNotNull() if mode != "none" else F.lit(True)
    return pairs.where(met & both & ~F.col("answer1").eqNullSafe(F.col("answer2")))


def common_indexes(*lists: DataFrame) -> DataFrame:
    """The idx that all lists have."""
    out = lists[0].select("idx")
    for other in lists[1:]:
        out = out.intersect(other.select("idx"))
    return out


def aligned(human: DataFrame, referenced: DataFrame, direct: DataFrame) -> DataFrame:
    """(idx, instruction, human, referenced, direct) of three (idx, instruction, output) tables.

    Rows whose instructions differ are an error; rows that one table lacks are left out.
    """
    a = human.select("idx", "instruction", F.col("output").alias("human"))
    b = referenced.select("idx", F.col("instruction").alias("i2"), F.col("output").alias("referenced"))
    c = direct.select("idx", F.col("instruction").alias("i3"), F.col("output").alias("direct"))
    same = F.col("instruction").eqNullSafe(F.col("i2")) & F.col("instruction").eqNullSafe(F.col("i3"))
    message = F.concat(F.lit("instructions differ at "), F.col("idx").cast("string"))
    return a.join(b, "idx").join(c, "idx").select("idx", F.when(same, F.col("instruction")).otherwise(F.raise_error(message).cast("string")).alias("instruction"), "human", "referenced", "direct")


def shuffled(df: DataFrame, *key: str, seed: int = 42) -> DataFrame:
    """``df`` in an order that the seed fixes, the same on any cluster and in any partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key)


def split_by_counts(df: DataFrame, counts: dict[str, int], rest: str, key: str = "idx", seed: int = 42, rows: int | None = None) -> DataFrame:
    """``df`` with ``part``: the parts follow each other in a seeded order, each of its count; ``rest`` takes the remainder."""
    ranked = distributed_rank(df.withColumn("_at", F.xxhash64(F.lit(seed), key)), F.asc("_at"), F.asc(key), name="_rank", rows=rows)
    upto, part = 0, F.lit(rest)
    for name, n in reversed(list(counts.items())):
        upto = sum(list(counts.values())[: list(counts).index(name) + 1])
        part = F.when(F.col("_rank") <= upto, name).otherwise(part)
    return ranked.withColumn("part", part).drop("_rank", "_at")


def split_train_valid_test(df: DataFrame, key: str = "idx", seed: int = 42) -> DataFrame:
    """80/10/10: the last two together are a fifth, rounded up, of which valid has half, rounded up."""
    n = df.count()
    held = -(-n // 5)
    return split_by_counts(df, {"train": n - held, "valid": -(-held // 2)}, "test", key, seed, n)


def split_train_eval(df: DataFrame, key: str = "idx", seed: int = 42, share: float = 0.995) -> DataFrame:
    n = df.count()
    return split_by_counts(df, {"train": int(n * share)}, "eval", key, seed, n)


def ranking_accuracy(scores: DataFrame) -> DataFrame:
    """(n, accuracy): how many of direct > referenced, direct > human and referenced > human hold, of 3 n."""
    wins = sum((F.col(a) > F.col(b)).cast("double") for a, b in (("direct", "referenced"), ("direct", "human"), ("referenced", "human")))
    return scores.agg(F.count("*").alias("n"), (F.sum(wins) / (3 * F.count("*"))).alias("accuracy"))


# Training rows


def masked(tokens: DataFrame, ignore: int = -100) -> DataFrame:
    """(idx, input_ids, labels) of (idx, prompt_ids, answer_ids): the labels of the prompt are masked."""
    return tokens.select(
        "idx", F.concat("prompt_ids", "answer_ids").alias("input_ids"),
        F.concat(F.array_repeat(F.lit(ignore), F.size("prompt_ids")), "answer_ids").alias("labels"),
    )


def padded(rows: DataFrame, batch: int, pad: int, ignore: int = -100) -> DataFrame:
    """Rows (idx, input_ids, labels) of equal length within each batch of ``batch`` idx, with attention_mask."""
    group = F.floor(F.col("idx") / batch)
    longest = rows.groupBy(group.alias("batch")).agg(F.max(F.size("input_ids")).alias("longest"))
    fill = lambda c, value: F.concat(c, F.array_repeat(F.lit(value), F.col("longest") - F.size("input_ids")))
    return rows.withColumn("batch", group).join(longest, "batch").select(
        "idx", "batch", fill("input_ids", pad).alias("input_ids"), fill("labels", ignore).alias("labels"),
        F.concat(F.array_repeat(F.lit(1), F.size("input_ids")), F.array_repeat(F.lit(0), F.col("longest") - F.size("input_ids"))).alias("attention_mask"),
    )


def tokenised(pairs: DataFrame, load, prompt: str = "prompt", answer: str = "answer", max_length: int | None = None) -> DataFrame:
    """(idx, prompt_ids, answer_ids) by a tokenizer that ``load`` makes once per worker: list of texts -> lists of ids.

    Prompt and answer are tokenised as one text and cut to ``max_length`` ids, if given; the prompt keeps as many ids as it has by itself.
    """

    def run(batches):
        import pyarrow as pa

        encode = load()
        for batch in batches:
            first = [t or "" for t in batch.column(prompt).to_pylist()]
            whole = [a + (b or "") for a, b in zip(first, batch.column(answer).to_pylist())]
            prompts, wholes = encode(first), encode(whole)
            cut = [(w[:max_length][: len(p)], w[:max_length][len(p) :]) for p, w in zip(prompts, wholes)]
            ids = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("idx"), pa.array([a for a, _ in cut], ids), pa.array([b for _, b in cut], ids)], names=["idx", "prompt_ids", "answer_ids"])

    return pairs.select("idx", prompt, answer).mapInArrow(run, "idx long, prompt_ids array<int>, answer_ids array<int>")


def chat_labels(turns: DataFrame, ignore: int = -100) -> DataFrame:
    """(idx, input_ids, labels) of (idx, turns array<struct<who, ids>>, n_tokens): only gpt turns are learned.

    A row whose turns don't add up to ``n_tokens`` is masked as a whole.
    """
    ids = F.flatten(F.transform("turns", lambda t: t["ids"]))
    labels = F.flatten(F.transform("turns", lambda t: F.when(t["who"] == "gpt", t["ids"]).otherwise(F.array_repeat(F.lit(ignore), F.size(t["ids"])))))
    return turns.select("idx", ids.alias("input_ids"), F.when(F.size(ids) == F.col("n_tokens"), labels).otherwise(F.array_repeat(F.lit(ignore), F.size(ids))).alias("labels"))
