"""Problem 4: records that occur, exactly or almost, on both sides of a train/evaluation split.

Questions are compared as sets of word shingles: minwise sketches, banded buckets, only buckets
that hold both sides, then exact Jaccard similarity on the sets. Equal sets are one class from the
start, so a hot group of copies costs one class. Lists of asserts are sets of two or three members,
for which minwise banding has no power; they use an exact index instead (below).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernlab.functions.sketch import TokenHasher, minhash_bands, set_ids, shingle_batch
from quernlab.llm.arrow import fixed_lists, long_lists, sliced
from quernlab.operators.skew import spread_join
from quernlab.session import discard, materialise

#: 64 bands of 5 rows find a pair of similarity 0.6 with probability 0.994, 0.65 with 0.9996, 0.7 and more with 0.99999.
BANDS, ROWS = 64, 5
SHINGLE, SIMILARITY = 3, 0.6
EVALUATION = ("valid", "test")


def _text_sets(size: int):
    def run(batches):
        hasher = TokenHasher()
        for batch in sliced(batches):
            values, offsets = shingle_batch(batch.column("text").to_pylist(), size, hasher)
            filled = pa.array(np.diff(offsets) > 0)
            ids = pa.array(set_ids(values, offsets), pa.binary())
            yield pa.RecordBatch.from_arrays([x.filter(filled) for x in (batch.column("idx"), batch.column("stamp"), batch.column("train"), ids)], names=["idx", "stamp", "train", "set_id"])

    return run


def _own(batch: pa.RecordBatch, values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Whether a row has the set of its class; rows that were read with another text have not."""
    return pa.array([a == b for a, b in zip(set_ids(values, offsets), batch.column("set_id").to_pylist())], pa.bool_())


def _band_keys(size: int, bands: int, rows: int, seed: int):
    def run(batches):
        hasher = TokenHasher()
        for batch in sliced(batches):
            values, offsets = shingle_batch(batch.column("text").to_pylist(), size, hasher)
            own, keys = _own(batch, values, offsets), fixed_lists(minhash_bands(values, offsets, bands, rows, seed))
            arrays = [*(batch.column(c) for c in ("rep", "has_train", "has_eval")), keys]
            yield pa.RecordBatch.from_arrays([x.filter(own) for x in arrays], names=["rep", "has_train", "has_eval", "keys"])

    return run


def _grams(size: int):
    def run(batches):
        hasher = TokenHasher()
        for batch in sliced(batches):
            values, offsets = shingle_batch(batch.column("text").to_pylist(), size, hasher)
            own = _own(batch, values, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("rep").filter(own), long_lists(values, offsets).filter(own)], names=["rep", "grams"])

    return run


def split_rows(samples: DataFrame) -> DataFrame:
    """(idx, train, stamp, question, test_list) of the rows that are in a known split."""
    return samples.where(F.col("idx").isNotNull() & F.col("split").isin("train", *EVALUATION)).select(
        "idx", (F.col("split") == "train").alias("train"), F.coalesce(F.col("loaded_at").cast("long"), F.lit(0)).alias("stamp"), "question", "test_list"
    )


def _classes(members: DataFrame) -> DataFrame:
    return members.groupBy("set_id").agg(
        F.min("idx").alias("rep"), F.max("train").alias("has_train"), F.max(~F.col("train")).alias("has_eval")
    )


class Links:
    """Rows in classes of equal sets, and which classes are similar across the split.

    ``members`` is (rep, idx, train): a class is named by its least idx. ``links`` is (a, b): some
    evaluation row of class a and some train row of class b are similar, a = b included.
    """

    def __init__(self, members: DataFrame, links: DataFrame):
        self.members, self.links = members, links

    def pairs(self) -> DataFrame:
        """(eval_idx, train_idx) of the similar rows, copies included."""
        return (
            self.links.join(self.members.where("not train").select(F.col("rep").alias("a"), F.col("idx").alias("eval_idx")), "a")
            .join(self.members.where("train").select(F.col("rep").alias("b"), F.col("idx").alias("train_idx")), "b")
            .select("eval_idx", "train_idx")
        )


def _meeting(keyed: DataFrame, key: str) -> DataFrame:
    """(a, b), a <> b: the classes with evaluation rows and those with train rows that share a key; hot keys are cut."""
    evaluated = keyed.where("has_eval").select(key, F.col("rep").alias("a"))
    trained = keyed.where("has_train").select(key, F.col("rep").alias("b"))
    return spread_join(evaluated, trained, key).where("a <> b").select("a", "b").distinct()


def question_links(samples: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, seed: int = 42) -> Links:
    """The rows whose questions are similar.

    Null questions, and those of fewer than ``size`` tokens, are similar to nothing. A row read
    several times counts once; should its copies differ, the last loaded one counts.
    """
    source = split_rows(samples).select("idx", "train", "stamp", F.col("question").alias("text"))
    read = source.mapInArrow(_text_sets(size), "idx long, stamp long, train boolean, set_id binary")
    members = materialise(read.groupBy("idx").agg(F.max_by(F.struct("train", "set_id"), F.struct("stamp", "set_id")).alias("m")).select("idx", "m.train", "m.set_id"))
    classes = materialise(_classes(members))
    # One row per class carries its text on: that of the least idx, where it has this very set.
    texts = source.select("idx", "text").join(classes.withColumn("idx", F.col("rep")), "idx").select("rep", "set_id", "has_train", "has_eval", "text")
    banded = materialise(texts.mapInArrow(_band_keys(size, bands, rows, seed), "rep long, has_train boolean, has_eval boolean, keys array<long>"))
    candidates = materialise(_meeting(banded.select("rep", "has_train", "has_eval", F.explode("keys").alias("key")), "key"))
    discard(banded)
    wanted = candidates.select(F.col("a").alias("rep")).unionByName(candidates.select(F.col("b").alias("rep"))).distinct()
    sets = texts.join(wanted, "rep", "left_semi").select("rep", "set_id", "text").mapInArrow(_grams(size), "rep long, grams array<long>").dropDuplicates(["rep"])
    both = F.size(F.array_intersect("ga", "gb"))
    close = (
        candidates.join(sets.select(F.col("rep").alias("a"), F.col("grams").alias("ga")), "a")
        .join(sets.select(F.col("rep").alias("b"), F.col("grams").alias("gb")), "b")
        .where(both / (F.size("ga") + F.size("gb") - both) >= F.lit(similarity))
        .select("a", "b")
    )
    same = classes.where("has_train and has_eval").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    return Links(members.join(classes.select("set_id", "rep"), "set_id").select("rep", "idx", "train"), close.unionByName(same))


def test_links(samples: DataFrame, least: int = 2, share: float = 0.5) -> Links:
    """The rows with ``least`` or more common asserts that are ``share`` of all their distinct ones.

    Whitespace in asserts is ignored. Two such lists of n and m asserts have at least
    max(least, ceil(share * n)) in common, so they share one of the n - that + 1 rarest asserts of
    each: only these are indexed, and a frequent assert is in the index only of lists without rarer
    ones. Equal lists are one class. Null asserts, and null or shorter lists, match nothing.
    """
    squeezed = F.transform(F.filter("test_list", lambda x: x.isNotNull()), lambda x: F.regexp_replace(x, r"(?U)\s+", ""))
    lists = (
        split_rows(samples).where(F.col("test_list").isNotNull())
        .groupBy("idx").agg(F.max_by(F.struct("train", "test_list"), F.struct("stamp", "test_list")).alias("m"))
        .select("idx", "m.train", F.col("m.test_list").alias("test_list"))
        .select("idx", "train", F.array_sort(F.array_distinct(squeezed)).alias("set_id"))
        .where(F.size("set_id") >= least)
    )
    members = materialise(lists)
    classes = _classes(members)
    items = materialise(classes.select("rep", "has_train", "has_eval", F.size("set_id").alias("n"), F.explode("set_id").alias("item")))
    common = items.groupBy("item").agg(F.count("*").alias("df"), F.max("has_train").alias("t"), F.max("has_eval").alias("e"))
    ranked = (
        spread_join(items, common, "item")
        .withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy("df", "item")))
        .where(F.col("at") <= F.col("n") - F.greatest(F.lit(least), F.ceil(F.col("n") * share)) + 1)
        .where("t and e and df > 1")
    )
    candidates = _meeting(materialise(ranked.select("rep", "has_train", "has_eval", "item")), "item")
    sets = classes.select("rep", "set_id")
    both = F.size(F.array_intersect("sa", "sb"))
    close = (
        candidates.join(sets.select(F.col("rep").alias("a"), F.col("set_id").alias("sa")), "a")
        .join(sets.select(F.col("rep").alias("b"), F.col("set_id").alias("sb")), "b")
        .where((both >= least) & (both / (F.size("sa") + F.size("sb") - both) >= F.lit(share)))
        .select("a", "b")
    )
    same = classes.where("has_train and has_eval").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    return Links(members.join(classes.select("set_id", "rep"), "set_id").select("rep", "idx", "train"), close.unionByName(same))


def cross_split_pairs(samples: DataFrame) -> DataFrame:
    """(eval_idx, train_idx), one row per overlapping pair of distinct idx, by question or by tests."""
    return question_links(samples).pairs().unionByName(test_links(samples).pairs()).where("eval_idx <> train_idx").distinct()


def overlap_found(samples: DataFrame) -> DataFrame:
    return cross_split_pairs(samples).select(
        F.least("eval_idx", "train_idx").alias("idx_a"), F.greatest("eval_idx", "train_idx").alias("idx_b")
    ).distinct()


def overlap_report(samples: DataFrame) -> DataFrame:
    """(split, source, n_rows, n_overlapping, n_pairs) of the evaluation rows; ``source`` null is a source of its own.

    Pairs are counted by multiplying class sizes: rows of the same question class and the same class
    of tests are one kind, and each linked pair of kinds counts its train rows once.
    """
    rows = (
        samples.where(F.col("idx").isNotNull() & F.col("split").isin("train", *EVALUATION))
        .groupBy("idx").agg(F.max_by(F.struct("split", "source"), F.struct(F.coalesce(F.col("loaded_at").cast("long"), F.lit(0)), "split", "source")).alias("r"))
        .select("idx", "r.split", "r.source")
    )
    questions, tests = question_links(samples), test_links(samples)
    kinds = materialise(
        rows.join(questions.members.select("idx", F.col("rep").alias("q")), "idx", "left")
        .join(tests.members.select("idx", F.col("rep").alias("t")), "idx", "left")
        .groupBy("split", "source", "q", "t").agg(F.count("*").alias("n"))
    )
    trained = materialise(kinds.where("split = 'train'").groupBy("q", "t").agg(F.sum("n").alias("n_train")))
    asked = materialise(kinds.where("split <> 'train'").select("q", "t").distinct())

    def linked(links: DataFrame, by: str) -> DataFrame:
        left = asked.select(F.col("q").alias("eq"), F.col("t").alias("et"), F.col(by).alias("a"))
        right = trained.select(F.col("q").alias("tq"), F.col("t").alias("tt"), F.col(by).alias("b"))
        return left.join(links.distinct(), "a").join(right, "b").select("eq", "et", "tq", "tt")

    met = linked(questions.links, "q").unionByName(linked(tests.links, "t")).distinct()
    sums = (
        met.join(trained, met["tq"].eqNullSafe(trained["q"]) & met["tt"].eqNullSafe(trained["t"]))
        .groupBy("eq", "et").agg(F.sum("n_train").alias("pairs"))
    )
    evaluated = kinds.where("split <> 'train'")
    return (
        evaluated.join(sums, evaluated["q"].eqNullSafe(sums["eq"]) & evaluated["t"].eqNullSafe(sums["et"]), "left")
        .groupBy("split", "source")
        .agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("pairs") > 0, F.col("n"))), F.lit(0)).alias("n_overlapping"), F.coalesce(F.sum(F.col("n") * F.col("pairs")), F.lit(0)).alias("n_pairs"))
    )
