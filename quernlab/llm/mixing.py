"""Problem 7: drawing texts per source towards target shares of the total size.

Capped water-filling gives each source its share of the wanted size, clamps those that would need
more than their allowed repeats, and hands the excess to the others in proportion to their weights,
again and again until nothing is clamped. Each source is then drawn in whole repetitions, and one
more time for the texts that come first in a seeded order until the rest of its share is used up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernlab.llm.encode import TOKENIZER, corpus_sizes
from quernlab.session import materialise

#: The seeded order of a source is cut into 2**PART_BITS parts, and into more where these would have more than PART_TEXTS
#: texts on average; only the part where the share ends is sorted.
PART_BITS, PART_TEXTS = 12, 50_000
#: Sources that the targets may name; their totals are handled on the driver.
SOURCE_LIMIT = 100_000


def water_fill(sizes: dict, weights: dict, caps: dict, total: float) -> dict:
    """The size to draw of each source: proportional to ``weights``, at most size * cap.

    Sources of no size or weight get 0. Where all caps together are less than ``total``, each source
    gets its cap.
    """
    most = {s: sizes.get(s, 0) * max(0, caps[s] or 0) for s in weights}
    active = {s for s in weights if most[s] > 0 and (weights[s] or 0) > 0}
    drawn, left = dict.fromkeys(weights, 0.0), float(total)
    while active and left > 0:
        scale = left / sum(weights[s] for s in active)
        over = {s for s in active if weights[s] * scale >= most[s]}
        if not over:
            drawn |= {s: weights[s] * scale for s in active}
            break
        drawn |= {s: float(most[s]) for s in over}
        left -= sum(most[s] for s in over)
        active -= over
    return drawn


class Mixture:
    """A draw of ``documents`` towards ``targets`` (source, weight, max_repeats).

    ``total`` is the size to draw in tokens; the default is the size of all texts of the targeted
    sources. Texts whose source is null or has no target are not drawn. Texts of no token have no
    size and are repeated like the others of their source. A target without texts, weight or repeats
    draws nothing; a source targeted twice is an error.
    A repeated doc_id is one text, of its largest size and least source; null ones are not drawn.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42, tokenizer: str = TOKENIZER):
        spark = documents.sparkSession
        rows = targets.where("source is not null").select("source", "weight", "max_repeats").limit(SOURCE_LIMIT + 1).collect()
        if len(rows) > SOURCE_LIMIT or len({r["source"] for r in rows}) < len(rows):
            raise ValueError("targets must name at most %d sources, each once" % SOURCE_LIMIT)
        sized = corpus_sizes(documents, tokenizer).groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
        sources = documents.where("doc_id is not null and source is not null").groupBy("doc_id").agg(F.min("source").alias("source"))
        self.texts = materialise(
            sources.join(sized, "doc_id").join(F.broadcast(targets.select("source")), "source", "left_semi")
            .select("doc_id", "source", "n_tokens", F.xxhash64(F.lit(seed), "source", "doc_id").alias("at"))
        )
        totals = self.texts.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("n")).collect()
        sums = {r["source"]: r["size"] or 0 for r in totals}
        most = max((r["n"] for r in totals), default=0)
        self.bits = max(PART_BITS, (most // PART_TEXTS).bit_length())
        weights = {r["source"]: r["weight"] for r in rows}
        caps = {r["source"]: r["max_repeats"] for r in rows}
        drawn = water_fill(sums, weights, caps, sum(sums.values()) if total is None else total)
        plan = []
        for source, wanted in drawn.items():
            size = sums.get(source, 0)
            whole = min(int(wanted // size), caps[source]) if size else 0
            rest = int(round(wanted - whole * size)) if size and whole < caps[source] else 0
            plan.append((source, weights[source], caps[source], size, float(wanted), whole, rest))
        self.plan = spark.createDataFrame(
            sorted(plan), "source string, weight double, max_repeats int, available_tokens long, allotted double, whole int, rest long"
        )

    def draw(self) -> DataFrame:
        """(doc_id, source, n_tokens, repeats) of the drawn texts."""
        part = F.shiftrightunsigned("at", 64 - self.bits)
        texts = self.texts.withColumn("part", part)
        before = (
            texts.groupBy("source", "part").agg(F.sum("n_tokens").alias("size"))
            .withColumn("end", F.sum("size").over(Window.partitionBy("source").orderBy("part")))
            .select("source", "part", (F.col("end") - F.col("size")).alias("start"), "end")
        )
        planned = texts.join(F.broadcast(self.plan.select("source", "whole", "rest")), "source")
        placed = planned.join(before, ["source", "part"])
        # Whole parts are in or out; the texts of the part in which the share ends are put in order.
        cut = placed.where("start < rest and end > rest").withColumn(
            "upto", F.col("start") + F.sum("n_tokens").over(Window.partitionBy("source").orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
        )
        extra = cut.select("doc_id", "source", "n_tokens", "whole", (F.col("upto") <= F.col("rest")).cast("int").alias("once"))
        rest = placed.where("not (start < rest and end > rest)").select(
            "doc_id", "source", "n_tokens", "whole", ((F.col("end") <= F.col("rest")) & (F.col("rest") > 0)).cast("int").alias("once")
        )
        return (
            extra.unionByName(rest)
            .select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("once")).alias("repeats"))
            .where("repeats > 0")
        )

    def shares(self) -> DataFrame:
        """One row per target: its weight, what there was, what was drawn, and its actual share."""
        drawn = self.draw().groupBy("source").agg(
            F.sum(F.col("n_tokens") * F.col("repeats")).alias("drawn_tokens"), F.count("*").alias("drawn_texts"), F.max("repeats").alias("most_repeats")
        )
        rows = self.plan.join(drawn, "source", "left")
        tokens = F.coalesce("drawn_tokens", F.lit(0))
        every = Window.partitionBy()
        return rows.select(
            "source", "weight", "max_repeats", "available_tokens", tokens.alias("drawn_tokens"), F.coalesce("drawn_texts", F.lit(0)).alias("drawn_texts"),
            F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.when(F.sum(tokens).over(every) > 0, tokens / F.sum(tokens).over(every)).alias("actual_share"),
        )
