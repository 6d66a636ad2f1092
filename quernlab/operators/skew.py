"""Joins whose keys may be hot: a third of all rows may have one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this is cut into parts of about so many.
PART = 50_000
#: At most so many keys are cut; only these, with their numbers of parts, are broadcast.
HOT_KEYS = 10_000


#: Rows of a key, on average, in the sample that finds hot keys.
SAMPLED = 1_000


def hot_keys(rows: DataFrame, keys: list[str], part: int = PART) -> DataFrame:
    """(keys, _parts) of the keys with too many rows for one task.

    A key is hot from ``part`` rows on, and from a share of 1 in HOT_KEYS of all rows, so there are
    at most HOT_KEYS of them whatever the size of the table. They are counted on a sample in which a
    key of ``part`` rows has about SAMPLED; that one key more or less is cut changes no result.
    """
    fraction = min(1.0, SAMPLED / part)
    some = rows if fraction == 1.0 else rows.sample(fraction, 42)
    counts = some.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = some.agg(F.count("*").alias("_total"))
    least = F.greatest(F.lit(part * fraction), F.col("_total") / HOT_KEYS)
    return counts.join(F.broadcast(total)).where(F.col("_n") > least).select(*keys, F.ceil(F.col("_n") / least).cast("int").alias("_parts"))


def spread_join(many: DataFrame, one: DataFrame, on: str | list[str], how: str = "inner", part: int = PART) -> DataFrame:
    """``many`` joined to ``one`` (inner or left) with hot keys of ``many`` in parts.

    The rows of a hot key are dealt to parts by a hash of their values, and the rows of ``one`` with
    that key are copied to each part. Rows with a null key match nothing. ``many`` is read twice.
    """
    keys = [on] if isinstance(on, str) else on
    hot = hot_keys(many.select(*keys), keys, part)
    dealt = many.join(F.broadcast(hot), keys, "left").withColumn(
        "_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*many.columns), F.col("_parts"))).cast("int")
    )
    copied = one.join(F.broadcast(hot), keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    return dealt.drop("_parts").join(copied.drop("_parts"), [*keys, "_part"], how).drop("_part")
