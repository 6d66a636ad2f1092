"""Problem 3: filling containers of fixed capacity with items of varying length.

The configuration linear program has a variable per way of filling a container and a row per length:
the configurations must cover the histogram of lengths with as few containers as possible. It is
solved by multiplicative weights in phases. A phase prices every length (its dual guess: the length
itself, times a weight that falls exponentially with the part of its demand already covered) and
solves the knapsack over the whole capacity by dynamic programming; this one table gives the best
configuration with each length in it, and the phase raises those, and prices anew what is left, until
every length is covered by a step further. The variables are rounded so that their running sum
is met, configurations that lack items are filled up by an exact subset sum, and what remains is packed
by the same subset sum around the longest item left.

Only the histogram, which the capacity bounds, leaves the executors, whatever the number of items; the
solver's work depends on the lengths and not on how many items have them. Items get their rank within
their length by counts per hash bucket, so a length that a third of all items have is no hot group,
and a rank determines container and place by a search in the plan. Capacities above GRID are measured
in cells of several units, lengths rounded up to whole cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernlab.session import materialise

#: A phase covers at most this part of a length's demand.
STEP = 0.2
#: How fast the price of a length falls with the part of its demand that is covered.
DECAY = 0.5
#: A configuration is raised if its value is at least this part of the best one's.
NEAR_BEST = 0.99
#: A rounded configuration that lacks items is filled up if that leaves at most this part of the capacity.
FILLED = 0.002
#: How often containers are packed anew at the end, a few at a time.
SQUEEZES = 400
#: Items of one length in a hash bucket, about.
BUCKET_ITEMS = 20_000
#: Cells of a capacity: the size of the dynamic program, and a bound of the histogram.
GRID = 1 << 14


def knapsack(capacity: int, lengths: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best, choice): for every capacity up to ``capacity`` the value of the most valuable multiset of the lengths, and a length's position to start it with, -1 for nothing.

    The lengths ascend.
    """
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(int(lengths[0]), capacity + 1):
        n = fits[c]
        found = best[c - lengths[:n]] + values[:n]
        at = int(found.argmax())
        if found[at] > best[c - 1]:
            best[c], choice[c] = found[at], at
        else:
            best[c], choice[c] = best[c - 1], -2  # a unit stays free
    return best, choice


class Sums:
    """Which sums up to the capacity the items at hand have, as the bits of whole numbers: a bounded subset sum."""

    def __init__(self, capacity: int, lengths: np.ndarray, left: np.ndarray):
        self.mask, self.parts, self.bits = (1 << (capacity + 1)) - 1, [], [1]
        bits = 1
        for i in np.flatnonzero(left).tolist():  # ascending, so the longest are taken first below
            length, count, size = int(lengths[i]), min(int(left[i]), capacity // int(lengths[i])), 1
            while count > 0:
                size = min(size, count)
                bits |= (bits << (size * length)) & self.mask
                self.parts.append((i, size, size * length))
                self.bits.append(bits)
                count -= size
                size *= 2

    def fill(self, room: int) -> dict[int, int]:
        """{position: times} of the items that fill ``room`` best, long ones first."""
        at = (self.bits[-1] & ((1 << (room + 1)) - 1)).bit_length() - 1
        chosen: dict[int, int] = {}
        for (i, size, weight), before in zip(reversed(self.parts), reversed(self.bits[:-1])):
            if at == 0:
                break
            if weight <= at and (before >> (at - weight)) & 1:
                chosen[i] = chosen.get(i, 0) + size
                at -= weight
        return chosen


def fractional(capacity: int, lengths: np.ndarray, demand: np.ndarray, step: float = STEP, decay: float = DECAY, near: float = NEAR_BEST) -> dict[tuple, float]:
    """{((position, times), ...): containers}: a solution of the configuration linear program."""
    solution: dict[tuple, float] = {}
    need, covered = demand.astype(float), np.zeros(len(lengths))
    least = 1e-3 * step
    while (covered < 1 - least).any():
        open_ = np.flatnonzero(covered < 1 - least)
        own, before = lengths[open_], covered[open_]
        room = np.minimum(step, 1 - before)  # what this phase may cover of each
        values = own * np.exp(-decay * (before - before.min()))
        best, choice = knapsack(capacity, own, values)
        fits = np.searchsorted(own, np.arange(capacity + 1), "right")
        most = np.maximum(1, np.ceil(need[open_] * (1 - before))).astype(np.int64)
        enough, raised = near * best[capacity], False
        offered = values.copy()  # minus infinity for what the phase has covered as far as it may
        for l in np.argsort(-values - best[capacity - own], kind="stable").tolist():
            if values[l] + best[capacity - own[l]] < enough:
                break
            while room[l] > least:
                config, free, worth = {l: 1}, capacity - int(own[l]), values[l]
                if most[l] == 1:
                    offered[l] = -np.inf
                while free >= own[0]:
                    at = int(choice[free])
                    if at == -2:
                        free -= 1
                        continue
                    if offered[at] < 0:
                        found = best[free - own[: fits[free]]] + offered[: fits[free]]
                        at = int(found.argmax())
                        if found[at] < 0 or (raised and worth + found[at] < enough):
                            break
                    config[at] = config.get(at, 0) + 1
                    if config[at] >= most[at]:
                        offered[at] = -np.inf
                    worth += values[at]
                    free -= int(own[at])
                rows, times = np.array(list(config)), np.array(list(config.values()), float)
                kept = not raised or worth >= enough
                if kept:
                    amount = float((room[rows] * need[open_[rows]] / times).min())
                    share = amount * times / need[open_[rows]]
                    room[rows] -= share
                    covered[open_[rows]] += share
                    key = tuple(sorted((int(open_[r]), int(t)) for r, t in zip(rows, times)))
                    solution[key] = solution.get(key, 0.0) + amount
                    raised = True
                offered[rows] = np.where(room[rows] > least, values[rows], -np.inf)
                if not kept:
                    break
    return solution


def _around(capacity: int, lengths: np.ndarray, left: np.ndarray) -> tuple[int, dict[int, int]]:
    """(copies, {position: times}): the longest item left and what fills its container best, as often as there are items for it."""
    longest = int(np.flatnonzero(left)[-1])
    room = capacity - int(lengths[longest])
    rest = np.where(lengths <= room, left, 0)
    rest[longest] -= rest[longest] > 0
    config = Sums(capacity, lengths, rest).fill(room)
    config[longest] = config.get(longest, 0) + 1
    return min(int(left[i]) // t for i, t in config.items()), config


def _squeezed(capacity: int, packed: list[tuple[int, dict[int, int]]], tries: int = SQUEEZES, few: int = 8) -> list[tuple[int, dict[int, int]]]:
    """The containers with their free space drawn together: a few at a time are packed anew, and kept so if that needs fewer or gathers the space."""
    single = [config for copies, config in packed if copies == 1]
    whole = [(copies, config) for copies, config in packed if copies != 1]
    fill = lambda config: sum(length * times for length, times in config.items())
    rng = np.random.default_rng(42)
    for _ in range(tries):
        if len(single) < 2 or len(single) * capacity - sum(map(fill, single)) < capacity:
            break  # no container can be saved among these
        single.sort(key=fill)
        some = {0, *rng.integers(1, len(single), min(few, len(single)) - 1).tolist()}
        old = [single[i] for i in some]
        items: dict[int, int] = {}
        for config in old:
            for length, times in config.items():
                items[length] = items.get(length, 0) + times
        lengths = np.array(sorted(items), np.int64)
        left = np.array([items[n] for n in lengths.tolist()], np.int64)
        new = []
        while left.any():
            copies, config = _around(capacity, lengths, left)
            for i, t in config.items():
                left[i] -= copies * t
            new += [{int(lengths[i]): int(t) for i, t in config.items()}] * copies
        if len(new) < len(old) or (len(new) == len(old) and sum(fill(c) ** 2 for c in new) > sum(fill(c) ** 2 for c in old)):
            single = [c for i, c in enumerate(single) if i not in some] + new
    return whole + [(1, config) for config in single]


def solve(capacity: int, lengths: np.ndarray, demand: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """[(copies, {length: times})]: containers that hold exactly ``demand`` items of each of ``lengths``.

    Lengths are positive, distinct and at most ``capacity``.
    """
    order = np.argsort(lengths)
    lengths, left = lengths[order].astype(np.int64), demand[order].astype(np.int64)
    packed: list[tuple[int, dict[int, int]]] = []
    if not left.any():
        return packed

    def put(copies: int, config: dict[int, int]) -> None:
        for i, t in config.items():
            left[i] -= copies * t
        packed.append((copies, {int(lengths[i]): int(t) for i, t in config.items()}))

    # Rounding, the configurations of the longest items first: running sums are met.
    solution = sorted(fractional(capacity, lengths, left).items(), key=lambda x: tuple(reversed(x[0])), reverse=True)
    running, given, short = 0.0, 0, []
    for key, amount in solution:
        running += amount
        copies = int(running + 0.5) - given
        given += copies
        whole = min(copies, *(int(left[i]) // t for i, t in key))
        if whole > 0:
            put(whole, dict(key))
        if copies > max(whole, 0):
            short.append((copies - max(whole, 0), key))
    # Those that lack items are filled up, or left to the rest.
    for copies, key in short:
        for _ in range(copies):
            config = {i: min(t, int(left[i])) for i, t in key if left[i]}
            if not config:
                break
            room = capacity - sum(int(lengths[i]) * t for i, t in config.items())
            rest = left.copy()
            for i, t in config.items():
                rest[i] -= t
            for i, t in Sums(capacity, lengths, np.where(lengths <= room, rest, 0)).fill(room).items() if room else ():
                config[i] = config.get(i, 0) + t
            if capacity - sum(int(lengths[i]) * t for i, t in config.items()) > FILLED * capacity:
                break
            put(1, config)
    # The rest, around the longest item left.
    while left.any():
        put(*_around(capacity, lengths, left))
    return _squeezed(capacity, packed)

    def put(copies: int, config: dict[int, int]) -> None:
        for i, t in config.items():
            left[i] -= copies * t
        packed.append((copies, {int(lengths[i]): int(t) for i, t in config.items()}))

    # Rounding, the configurations of the longest items first: running sums are met.
    solution = sorted(fractional(capacity, lengths, left).items(), key=lambda x: tuple(reversed(x[0])), reverse=True)
    running, given, short = 0.0, 0, []
    for key, amount in solution:
        running += amount
        copies = int(running + 0.5) - given
        given += copies
        whole = min(copies, *(int(left[i]) // t for i, t in key))
        if whole > 0:
            put(whole, dict(key))
        if copies > max(whole, 0):
            short.append((copies - max(whole, 0), key))
    # Those that lack items are filled up, or left to the rest.
    for copies, key in short:
        for _ in range(copies):
            config = {i: min(t, int(left[i])) for i, t in key if left[i]}
            if not config:
                break
            room = capacity - sum(int(lengths[i]) * t for i, t in config.items())
            rest = left.copy()
            for i, t in config.items():
                rest[i] -= t
            for i, t in Sums(capacity, lengths, np.where(lengths <= room, rest, 0)).fill(room).items() if room else ():
                config[i] = config.get(i, 0) + t
            if capacity - sum(int(lengths[i]) * t for i, t in config.items()) > FILLED * capacity:
                break
            put(1, config)
    # The rest, around the longest item left.
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        room = capacity - int(lengths[longest])
        rest = left.copy()
        rest[longest] -= 1
        config = Sums(capacity, lengths, np.where(lengths <= room, rest, 0)).fill(room)
        config[longest] = config.get(longest, 0) + 1
        put(min(int(left[i]) // t for i, t in config.items()), config)
    return packed


def _plan(histogram: pd.DataFrame) -> pd.DataFrame:
    """The plan of one capacity, in cells: which ranks of a length go to which containers, and where in them."""
    capacity = int(histogram["cells"].iloc[0])
    some = histogram[histogram["cell"] > 0].sort_values("cell")
    rows, used, first = [], {}, 0
    for copies, config in solve(capacity, some["cell"].to_numpy(np.int64), some["count"].to_numpy(np.int64)) if len(some) else ():
        place = start = 0
        for cell in sorted(config, reverse=True):
            times = config[cell]
            rows.append((cell, used.get(cell, 0), times, first, place, start))
            used[cell] = used.get(cell, 0) + copies * times
            place, start = place + times, start + times * cell
        first += copies
    plan = pd.DataFrame(rows, columns=["cell", "rank", "times", "container", "place", "start"], dtype="int64")
    return plan.assign(cap_id=int(histogram["cap_id"].iloc[0]))[["cap_id", "cell", "rank", "times", "container", "place", "start"]]


def _placed(plans):
    def run(batches):
        tables = plans.value
        for batch in batches:
            cap, cell, rank = (batch.column(c).to_numpy() for c in ("cap_id", "cell", "rank"))
            out = {c: np.zeros(len(cap), np.int64) for c in ("container", "place", "start")}
            for cap_id in np.unique(cap):
                plan = tables[int(cap_id)]
                mine = np.flatnonzero((cap == cap_id) & (cell > 0))
                if len(mine):
                    # Plans are sorted by (cell, rank): the last row at or before an item's is its own.
                    at = np.searchsorted(plan["key"], (cell[mine].astype(np.int64) << 40) + rank[mine], "right") - 1
                    offset = rank[mine] - plan["rank"][at]
                    inner = offset % plan["times"][at]
                    out["container"][mine] = plan["container"][at] + offset // plan["times"][at]
                    out["place"][mine] = plan["place"][at] + inner
                    out["start"][mine] = plan["unit"] * (plan["start"][at] + inner * cell[mine])
                empty = np.flatnonzero((cap == cap_id) & (cell == 0))
                out["place"][empty] = plan["first_places"] + rank[empty]
                out["start"][empty] = plan["first_fill"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("cap_id", "idx", "piece", "n_pieces", "length")] + [pa.array(out[c]) for c in out],
                names=["cap_id", "idx", "piece", "n_pieces", "length", "container", "place", "start"],
            )

    return run


def item_lengths(pairs: DataFrame) -> DataFrame:
    """(idx, words, chars) of instruction, one blank and output; null counts as empty.

    Words are separated by Unicode white space or the separators U+001C to U+001F.
    """
    text = F.concat(F.coalesce("instruction", F.lit("")), F.lit(" "), F.coalesce("output", F.lit("")))
    return pairs.where("idx is not null").select(
        "idx",
        F.size(F.regexp_extract_all(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"), 0)).cast("long").alias("words"),
        F.length(text).cast("long").alias("chars"),
    )


class Packing:
    """Containers for the items (idx, words, chars) at each of ``capacities`` (cap_id, unit, capacity).

    ``items`` is (cap_id, idx, piece, n_pieces, length, container, place, start): an item longer than
    the capacity is cut into pieces, all but the last as long as the capacity; others are one piece.
    In a capacity above GRID items start at whole cells, so up to a cell per item may stay free between.
    Items of no length lie at the end of container 0. ``containers`` is (cap_id, container, capacity,
    n_items, fill, free). No items, no rows. Rows that repeat an idx are items of their own.
    A capacity that is null or less than 1, an unknown unit or a repeated cap_id is an error.
    """

    def __init__(self, lengths: DataFrame, capacities: DataFrame):
        spark = lengths.sparkSession
        caps = capacities.select("cap_id", "unit", "capacity").limit(1001).collect()
        if len(caps) > 1000 or len({c["cap_id"] for c in caps}) < len(caps):
            raise ValueError("capacities must have at most 1,000 rows, each of its own cap_id")
        for c in caps:
            if c["cap_id"] is None or c["unit"] not in ("words", "chars") or not 0 < (c["capacity"] or 0):
                raise ValueError(f"not a capacity: {c}")
        lengths = materialise(lengths.select("idx", "words", "chars"))
        self.capacities = spark.createDataFrame([tuple(c) for c in caps], "cap_id int, unit string, capacity int")
        full = F.greatest(F.lit(1), F.ceil(F.col("total") / F.col("capacity"))).cast("int")
        each = F.array(*[F.struct(F.lit(c["cap_id"]).alias("cap_id"), F.lit(c["unit"]).alias("unit"), F.lit(c["capacity"]).alias("capacity")) for c in caps])
        pieces = (
            lengths.select("*", F.inline(each.cast("array<struct<cap_id:int,unit:string,capacity:int>>")))
            .withColumn("total", F.when(F.col("unit") == "words", F.col("words")).otherwise(F.col("chars")))
            .withColumn("n_pieces", full)
            .select("cap_id", "capacity", "idx", "total", "n_pieces", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"))
            .select("cap_id", "capacity", "idx", "piece", "n_pieces", F.least(F.col("capacity").cast("long"), F.col("total") - F.col("piece").cast("long") * F.col("capacity")).alias("length"))
        )
        unit, cells = F.ceil(F.col("capacity") / GRID), F.floor(F.col("capacity") / F.ceil(F.col("capacity") / GRID))
        pieces = pieces.withColumn("cells", cells.cast("long")).withColumn("cell", F.least(F.ceil(F.col("length") / unit), F.col("cells")).cast("long"))
        histogram = materialise(pieces.groupBy("cap_id", "cells", "cell").agg(F.count("*").alias("count")))
        plan = materialise(
            histogram.repartition(8 * max(1, len(caps)), "cap_id").groupBy("cap_id").applyInPandas(_plan, "cap_id int, cell long, rank long, times long, container long, place long, start long")
        )
        tables = {}
        for c in caps:
            own = plan.where(F.col("cap_id") == c["cap_id"]).drop("cap_id").toPandas().sort_values(["cell", "rank"])
            key = (own["cell"].to_numpy(np.int64) << 40) + own["rank"].to_numpy(np.int64)
            first = own[own["container"] == 0]
            size = -(-c["capacity"] // GRID)
            tables[c["cap_id"]] = {"key": key, "unit": size, "first_places": int(first["times"].sum()), "first_fill": size * int((first["times"] * first["cell"]).sum())} | {
                x: own[x].to_numpy(np.int64) for x in ("rank", "times", "container", "place", "start")
            }
        plans = spark.sparkContext.broadcast(tables)

        most = histogram.agg(F.max("count")).first()[0] or 0
        buckets = max(1, -(-most // BUCKET_ITEMS))
        spread = pieces.withColumn("bucket", F.pmod(F.xxhash64("idx", "piece"), F.lit(buckets)))
        keys = ["cap_id", "cell", "bucket"]
        before = (
            spread.groupBy(*keys).agg(F.count("*").alias("n"))
            .withColumn("before", F.sum("n").over(Window.partitionBy("cap_id", "cell").orderBy("bucket")) - F.col("n"))
        )
        ranked = (
            spread.withColumn("row", F.row_number().over(Window.partitionBy(*keys).orderBy("idx", "piece")))
            .join(before.select(*keys, "before"), keys)
            .select("cap_id", "idx", "piece", "n_pieces", "length", "cell", (F.col("before") + F.col("row") - 1).alias("rank"))
        )
        self.items = ranked.mapInArrow(
            _placed(plans), "cap_id int, idx long, piece int, n_pieces int, length long, container long, place long, start long"
        )

    def containers(self) -> DataFrame:
        fills = self.items.groupBy("cap_id", "container").agg(F.count("*").alias("n_items"), F.sum("length").alias("fill"))
        return fills.join(F.broadcast(self.capacities), "cap_id").select(
            "cap_id", "container", "capacity", "n_items", "fill", (F.col("capacity") - F.col("fill")).alias("free")
        )

    def report(self) -> DataFrame:
        """(cap_id, unit, capacity, n_containers, least_containers, fill_share) per capacity."""
        sums = self.containers().groupBy("cap_id").agg(F.count("*").alias("n_containers"), F.sum("fill").alias("fill"))
        return self.capacities.join(sums, "cap_id").select(
            "cap_id", "unit", "capacity", "n_containers", F.ceil(F.col("fill") / F.col("capacity")).alias("least_containers"),
            (F.col("fill") / (F.col("n_containers") * F.col("capacity"))).alias("fill_share"),
        )


def pack(pairs: DataFrame, capacities: DataFrame) -> Packing:
    return Packing(item_lengths(pairs), capacities)
