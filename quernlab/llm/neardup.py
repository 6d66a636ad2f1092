"""Problem 5: groups of records that share most of their content, by a token-group matrix.

Records are sets of word shingles. One global order puts frequent shingles last, so two sets of
similarity t share at least L of the |S| - ceil(t |S|) + L first shingles of each. The matrix holds,
for every group of similar sets, the union of those prefixes; the number of a query's prefix shingles
in a group's column bounds its overlap with every member: beyond them, two sets share at most what lies
behind the prefix. Shingles that are in one set only are left out of it, and sets with too few others:
a counter of fixed size shows some of them, what it leaves is counted exactly by a shuffle of packed
blocks. Only groups whose bound reaches the overlap that similarity t asks of sets of such
sizes are opened, and their members compared exactly. Nothing is capped: the order and the groups only
decide how much work the exact answer takes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlab.functions.sketch import TokenHasher, mix64, set_ids, shingle_batch
from quernlab.llm.arrow import long_lists, sliced
from quernlab.operators.components import connected_components
from quernlab.operators.skew import spread_join
from quernlab.session import discard, materialise

SHINGLE, SIMILARITY = 3, 0.6
#: Common prefix shingles asked for (L); sets with a smaller needed overlap ask for that.
NEEDED = 3
#: 2**22 counters of 4 bytes estimate how frequent a shingle is; this array, of fixed size, is what gets broadcast.
COUNTER_BITS = 22
_BLOCK = 16
#: Prefix shingles that a task packs at a time.
PACKED = 2_000_000
#: A shingle that a task packs so often at a time is known to be in several sets and not sent to one place.
HOT = 256
#: The matrix is met by slices of the shingles, and its bounds summed by slices of the sets, of about so many prefix
#: shingles, so that the shuffle files of only one are there at a time; and at most so many slices.
SLICE, SLICES = 400_000, 8
#: Groups of more sets than this are split by a hash.
GROUP_SIZE = 64


def _text(pairs: DataFrame) -> DataFrame:
    return pairs.where("idx is not null").select(
        "idx", F.concat(F.coalesce("instruction", F.lit("")), F.lit(" "), F.coalesce("output", F.lit(""))).alias("text")
    )


def _slots(values: np.ndarray, bits: int) -> np.ndarray:
    return (values.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _packed(values: np.ndarray) -> bytes:
    """The array compressed, behind its size."""
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), dtype)


_READ = "idx long, set_id binary, block int, counts binary"


def _read(size: int, bits: int):
    """A row (idx, set_id) per text with shingles, and at a task's end its counters in rows (block, counts)."""

    def run(batches):
        hasher, counts = TokenHasher(), np.zeros(1 << bits, np.int32)
        for batch in sliced(batches):
            values, offsets = shingle_batch(batch.column("text").to_pylist(), size, hasher)
            np.add.at(counts, _slots(values, bits), 1)
            filled = pa.array(np.diff(offsets) > 0)
            ids = pa.array(set_ids(values, offsets), pa.binary()).filter(filled)
            yield pa.RecordBatch.from_arrays([batch.column("idx").filter(filled), ids, pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())], names=["idx", "set_id", "block", "counts"])
        for block, part in enumerate(np.split(counts, 1 << (bits - _BLOCK))):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([block], pa.int32()), pa.array([_packed(part)], pa.binary())], names=["idx", "set_id", "block", "counts"])

    return run


def _sum_blocks(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            part = _unpacked(counts, np.int32)
            total[block] = total[block] + part if block in total else part
    for block, counts in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_packed(counts)], pa.binary())], names=["block", "counts"])


def shingle_counters(read: DataFrame, bits: int = COUNTER_BITS) -> np.ndarray:
    """How often the shingles of each hash slot occur in all texts: one array of 2**bits counters."""
    parts = read.where("block is not null").select("block", "counts")
    blocks = parts.repartition(min(32, 1 << (bits - _BLOCK)), "block").mapInArrow(_sum_blocks, "block int, counts binary")
    total = np.zeros(1 << bits, np.int32)
    for row in blocks.toLocalIterator():  # 2**(bits - 16) rows of 256 KB
        total[row["block"] << _BLOCK : (row["block"] + 1) << _BLOCK] = _unpacked(row["counts"], np.int32)
    return total


_HEADS = "rep long, n int, key long"
#: Heads of sets, and blocks of (shingle, rep): ``kind`` says what is known of the shingles.
_ALONE, _KNOWN, _MARK = 0, 1, 2
_BLOCKS = f"{_HEADS}, bucket int, kind int, tokens binary, reps binary"


def _table(schema: str, **columns) -> pa.RecordBatch:
    """A batch of the schema; columns that aren't given are null."""
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    rows = len(next(iter(columns.values())))
    named = [field.split() for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[name], types[kind]) if name in columns else pa.nulls(rows, types[kind]) for name, kind in named], names=[name for name, _ in named])


def _six(tokens: np.ndarray) -> bytes:
    """The low six bytes of each; shingles that agree in them pass for one, which only raises bounds."""
    return np.ascontiguousarray(tokens).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _of_six(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view(np.int64)


def _cut(kind: int, at: np.ndarray, tokens: np.ndarray, reps: np.ndarray | None):
    """The shingles as one block per bucket, ``at``."""
    order = np.argsort(at, kind="stable")
    buckets, starts = np.unique(at[order], return_index=True)
    if len(buckets):
        tokens, ends = tokens[order], [*starts[1:], len(order)]
        reps = reps[order] if reps is not None else None
        kept = [None if reps is None else _packed(np.diff(reps[i:j], prepend=0)) for i, j in zip(starts, ends)]
        yield _table(_BLOCKS, bucket=buckets, kind=np.full(len(buckets), kind), tokens=[_six(tokens[i:j]) for i, j in zip(starts, ends)], reps=kept)


def _blocks(tokens: np.ndarray, reps: np.ndarray, buckets: int):
    """Shingles go to the bucket of their hash; hot ones to those of their sets, with a mark at their own."""
    own = lambda x: ((x.view(np.uint64) >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
    values, counts = np.unique(tokens, return_counts=True)
    hot = values[counts >= HOT]
    known = np.isin(tokens, hot) if len(hot) else np.zeros(len(tokens), bool)
    yield from _cut(_ALONE, own(tokens[~known]), tokens[~known], reps[~known])
    yield from _cut(_KNOWN, own(mix64(reps[known].view(np.uint64))), tokens[known], reps[known])
    yield from _cut(_MARK, own(hot), hot, None)


def _prefixes(size: int, similarity: float, needed: int, bits: int, counters, buckets: int):
    """A row (rep, n, key) per set, and its prefix shingles in blocks."""

    def run(batches):
        hasher, counts = TokenHasher(), counters.value
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in sliced(batches):
            values, offsets = shingle_batch(batch.column("text").to_pylist(), size, hasher)
            n = np.diff(offsets)
            doc = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((values, counts[_slots(values, bits)], doc))
            values, at = values[order], np.arange(len(values)) - np.repeat(offsets[:-1], n)
            overlap = np.ceil(similarity * n - 1e-9).astype(np.int64)
            length = n - overlap + np.minimum(needed, overlap)
            values = values[at < np.repeat(length, n)]
            keys, reps = np.zeros(len(n), np.int64), batch.column("rep").to_numpy()
            if len(values):
                filled = length > 0
                starts = np.concatenate([[0], np.cumsum(length)])[:-1][filled]
                keys[filled] = np.minimum.reduceat(mix64(values.view(np.uint64)), starts).view(np.int64)
                # A shingle whose counter stands at one is in this set only; it can't link anything and ends here.
                twice = counts[_slots(values, bits)] > 1
                waiting.append((values[twice], np.repeat(reps, length)[twice]))
            filled = n > 0
            yield _table(_BLOCKS, rep=reps[filled], n=n[filled], key=keys[filled], bucket=((reps[filled].view(np.uint64) % np.uint64(buckets)).astype(np.int64)))
            if sum(len(v) for v, _ in waiting) >= PACKED:
                yield from _blocks(*map(np.concatenate, zip(*waiting)), buckets)
                waiting = []
        if waiting:
            yield from _blocks(*map(np.concatenate, zip(*waiting)), buckets)

    return run


def _linking(batches):
    """The heads, and a row (rep, token) per prefix shingle that is in more sets than one."""
    schema = f"{_HEADS}, token long"
    alone, marked = [], [np.zeros(0, np.int64)]
    for batch in batches:
        heads = batch.filter(pa.compute.is_null(batch.column("kind")))
        if heads.num_rows:
            yield _table(schema, rep=heads.column("rep"), n=heads.column("n"), key=heads.column("key"))
        blocks = batch.filter(pa.compute.is_valid(batch.column("kind")))
        for kind, tokens, reps in zip(*(blocks.column(c).to_pylist() for c in ("kind", "tokens", "reps"))):
            tokens = _of_six(tokens)
            if kind == _MARK:
                marked.append(tokens)
                continue
            reps = np.cumsum(_unpacked(reps, np.int64))
            if kind == _KNOWN:
                yield _table(schema, rep=reps, token=tokens)
            else:
                alone.append((tokens, reps))
    if alone:
        tokens, reps = map(np.concatenate, zip(*alone))
        order = np.argsort(tokens, kind="stable")
        tokens, reps = tokens[order], reps[order]
        same = tokens[1:] == tokens[:-1]
        several = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | np.isin(tokens, np.concatenate(marked))
        tokens, reps = tokens[several], reps[several]
        for at in range(0, len(tokens), 100_000):
            yield _table(schema, rep=reps[at : at + 100_000], token=tokens[at : at + 100_000])


def _grams(size: int):
    def run(batches):
        hasher = TokenHasher()
        for batch in sliced(batches):
            values, offsets = shingle_batch(batch.column("text").to_pylist(), size, hasher)
            yield pa.RecordBatch.from_arrays([batch.column("idx"), long_lists(values, offsets)], names=["idx", "grams"])

    return run


class NearDuplicates:
    """The classes of equal shingle sets in ``pairs`` and the pairs of similar classes.

    ``members`` is (idx, rep): a class is named by its least idx. ``links`` is (a, b), a < b, the
    classes of similarity ``similarity`` or more. Texts of fewer than ``size`` tokens have no
    shingles and are in neither. An idx is expected once; rows that repeat one with another text make
    it a member of both classes.
    """

    def __init__(self, pairs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, needed: int = NEEDED, bits: int = COUNTER_BITS):
        texts = _text(pairs)
        read = materialise(texts.mapInArrow(_read(size, bits), _READ))
        sets = read.where("block is null").select("idx", "set_id").distinct()
        classes = sets.groupBy("set_id").agg(F.min("idx").alias("rep"))
        self.members = materialise(sets.join(classes, "set_id").select("idx", "rep"))
        reps = self.members.where("idx = rep").select("rep").distinct()
        counters = pairs.sparkSession.sparkContext.broadcast(shingle_counters(read, bits))
        discard(read)
        own = texts.join(reps.select(F.col("rep").alias("idx")), "idx", "left_semi").select(F.col("idx").alias("rep"), "text")
        spark = pairs.sparkSession
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        blocks = own.mapInArrow(_prefixes(size, similarity, needed, bits, counters, buckets), _BLOCKS)
        linking = materialise(blocks.repartitionById(buckets, F.col("bucket")).mapInArrow(_linking, f"{_HEADS}, token long"))
        # The partners of n shingles have t n at least, and share so many of the prefixes as the smaller set asks for.
        least = F.least(F.lit(needed), F.ceil(similarity * F.ceil(similarity * F.col("n") - 1e-9) - 1e-9))
        prefixes = linking.where("token is not null").groupBy("rep").agg(F.collect_list("token").alias("prefix"))
        prefixed = materialise(linking.where("token is null").select("rep", "n", "key").join(prefixes, "rep").where(F.size("prefix") >= least))
        discard(linking)
        self.links = self._links(texts, prefixed, similarity, size, needed)

    def _links(self, texts: DataFrame, prefixed: DataFrame, similarity: float, size: int, needed: int) -> DataFrame:
        hot = prefixed.groupBy("key").count().where(F.col("count") > GROUP_SIZE).select("key", F.ceil(F.col("count") / GROUP_SIZE).alias("parts"))
        grouped = materialise(
            prefixed.join(hot, "key", "left")
            .withColumn("grp", F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.pmod(F.xxhash64("rep"), "parts"))))
            .select("grp", "rep", "n", "prefix")
        )
        discard(prefixed)
        groups = grouped.select("grp", "rep", "n")
        shared = grouped.select(F.explode("prefix").alias("token"), "rep", "grp", "n")
        rows = grouped.agg(F.sum(F.size("prefix"))).first()[0] or 0
        slices = max(1, min(SLICES, -(-rows // SLICE)))
        sliced_by = lambda df, by, k: df.where(F.pmod(F.hash(by), F.lit(slices)) == k)
        t = F.lit(similarity)
        # Sets of n and m shingles need the overlap t / (1 + t) (n + m). What they share beyond the
        # ``bound`` common prefix shingles lies behind the prefix of one of them, ``rest`` at most.
        needs = lambda n, m: t / (1 + t) * (n + m)
        overlap = lambda n: F.ceil(t * n - 1e-9)
        rest = lambda n: overlap(n) - F.least(F.lit(needed), overlap(n))
        # Of the sizes m that a group has and that can be similar, the least for m up to n is at the
        # smallest; beyond n, needs(n, m) - rest(m) falls with m but for rounding, so it is at the largest.
        low, high = F.greatest(F.col("g_low"), overlap(F.col("n"))), F.least(F.col("g_high"), F.floor(F.col("n") / t + 1e-9))
        below = F.when(low <= F.col("n"), needs(F.col("n"), low) - rest(F.col("n")))
        above = F.when(high > F.col("n"), needs(F.col("n"), high) - (t * high + 1) + F.least(F.lit(needed), overlap(high)))

        def met(k: int) -> DataFrame:
            some = sliced_by(shared, "token", k)
            matrix = some.groupBy("token", F.col("grp").alias("opened")).agg(F.min("n").alias("g_min"), F.max("n").alias("g_max"), F.max("rep").alias("g_last"))
            return (
                spread_join(some.select("token", "rep", "n"), matrix, "token")
                .where((F.col("rep") < F.col("g_last")) & (F.col("g_max") >= t * F.col("n") - 1e-9) & (t * F.col("g_min") <= F.col("n") + 1e-9))
                .select("rep", "opened", "n", "g_min", "g_max")
            )

        def bounded(rows: DataFrame) -> DataFrame:
            return (
                rows.groupBy("rep", "opened")
                .agg(F.count("*").alias("bound"), F.first("n").alias("n"), F.min("g_min").alias("g_low"), F.max("g_max").alias("g_high"))
                .where((low <= high) & (F.col("bound") >= F.least(below, above) - 1e-6))
            )

        meetings = [materialise(met(k)) for k in range(slices)]
        every = reduce(DataFrame.unionByName, meetings)
        opening = [materialise(bounded(sliced_by(every, "rep", k))) for k in range(slices)]
        qualified = reduce(DataFrame.unionByName, opening)
        for part in meetings:
            discard(part)
        candidates = materialise(
            spread_join(qualified, groups.select(F.col("grp").alias("opened"), F.col("rep").alias("b"), F.col("n").alias("m")), "opened")
            .where((F.col("rep") < F.col("b")) & (F.col("m") >= t * F.col("n") - 1e-9) & (F.col("n") >= t * F.col("m") - 1e-9))
            .where(F.col("bound") >= needs(F.col("n"), F.col("m")) - F.greatest(rest(F.col("n")), rest(F.col("m"))) - 1e-6)
            .select(F.col("rep").alias("a"), "b").distinct()
        )
        for part in (*opening, grouped):
            discard(part)
        wanted = candidates.select(F.col("a").alias("idx")).unionByName(candidates.select(F.col("b").alias("idx"))).distinct()
        grams = materialise(texts.join(wanted, "idx", "left_semi").mapInArrow(_grams(size), "idx long, grams array<long>"))
        both = F.size(F.array_intersect("ga", "gb"))
        links = materialise(
            candidates.join(grams.select(F.col("idx").alias("a"), F.col("grams").alias("ga")), "a")
            .join(grams.select(F.col("idx").alias("b"), F.col("grams").alias("gb")), "b")
            .where(both / (F.size("ga") + F.size("gb") - both) >= t)
            .select("a", "b").distinct()
        )
        discard(candidates)
        discard(grams)
        return links

    def pairs(self) -> DataFrame:
        """(idx_a, idx_b), idx_a < idx_b: every pair of similar rows, copies included."""
        left = self.members.select(F.col("rep").alias("a"), F.col("idx").alias("x"))
        right = self.members.select(F.col("rep").alias("b"), F.col("idx").alias("y"))
        across = self.links.join(left, "a").join(right, "b").select("x", "y")
        within = left.join(right, F.col("a") == F.col("b")).where("x < y").select("x", "y")
        return across.unionByName(within).where("x <> y").select(F.least("x", "y").alias("idx_a"), F.greatest("x", "y").alias("idx_b")).distinct()

    def groups(self) -> DataFrame:
        """(idx, group_id, n_links): one row per row that is similar to another, with the least idx
        it is connected to and the number of rows it is similar to; copies aren't expanded to pairs."""
        sizes = self.members.groupBy("rep").agg(F.count("*").alias("own"))
        both = self.links.unionByName(self.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        others = both.join(sizes.select(F.col("rep").alias("b"), F.col("own").alias("size")), "b").groupBy("a").agg(F.sum("size").alias("others"))
        component = connected_components(self.links)
        return (
            self.members.join(sizes, "rep")
            .join(others.withColumnRenamed("a", "rep"), "rep", "left")
            .join(component.withColumnRenamed("id", "rep"), "rep", "left")
            .select("idx", F.coalesce("component", "rep").alias("group_id"), (F.col("own") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
            .where("n_links > 0")
        )


def near_duplicates_found(pairs: DataFrame) -> DataFrame:
    return NearDuplicates(pairs).pairs()


def near_duplicate_groups(pairs: DataFrame) -> DataFrame:
    return NearDuplicates(pairs).groups()
