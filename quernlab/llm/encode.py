"""Problem 6: the whole corpus as ids of a public byte-level BPE tokenizer, and back.

Documents are cut into pre-tokens, and blocks of documents keep one entry per distinct pre-token, so
a frequent word leaves each block once. The distinct words of all blocks meet in one shuffle and are
encoded once each; their ids go back to the blocks, which put their documents together by position.
A block is bounded in characters, so is every task's share, and no vocabulary of the corpus is ever
collected or broadcast.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlab.llm.arrow import sliced
from quernlab.operators.skew import spread_join
from quernlab.session import materialise

TOKENIZER = "byte_bpe_50k.tiktoken"
#: Characters of text in a block; a longer text is a block of its own.
BLOCK_CHARS = 1_000_000
#: Tokens that a vocabulary may have to be held by every worker.
VOCABULARY_LIMIT = 1 << 20


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The place of a vocabulary file; a path is returned as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(tokenizer_path(path), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if len(ranks) > VOCABULARY_LIMIT:
        raise ValueError(f"{path} has {len(ranks)} tokens, more than {VOCABULARY_LIMIT}")
    return ranks


@cache
def _pattern():
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


@cache
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


_BLOCK_SCHEMA = pa.schema([("block", pa.string()), ("doc_id", pa.int64()), ("codes", pa.list_(pa.int32())), ("code", pa.int32()), ("word", pa.string())])


def _block(name: str, ids: list, codes: list[int], lengths: list[int], words: dict[str, int]):
    """One block: a row per document with the codes of its pre-tokens, a row per distinct pre-token."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    n, m = len(ids), len(words)
    yield pa.RecordBatch.from_arrays(
        [pa.array([name] * n), pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes, pa.int32())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())],
        schema=_BLOCK_SCHEMA,
    )
    yield pa.RecordBatch.from_arrays(
        [pa.array([name] * m, pa.string()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int32())), pa.array(np.arange(m, dtype=np.int32)), pa.array(list(words), pa.string())],
        schema=_BLOCK_SCHEMA,
    )


def _blocks(limit: int):
    def run(batches):
        find, task, made = _pattern().findall, TaskContext.get().partitionId(), 0
        ids, codes, lengths, words, chars = [], [], [], {}, 0
        for batch in sliced(batches, 500):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                tokens = find(text) if text else ()
                for token in tokens:
                    codes.append(words.setdefault(token, len(words)))
                ids.append(doc_id)
                lengths.append(len(tokens))
                chars += len(text or "")
                if chars >= limit:
                    yield from _block(f"{task}-{made}", ids, codes, lengths, words)
                    made += 1
                    ids, codes, lengths, words, chars = [], [], [], {}, 0
        if ids:
            yield from _block(f"{task}-{made}", ids, codes, lengths, words)

    return run


def _encode_words(path: str):
    def run(batches):
        encode = _encoding(path)._encode_single_piece
        for batch in sliced(batches, 20_000):
            ids = [encode(word) for word in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return run


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The lengths and the flat values of a list column without nulls."""
    whole = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return np.diff(whole.offsets.to_numpy()), whole.flatten().to_numpy(zero_copy_only=False)


def _reassemble(only_sizes: bool):
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        lengths, codes = _lists(docs.column("codes")) if docs.num_rows else (np.empty(0, np.int64), np.empty(0, np.int32))
        if words.num_rows:
            sizes, values = _lists(words.column("ids"))
            order = np.argsort(words.column("code").to_numpy())
            starts = (np.cumsum(sizes) - sizes)[order]
            sizes = sizes[order]
        else:
            sizes = starts = np.empty(0, np.int64)
            values = np.empty(0, np.int32)
        per = sizes[codes].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(per)])
        bounds = ends[np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)]
        if only_sizes:
            out = pa.array(np.diff(bounds), pa.int64())
            return pa.table({"doc_id": docs.column("doc_id"), "n_tokens": out})
        flat = values[np.arange(ends[-1]) + np.repeat(starts[codes] - ends[:-1], per)]
        ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32)))
        return pa.table({"doc_id": docs.column("doc_id"), "ids": ids})

    return run


def _assembled(documents: DataFrame, path: str, only_sizes: bool, block_chars: int) -> DataFrame:
    blocks = materialise(documents.select("doc_id", "text").mapInArrow(_blocks(block_chars), "block string, doc_id long, codes array<int>, code int, word string"))
    entries = blocks.where("word is not null").select("block", "code", "word")
    encoded = entries.select("word").distinct().mapInArrow(_encode_words(path), "word string, ids array<int>")
    # A frequent word has a row in every block, so its rows are dealt to several tasks.
    dictionary = spread_join(entries, encoded, "word").select(F.col("block").alias("of_block"), "code", "ids")
    docs = blocks.where("word is null").select("block", "doc_id", "codes")
    schema = "doc_id long, n_tokens long" if only_sizes else "doc_id long, ids array<int>"
    return docs.groupBy("block").cogroup(dictionary.groupBy("of_block")).applyInArrow(_reassemble(only_sizes), schema)


def encode_corpus(documents: DataFrame, path: str = TOKENIZER, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, ids): the ids of each row's text without special tokens.

    Null and empty texts have an empty list; texts that spell a special token are ordinary text; a
    repeated or null doc_id keeps its rows.
    """
    return _assembled(documents, path, False, block_chars)


def corpus_sizes(documents: DataFrame, path: str = TOKENIZER, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_tokens), by the same shuffle, without putting the ids together."""
    return _assembled(documents, path, True, block_chars)


def _decode(path: str):
    def run(batches):
        table = {rank: token for token, rank in _ranks(path).items()}
        for batch in sliced(batches):
            texts = [None if ids is None else b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode_corpus(encoded: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, text): a map-side join of the ids with the token-byte table, which has a fixed size.

    Null ids give a null text; bytes that aren't UTF-8 become the replacement character.
    """
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, text string")


def roundtrip(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, same): whether the text comes back from its ids; null counts as empty."""
    back = decode_corpus(encode_corpus(documents, path), path).select("doc_id", F.col("text").alias("back"))
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(back, "doc_id").select("doc_id", (F.col("text") == F.col("back")).alias("same"))
