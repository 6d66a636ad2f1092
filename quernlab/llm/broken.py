"""Problem 2: source files that are not valid in their language.

Each file is read once, in the task that scanned it; only the broken ones go on. The checks are in
``syntax``: a lexer with a pushdown stack for each language, then its grammar.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlab.llm.arrow import sliced
from quernlab.llm.syntax.check import LANGUAGES, defect


def _defects(batches):
    for batch in sliced(batches):
        kinds = [defect(text, lang) for text, lang in zip(batch.column("text").to_pylist(), batch.column("language").to_pylist())]
        kinds = pa.array(kinds, pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column(c).filter(kinds.is_valid()) for c in ("tbl", "file_key", "repo", "language")] + [kinds.filter(kinds.is_valid())],
            names=["tbl", "file_key", "repo", "language", "kind"],
        )


def _language() -> F.Column:
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), extension)


def code_files(all_code: DataFrame) -> DataFrame:
    return all_code.where("id is not null").select(F.lit("all_code").alias("tbl"), F.col("id").alias("file_key"), "repo", _language().alias("language"), F.col("code").alias("text"))


def pair_files(pairs: DataFrame) -> DataFrame:
    return pairs.where("kind = 'code' and idx is not null").select(
        F.lit("pairs").alias("tbl"), F.col("idx").cast("string").alias("file_key"), F.lit(None).cast("string").alias("repo"), F.lit("python").alias("language"), F.col("output").alias("text")
    )


def broken_files(files: DataFrame) -> DataFrame:
    """(tbl, file_key, repo, language, kind) of the broken ones of ``files`` (tbl, file_key, repo, language, text).

    Null and blank texts, and files of no known language, are none. A file that was read several times
    with the same text comes out once; the kinds are those of ``syntax.lexer``.
    """
    return files.where("text is not null and language is not null").mapInArrow(
        _defects, "tbl string, file_key string, repo string, language string, kind string"
    ).distinct()


def broken_found(all_code: DataFrame, pairs: DataFrame) -> DataFrame:
    return broken_files(code_files(all_code).unionByName(pair_files(pairs))).select("tbl", "file_key").distinct()


def broken_rates(all_code: DataFrame) -> DataFrame:
    """(repo, language, n_files, n_broken, rate) over the distinct files whose text is not blank; a null repo is a repo of its own."""
    files = code_files(all_code).where("language is not null and text is not null")
    whole = files.where(F.length(F.regexp_replace("text", r"(?U)[\s\x1c-\x1f]+", "")) > 0).groupBy("file_key").agg(F.max("repo").alias("repo"), F.max("language").alias("language"))
    broken = broken_files(files).select("file_key", F.lit(1).alias("bad")).distinct()
    return (
        whole.join(broken, "file_key", "left")
        .groupBy("repo", "language").agg(F.count("*").alias("n_files"), F.count("bad").alias("n_broken"))
        .withColumn("rate", F.col("n_broken") / F.col("n_files"))
    )


def broken_kinds(all_code: DataFrame, pairs: DataFrame) -> DataFrame:
    """(language, kind, n_files) of the broken files."""
    return broken_files(code_files(all_code).unionByName(pair_files(pairs))).groupBy("language", "kind").agg(F.countDistinct("tbl", "file_key").alias("n_files"))
