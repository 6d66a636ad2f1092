"""The pN_ queries and, where SQL can say the same over whole tables, their SQL."""

from __future__ import annotations

from quernlab.llm import broken, defects, encode, mixing, neardup, overlap, packing, spam
from quernlab.session import table


def queries() -> dict:
    return {
        "p1_found": lambda spark, d: defects.defects_found(table(spark, d, "pairs", wide=True)),
        "p1_report": lambda spark, d: defects.defect_report(table(spark, d, "pairs", wide=True)),
        "p2_found": lambda spark, d: broken.broken_found(table(spark, d, "all_code", wide=True), table(spark, d, "pairs", wide=True)),
        "p2_rates": lambda spark, d: broken.broken_rates(table(spark, d, "all_code", wide=True)),
        "p2_kinds": lambda spark, d: broken.broken_kinds(table(spark, d, "all_code", wide=True), table(spark, d, "pairs", wide=True)),
        "p3_items": lambda spark, d: packing.pack(table(spark, d, "pairs"), table(spark, d, "pack_capacity")).items,
        "p3_containers": lambda spark, d: packing.pack(table(spark, d, "pairs"), table(spark, d, "pack_capacity")).containers(),
        "p3_report": lambda spark, d: packing.pack(table(spark, d, "pairs"), table(spark, d, "pack_capacity")).report(),
        "p4_found": lambda spark, d: overlap.overlap_found(table(spark, d, "samples", wide=True)),
        "p4_report": lambda spark, d: overlap.overlap_report(table(spark, d, "samples", wide=True)),
        "p5_found": lambda spark, d: neardup.near_duplicates_found(table(spark, d, "pairs", wide=True)),
        "p5_groups": lambda spark, d: neardup.near_duplicate_groups(table(spark, d, "pairs", wide=True)),
        "p6_ids": lambda spark, d: encode.encode_corpus(table(spark, d, "documents", wide=True)),
        "p6_roundtrip": lambda spark, d: encode.roundtrip(table(spark, d, "documents", wide=True)),
        "p7_draw": lambda spark, d: mixing.Mixture(table(spark, d, "documents", wide=True), table(spark, d, "mix_targets")).draw(),
        "p7_shares": lambda spark, d: mixing.Mixture(table(spark, d, "documents", wide=True), table(spark, d, "mix_targets")).shares(),
        "p8_found": lambda spark, d: spam.spam_found(table(spark, d, "documents", wide=True)),
        "p8_report": lambda spark, d: spam.spam_report(table(spark, d, "documents", wide=True)),
    }


def _shingles(rows: str, text: str, carry: str = "") -> str:
    """Common table expressions ``sh`` (idx, carried columns, g), the distinct shingles of three tokens, and ``n`` (idx, c), how many there are."""
    return f"""
tok AS (SELECT idx, {carry} regexp_extract_all(lower({text}), '[a-z0-9_]+') AS w FROM {rows}),
sh AS (SELECT DISTINCT idx, {carry} unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS g FROM tok WHERE len(w) >= 3),
n AS (SELECT idx, count(*) AS c FROM sh GROUP BY idx)"""


_OVERLAPS = f"""
s AS (SELECT idx, any_value(split) AS split, any_value(source) AS source, any_value(question) AS question, any_value(test_list) AS test_list, any_value(split) = 'train' AS train
      FROM samples WHERE idx IS NOT NULL AND split IN ('train', 'valid', 'test') GROUP BY idx),
{_shingles("s", "question", "train,")},
asserts AS (SELECT DISTINCT idx, train, regexp_replace(unnest(test_list), '\\s+', '', 'g') AS g FROM s),
m AS (SELECT idx, count(*) AS c FROM asserts WHERE g IS NOT NULL GROUP BY idx),
by_question AS (
  SELECT a.idx AS eval_idx, b.idx AS train_idx FROM sh a JOIN sh b ON a.g = b.g JOIN n x ON x.idx = a.idx JOIN n y ON y.idx = b.idx
  WHERE NOT a.train AND b.train GROUP BY a.idx, b.idx HAVING count(*) / CAST(any_value(x.c) + any_value(y.c) - count(*) AS DOUBLE) >= 0.6),
by_tests AS (
  SELECT a.idx AS eval_idx, b.idx AS train_idx FROM asserts a JOIN asserts b ON a.g = b.g JOIN m x ON x.idx = a.idx JOIN m y ON y.idx = b.idx
  WHERE NOT a.train AND b.train GROUP BY a.idx, b.idx HAVING count(*) >= 2 AND count(*) / CAST(any_value(x.c) + any_value(y.c) - count(*) AS DOUBLE) >= 0.5),
met AS (SELECT * FROM by_question UNION SELECT * FROM by_tests)"""

_SIMILAR = f"""
p AS (SELECT idx, coalesce(instruction, '') || ' ' || coalesce(output, '') AS text FROM pairs WHERE idx IS NOT NULL),
{_shingles("p", "text")},
links AS (
  SELECT a.idx AS idx_a, b.idx AS idx_b FROM sh a JOIN sh b ON a.g = b.g AND a.idx < b.idx JOIN n x ON x.idx = a.idx JOIN n y ON y.idx = b.idx
  GROUP BY a.idx, b.idx HAVING count(*) / CAST(any_value(x.c) + any_value(y.c) - count(*) AS DOUBLE) >= 0.6)"""

#: Brute force over all pairs that share a shingle or an assert.
SQL = {
    "p4_found": f"WITH {_OVERLAPS} SELECT DISTINCT least(eval_idx, train_idx) AS idx_a, greatest(eval_idx, train_idx) AS idx_b FROM met",
    "p4_report": f"""WITH {_OVERLAPS}, k AS (SELECT eval_idx, count(*) AS pairs FROM met GROUP BY eval_idx)
SELECT split, source, count(*) AS n_rows, count(eval_idx) AS n_overlapping, coalesce(CAST(sum(pairs) AS BIGINT), 0) AS n_pairs FROM s LEFT JOIN k ON s.idx = k.eval_idx WHERE NOT train GROUP BY split, source""",
    "p5_found": f"WITH {_SIMILAR} SELECT idx_a, idx_b FROM links",
    "p5_groups": f"""WITH RECURSIVE {_SIMILAR}, both_ways AS (SELECT idx_a AS u, idx_b AS v FROM links UNION ALL SELECT idx_b, idx_a FROM links),
reach AS (SELECT DISTINCT u, u AS v FROM both_ways UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON r.v = b.u),
root AS (SELECT u, min(v) AS group_id FROM reach GROUP BY u), degree AS (SELECT u, count(*) AS n_links FROM both_ways GROUP BY u)
SELECT root.u AS idx, group_id, n_links FROM root JOIN degree ON root.u = degree.u""",
    "p6_roundtrip": "SELECT doc_id, TRUE AS same FROM documents WHERE doc_id IS NOT NULL",
}


def oracle_sql() -> dict:
    return dict(SQL)
