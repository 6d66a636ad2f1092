"""The registered queries in SQL (DuckDB), over the same tables."""

from __future__ import annotations

from quernlab.functions import text as X
from quernlab.sources.writing import SUMMARY_FIELDS


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LATEST = """latest AS (SELECT idx, aspect, coalesce(score, 0.0) AS score FROM judged
  QUALIFY row_number() OVER (PARTITION BY idx, aspect ORDER BY loaded_at DESC, judged_at DESC) = 1)"""
_QUALITY = f"""{_LATEST}, quality AS (SELECT c.idx, c.score AS correct, h.score AS help, (c.score + h.score) / 2 AS score
  FROM latest c JOIN latest h ON c.idx = h.idx AND c.aspect = 'correct' AND h.aspect = 'help')"""
_SCORED = f"{_QUALITY}, scored AS (SELECT p.idx, q.score FROM pairs p JOIN quality q USING (idx))"
_FILES = """files AS (SELECT path, min(code) AS code FROM all_code GROUP BY path),
  errors AS (SELECT path FROM files WHERE code IS NULL OR trim(code) = ''),
  split AS (SELECT f.path, CASE WHEN e.path IS NOT NULL THEN 'syntax_error' WHEN s.path IS NOT NULL THEN 'defective' ELSE 'clean' END AS bucket
    FROM files f LEFT JOIN errors e USING (path) LEFT JOIN (SELECT DISTINCT path FROM scan_findings) s USING (path))"""
_CATEGORY = "coalesce(category, CASE WHEN len(cwe) > 0 THEN 'security' END)"
_SECURITY = "security AS (SELECT * FROM scan_findings WHERE category IS NULL OR category = 'security')"
_RUNS = """runs AS (SELECT split_part(id, '_', 1)::BIGINT AS idx, split_part(id, '_', 2)::INT AS j, code, (length(code) % 5) / 4.0::DOUBLE AS ratio
    FROM (SELECT id, min(code) AS code FROM all_code GROUP BY id)),
  items AS (SELECT DISTINCT idx FROM samples WHERE split IN ('valid', 'test'))"""
_ATTEMPTS = """tried AS (SELECT idx, min(j) FILTER (WHERE ratio = 1.0) AS first, max(j) AS last FROM runs GROUP BY idx),
  results AS (SELECT t.idx, coalesce(t.first, t.last) + 1 AS attempts, t.first IS NOT NULL AS passed, r.code
    FROM tried t JOIN runs r ON r.idx = t.idx AND r.j = coalesce(t.first, t.last))"""
_GRAMS = r"""words AS (SELECT idx, list_filter(string_split_regex(lower(coalesce(instruction, '') || ' ' || coalesce(output, '')), '[\t-\r ]+'), lambda w: w <> '') AS w FROM pairs),
  grams AS (SELECT idx, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) AS g FROM words WHERE len(w) >= 3),
  members AS (SELECT idx, min(idx) OVER (PARTITION BY g) AS rep, g FROM grams),
  sets AS (SELECT rep, len(g) AS n, unnest(g) AS gram FROM members WHERE idx = rep),
  links AS (SELECT a.rep AS a, b.rep AS b, count(*)::DOUBLE / (a.n + b.n - count(*)) AS similarity
    FROM sets a JOIN sets b ON a.gram = b.gram AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n
    HAVING count(*)::DOUBLE / (a.n + b.n - count(*)) >= 0.5)"""
_CLUSTERS = f"""{_GRAMS}, edges AS (SELECT a AS x, b AS y FROM links UNION SELECT b, a FROM links UNION SELECT rep, rep FROM members),
  reach AS (SELECT x AS id, y AS other FROM edges UNION SELECT r.id, e.y FROM reach r JOIN edges e ON r.other = e.x),
  component AS (SELECT id AS rep, min(other) AS cluster_id FROM reach GROUP BY id),
  sizes AS (SELECT rep, count(*) AS own FROM members GROUP BY rep),
  near AS (SELECT e.x AS rep, sum(s.own) - 1 AS n_links FROM edges e JOIN sizes s ON s.rep = e.y GROUP BY e.x),
  clusters AS (SELECT m.idx, c.cluster_id, n.n_links::BIGINT AS n_links FROM members m JOIN component c USING (rep) JOIN near n USING (rep) WHERE n.n_links > 0)"""


def _pct(n: str, total: str) -> str:
    return f"{n} * 100::DOUBLE / {total}"


def _folded(counts: str, keys: str, label: str, top: int) -> str:
    """The most frequent by group and the others as one row, of (keys, label, n)."""
    part = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""placed AS (SELECT *, row_number() OVER ({part} ORDER BY n DESC, {label}) AS place, sum(n) OVER ({part}) AS total FROM ({counts}))
  SELECT {lead}least(place, {top + 1})::INT AS place, CASE WHEN place > {top} THEN 'OTHERS' ELSE {label} END AS {label}, sum(n)::BIGINT AS n, {_pct('sum(n)', 'max(total)')} AS percent
  FROM placed GROUP BY {lead}least(place, {top + 1}), CASE WHEN place > {top} THEN 'OTHERS' ELSE {label} END"""


_NONE = "coalesce({}, 'None')"
_JUDGE = X.judge_template("correctness")


def _strip(value: str) -> str:
    return f"regexp_replace(regexp_replace({value}, '\\A{X.BLANK}+', ''), '{X.BLANK}+\\z', '')"


_PYTHON_PART = "substr(coalesce(output, ''), strpos(coalesce(output, ''), '```python') + 9)"
_EXTRACT = f"""CASE WHEN contains(coalesce(output, ''), '```python') THEN CASE WHEN contains({_PYTHON_PART}, '```') THEN regexp_extract({_PYTHON_PART}, '(?s)\\A(.*)```', 1) ELSE {_PYTHON_PART} END
  WHEN contains(coalesce(output, ''), '```') THEN split_part(output, '```', 1) ELSE coalesce(output, '') END"""
_CLEAN = f"regexp_replace(regexp_replace(coalesce(output, ''), '\\A{X.BLANK}*```python{X.BLANK}*', ''), '{X.BLANK}*```\\n?\\z', '')"
_FILTERED = f"""WITH {_QUALITY} SELECT p.idx FROM pairs p JOIN (SELECT idx, help AS s1, correct AS s2 FROM quality) q USING (idx)
  WHERE p.output IS DISTINCT FROM p.instruction AND """
_SIZES = "SELECT part, n FROM (SELECT count(*) AS c FROM pairs) t, LATERAL (VALUES {}) v(part, n) WHERE n > 0"

SQL = {
    "select_ratio": f"WITH {_SCORED} SELECT idx, score FROM scored QUALIFY row_number() OVER (ORDER BY score DESC, idx) <= floor((SELECT count(*) FROM scored) * 0.2::DOUBLE)",
    "select_topk": f"WITH {_SCORED} SELECT idx, score FROM scored ORDER BY score DESC, idx LIMIT 100",
    "select_threshold": f"WITH {_SCORED} SELECT idx, score FROM scored WHERE score >= 6.0",
    "rank_pairs": f"WITH {_SCORED} SELECT idx, score, row_number() OVER (ORDER BY score DESC, idx) AS rank FROM scored",
    "near_dup_pairs": f"WITH {_GRAMS} SELECT a, b, similarity FROM links",
    "near_dup_members": f"WITH {_GRAMS} SELECT idx, rep FROM members",
    "near_dup_clusters": f"WITH RECURSIVE {_CLUSTERS} SELECT idx, cluster_id, n_links FROM clusters",
    "near_dup_keep": f"WITH RECURSIVE {_CLUSTERS} SELECT idx FROM pairs WHERE idx NOT IN (SELECT idx FROM clusters WHERE idx <> cluster_id)",
    "select_scored": r"""WITH s AS (SELECT DISTINCT idx, list_distinct(regexp_extract_all(lower(coalesce(solutions, '')), '(?:[^\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}])+')) AS given,
    regexp_extract_all(lower(coalesce(question, '')), '(?:[^\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}])+') AS asked FROM samples),
  scored AS (SELECT idx, CASE WHEN len(given) > 0 THEN len(list_intersect(given, asked))::DOUBLE / len(given) ELSE 0.0 END AS score FROM s)
  SELECT idx, score FROM scored QUALIFY row_number() OVER (ORDER BY score DESC, idx) <= floor((SELECT count(*) FROM scored) * 0.2::DOUBLE)""",
    "similarities": f"""WITH {_GRAMS}, every AS (SELECT idx, len(g) AS n, unnest(g) AS gram FROM grams)
  SELECT q.idx AS query_id, e.idx AS id, count(*)::DOUBLE / (any_value(q.n) + any_value(e.n) - count(*)) AS similarity FROM every q JOIN every e ON q.gram = e.gram AND q.idx <> e.idx WHERE q.idx % 20 = 0 GROUP BY q.idx, e.idx""",
    "exact_dups": "SELECT min(doc_id) AS first_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
    "split_three_way": f"WITH {_FILES} SELECT path, bucket FROM split",
    "split_counts": f"WITH {_FILES} SELECT bucket, count(*) AS n FROM split GROUP BY bucket",
    "defective_files": f"WITH {_FILES} SELECT DISTINCT path FROM scan_findings WHERE path NOT IN (SELECT path FROM errors)",
    "findings_kept": f"WITH {_FILES} SELECT path, check_id, line FROM scan_findings WHERE path NOT IN (SELECT path FROM errors)",
    "severity_counts": "SELECT severity, count(*) AS n FROM scan_findings WHERE severity IS NOT NULL GROUP BY severity",
    "category_counts": f"SELECT {_CATEGORY} AS category, count(*) AS n FROM scan_findings WHERE {_CATEGORY} IS NOT NULL GROUP BY 1",
    "severity_category_pct": f"""WITH frame AS (SELECT s.severity, c.category FROM (SELECT DISTINCT severity FROM scan_findings WHERE severity IS NOT NULL) s, (SELECT DISTINCT category FROM scan_findings WHERE category IS NOT NULL) c),
  counts AS (SELECT severity, category, count(*) AS n FROM scan_findings GROUP BY ALL),
  filled AS (SELECT f.severity, f.category, coalesce(n, 0) AS n FROM frame f LEFT JOIN counts c ON c.severity = f.severity AND c.category = f.category)
  SELECT severity, category, n, CASE WHEN sum(n) OVER (PARTITION BY severity) > 0 THEN {_pct('n', 'sum(n) OVER (PARTITION BY severity)')} ELSE 0 END AS percent FROM filled""",
    "top_issues": "WITH " + _folded("SELECT category, regexp_extract(check_id, '[^.]+$') AS issue, count(*) AS n FROM scan_findings WHERE category <> 'security' GROUP BY 1, 2", "category", "issue", 2),
    "top_issues_by_severity": "WITH " + _folded("SELECT severity, category, regexp_extract(check_id, '[^.]+$') AS issue, count(*) AS n FROM scan_findings WHERE category <> 'security' AND severity IS NOT NULL GROUP BY 1, 2, 3", "severity, category", "issue", 5),
    "cwe_counts": f"WITH {_SECURITY} SELECT label, count(*) AS n FROM (SELECT unnest(cwe) AS label FROM security) WHERE label IS NOT NULL GROUP BY label",
    "owasp_counts": f"WITH {_SECURITY} SELECT label, count(*) AS n FROM (SELECT unnest(owasp) AS label FROM security) WHERE label IS NOT NULL GROUP BY label",
    "impact_counts": f"WITH {_SECURITY} SELECT impact, count(*) AS n FROM security WHERE impact IS NOT NULL GROUP BY impact",
    "confidence_counts": f"WITH {_SECURITY} SELECT confidence, count(*) AS n FROM security WHERE confidence IS NOT NULL GROUP BY confidence",
    "cwe_pivot": f"""WITH {_SECURITY}, e AS (SELECT unnest(cwe) AS cwe, severity FROM security WHERE severity IN ('INFO', 'WARNING', 'ERROR'))
  SELECT cwe, count(*) FILTER (WHERE severity = 'INFO') AS "INFO", count(*) FILTER (WHERE severity = 'WARNING') AS "WARNING", count(*) FILTER (WHERE severity = 'ERROR') AS "ERROR", count(*) AS total FROM e WHERE cwe IS NOT NULL GROUP BY cwe""",
    "cwe_top": f"WITH {_SECURITY}, " + _folded("SELECT label, count(*) AS n FROM (SELECT unnest(cwe) AS label FROM security) WHERE label IS NOT NULL GROUP BY label", "", "label", 3),
    "rates": f"""WITH {_FILES}, c AS (SELECT count(*) AS scanned, count(*) FILTER (WHERE bucket = 'defective') AS d, count(*) FILTER (WHERE bucket = 'syntax_error') AS e, count(*) FILTER (WHERE bucket = 'clean') AS k FROM split),
  i AS (SELECT count(*) AS issues FROM scan_findings)
  SELECT scanned, issues, {_pct('d', 'scanned')} AS defective_rate, {_pct('e', 'scanned')} AS error_rate, {_pct('issues', 'scanned')} AS issue_rate, {_pct('k', 'scanned')} AS clean_rate FROM c, i""",
    "severity_rates": f"SELECT severity, count(*) AS n, {_pct('count(*)', '(SELECT count(*) FROM scan_findings)')} AS percent FROM scan_findings WHERE severity IS NOT NULL GROUP BY severity",
    "category_rates": f"SELECT {_CATEGORY} AS category, count(*) AS n, {_pct('count(*)', '(SELECT count(*) FROM scan_findings)')} AS percent FROM scan_findings WHERE {_CATEGORY} IS NOT NULL GROUP BY 1",
    "finding_domains": " UNION ".join(
        [f"SELECT '{f}' AS field, {f} AS value FROM scan_findings WHERE {f} IS NOT NULL" for f in ("severity", "category", "impact", "confidence")]
        + [f"SELECT '{f}' AS field, value FROM (SELECT unnest({f}) AS value FROM scan_findings) WHERE value IS NOT NULL" for f in ("cwe", "owasp")]
    ),
    "line_numbers": r"SELECT DISTINCT id, try_cast(nullif(regexp_extract(path, '^\w+_(\d+)\.py', 1), '') AS BIGINT) AS n FROM all_code",
    "issue_lines": r"SELECT DISTINCT regexp_extract(path, '^\w+_(\d+)\.py', 1)::BIGINT - 1 AS idx FROM scan_findings WHERE regexp_matches(path, '^\w+_(\d+)\.py')",
    "best_ratios": f"WITH {_RUNS} SELECT i.idx, coalesce(max(r.ratio), 0.0) AS best FROM items i LEFT JOIN runs r USING (idx) GROUP BY i.idx",
    "pass_at_1": f"WITH {_RUNS}, b AS (SELECT i.idx, coalesce(max(r.ratio), 0.0) AS best FROM items i LEFT JOIN runs r ON r.idx = i.idx AND r.j < 1 GROUP BY i.idx) SELECT count(*) AS n_items, coalesce(avg((best = 1.0)::INT), 0.0) AS pass_at_k FROM b",
    "pass_at_5": f"WITH {_RUNS}, b AS (SELECT i.idx, coalesce(max(r.ratio), 0.0) AS best FROM items i LEFT JOIN runs r ON r.idx = i.idx AND r.j < 5 GROUP BY i.idx) SELECT count(*) AS n_items, coalesce(avg((best = 1.0)::INT), 0.0) AS pass_at_k FROM b",
    "avg_pass_ratio": f"WITH {_RUNS}, b AS (SELECT i.idx, coalesce(max(r.ratio), 0.0) AS best FROM items i LEFT JOIN runs r ON r.idx = i.idx AND r.j < 5 GROUP BY i.idx) SELECT count(*) AS n_items, coalesce(avg(best), 0.0) AS avg_pass_ratio FROM b",
    "best_checkpoint": r"""SELECT dataset, model, best_ckpt, val_pass1 FROM eval_summary WHERE val_pass1 IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dataset, model ORDER BY val_pass1 DESC, regexp_extract(best_ckpt, '-(\d+)$', 1)::INT) = 1""",
    "quality_averages": "SELECT dataset, model, round(avg(coalesce(avg_code_smell_score, 0.0)), 6) AS smell, round(avg(coalesce(avg_mi_score, 0.0)), 6) AS mi FROM eval_summary GROUP BY dataset, model",
    "first_passing": f"WITH {_RUNS}, {_ATTEMPTS} SELECT idx, attempts, passed, code FROM results",
    "failure_ratio": f"WITH {_RUNS}, {_ATTEMPTS} SELECT count(*) AS n, count(*) FILTER (WHERE NOT passed) AS n_failed, count(*) FILTER (WHERE NOT passed)::DOUBLE / count(*) AS failure_ratio FROM results",
    "generation_ids": "SELECT DISTINCT id, split_part(id, '_', 1)::BIGINT AS idx, split_part(id, '_', 2)::INT AS j FROM all_code",
    "quality_join": f"WITH {_QUALITY} SELECT idx, correct, help, score FROM quality",
    "pair_filter_abs": _FILTERED + "least(s1, s2) > 3.0 AND greatest(s1, s2) < 7.0",
    "pair_filter_abs_pos": _FILTERED + "s1 > 3.0 AND s1 < 7.0",
    "pair_filter_diff": _FILTERED + "abs(s1 - s2) < 7.0",
    "pair_filter_abs_diff": _FILTERED + "abs(s1 - s2) < 7.0 AND least(s1, s2) > 3.0",
    "pair_filter_none": _FILTERED + "true",
    "common_indexes": "SELECT idx FROM pairs INTERSECT SELECT idx FROM judged WHERE aspect = 'help' INTERSECT SELECT idx FROM judged WHERE aspect = 'correct'",
    "aligned_answers": "SELECT idx, length(output)::INT AS human, (length(output) + 1)::INT AS referenced, length(output)::INT AS direct FROM pairs",
    "split_80_10_10": _SIZES.format("('train', c - ceil(c / 5.0)::BIGINT), ('valid', ceil(ceil(c / 5.0) / 2)::BIGINT), ('test', ceil(c / 5.0)::BIGINT - ceil(ceil(c / 5.0) / 2)::BIGINT)"),
    "split_995": _SIZES.format("('train', floor(c * 0.995::DOUBLE)::BIGINT), ('eval', c - floor(c * 0.995::DOUBLE)::BIGINT)"),
    "ranking_accuracy": "SELECT count(*) AS n, (sum((val_pass1 > test_pass1)::INT + (val_pass1 > avg_pass_ratio)::INT + (test_pass1 > avg_pass_ratio)::INT)) / (3.0::DOUBLE * count(*)) AS accuracy FROM eval_summary",
    "build_prompt": f"SELECT idx, {_q(X.INSTRUCTION_HEAD)} || {_strip('coalesce(instruction, chr(32))')} || {_q(X.INSTRUCTION_TAIL)} AS prompt FROM pairs",
    "synthesis_prompt": f"SELECT DISTINCT idx, {_q(X.SYNTHESIS_HEAD)} || {_NONE.format('question')} || chr(10) || chr(10) AS prompt FROM samples",
    "judge_prompt": "SELECT idx, " + " || ".join(
        [_q(_JUDGE.split("{PROBLEM}")[0]), _NONE.format("instruction"), _q(_JUDGE.split("{PROBLEM}")[1].split("{OUTPUT}")[0]), _NONE.format("output"), _q(_JUDGE.split("{OUTPUT}")[1])]
    ) + " AS prompt FROM pairs",
    "style_prompt": "SELECT idx, " + " || ".join(
        [_q("\n### Reference Answer:\n\n"), _NONE.format("output"), _q(f"\n\n### Background:\n\n{X.STYLE_BACKGROUND['referenced']}\n\n### Instruction:\n\n"), _NONE.format("instruction"), _q("\n\n### Response:\n")]
    ) + " AS prompt FROM pairs",
    "chat_text": f"SELECT idx, {_q(X.CHAT_HEAD)} || {_NONE.format('instruction')} || ' ASSISTANT: ' || {_NONE.format('output')} || '</s>' AS chat FROM pairs",
    "chat_format": "SELECT 'identity_' || idx AS id, 2 AS n_turns, instruction AS human, output AS gpt FROM pairs",
    "pair_keys": f"SELECT idx, 'Instruction: ' || {_NONE.format('instruction')} || 'Answer: ' || {_NONE.format('output')} AS key FROM pairs",
    "score_map": f"""WITH k AS (SELECT p.idx, 'Instruction: ' || {_NONE.format('p.instruction')} || 'Answer: ' || {_NONE.format('p.output')} AS key, coalesce(j.score, 0.0) AS score, j.loaded_at, j.judged_at
  FROM pairs p JOIN judged j USING (idx) WHERE j.aspect = 'help')
  SELECT key, score FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY loaded_at DESC, judged_at DESC, idx DESC) = 1""",
    "extract_code": f"SELECT idx, {_strip(f"split_part({_EXTRACT}, '</s>', 1)")} AS code FROM pairs",
    "clean_code": f"SELECT idx, {_strip(_CLEAN)} AS code FROM pairs",
    "issue_names": "SELECT regexp_extract(check_id, '[^.]+$') AS issue, count(*) AS n, count(cwe) AS n_cwe FROM scan_findings GROUP BY 1",
    "judge_score": r"""WITH t AS (SELECT row_number() OVER () AS r, idx, aspect, replace(regexp_replace(lower(content), '[()-]', '', 'g'), 'out of', '/') AS text FROM judged),
  v AS (SELECT r, list_concat(
      list_transform(list_filter(flatten(list_transform(list_filter(regexp_extract_all(text, '(?m)(?:^[\d. ]+)?(.+?)(?:\. |$)', 1), lambda x: contains(x, 'score') OR list_has_any([true], list_transform(string_split(coalesce(aspect, ''), ' '), lambda w: w <> '' AND contains(x, w)))),
        lambda x: string_split_regex(x, '\s+'))), lambda w: regexp_full_match(w, '\d+(?:/4)?\.*')), lambda w: regexp_extract(w, '^\d+')),
      """ + ",\n      ".join(f"regexp_extract_all(text, '{form}', 1)" for form in X.SCORE_FORMS) + r""") AS votes FROM t),
  u AS (SELECT r, unnest(votes)::DOUBLE AS score, generate_subscripts(votes, 1) AS place FROM v),
  w AS (SELECT r, score, count(*) AS n, min(place) AS place FROM u WHERE score <= 9 GROUP BY r, score),
  b AS (SELECT r, first(score ORDER BY n DESC, place) AS score FROM w GROUP BY r)
  SELECT idx, aspect, coalesce(score, CASE WHEN contains(text, 'n/a') THEN 0.0 END) AS score FROM t LEFT JOIN b USING (r)""",
    "summary_lines": "SELECT concat_ws(chr(10), " + ", ".join(
        f"'{c}=' || coalesce(printf('%.4f', {c}), 'None')" if c.endswith("pass1") else f"'{c}=' || coalesce({c}::VARCHAR, 'None')" for c in SUMMARY_FIELDS
    ) + ") AS value FROM eval_summary",
    "sample_tests": "SELECT DISTINCT idx, CASE WHEN dataset = 'mbpp' THEN to_json(test_list)::VARCHAR ELSE input_output END AS tests FROM samples",
    "test_functions": "SELECT DISTINCT idx, CASE WHEN json_valid(input_output) THEN json_extract_string(input_output, '$.fn_name') END AS fn_name FROM samples WHERE dataset <> 'mbpp'",
    "jsonl_roundtrip": "SELECT idx, dataset, question, solutions, input_output, coalesce(len(test_list), 0)::INT AS n_tests FROM samples",
    "train_labels": f"""WITH b AS (SELECT idx, octet_length(encode({_q(X.INSTRUCTION_HEAD)} || {_strip('coalesce(instruction, chr(32))')} || {_q(X.INSTRUCTION_TAIL)})) AS p, octet_length(encode(coalesce(output, ''))) AS o FROM pairs)
  SELECT idx, least(1024, p + o)::INT AS n_ids, least(1024, p)::INT AS n_masked FROM b""",
}
