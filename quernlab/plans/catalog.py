"""The registered queries of the core operators, over whole tables, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlab.functions import text as X
from quernlab.functions.cases import decoded, tests_of
from quernlab.functions.formatters import refactor
from quernlab.functions.quality import lint_rating, maintainability, score_column
from quernlab.functions.rewrite import code_variants
from quernlab.functions.sandbox import pass_ratios
from quernlab.functions.scan import scan_code
from quernlab.operators import dedup, evaluate, findings, selection, split
from quernlab.plans import techniques
from quernlab.plans.oracles import SQL
from quernlab.session import scratch, spread, table
from quernlab.sources import reading, writing

NEAR_N, NEAR_T = 3, 0.5


def _latest(judged: DataFrame) -> DataFrame:
    return split.latest_scores(judged)


def _quality(spark: SparkSession, d: str) -> DataFrame:
    scores = _latest(table(spark, d, "judged"))
    of = lambda a: scores.where(F.col("aspect") == a).select("idx", "score")
    return split.quality(of("correct"), of("help"), strict=False)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pairs").select("idx").join(_quality(spark, d), "idx").select("idx", "score")


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """The samples, each once: of repeated rows, which agree, any."""
    return table(spark, d, "samples").dropDuplicates(["idx"])


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "all_code").select("path", "code").dropDuplicates(["path"])


def _python_files(spark: SparkSession, d: str) -> DataFrame:
    """The Python files, each id once, dealt to tasks for a costly stage."""
    return spread(table(spark, d, "all_code").where("path like '%.py'").dropDuplicates(["id"]))


def _unreadable(spark: SparkSession, d: str) -> DataFrame:
    """The files that a scan reports as errors here: those without text."""
    return _files(spark, d).where("code is null or trim(code) = ''").select("path")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """(idx, j, ratio, code) with a ratio that SQL can state too; the sandbox has queries of its own."""
    code = table(spark, d, "all_code").select("id", "code").dropDuplicates(["id"])
    return evaluate.split_generation_id(code).where("idx is not null").select("idx", "j", "code", (F.length("code") % 5 / F.lit(4.0)).alias("ratio"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "samples").where("split in ('valid', 'test')").select("idx")


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("idx", F.col("j").alias("attempt"), "code", (F.col("ratio") == 1.0).alias("passed"))


def _pair_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pairs", wide=True).select("idx", F.concat_ws(" ", F.coalesce("instruction", F.lit("")), F.coalesce("output", F.lit(""))).alias("text"))


def _near(spark: SparkSession, d: str) -> dedup.SimilarSets:
    return dedup.SimilarSets(_pair_texts(spark, d), "idx", "text", NEAR_N, NEAR_T)


def _minhash_pairs(spark: SparkSession, d: str) -> DataFrame:
    texts = _pair_texts(spark, d)
    found = dedup.minhash_candidates(dedup.minhash_signatures(texts, "idx", "text", NEAR_N))
    return dedup.verified(found, texts, "idx", "text", NEAR_N, NEAR_T)


def _near_dup_keep(spark: SparkSession, d: str) -> DataFrame:
    texts = _pair_texts(spark, d)
    return dedup.distinct_rows(texts, "idx", dedup.near_dup_clusters(texts, "idx", "text", NEAR_N, NEAR_T)).withColumnRenamed("id", "idx")


def _pair_filter(mode: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        scores = _quality(spark, d).select("idx", F.col("help").alias("score1"), F.col("correct").alias("score2"))
        pairs = table(spark, d, "pairs").select("idx", F.col("output").alias("answer1"), F.col("instruction").alias("answer2"))
        return split.pair_filter(pairs.join(scores, "idx"), mode, 3.0, 7.0).select("idx")

    return run


def _part_sizes(parts: DataFrame) -> DataFrame:
    return parts.groupBy("part").agg(F.count("*").alias("n"))


def _jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "jsonl")
    writing.write_jsonl(table(spark, d, "samples").select("idx", "dataset", "split", "source", "question", "solutions", "input_output", "test_list"), path)
    back = reading.read_jsonl(spark, path, reading.SAMPLE_SCHEMA)
    return back.select("idx", "dataset", "question", "solutions", "input_output", F.size(F.coalesce("test_list", F.array())).alias("n_tests"))


def _score_map(spark: SparkSession, d: str) -> DataFrame:
    judged = table(spark, d, "judged").where("aspect = 'help'")
    keyed = table(spark, d, "pairs").select("idx", X.pair_key("instruction", "output").alias("key")).join(judged, "idx")
    return writing.last_scores(keyed.select(F.struct("loaded_at", "judged_at", "idx").alias("idx"), "key", F.coalesce("score", F.lit(0.0)).alias("score")))


def _pass_ratios(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        chosen = _samples(spark, d).where("dataset = 'mbpp'" if kind == "mbpp" else "dataset <> 'mbpp'")
        rows = chosen.select("idx", tests_of().alias("tests"), F.col("solutions").alias("code"))
        return pass_ratios(spread(rows), ["idx"])

    return run


def _tokenised(spark: SparkSession, d: str) -> DataFrame:
    """Prompts and answers as ids of a byte tokenizer, masked for training; cut to 1,024 ids, as the SQL states it."""

    def load():
        return lambda texts: [list(t.encode()) for t in texts]

    prompts = table(spark, d, "pairs").select("idx", X.instruction_prompt("instruction").alias("prompt"), F.coalesce("output", F.lit("")).alias("answer"))
    rows = split.masked(split.tokenised(prompts, load, max_length=1024))
    return rows.select("idx", F.size("input_ids").alias("n_ids"), F.size(F.filter("labels", lambda x: x == -100)).alias("n_masked"))


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pairs").select("idx", "instruction", "output")
    marked = rows.withColumn("output", F.concat("output", F.lit("!")))
    return split.aligned(rows, marked, rows.withColumn("output", F.reverse("output"))).select("idx", F.length("human").alias("human"), F.length("referenced").alias("referenced"), F.length("direct").alias("direct"))


def queries() -> dict:
    t = table
    find = lambda s, d: t(s, d, "scan_findings")
    pairs = lambda s, d: t(s, d, "pairs")
    return {
        # ranking and selection
        "select_ratio": lambda s, d: selection.filter_pairs(_scored(s, d), ratio=0.2),
        "select_topk": lambda s, d: selection.filter_pairs(_scored(s, d), topk=100),
        "select_threshold": lambda s, d: selection.filter_pairs(_scored(s, d), threshold=6.0),
        "rank_pairs": lambda s, d: selection.rank_pairs(_scored(s, d)),
        "select_scored": lambda s, d: selection.select(spread(_samples(s, d)), keep_columns=True).select("idx", "score"),
        # duplicates
        "near_dup_pairs": lambda s, d: _near(s, d).links,
        "near_dup_members": lambda s, d: _near(s, d).members.select(F.col("id").alias("idx"), "rep"),
        "near_dup_clusters": lambda s, d: _near(s, d).clusters().select(F.col("id").alias("idx"), "cluster_id", "n_links"),
        "near_dup_keep": _near_dup_keep,
        "minhash_pairs": _minhash_pairs,
        "similarities": lambda s, d: dedup.similarities(_pair_texts(s, d), "idx", "text", F.col("idx") % 20 == 0, NEAR_N),
        "exact_dups": lambda s, d: dedup.exact_duplicates(t(s, d, "documents"), "doc_id", "text"),
        # findings
        "split_three_way": lambda s, d: findings.split_three_way(_files(s, d).select("path"), find(s, d), _unreadable(s, d)),
        "split_counts": lambda s, d: findings.split_counts(findings.split_three_way(_files(s, d).select("path"), find(s, d), _unreadable(s, d))),
        "defective_files": lambda s, d: findings.defective_files(find(s, d), _unreadable(s, d)),
        "findings_kept": lambda s, d: findings.findings_without_errors(find(s, d), _unreadable(s, d)).select("path", "check_id", "line"),
        "severity_counts": lambda s, d: findings.severity_counts(find(s, d)),
        "category_counts": lambda s, d: findings.category_counts(find(s, d)),
        "severity_category_pct": lambda s, d: findings.severity_by_category(find(s, d)),
        "top_issues": lambda s, d: findings.top_issues(find(s, d), 2),
        "top_issues_by_severity": lambda s, d: findings.top_issues_by_severity(find(s, d)),
        "cwe_counts": lambda s, d: findings.counts_of_labels(findings.security_findings(find(s, d)), "cwe"),
        "owasp_counts": lambda s, d: findings.counts_of_labels(findings.security_findings(find(s, d)), "owasp"),
        "impact_counts": lambda s, d: findings.count_by(findings.security_findings(find(s, d)), "impact", "impact"),
        "confidence_counts": lambda s, d: findings.count_by(findings.security_findings(find(s, d)), "confidence", "confidence"),
        "cwe_pivot": lambda s, d: findings.cwe_by_severity(find(s, d)),
        "cwe_top": lambda s, d: findings.top_cwe(find(s, d), 3),
        "rates": lambda s, d: findings.rates(_files(s, d), find(s, d), _unreadable(s, d)),
        "severity_rates": lambda s, d: findings.label_rates(find(s, d), "severity", "severity"),
        "category_rates": lambda s, d: findings.label_rates(find(s, d), findings.category_or_security(), "category"),
        "finding_domains": lambda s, d: findings.domains(find(s, d)),
        "line_numbers": lambda s, d: t(s, d, "all_code").select("id", X.line_number("path").alias("n")).distinct(),
        "issue_lines": lambda s, d: findings.line_lists(find(s, d).select(X.line_number("path").alias("n"))),
        # metrics over generations
        "best_ratios": lambda s, d: evaluate.best_ratios(_items(s, d), _runs(s, d)),
        "pass_at_1": lambda s, d: evaluate.pass_at_k(_items(s, d), _runs(s, d), 1),
        "pass_at_5": lambda s, d: evaluate.pass_at_k(_items(s, d), _runs(s, d), 5),
        "avg_pass_ratio": lambda s, d: evaluate.average_pass_ratio(_items(s, d), _runs(s, d), 5),
        "best_checkpoint": lambda s, d: evaluate.best_checkpoint(t(s, d, "eval_summary"), ["dataset", "model"], "best_ckpt", "val_pass1"),
        "quality_averages": lambda s, d: evaluate.quality_averages(t(s, d, "eval_summary"), ["dataset", "model"], ["avg_code_smell_score", "avg_mi_score"]).select(
            "dataset", "model", F.round("avg_avg_code_smell_score", 6).alias("smell"), F.round("avg_avg_mi_score", 6).alias("mi")
        ),
        "first_passing": lambda s, d: evaluate.first_passing(_attempts(s, d)),
        "failure_ratio": lambda s, d: evaluate.failure_ratio(evaluate.first_passing(_attempts(s, d))),
        "generation_ids": lambda s, d: evaluate.split_generation_id(t(s, d, "all_code").select("id").distinct()),
        # joins and splits
        "quality_join": _quality,
        **{f"pair_filter_{mode}": _pair_filter(mode) for mode in split.MODES},
        "common_indexes": lambda s, d: split.common_indexes(pairs(s, d), *[_latest(t(s, d, "judged")).where(F.col("aspect") == a) for a in ("help", "correct")]),
        "aligned_answers": _aligned,
        "split_80_10_10": lambda s, d: _part_sizes(split.split_train_valid_test(pairs(s, d).select("idx"))),
        "split_995": lambda s, d: _part_sizes(split.split_train_eval(pairs(s, d).select("idx"))),
        "ranking_accuracy": lambda s, d: split.ranking_accuracy(t(s, d, "eval_summary").select(F.col("val_pass1").alias("direct"), F.col("test_pass1").alias("referenced"), F.col("avg_pass_ratio").alias("human"))),
        "train_labels": _tokenised,
        # texts
        "build_prompt": lambda s, d: pairs(s, d).select("idx", X.instruction_prompt("instruction").alias("prompt")),
        "synthesis_prompt": lambda s, d: _samples(s, d).select("idx", X.synthesis_prompt("question").alias("prompt")),
        "judge_prompt": lambda s, d: pairs(s, d).select("idx", X.judge_prompt("correctness", "instruction", "output").alias("prompt")),
        "style_prompt": lambda s, d: pairs(s, d).select("idx", X.style_prompt("referenced", "instruction", "output").alias("prompt")),
        "chat_text": lambda s, d: pairs(s, d).select("idx", X.chat_text("instruction", "output").alias("chat")),
        "chat_format": lambda s, d: pairs(s, d).select("idx", X.conversation("idx", "instruction", "output").alias("c")).select(
            "c.id", F.size("c.conversations").alias("n_turns"), F.col("c.conversations")[0]["value"].alias("human"), F.col("c.conversations")[1]["value"].alias("gpt")
        ),
        "pair_keys": lambda s, d: pairs(s, d).select("idx", X.pair_key("instruction", "output").alias("key")),
        "score_map": _score_map,
        "extract_code": lambda s, d: pairs(s, d).select("idx", X.extract_code("output").alias("code")),
        "clean_code": lambda s, d: pairs(s, d).select("idx", X.clean_code("output").alias("code")),
        "issue_names": lambda s, d: find(s, d).select(X.short_name("check_id").alias("issue"), X.corrected_cwe("check_id", "cwe").alias("cwe")).groupBy("issue").agg(F.count("*").alias("n"), F.count("cwe").alias("n_cwe")),
        "judge_score": lambda s, d: t(s, d, "judged").select("idx", "aspect", X.judge_score("content", "aspect").alias("score")),
        "sample_tests": lambda s, d: _samples(s, d).select("idx", tests_of().alias("tests")),
        "test_functions": lambda s, d: _samples(s, d).where("dataset <> 'mbpp'").select("idx", decoded("input_output")["fn_name"].alias("fn_name")),
        "jsonl_roundtrip": _jsonl_roundtrip,
        "summary_lines": lambda s, d: writing.summary_lines(t(s, d, "eval_summary")),
        # Python source
        "aug_variants": lambda s, d: code_variants(spread(_samples(s, d))),
        "refactor": lambda s, d: refactor(spread(_samples(s, d))).select("idx", "solutions", "code"),
        "scan_code": lambda s, d: scan_code(_python_files(s, d)),
        "aug_kept": lambda s, d: techniques.augmentation(_samples(s, d), order=False).groupBy("transform").agg(F.count("*").alias("n")),
        "cle_split": lambda s, d: findings.split_counts(techniques.cleaning(t(s, d, "all_code").where("path like '%.py'").dropDuplicates(["id"]).select(F.col("id").alias("idx"), F.col("code").alias("solutions")))),
        "evaluate_generations": lambda s, d: techniques.evaluation(_samples(s, d).where("split in ('valid', 'test')"), t(s, d, "all_code").where("path like '%.py'").select("id", "code"), k=5),
        "mi_score": lambda s, d: _python_files(s, d).select("id", score_column("code", maintainability).alias("mi")),
        "lint_rating": lambda s, d: _python_files(s, d).select("id", score_column("code", lint_rating).alias("rating")),
        "mbpp_ratio": _pass_ratios("mbpp"),
        "io_ratio": _pass_ratios("io"),
    }


def oracle_sql() -> dict:
    return {name: sql for name, sql in SQL.items() if name in queries()}
