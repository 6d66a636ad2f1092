"""Roll-ups of static-analysis findings.

``findings`` is (path, check_id, severity, category, cwe array, owasp array, impact, confidence), one
row per finding, repeats included; ``errors`` and ``scanned`` are (path) tables. A null path belongs
to no file. Every result is a small table keyed by its labels; counts are pre-aggregated where they
are read, so no label is a hot spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernlab.functions.text import short_name

SEVERITIES = ("INFO", "WARNING", "ERROR")
TOP = 5


def category_or_security() -> Column:
    """A finding's category; security where it has none but a CWE; else null."""
    return F.coalesce("category", F.when(F.size("cwe") > 0, F.lit("security")))


def error_files(errors: DataFrame) -> DataFrame:
    return errors.where("path is not null").select("path").distinct()


def defective_files(findings: DataFrame, errors: DataFrame) -> DataFrame:
    """(path) with a finding and no error."""
    return findings.where("path is not null").select("path").distinct().join(error_files(errors), "path", "left_anti")


def findings_without_errors(findings: DataFrame, errors: DataFrame) -> DataFrame:
    """The findings in files without an error, as often as they were reported."""
    return findings.join(error_files(errors), "path", "left_anti")


def split_three_way(files: DataFrame, findings: DataFrame, errors: DataFrame) -> DataFrame:
    """``files`` with ``bucket``: syntax_error, defective or clean; an error outweighs findings."""
    bad = error_files(errors).withColumn("_e", F.lit(True))
    found = findings.where("path is not null").select("path").distinct().withColumn("_f", F.lit(True))
    return (
        files.join(bad, "path", "left").join(found, "path", "left")
        .withColumn("bucket", F.when(F.col("_e"), "syntax_error").when(F.col("_f"), "defective").otherwise("clean"))
        .drop("_e", "_f")
    )


def split_counts(split: DataFrame) -> DataFrame:
    return split.groupBy("bucket").agg(F.count("*").alias("n"))


def count_by(findings: DataFrame, column: Column | str, name: str) -> DataFrame:
    """(name, n) of the labels that aren't null."""
    c = F.col(column) if isinstance(column, str) else column
    return findings.select(c.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))


def severity_counts(findings: DataFrame) -> DataFrame:
    return count_by(findings, "severity", "severity")


def category_counts(findings: DataFrame) -> DataFrame:
    return count_by(findings, category_or_security(), "category")


def severity_by_category(findings: DataFrame) -> DataFrame:
    """(severity, category, n, percent): every combination of the labels that occur, percent of the severity's row."""
    counts = findings.where("severity is not null and category is not null").groupBy("severity", "category").agg(F.count("*").alias("n"))
    labels = findings.groupBy("severity", "category").agg(F.lit(0).alias("n")).agg(F.collect_set("severity").alias("s"), F.collect_set("category").alias("c"))
    frame = labels.select(F.explode("s").alias("severity"), "c").select("severity", F.explode("c").alias("category"))
    total = F.sum("n").over(Window.partitionBy("severity"))
    return (
        frame.join(counts, ["severity", "category"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("percent", F.when(total > 0, F.col("n") * 100.0 / total).otherwise(0.0))
    )


def _top_with_others(counts: DataFrame, keys: list[str], label: str, top: int) -> DataFrame:
    """(keys, place, label, n, percent) of (keys, label, n): the most frequent by group, ties by label, the others as one row."""
    group = Window.partitionBy(*[F.col(k) for k in keys]) if keys else Window.partitionBy(F.lit(0))
    placed = counts.withColumns({"place": F.row_number().over(group.orderBy(F.desc("n"), F.asc(label))), "_total": F.sum("n").over(group)})
    folded = placed.select(*keys, "_total", "n", F.least("place", F.lit(top + 1)).alias("place"), F.when(F.col("place") > top, "OTHERS").otherwise(F.col(label)).alias(label))
    return (
        folded.groupBy(*keys, "place", label).agg(F.sum("n").alias("n"), F.max("_total").alias("_total"))
        .where(F.col("n") > 0)
        .select(*keys, "place", label, "n", (F.col("n") * 100.0 / F.col("_total")).alias("percent"))
    )


def top_issues(findings: DataFrame, top: int = TOP) -> DataFrame:
    """The most frequent issue names of each category but security."""
    named = findings.where("category is not null and category <> 'security'").select("category", short_name("check_id").alias("issue"))
    return _top_with_others(named.groupBy("category", "issue").agg(F.count("*").alias("n")), ["category"], "issue", top)


def top_issues_by_severity(findings: DataFrame, top: int = TOP) -> DataFrame:
    """The most frequent issue names of each severity and category but security; combinations without any don't show."""
    named = findings.where("severity is not null and category is not null and category <> 'security'").select("severity", "category", short_name("check_id").alias("issue"))
    return _top_with_others(named.groupBy("severity", "category", "issue").agg(F.count("*").alias("n")), ["severity", "category"], "issue", top)


def security_findings(findings: DataFrame) -> DataFrame:
    """The findings of category security or of none."""
    return findings.where("category is null or category = 'security'")


def counts_of_labels(findings: DataFrame, column: str) -> DataFrame:
    """(label, n) of a list column, e.g. cwe or owasp: every entry counts."""
    return count_by(findings, F.explode(column), "label")


def cwe_by_severity(findings: DataFrame) -> DataFrame:
    """(cwe, INFO, WARNING, ERROR, total) of the security findings; other severities don't count."""
    entries = security_findings(findings).where(F.col("severity").isin(*SEVERITIES)).select(F.explode("cwe").alias("cwe"), "severity")
    sums = [F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in SEVERITIES]
    return entries.where("cwe is not null").groupBy("cwe").agg(*sums, F.count("*").alias("total"))


def top_cwe(findings: DataFrame, top: int = TOP) -> DataFrame:
    """(place, label, n, percent) of the CWEs of the security findings."""
    return _top_with_others(counts_of_labels(security_findings(findings), "cwe"), [], "label", top)


def rates(files: DataFrame, findings: DataFrame, errors: DataFrame) -> DataFrame:
    """One row of percentages of the scanned files; 0 where nothing was scanned."""
    buckets = split_three_way(files.select("path").distinct(), findings, errors).groupBy("bucket").agg(F.count("*").alias("n"))
    issues = findings.agg(F.count("*").alias("n")).select(F.lit("issues").alias("bucket"), "n")
    of = lambda b: F.coalesce(F.sum(F.when(F.col("bucket") == b, F.col("n"))), F.lit(0)).alias(b)
    counted = buckets.unionByName(issues).agg(*[of(b) for b in ("defective", "syntax_error", "clean", "issues")])
    counted = counted.withColumn("scanned", F.col("defective") + F.col("syntax_error") + F.col("clean"))
    share = lambda c: F.when(F.col("scanned") > 0, F.col(c) * 100.0 / F.col("scanned")).otherwise(0.0)
    return counted.select(
        "scanned", "issues", share("defective").alias("defective_rate"), share("syntax_error").alias("error_rate"), share("issues").alias("issue_rate"), share("clean").alias("clean_rate")
    )


def label_rates(findings: DataFrame, column: Column | str, name: str) -> DataFrame:
    """(name, n, percent) of a label, percent of all findings."""
    c = F.col(column) if isinstance(column, str) else column
    counts = findings.select(c.alias(name)).groupBy(name).agg(F.count("*").alias("n"))
    every = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select(name, "n", (F.col("n") * 100.0 / every).alias("percent")).where(F.col(name).isNotNull())


def domains(findings: DataFrame) -> DataFrame:
    """(field, value): the distinct labels that occur, list entries each."""
    parts = [findings.select(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("severity", "category", "impact", "confidence")]
    parts += [findings.select(F.lit(f).alias("field"), F.explode(f).alias("value")) for f in ("cwe", "owasp")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("value is not null").distinct()


def line_lists(paths: DataFrame) -> DataFrame:
    """(idx) of (n): 1-based sample numbers to 0-based ones; null numbers are left out."""
    return paths.where("n is not null").select((F.col("n") - 1).alias("idx")).distinct()
