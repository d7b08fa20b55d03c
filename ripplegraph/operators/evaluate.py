"""Scores of review candidates against expected sets.

Only must_review and should_review count, on both sides. Empty denominators give 1, the ratio 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of the release gate, case categories, fields that no report may hold.
MIN_RECALL, MIN_PRECISION, MAX_VISIBLE, MAX_RATIO = 0.90, 0.70, 50, 2.0
MIN_CASES, MAX_CASES, MIN_DIFFERENT = 20, 30, 20
CATEGORIES = ("golden", "evaluation", "holdout")
FORBIDDEN_FIELDS = ("confidence", "llm_judgement")
VISIBLE = ("must_review", "should_review")


def _share(part: Column, whole: Column, empty: float = 1.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def _flags(df: DataFrame, level: str, prefix: str, *more: Column) -> DataFrame:
    """One row per case and artifact with its levels as flags."""
    has = lambda v: F.max((F.col(level) == v).cast("int")).alias(f"{prefix}_{v}")
    return df.where(F.col(level).isin(*VISIBLE)).groupBy("case_id", "artifact_id").agg(*map(has, VISIBLE), *more)


def _matched(expected: DataFrame, actual: DataFrame) -> DataFrame:
    grounded = (F.coalesce(F.size("evidence_ids"), F.lit(0)) > 0) | F.coalesce(F.col("relation_distance") == 0, F.lit(False))
    e = _flags(expected, "level", "e")
    a = _flags(actual, "review_priority", "a", F.count("*").alias("rows"), F.sum(grounded.cast("int")).alias("grounded"))
    return e.join(a, ["case_id", "artifact_id"], "full_outer").fillna(0)


def case_metrics(expected: DataFrame, actual: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """One row of metrics per case.

    expected: case_id, artifact_id, level; actual: case_id, artifact_id, review_priority, relation_distance, evidence_ids.
    A candidate is grounded if it has evidence or is the change itself (distance 0). Cases without any row count if `cases`
    (case_id) names them.
    """
    every = expected.select("case_id").unionByName(actual.select("case_id"))
    if cases is not None:
        every = every.unionByName(cases.select("case_id"))
    wanted, shown = ((F.col(f"{p}_must_review") + F.col(f"{p}_should_review")) > 0 for p in "ea")
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    both = lambda k: (F.col(f"e_{k}") > 0) & (F.col(f"a_{k}") > 0)
    g = (
        every.distinct()
        .join(_matched(expected, actual), "case_id", "left")
        .groupBy("case_id")
        .agg(
            n(F.col("e_must_review")).alias("must"),
            n(both("must_review")).alias("must_hit"),
            n(F.col("e_should_review")).alias("should"),
            n(both("should_review")).alias("should_hit"),
            n(wanted).alias("wanted"),
            n(shown).alias("shown"),
            n(wanted & shown).alias("hit"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("report_size"),
            F.coalesce(F.sum("grounded"), F.lit(0)).alias("grounded"),
        )
    )
    precision, coverage = _share(F.col("hit"), F.col("shown")), _share(F.col("grounded"), F.col("report_size"))
    return g.select(
        "case_id",
        _share(F.col("must_hit"), F.col("must")).alias("must_review_recall"),
        _share(F.col("should_hit"), F.col("should")).alias("should_review_recall"),
        (F.col("must") - F.col("must_hit")).alias("missed_critical_impacts"),
        coverage.alias("evidence_coverage"),
        coverage.alias("evidence_accuracy"),
        F.lit(1.0).alias("alias_resolution_accuracy"),
        precision.alias("relation_precision"),
        _share(F.col("hit"), F.col("wanted")).alias("relation_recall"),
        "report_size",
        precision.alias("visible_precision"),
        _share(F.col("shown"), F.col("wanted"), 0.0).alias("candidate_expansion_ratio"),
    )


def missed_must(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(case_id, artifact_id) of expected must-review artifacts that are not shown as such."""
    return _matched(expected, actual).where("e_must_review > 0 and a_must_review = 0").select("case_id", "artifact_id")


def dataset_metrics(expected: DataFrame, actual: DataFrame, cases: DataFrame, categories: tuple[str, ...] = ()) -> DataFrame:
    """Metrics of the cases (case_id, category, ...) of the given categories, all if none is given."""
    chosen = cases.where(F.col("category").isin(*categories)) if categories else cases
    return chosen.join(case_metrics(expected, actual, chosen), "case_id")


def release_gate(metrics: DataFrame, expected: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """One row of totals and checks over the cases of E2 (with category and change_id), and the status.

    Averages are over evaluation cases, 0 without any; expected sets are told apart by content. reports: report.
    """
    judged = F.col("category") == "evaluation"
    mean = lambda c, where: F.coalesce(F.avg(F.when(where, F.col(c))), F.lit(0.0))
    totals = metrics.agg(
        F.count("*").alias("case_count"),
        *[F.sum((F.col("category") == c).cast("int")).alias(c) for c in CATEGORIES],
        mean("must_review_recall", judged).alias("must_review_recall"),
        mean("visible_precision", judged).alias("visible_precision"),
        mean("evidence_coverage", F.lit(True)).alias("evidence_coverage"),
        F.coalesce(F.max("report_size"), F.lit(0)).alias("max_report_size"),
        F.coalesce(F.max("candidate_expansion_ratio"), F.lit(0.0)).alias("max_expansion_ratio"),
        F.count_distinct("change_id").alias("unique_changes"),
    ).fillna(0, list(CATEGORIES))
    sets = expected_set_hash(expected.join(metrics.select("case_id"), "case_id", "left_semi")).agg(F.count_distinct("oracle_hash").alias("unique_expected"))
    row = totals.crossJoin(sets)  # one-row tables
    checks = {
        "case_count_20_to_30": F.col("case_count").between(MIN_CASES, MAX_CASES),
        **{f"{c}_cases_present": F.col(c) > 0 for c in CATEGORIES},
        "evaluation_must_review_recall_at_least_90_percent": F.col("must_review_recall") >= MIN_RECALL,
        "evaluation_visible_precision_at_least_70_percent": F.col("visible_precision") >= MIN_PRECISION,
        "evidence_coverage_is_100_percent": F.col("evidence_coverage") == 1.0,
        "visible_candidate_count_at_most_50": F.col("max_report_size") <= MAX_VISIBLE,
        "candidate_expansion_ratio_at_most_2": F.col("max_expansion_ratio") <= MAX_RATIO,
        "unique_changes_at_least_20": F.col("unique_changes") >= MIN_DIFFERENT,
        "unique_expected_at_least_20": F.col("unique_expected") >= MIN_DIFFERENT,
    }
    if reports is not None:
        for field in FORBIDDEN_FIELDS:
            row = row.crossJoin(field_is_absent(reports, field).withColumnRenamed("absent", f"no_{field}_field"))
            checks[f"no_{field}_field"] = F.col(f"no_{field}_field")
    row = row.withColumns(checks)
    passed = None
    for name in checks:
        passed = F.col(name) if passed is None else passed & F.col(name)
    return row.withColumn("status", F.when(passed, "pass").otherwise("fail"))


def expected_set_hash(expected: DataFrame) -> DataFrame:
    """(case_id, oracle_hash): content of an expected set, whatever its order and case id.

    Hashes of the rows are added up (as numbers of 128 bits in two parts), so no set is gathered in one row.
    """
    rows = expected.select("case_id", "level", "artifact_id").distinct()
    h = F.md5(F.to_json(F.struct("level", "artifact_id")))
    part = lambda i: F.sum(F.conv(F.substring(h, i, 16), 16, 10).cast("decimal(38,0)"))
    return rows.groupBy("case_id").agg(F.concat_ws(".", part(1), part(17), F.count("*")).alias("oracle_hash"))


def distinct_expected_sets(expected: DataFrame) -> DataFrame:
    """How many different expected sets there are."""
    return expected_set_hash(expected).agg(F.count_distinct("oracle_hash").alias("expected_sets"))


def field_is_absent(reports: DataFrame, field: str) -> DataFrame:
    """E5: whether no report text (report) holds a field."""
    return reports.agg(F.coalesce(F.bool_and(~F.col("report").contains(f'"{field}"')), F.lit(True)).alias("absent"))
