"""Batch-level comparisons (H1-H9): schemas, distributions, tests, histograms."""

from __future__ import annotations

import math
import sys
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.functions.sqltext import quote
from tidemark.operators.ranks import CELLS, largest_distance

# Ship the tail probability with the plan: workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def extract_schema(profile: DataFrame, rows: DataFrame) -> DataFrame:
    """H1: type and frequency of each field, with the number of records looked at."""
    return profile.join(F.broadcast(rows), "window").selectExpr(
        "window", "field", "type", "present_count / rows AS frequency", "rows AS sample_size"
    )


def compare_schemas(schemas: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """H2: new and missing fields, changed types and changed frequencies, one row per difference."""
    sides = schemas.groupBy("field").agg(
        F.expr("max(named_struct('type', type, 'f', frequency)) FILTER (WHERE window = 'baseline')").alias("b"),
        F.expr("max(named_struct('type', type, 'f', frequency)) FILTER (WHERE window = 'current')").alias("c"),
    )
    shapes = {
        "new_field": ("b IS NULL", "NULL", "c.type"),
        "missing_field": ("c IS NULL", "b.type", "NULL"),
        "type_change": ("b.type <> c.type", "b.type", "c.type"),
        "frequency_change": (f"abs(b.f - c.f) > {tolerance}D", "round(b.f, 6)", "round(c.f, 6)"),
    }
    rows = ", ".join(
        f"CASE WHEN {when} THEN named_struct('change', {quote(change)}, "
        f"'old', CAST({old} AS STRING), 'new', CAST({new} AS STRING)) END"
        for change, (when, old, new) in shapes.items()
    )
    return sides.selectExpr("field", f"inline(array_compact(array({rows})))")


def new_fields(current: DataFrame, baseline_fields: DataFrame) -> DataFrame:
    """H3: fields of the current schema that the baseline list does not have."""
    return current.select("field").join(baseline_fields.select("field"), "field", "left_anti")


def missing_or_rare_fields(current: DataFrame, baseline_fields: DataFrame, threshold: float = 0.9) -> DataFrame:
    """H4: expected fields that are absent or rarer than the threshold."""
    seen = current.select("field", "frequency")
    joined = baseline_fields.select("field").join(seen, "field", "left")
    return joined.selectExpr("field", "coalesce(frequency, 0D) AS frequency").filter(F.col("frequency") < threshold)


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or 1e-300)
        c = b + step / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


@F.arrow_udf(T.DoubleType())
def chi_square_p(statistic: pa.Array, freedom: pa.Array) -> pa.Array:
    """Tail probability of a chi-square statistic; runs on one row per field."""
    pairs = zip(statistic.to_pylist(), freedom.to_pylist())
    return pa.array([_upper_gamma(k / 2, s / 2) if k > 0 else 1.0 for s, k in pairs], pa.float64())


def chi_square(counts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """H6 over value counts: current counts against baseline shares, one row per field.

    With expected counts e = b * C / B the statistic is B/C * sum(c*c/b) - C, so
    one aggregate suffices. A value the baseline never had makes it infinite.
    """
    pairs = counts.filter("value IS NOT NULL").groupBy("field", "value").agg(
        F.expr("coalesce(sum(n) FILTER (WHERE window = 'baseline'), 0)").alias("b"),
        F.expr("coalesce(sum(n) FILTER (WHERE window = 'current'), 0)").alias("c"),
    )
    sums = pairs.groupBy("field").agg(
        F.expr("sum(try_divide(CAST(c AS DOUBLE) * c, b))").alias("squares"),
        F.sum("b").alias("total_b"),
        F.sum("c").alias("total_c"),
        F.expr("count_if(b = 0)").alias("unseen"),
        (F.count("*") - 1).alias("freedom"),
    )
    tested = sums.filter("total_b > 0 AND total_c > 0").selectExpr(
        "field",
        "if(unseen > 0, double('infinity'), greatest(0D, squares * total_b / total_c - total_c)) AS statistic",
        "freedom",
    )
    return tested.withColumn("p_value", chi_square_p("statistic", "freedom")).selectExpr(
        "*", f"p_value < {alpha}D AS drift_detected", f"{alpha}D AS significance_level"
    )


def ks_two_sample(values: DataFrame, thresholds: dict | None = None, cells: int = CELLS) -> DataFrame:
    """H7 over ``window, field, value``: largest distance of the two distribution functions.

    The p-value is the asymptotic series; below 0.01 the severity is WARNING,
    below 0.05 INFO, and drift is detected where both windows have values. More
    ``cells`` spread the ordering of values wider and leave less of it to do.
    """
    limits = {"info_pvalue": 0.05, "warning_pvalue": 0.01, **(thresholds or {})}
    distance = largest_distance(values.filter("value IS NOT NULL"), ["field"], cells).selectExpr(
        "field", "statistic", "total_b AS baseline_n", "total_c AS current_n"
    )
    scaled = distance.selectExpr(
        "*", "sqrt(CAST(baseline_n AS DOUBLE) * current_n / (baseline_n + current_n)) * statistic AS __l"
    )
    series = "aggregate(sequence(1, 100), 0D, (acc, k) -> acc + if(k % 2 = 1, 2D, -2D) * exp(-2D * k * k * __l * __l))"
    tested = scaled.selectExpr(
        "field",
        "statistic",
        "baseline_n",
        "current_n",
        f"if(__l < 0.2, 1D, least(1D, greatest(0D, {series}))) AS p_value",
    )
    return tested.selectExpr(
        "*",
        f"CASE WHEN p_value < {limits['warning_pvalue']} THEN 'WARNING' "
        f"WHEN p_value < {limits['info_pvalue']} THEN 'INFO' ELSE 'NONE' END AS severity",
        f"p_value < {limits['info_pvalue']}D AND baseline_n > 0 AND current_n > 0 AS drift_detected",
        f"{limits['info_pvalue']}D AS significance_level",
    )


def histogram_compare(values: DataFrame, bins: int = 50) -> DataFrame:
    """H8: rows of both windows per equal-width bin between the common extremes."""
    numbers = values.filter("value IS NOT NULL")
    extremes = numbers.groupBy("field").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    # One row per configured field.
    placed = numbers.join(F.broadcast(extremes), "field").selectExpr(
        "field",
        "window",
        "low",
        "(high - low) / {0} AS width".format(bins),
        f"if(high = low, 1, least({bins}, CAST(floor((value - low) / (high - low) * {bins}) AS INT) + 1)) AS bin",
    )
    return (
        placed.groupBy("field", "bin")
        .agg(
            F.expr("min(low + (bin - 1) * width)").alias("lower"),
            F.expr("count_if(window = 'baseline')").alias("baseline_n"),
            F.expr("count_if(window = 'current')").alias("current_n"),
        )
    )


def histogram_test(histograms: DataFrame, alpha: float = 0.05) -> DataFrame:
    """H9 over ``histogram_compare``: two-sample chi-square test of the bins, one row per field.

    Both windows are samples here, so a bin the baseline never had counts with what
    it holds. Fields without values in one window are left out.
    """
    totals = histograms.groupBy("field").agg(F.sum("baseline_n").alias("total_b"), F.sum("current_n").alias("total_c"), F.collect_list(
        F.struct(F.col("baseline_n").cast("double").alias("b"), F.col("current_n").cast("double").alias("c"))
    ).alias("bins"))
    # Bins are few and bounded; the order of the sum is fixed.
    tested = totals.filter("total_b > 0 AND total_c > 0").selectExpr(
        "field",
        "aggregate(array_sort(bins), 0D, (acc, x) -> acc + "
        "power(x.b * sqrt(total_c / total_b) - x.c * sqrt(total_b / total_c), 2) / (x.b + x.c)) AS statistic",
        "CAST(size(bins) - 1 AS BIGINT) AS freedom",
    )
    return tested.withColumn("p_value", chi_square_p("statistic", "freedom")).selectExpr(
        "*", f"p_value < {alpha}D AS drift_detected", f"{alpha}D AS significance_level"
    )


def schema_drift_failures(differences: DataFrame, severity: str = "WARN") -> DataFrame:
    """H9: schema differences as failure rows, so that they can join other results."""
    return differences.filter("change <> 'frequency_change'").selectExpr(
        "concat('drift.schema.', change, '.', field) AS check_name",
        "field AS field_path",
        "'schema_drift' AS check_type",
        f"{quote(severity)} AS severity",
        "concat('Schema drift: ', change) AS error_message",
        "old AS expected_value",
        "new AS actual_value",
    )


def distribution_drift_failures(
    tests: DataFrame, severity: str = "WARN", ks: DataFrame | None = None, histograms: DataFrame | None = None
) -> DataFrame:
    """H9: failed distribution tests as failure rows: chi-square (H6), Kolmogorov-Smirnov (H7), histograms (H8).

    The chi-square checks are named after their field, the others after test and field.
    """
    kinds = [("", tests), ("ks.", ks), ("histogram.", None if histograms is None else histogram_test(histograms))]
    verdicts = [
        t.selectExpr(f"{quote(kind)} AS kind", "field", "p_value", "drift_detected", "significance_level")
        for kind, t in kinds if t is not None
    ]
    return reduce(DataFrame.unionByName, verdicts).filter("drift_detected").selectExpr(
        "concat('drift.distribution.', kind, field) AS check_name",
        "field AS field_path",
        "'distribution_drift' AS check_type",
        f"{quote(severity)} AS severity",
        "'Distribution drift' AS error_message",
        "concat('p >= ', significance_level) AS expected_value",
        "concat('p = ', round(p_value, 6)) AS actual_value",
    )
