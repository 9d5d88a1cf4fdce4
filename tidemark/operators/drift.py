"""Drift detectors over profile tables.

A detector folds the baseline and the current row of each key side by side
with one conditional aggregate - a full outer join without a second pass over
the profile - and derives its findings from the folded row. Comparisons that
found nothing carry severity ``NONE``; they count as checks and are dropped
unless ``include_stable`` is asked for.
"""

from __future__ import annotations

from copy import deepcopy
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.paths import Fields, flatten_document
from tidemark.functions.sqltext import case, name, quote
from tidemark.operators import profiles
from tidemark.operators.validate import timestamp_sql
from tidemark.session import landed
from tidemark.operators.windows import TimeWindow, drift_windows, gate, tag_windows, window_counts

# Default windows, thresholds, targets and profile limits of a run.
DEFAULTS = {
    "windowing": {"baseline": {"days": 7}, "current": {"hours": 24}, "gap_hours": 0},
    "thresholds": {
        "schema": {"cardinality_warning_ratio": 2.0, "cardinality_critical_ratio": 5.0},
        "distribution": {
            "psi": {"info": 0.1, "warning": 0.25},
            "ks_test": {"info_pvalue": 0.05, "warning_pvalue": 0.01},
            "null_ratio_change": {"warning": 0.1, "critical": 0.25},
        },
        "volume": {
            "z_score": {"info": 2.0, "warning": 3.0},
            "percent_change": {"info": 0.20, "warning": 0.50},
        },
    },
    "targets": {
        "schema_drift": {
            "enabled": True,
            "check_field_additions": True,
            "check_field_removals": True,
            "check_type_changes": True,
            "check_cardinality": True,
        },
        "distribution_drift": {
            "enabled": True,
            "categorical_fields": ["type", "actor.login", "repo.name"],
            "numerical_fields": ["payload.size"],
            "check_null_ratios": True,
        },
        "volume_drift": {
            "enabled": True,
            "check_global_volume": True,
            "check_per_entity_volume": True,
            "top_n_entities": 50,
        },
    },
    "profiling": {"min_sample_size": 100, "max_cardinality_track": 1000, "categorical_max_categories": 100},
}


def drift_config(overrides: dict | None = None) -> dict:
    """The defaults with a partial configuration laid over them."""

    def merge(base: dict, extra: dict) -> dict:
        for key, value in extra.items():
            base[key] = merge(base[key], value) if isinstance(value, dict) and isinstance(base.get(key), dict) else value
        return base

    return merge(deepcopy(DEFAULTS), overrides or {})


COMPARISON = [
    "drift_type",
    "entity",
    "field_name",
    "metric_name",
    "baseline_value",
    "current_value",
    "drift_score",
    "severity",
    "metadata",
    "checks",
]


def _comparison(
    drift_type: str,
    entity: str,
    field: str,
    metric: str,
    baseline: str,
    current: str,
    score: str,
    severity: str,
    metadata: dict[str, str],
    checks: str,
) -> list[str]:
    """Select list of one comparison; ``metadata`` maps keys to expressions."""
    members = ", ".join(f"{quote(k)}, {v}" for k, v in metadata.items())
    parts = [
        quote(drift_type),
        entity,
        field,
        quote(metric),
        f"CAST({baseline} AS STRING)",
        f"CAST({current} AS STRING)",
        f"if({severity} = 'NONE', 0D, CAST({score} AS DOUBLE))",
        severity,
        f"to_json(named_struct({members}))",
        f"CAST({checks} AS BIGINT)",
    ]
    return [f"{sql} AS {column}" for sql, column in zip(parts, COMPARISON)]


def _fold(profile: DataFrame, key: list[str]) -> DataFrame:
    """One row per key with the structs ``b`` (baseline) and ``c`` (current), NULL where absent."""
    members = ", ".join(c for c in profile.columns if c != "window" and c not in key)
    side = "max(named_struct({})) FILTER (WHERE window = '{}')"
    packed = ", ".join(f"'{c}', {c}" for c in members.split(", "))
    return profile.groupBy(*key).agg(
        F.expr(side.format(packed, "baseline")).alias("b"), F.expr(side.format(packed, "current")).alias("c")
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def schema_comparisons(profile: DataFrame, thresholds: dict | None = None, flags: dict | None = None) -> DataFrame:
    """G3-G6 over a schema profile of both windows."""
    limits = {**DEFAULTS["thresholds"]["schema"], **(thresholds or {})}
    flags = {**DEFAULTS["targets"]["schema_drift"], **(flags or {})}
    low, high = limits["cardinality_warning_ratio"], limits["cardinality_critical_ratio"]
    ratio = "(c.cardinality / b.cardinality)"
    grown = case([(f"{ratio} >= {high}", "'CRITICAL'"), (f"{ratio} >= {low}", "'WARNING'")], "'NONE'")

    def record(when, metric, baseline, current, score, severity, metadata, checks):
        named = [part.rsplit(" AS ", 1) for part in _comparison(
            "schema", "'schema'", "field", metric, baseline, current, score, severity, metadata, checks
        )]
        return f"CASE WHEN {when} THEN named_struct({', '.join(f'{quote(c)}, {sql}' for sql, c in named)}) END"

    both = "b IS NOT NULL AND c IS NOT NULL"
    added = "if(c.nullable, 'INFO', 'WARNING')" if flags["check_field_additions"] else "'NONE'"
    removed = "'CRITICAL'" if flags["check_field_removals"] else "'NONE'"
    grown = grown if flags["check_cardinality"] else "'NONE'"
    changed = "if(b.type <> c.type, 'CRITICAL', 'NONE')" if flags["check_type_changes"] else "'NONE'"
    records = [
        record(
            "b IS NULL", "field_added", "NULL", "to_json(c)", "if(c.nullable, 0.5, 0.8)", added,
            {"change_type": "'addition'", "nullable": "c.nullable", "type": "c.type"}, "1",
        ),
        record(
            "c IS NULL", "field_removed", "to_json(b)", "NULL", "1", removed,
            {
                "change_type": "'removal'",
                "baseline_type": "b.type",
                "baseline_presence_ratio": "b.presence_ratio",
            },
            "1",
        ),
        record(
            both, "type_change", "b.type", "c.type", "1", changed,
            {"change_type": "'type_mutation'", "from_type": "b.type", "to_type": "c.type"}, "2",
        ),
        record(
            f"{both} AND b.cardinality > 0 AND c.cardinality > 0", "cardinality_explosion",
            "b.cardinality", "c.cardinality", f"if({grown} = 'CRITICAL', least(1D, {ratio} / 10), {ratio} / 10)", grown,
            {
                "change_type": "'cardinality_increase'",
                "ratio": f"round({ratio}, 2)",
                "baseline_cardinality": "b.cardinality",
                "current_cardinality": "c.cardinality",
            },
            "0",
        ),
    ]
    return _fold(profile, ["field"]).selectExpr(f"inline(array_compact(array({', '.join(records)})))")


def psi_comparisons(categories: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """G7 over distributions: population stability index of fields profiled in both windows.

    The distribution texts hold at most the profile's category limit per field.
    """
    limits = {**DEFAULTS["thresholds"]["distribution"]["psi"], **(thresholds or {})}
    pairs = categories.groupBy("field", "value").agg(
        F.expr("max(proportion) FILTER (WHERE window = 'baseline')").alias("b"),
        F.expr("max(proportion) FILTER (WHERE window = 'current')").alias("c"),
    )
    floor_b, floor_c = "greatest(coalesce(b, 0D), 1e-10D)", "greatest(coalesce(c, 0D), 1e-10D)"
    listed = "array_sort(collect_list(if({0} IS NULL, NULL, named_struct('p', -{0}, 'value', value))))"
    scored = pairs.groupBy("field").agg(
        F.expr(f"abs(sum(({floor_c} - {floor_b}) * ln({floor_c} / {floor_b})))").alias("psi"),
        F.count("b").alias("nb"),
        F.count("c").alias("nc"),
        F.expr(listed.format("b")).alias("lb"),
        F.expr(listed.format("c")).alias("lc"),
    )
    graded = case(
        [
            ("nb = 0 OR nc = 0", "'NONE'"),
            (f"psi >= {limits['warning']}", "'CRITICAL'"),
            (f"psi >= {limits['info']}", "'WARNING'"),
        ],
        "'NONE'",
    )
    as_map = "map_from_entries(transform({}, e -> struct(e.value, -e.p)))"
    return scored.selectExpr(
        *_comparison(
            "distribution", "'categorical'", "field", "psi",
            f"to_json({as_map.format('lb')})", f"to_json({as_map.format('lc')})",
            f"if({graded} = 'CRITICAL', least(1D, psi / 0.5D), psi / 0.5D)", graded,
            {
                "psi_score": "round(psi, 4)",
                "baseline_top_values": as_map.format("slice(lb, 1, 5)"),
                "current_top_values": as_map.format("slice(lc, 1, 5)"),
            },
            "if(nb > 0, 1, 0)",
        ),
        "if(nb > 0 AND nc > 0, psi, NULL) AS measure",
    )


def top_values(categories: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` largest proportions of each distribution."""
    order = Window.partitionBy("window", "field").orderBy(F.col("proportion").desc(), "value")
    ranked = categories.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return ranked.select("window", "field", "value", "proportion", "rank")


def mean_shift_comparisons(numbers: DataFrame) -> DataFrame:
    """G9 on the rounded statistics: shift of the mean in baseline deviations."""
    shift = "if(b.std > 0, abs(c.mean - b.mean) / b.std, 0D)"
    # Steps of the shift, in standard deviations.
    graded = case(
        [
            ("b IS NULL OR c IS NULL", "'NONE'"),
            (f"{shift} >= 3", "'CRITICAL'"),
            (f"{shift} >= 2", "'WARNING'"),
            (f"{shift} >= 1", "'INFO'"),
        ],
        "'NONE'",
    )
    return _fold(numbers, ["field"]).selectExpr(
        *_comparison(
            "distribution", "'numerical'", "field", "mean_shift", "to_json(b)", "to_json(c)",
            f"least(1D, {shift} / 5)", graded,
            {
                "mean_shift_std_units": f"round({shift}, 2)",
                "baseline_mean": "b.mean",
                "current_mean": "c.mean",
                "baseline_std": "b.std",
            },
            "if(b IS NOT NULL, 1, 0)",
        ),
        f"if(b IS NOT NULL AND c IS NOT NULL, {shift}, NULL) AS measure",
    )


def null_ratio_comparisons(ratios: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """Absolute change of the null ratio."""
    limits = {**DEFAULTS["thresholds"]["distribution"]["null_ratio_change"], **(thresholds or {})}
    change = "abs(c.null_ratio - b.null_ratio)"
    graded = case(
        [(f"{change} >= {limits['critical']}", "'CRITICAL'"), (f"{change} >= {limits['warning']}", "'WARNING'")],
        "'NONE'",
    )
    return _fold(ratios, ["field"]).selectExpr(
        *_comparison(
            "distribution", "'null_ratio'", "field", "null_ratio_change", "b.null_ratio", "c.null_ratio",
            f"if({graded} = 'CRITICAL', least(1D, {change} / 0.5D), {change} / 0.5D)", graded,
            {
                "absolute_change": f"round({change}, 4)",
                "baseline_null_ratio": "round(b.null_ratio, 4)",
                "current_null_ratio": "round(c.null_ratio, 4)",
            },
            "0",
        ),
        f"{change} AS measure",
    )


def global_rate_comparison(
    counts: DataFrame,
    baseline: TimeWindow,
    current: TimeWindow,
    thresholds: dict | None = None,
    history: DataFrame | None = None,
) -> DataFrame:
    """G11, and G12 when ``history`` (one row ``n`` per earlier window) is given.

    Without a usable history the deviation is taken as a tenth of the baseline
    rate. Every historic count is divided by the baseline's duration.
    """
    limits = {**DEFAULTS["thresholds"]["volume"], **(thresholds or {})}
    z_low, z_high = limits["z_score"]["info"], limits["z_score"]["warning"]
    p_low, p_high = limits["percent_change"]["info"], limits["percent_change"]["warning"]
    rates = counts.selectExpr(
        "baseline_rows",
        "current_rows",
        f"baseline_rows / {baseline.hours}D AS b",
        f"current_rows / {current.hours}D AS c",
    )
    if history is None:
        rates = rates.selectExpr("*", "b AS mean_rate", "b * 0.1D AS std_rate")
    else:
        past = history.agg(
            F.struct(F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.count("*").alias("periods")).alias("p")
        )
        rates = rates.withColumn("past", past.scalar()).selectExpr(
            "*",
            f"if(past.periods > 1, past.mean / {baseline.hours}D, b) AS mean_rate",
            f"if(past.periods > 1 AND past.std > 0, past.std / {baseline.hours}D, b * 0.1D) AS std_rate",
        )
    measured = rates.selectExpr(
        "*",
        "if(std_rate > 0, (c - mean_rate) / std_rate, 0D) AS z",
        "if(b > 0, (c - b) / b, 0D) AS pct",
    )
    graded = case(
        [
            (f"abs(z) >= {z_high} OR abs(pct) >= {p_high}", "'CRITICAL'"),
            (f"abs(z) >= {z_low} OR abs(pct) >= {p_low}", "'WARNING'"),
        ],
        "'NONE'",
    )
    return measured.selectExpr(
        *_comparison(
            "volume", "'global'", "CAST(NULL AS STRING)", "event_rate_change", "b", "c",
            f"if({graded} = 'CRITICAL', least(1D, abs(z) / 5), abs(z) / 5)", graded,
            {
                "z_score": "round(z, 2)",
                "percent_change": "round(pct * 100, 2)",
                "direction": "if(c > b, 'increase', 'decrease')",
                "baseline_total": "baseline_rows",
                "current_total": "current_rows",
                "baseline_rate_per_hour": "round(b, 2)",
                "current_rate_per_hour": "round(c, 2)",
            },
            "1",
        ),
        "z AS measure",
    )


def history_counts(df: DataFrame, ts: str, baseline: TimeWindow, periods: int) -> DataFrame:
    """Row counts ``n`` of the ``periods`` windows of the baseline's length that precede it."""
    length = baseline.end - baseline.start
    start = baseline.start - length * periods
    past = TimeWindow(start, baseline.start)
    seconds = int(length.total_seconds())
    offset = f"CAST((unix_micros(CAST({ts} AS TIMESTAMP)) - unix_micros({timestamp_sql(start)})) / 1000000 AS BIGINT)"
    return (
        past.of(df, ts)
        .groupBy(F.expr(f"{offset} DIV {seconds}").alias("period"))
        .agg(F.count("*").alias("n"))
    )


def entity_comparisons(
    entities: DataFrame,
    thresholds: dict | None = None,
    normalize: tuple[float, float] | None = None,
) -> DataFrame:
    """Change of each entity that is among the top of both windows.

    Raw counts are compared; ``normalize=(baseline_hours, current_hours)``
    compares hourly rates instead.
    """
    limits = {**DEFAULTS["thresholds"]["volume"]["percent_change"], **(thresholds or {})}
    b, c = ("b.n", "c.n") if normalize is None else (f"(b.n / {normalize[0]}D)", f"(c.n / {normalize[1]}D)")
    change = f"(({c} - {b}) / {b})"
    graded = case(
        [
            (f"abs({change}) >= {limits['warning']}", "'WARNING'"),
            (f"abs({change}) >= {limits['info']}", "'INFO'"),
        ],
        "'NONE'",
    )
    return _fold(entities, ["field", "value"]).selectExpr(
        *_comparison(
            "volume", "field", "value", "entity_count_change", "b.n", "c.n",
            f"if({graded} = 'WARNING', least(1D, abs({change})), abs({change}))", graded,
            {
                "percent_change": f"round({change} * 100, 2)",
                "direction": "if(c.n > b.n, 'increase', 'decrease')",
                "baseline_count": "b.n",
                "current_count": "c.n",
            },
            # One check per entity dimension of the baseline: counted on its first entity.
            "if(b.rank = 1, 1, 0)",
        ),
        f"{change} AS measure",
    )


def compare_windows(
    df: DataFrame,
    as_of: datetime | str,
    fields: Fields,
    leaves=None,
    *,
    ts: str = "ts",
    config: dict | None = None,
    normalize_entities: bool = False,
) -> DataFrame:
    """Every comparison of the enabled detectors, gated by G2.

    ``leaves`` turns the tagged rows into flattened leaves (see ``flatten_table``);
    documents are flattened by default.

    The source is read twice. One pass lands the configured fields of both
    windows as typed columns, when the plan is built; row counts, distributions,
    statistics, null ratios, entities and the gate derive from these. Of fields
    with many values only candidates for the top are exchanged. The other pass
    profiles the leaves.
    """
    config = drift_config(config)
    windowing, limits, targets = config["windowing"], config["thresholds"], config["targets"]
    baseline, current = drift_windows(
        as_of, windowing["current"]["hours"], windowing["baseline"]["days"], windowing.get("gap_hours", 0)
    )
    tagged = tag_windows(df, ts, baseline, current)
    profiling = config["profiling"]
    dist, vol, sch = targets["distribution_drift"], targets["volume_drift"], targets["schema_drift"]
    if not (sch["enabled"] or dist["enabled"] or vol["enabled"]):
        raise ValueError("every detector is switched off")
    categorical = dist["categorical_fields"] if dist["enabled"] or vol["enabled"] else []
    numeric = dist["numerical_fields"] if dist["enabled"] else []
    chosen = profiles.Targets(fields, categorical, numeric, ts)
    narrow = landed(chosen.read(tagged))
    if leaves is None:

        def leaves(rows: DataFrame) -> DataFrame:
            return flatten_document(rows.selectExpr("window", name(ts), name(fields.doc)), fields.doc)

    parts = []
    if sch["enabled"]:
        profile = profiles.schema_profile(
            leaves(tagged), profiles.row_counts(narrow), profiling["max_cardinality_track"], ts
        )
        parts.append(schema_comparisons(profile, limits["schema"], sch))
    values, most = None, profiling["categorical_max_categories"]
    if categorical:
        values = chosen.text_values(narrow)
        summaries = profiles.value_summaries(values, vol["top_n_entities"], most)
    if dist["enabled"]:
        if values is not None:
            categories = profiles.categorical_profile(profiles.counts_of_narrow(values, summaries, most, ts), most)
            parts.append(psi_comparisons(categories, limits["distribution"]["psi"]))
        if numeric:
            parts.append(mean_shift_comparisons(profiles.numeric_profile(chosen.numeric_values(narrow))))
        if dist["check_null_ratios"] and (categorical or numeric):
            parts.append(null_ratio_comparisons(chosen.null_ratios(narrow), limits["distribution"]["null_ratio_change"]))
    if vol["enabled"]:
        if vol["check_global_volume"]:
            parts.append(global_rate_comparison(window_counts(narrow), baseline, current, limits["volume"]))
        if vol["check_per_entity_volume"] and values is not None:
            entities = profiles.entity_top_values(values, summaries, vol["top_n_entities"], ts)
            hours = (baseline.hours, current.hours) if normalize_entities else None
            parts.append(entity_comparisons(entities, limits["volume"]["percent_change"], hours))
    if not parts:
        raise ValueError("every detector is switched off")
    compared = _union([p.select(*COMPARISON) for p in parts])
    stamped = compared.selectExpr(
        *COMPARISON[:3],
        f"{timestamp_sql(baseline.start)} AS baseline_start",
        f"{timestamp_sql(baseline.end)} AS baseline_end",
        f"{timestamp_sql(current.start)} AS current_start",
        f"{timestamp_sql(current.end)} AS current_end",
        *COMPARISON[3:8],
        f"{timestamp_sql(as_of)} AS detected_at",
        *COMPARISON[8:],
    )
    return gate(stamped, narrow, profiling["min_sample_size"])


def findings(comparisons: DataFrame, include_stable: bool = False) -> DataFrame:
    """The drifts among the comparisons, in the shape of the drift table."""
    kept = comparisons if include_stable else comparisons.filter("severity <> 'NONE'")
    return kept.drop("checks")


def summarise(comparisons: DataFrame) -> DataFrame:
    """One row of totals and counts by severity; all zero when the gate was shut."""
    return comparisons.agg(
        F.expr("coalesce(sum(checks), 0)").alias("total_checks"),
        F.expr("count_if(severity <> 'NONE')").alias("total_drifts"),
        F.expr("count_if(severity = 'CRITICAL')").alias("critical_count"),
        F.expr("count_if(severity = 'WARNING')").alias("warning_count"),
        F.expr("count_if(severity = 'INFO')").alias("info_count"),
    )


def drifts_by_type(comparisons: DataFrame) -> DataFrame:
    """Number of drifts per drift type."""
    return findings(comparisons).groupBy("drift_type").agg(F.count("*").alias("drifts"))
