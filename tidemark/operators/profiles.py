"""Profiles of tagged windows (F1-F9), as long tables keyed by ``window`` and field.

Every profile is a mergeable aggregate. Distinct counts use a theta sketch,
which is exact up to its size and whose size is chosen above the cap, so the
capped cardinality is exact while only a bounded state is exchanged per field.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.once import evaluate_once
from tidemark.functions.paths import Fields, TableField
from tidemark.functions.sqltext import case, name, quote
from tidemark.operators.ranks import CELLS, percentiles
from tidemark.session import landed

PERCENTILES = [50, 95, 99]


def row_counts(tagged: DataFrame) -> DataFrame:
    """rows per window."""
    return tagged.groupBy("window").agg(F.count("*").alias("rows"))


def schema_profile(leaves: DataFrame, rows: DataFrame, cap: int = 1000, seen: str = "ts") -> DataFrame:
    """F1 and F2 over flattened leaves (``window, path, kind, text, is_null`` and the arrival column).

    The dominant type is the most frequent one, the first seen among equals.
    ``rows`` is the number of records per window. The sketch passes over empty
    strings, hence the prefix.
    """
    size = max(12, math.ceil(math.log2(max(cap, 2))) + 1)
    votes = leaves.groupBy("window", "path", "kind").agg(
        F.count("*").alias("n"),
        F.min(seen).alias("seen"),
        F.expr(f"theta_sketch_agg(concat('=', text), {size})").alias("sketch"),
    )
    typed = "kind <> 'NoneType'"
    fields = votes.groupBy("window", "path").agg(
        F.expr(f"max_by(kind, struct(n, -unix_micros(CAST(seen AS TIMESTAMP)), kind)) FILTER (WHERE {typed})").alias("type"),
        F.expr("coalesce(sum(n) FILTER (WHERE kind = 'NoneType'), 0)").alias("null_count"),
        F.sum("n").alias("present_count"),
        F.expr(f"theta_sketch_estimate(theta_union_agg(sketch, {size}))").alias("distinct"),
    )
    return fields.join(F.broadcast(rows), "window").selectExpr(
        "window",
        "path AS field",
        "coalesce(type, 'null') AS type",
        "null_count > 0 AS nullable",
        "round(null_count / rows, 4) AS null_ratio",
        "present_count",
        "round(present_count / rows, 4) AS presence_ratio",
        f"least(distinct, {cap}) AS cardinality",
        f"distinct < {cap} AS cardinality_exact",
    )


def _long(tagged: DataFrame, fields: Fields, values: dict[str, str], keep: list[str]) -> DataFrame:
    """Unpivot expressions to ``field, value`` rows beside the kept columns."""
    records = ", ".join(f"named_struct('field', {quote(f)}, 'value', {sql})" for f, sql in values.items())
    return fields.attach(tagged).selectExpr(*[name(k) for k in keep], f"inline(array({records}))")


class Targets:
    """The configured fields of tagged rows as typed columns, read once from their source.

    ``columns`` holds one text column per categorical field, one number per
    numerical field and one flag per field whose nulls are counted. Everything a
    drift run compares, but for the schema, derives from these columns.
    """

    def __init__(self, fields: Fields, categorical: list[str], numeric: list[str], seen: str = "ts"):
        self.fields, self.seen = fields, seen
        numbers = {p: _as_number(fields.field(p)) for p in numeric}
        self.texts = {p: f"__text{n}" for n, p in enumerate(categorical)}
        self.numbers = {p: f"__number{n}" for n, p in enumerate(numeric)}
        only_text = [p for p in categorical if p not in numeric]
        self.nones = {p: f"__none{n}" for n, p in enumerate(only_text)}
        self._sql = [f"{fields.field(p).text} AS {c}" for p, c in self.texts.items()]
        self._sql += [f"{numbers[p]} AS {c}" for p, c in self.numbers.items()]
        self._sql += [f"{fields.field(p).is_none} AS {c}" for p, c in self.nones.items()]

    def read(self, tagged: DataFrame) -> DataFrame:
        return self.fields.attach(tagged).selectExpr("window", name(self.seen), *self._sql)

    def _long(self, narrow: DataFrame, columns: dict[str, str], keep: list[str]) -> DataFrame:
        records = ", ".join(f"named_struct('field', {quote(f)}, 'value', {c})" for f, c in columns.items())
        return narrow.selectExpr(*[name(k) for k in keep], f"inline(array({records}))")

    def text_values(self, narrow: DataFrame) -> DataFrame:
        """``window, field, value`` and the arrival column, one row per categorical field."""
        return self._long(narrow, self.texts, ["window", self.seen])

    def numeric_values(self, narrow: DataFrame) -> DataFrame:
        """As ``numeric_values``."""
        return self._long(narrow, self.numbers, ["window"])

    def null_ratios(self, narrow: DataFrame) -> DataFrame:
        """As ``null_ratios``."""
        flags = {p: f"if({c}, 1, 0)" for p, c in self.nones.items()} | {p: f"if({c} IS NULL, 1, 0)" for p, c in self.numbers.items()}
        return _null_shares(narrow, flags)


def _counted(values: DataFrame, seen: str) -> DataFrame:
    counted = values.groupBy("window", "field", "value").agg(F.count("*").alias("n"), F.min(seen).alias("seen"))
    return evaluate_once(counted, value="value", n="n", seen="seen")


def value_counts(tagged: DataFrame, fields: Fields, paths: list[str], seen: str = "ts") -> DataFrame:
    """Rows per ``window, field, value`` (value as text, NULL kept) with the first arrival.

    One exchange of pre-aggregated counts serves distributions, entities and
    null ratios. ``value`` is pinned so that a later filter on it cannot make
    two uses of the counts differ, which lets Spark reuse the exchange.
    """
    values = _long(tagged, fields, {p: fields.field(p).text for p in paths}, ["window", seen])
    return _counted(values, seen)


def categorical_profile(counts: DataFrame, max_categories: int | None = 100) -> DataFrame:
    """F3 (and H5 without a limit): proportion of each non-null value; wide fields are dropped."""
    totals = counts.groupBy("window", "field").agg(
        F.expr("sum(n) FILTER (WHERE value IS NOT NULL)").alias("total"), F.count("value").alias("categories")
    )
    if max_categories is not None:
        totals = totals.filter(f"categories <= {max_categories}")
    # One row per window and configured field: bounded by the configuration.
    return (
        counts.filter("value IS NOT NULL")
        .join(F.broadcast(totals), ["window", "field"])
        .selectExpr("window", "field", "value", "n", "n / total AS proportion", "categories")
    )


def entity_top_n(counts: DataFrame, top_n: int = 50) -> DataFrame:
    """F8: the most frequent values of each field, the first seen among equals.

    The rank limit is applied before the exchange, so each task sends at most
    ``top_n`` rows per field.
    """
    order = Window.partitionBy("window", "field").orderBy(F.col("n").desc(), "seen", "value")
    ranked = counts.filter("value IS NOT NULL").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= top_n).select("window", "field", "value", "n", "rank")


class ValueSummary(NamedTuple):
    """What one pass tells about the values of a field in a window; at most ``CANDIDATES * top_n`` values."""

    total: int
    distinct: float
    top: list[str]
    #: No value outside ``top`` occurs more often.
    bound: float


#: Values that a summary tracks, and candidates it names for each wanted one.
TRACKED, CANDIDATES = 65_536, 4


def value_summaries(values: DataFrame, top_n: int, max_categories: int | None, tracked: int | None = None) -> dict[tuple[str, str], ValueSummary]:
    """One mergeable summary for each (window, field) of the configuration, gathered on the driver.

    A frequent-items sketch keeps counters of ``tracked`` values and never
    counts a value too low; values it has let go occur at most 3.5 / ``tracked``
    of all rows. A theta sketch counts distinct values, exactly up to the category limit.
    """
    tracked = tracked or TRACKED
    wanted = min(tracked, CANDIDATES * max(1, top_n))
    size = max(12, math.ceil(math.log2(max(max_categories or 2, 2))) + 1)
    rows = (
        values.filter("value IS NOT NULL")
        .groupBy("window", "field")
        .agg(
            F.count("*").alias("total"),
            F.expr(f"theta_sketch_estimate(theta_sketch_agg(concat('=', value), {size}))").alias("distinct"),
            F.expr(f"approx_top_k(value, {wanted}, {tracked})").alias("top"),
        )
        .collect()
    )
    out = {}
    for r in rows:
        # a table half full has let nothing go
        lost = 0.0 if r["distinct"] < tracked / 2 else 3.5 * r["total"] / tracked
        last = r["top"][-1]["count"] if len(r["top"]) == wanted else 0
        out[r["window"], r["field"]] = ValueSummary(r["total"], r["distinct"], [t["item"] for t in r["top"]], max(lost, last))
    return out


def _of_groups(groups) -> Column:
    """Whether a row's window and field are among these, which the configuration bounds."""
    pairs = [F.struct(F.lit(w).alias("w"), F.lit(f).alias("f")) for w, f in groups]
    return F.struct(F.col("window").alias("w"), F.col("field").alias("f")).isin(pairs) if pairs else F.lit(False)


def counts_of_narrow(values: DataFrame, summaries: dict[tuple[str, str], ValueSummary], max_categories: int | None, seen: str = "ts") -> DataFrame:
    """As ``value_counts``, of the non-null values of fields within the category limit only."""
    groups = [g for g, s in summaries.items() if max_categories is None or s.distinct <= max_categories]
    return _counted(values.filter("value IS NOT NULL").filter(_of_groups(groups)), seen)


def entity_top_values(values: DataFrame, summaries: dict[tuple[str, str], ValueSummary], top_n: int = 50, seen: str = "ts") -> DataFrame:
    """F8 in two passes: as ``entity_top_n``, but only candidates are exchanged and counted.

    The summaries name candidates. If the last wanted candidate occurs more
    often than any other value can, the exact counts of the candidates hold the
    answer; the values of a field where the bound does not decide are all counted.
    """
    spark = values.sparkSession
    named = [(w, f, v) for (w, f), s in summaries.items() for v in s.top]
    if not named:
        return entity_top_n(_counted(values, seen), top_n)
    candidates = F.broadcast(spark.createDataFrame(named, "window string, field string, value string"))
    counts = landed(_counted(values.join(candidates, ["window", "field", "value"], "left_semi"), seen))
    ranked = entity_top_n(counts, top_n)
    last = {(r["window"], r["field"]): (r["least"], r["found"]) for r in ranked.groupBy("window", "field").agg(F.min("n").alias("least"), F.count("*").alias("found")).collect()}
    open_groups = []
    for group, summary in summaries.items():
        least, found = last.get(group, (0, 0))
        if not (summary.bound == 0 or (found == top_n and least > summary.bound)):
            open_groups.append(group)
    if not open_groups:
        return ranked
    rest = entity_top_n(_counted(values.filter(_of_groups(open_groups)), seen), top_n)
    return ranked.filter(~_of_groups(open_groups)).unionByName(rest)


def _as_number(field) -> str:
    """``float(value)``; text is parsed, NaN counts as null."""
    if isinstance(field, TableField):
        parsed = f"try_cast({field.value} AS DOUBLE)" if field._static == "str" else field.number
    else:
        parsed = case(
            [
                (field.is_number, field.number),
                (field.is_kind("str"), f"try_cast({field.text} AS DOUBLE)"),
            ]
        )
    return f"nanvl({parsed}, CAST(NULL AS DOUBLE))"


def numeric_values(tagged: DataFrame, fields: Fields, paths: list[str]) -> DataFrame:
    """``window, field, value`` with NULL for everything that is not a number."""
    return _long(tagged, fields, {p: _as_number(fields.field(p)) for p in paths}, ["window"])


def numeric_stats(values: DataFrame) -> DataFrame:
    """mean, population deviation, extremes; groups without numbers are absent."""
    return (
        values.filter("value IS NOT NULL")
        .groupBy("window", "field")
        .agg(
            F.round(F.avg("value"), 4).alias("mean"),
            F.round(F.stddev_pop("value"), 4).alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.count("*").alias("n"),
        )
    )


def numeric_percentiles(
    values: DataFrame, ps: list[int] | None = None, approximate: bool = False, cells: int = CELLS
) -> DataFrame:
    """exact by default; ``approximate`` trades exactness for a single pass."""
    ps = ps or PERCENTILES
    numbers = values.filter("value IS NOT NULL")
    if approximate:
        picks = [F.percentile_approx("value", p / 100, 10000).alias(f"p{p}") for p in ps]
        return numbers.groupBy("window", "field").agg(*picks)
    return percentiles(numbers, ["window", "field"], ps, cells)


def numeric_profile(values: DataFrame, approximate: bool = False) -> DataFrame:
    """F5 and F6 in one table."""
    # Both sides have one row per window and configured field.
    return numeric_stats(values).join(
        F.broadcast(numeric_percentiles(values, approximate=approximate)), ["window", "field"]
    )


def null_ratios(
    tagged: DataFrame, fields: Fields, categorical: list[str], numeric: list[str]
) -> DataFrame:
    """share of nulls per field; a field in both lists is judged as a number."""
    flags = {p: f"if({fields.field(p).is_none}, 1, 0)" for p in categorical if p not in numeric}
    flags |= {p: f"if({_as_number(fields.field(p))} IS NULL, 1, 0)" for p in numeric}
    return _null_shares(fields.attach(tagged), flags)


def _null_shares(rows: DataFrame, flags: dict[str, str]) -> DataFrame:
    # One row in, one wide partial aggregate out: nothing is unpivoted per event.
    wide = rows.groupBy("window").agg(*[F.expr(f"avg({sql})").alias(f"__r{n}") for n, sql in enumerate(flags.values())])
    pairs = ", ".join(f"{quote(f)}, __r{n}" for n, f in enumerate(flags))
    return wide.selectExpr("window", f"stack({len(flags)}, {pairs}) AS (field, null_ratio)")


def field_names(profile: DataFrame, window: str) -> DataFrame:
    """names of the profiled fields of a window."""
    return profile.filter(F.col("window") == window).select("field")


def field_type(profile: DataFrame, window: str, field: str) -> DataFrame:
    """dominant type and cardinality of one field."""
    return profile.filter((F.col("window") == window) & (F.col("field") == field)).select(
        "field", "type", "cardinality"
    )


def distribution_of(categories: DataFrame, window: str, field: str) -> DataFrame:
    """one field's distribution."""
    return categories.filter((F.col("window") == window) & (F.col("field") == field)).select("value", "proportion")


def statistics_of(numbers: DataFrame, window: str, field: str) -> DataFrame:
    """one field's numeric statistics."""
    return numbers.filter((F.col("window") == window) & (F.col("field") == field))


def entity_count(entities: DataFrame, window: str, field: str, value: str) -> DataFrame:
    """count of one entity, 0 when it is not among the top."""
    chosen = entities.filter(
        (F.col("window") == window) & (F.col("field") == field) & (F.col("value") == value)
    )
    return chosen.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))


def top_entities(entities: DataFrame, window: str, field: str, n: int = 10) -> DataFrame:
    """the first ``n`` entities of a field."""
    return entities.filter(
        (F.col("window") == window) & (F.col("field") == field) & (F.col("rank") <= n)
    ).select("value", "n", "rank")
