"""Exact ranks without ordering a whole group in one task.

Values are cut into cells at approximate quantiles (a small mergeable sketch
per group, broadcast back) and rows are counted per cell. Cells that cannot
matter to the result are ruled out by these counts alone; values of the others
are counted per distinct value and ordered inside their cell. The cut points
influence balance, never results; a value that holds a third of all rows is one
counted row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.sqltext import name

CELLS = 256


def with_cells(values: DataFrame, group: list[str], value: str = "value", cells: int = CELLS) -> DataFrame:
    """Add ``cell``, a number that grows with the value inside each group.

    ``cells`` is a power of two: the cell is found by binary search, one
    comparison per bit. The broadcast holds ``cells`` numbers per group, and
    groups are (window, field) pairs of the configuration.
    """
    steps = cells.bit_length() - 1
    points = ", ".join(f"{n / cells!r}D" for n in range(1, cells))
    bounds = values.groupBy(*group).agg(F.expr(f"percentile_approx({value}, array({points}), 5000)").alias("__bounds"))
    out = values.join(F.broadcast(bounds), group).selectExpr(*[name(c) for c in values.columns], "__bounds", "0 AS cell")
    for step in range(steps - 1, -1, -1):
        half = 1 << step
        passed = f"{value} > element_at(__bounds, cell + {half})"
        out = out.selectExpr(*[name(c) for c in values.columns], "__bounds", f"if({passed}, cell + {half}, cell) AS cell")
    return out.drop("__bounds")


def percentiles(values: DataFrame, group: list[str], ps: list[int], cells: int = CELLS) -> DataFrame:
    """exact percentiles, linearly interpolated at ``p/100 * (n - 1)``, one row per group.

    ``values`` has the group columns and a non-null ``value``; the result has
    columns ``p<p>``. Rows are counted per cell first; only values of the few
    cells that hold a wanted rank are then exchanged and ordered.
    """
    placed = with_cells(values, group, cells=cells)
    by_cell = placed.groupBy(*group, "cell").agg(F.count("*").alias("cell_rows"))
    ordered = Window.partitionBy(*group).orderBy("cell")
    everything = Window.partitionBy(*group)
    ranks = ", ".join(f"CAST(floor({p}D / 100 * (total - 1)) AS BIGINT)" for p in ps)
    # at most two cells for each percentile and group
    hit = (
        by_cell.withColumn("before", F.sum("cell_rows").over(ordered) - F.col("cell_rows"))
        .withColumn("total", F.sum("cell_rows").over(everything))
        .selectExpr("*", f"array({ranks}) AS ranks")
        .filter("exists(ranks, r -> r + 1 >= before AND r < before + cell_rows)")
        .select(*group, "cell", "before", "total", "ranks")
    )
    wanted = placed.join(F.broadcast(hit.select(*group, "cell")), [*group, "cell"], "left_semi")
    counts = wanted.groupBy(*group, "cell", "value").agg(F.count("*").alias("n"))
    inside = Window.partitionBy(*group, "cell").orderBy("value")
    running = (
        counts.join(F.broadcast(hit), [*group, "cell"])
        .withColumn("upto", F.col("before") + F.sum("n").over(inside))
        .withColumn("from", F.col("upto") - F.col("n"))
    )
    picks = []
    for i, p in enumerate(ps):
        for side, shift in (("lo", 0), ("hi", 1)):
            at = f"ranks[{i}] + {shift}"
            picks.append(F.expr(f"max(CASE WHEN {at} >= `from` AND {at} < upto THEN value END)").alias(f"{side}{p}"))
    found = running.groupBy(*group).agg(F.first("total").alias("total"), *picks)
    out = []
    for p in ps:
        place = f"({p}D / 100 * (total - 1))"
        share = f"({place} - floor({place}))"
        out.append(f"if({share} = 0, lo{p}, lo{p} + (hi{p} - lo{p}) * {share}) AS p{p}")
    return found.selectExpr(*[name(g) for g in group], *out)


def _of_both() -> list[Column]:
    return [F.expr("count_if(window = 'baseline')").alias("b"), F.expr("count_if(window = 'current')").alias("c")]


def distance_bounds(placed: DataFrame, group: list[str]) -> DataFrame:
    """Per group and cell: counts of both windows before it, totals, and bounds of the distance of their distribution functions.

    ``least`` is the distance at the cell's end, ``most`` a bound for all places inside it.
    """
    by_cell = placed.groupBy(*group, "cell").agg(*_of_both())
    ordered, everything = Window.partitionBy(*group).orderBy("cell"), Window.partitionBy(*group)
    sums = [F.sum(x).over(ordered).alias(f"upto_{x}") for x in "bc"] + [F.sum(x).over(everything).alias(f"total_{x}") for x in "bc"]
    share = "try_divide(upto_{0}{1}, total_{0})"
    end_b, end_c, start_b, start_c = share.format("b", ""), share.format("c", ""), share.format("b", " - b"), share.format("c", " - c")
    return by_cell.select("*", *sums).selectExpr(
        *[name(g) for g in group], "cell", "upto_b - b AS before_b", "upto_c - c AS before_c", "total_b", "total_c",
        f"abs({end_b} - {end_c}) AS least", f"greatest({end_b} - {start_c}, {end_c} - {start_b}) AS most",
    )


def largest_distance(values: DataFrame, group: list[str], cells: int = CELLS) -> DataFrame:
    """``statistic, total_b, total_c`` per group: largest distance of the windows' distribution functions.

    ``values`` has the group columns, ``window`` and a non-null ``value``. Cell
    counts bound the distance inside each cell; only values of cells that may
    exceed the largest distance at a cell's end are exchanged and ordered.
    """
    placed = with_cells(values, group, cells=cells)
    bounds = distance_bounds(placed, group)
    known = bounds.groupBy(*group).agg(F.max("least").alias("known"), F.max("total_b").alias("total_b"), F.max("total_c").alias("total_c"))
    everything = Window.partitionBy(*group)
    # at most ``cells`` rows a group
    opened = bounds.withColumn("known", F.max("least").over(everything)).filter("most > known").drop("known", "least", "most")
    wanted = placed.join(F.broadcast(opened.select(*group, "cell")), [*group, "cell"], "left_semi")
    counts = wanted.groupBy(*group, "cell", "value").agg(*_of_both())
    inside = Window.partitionBy(*group, "cell").orderBy("value")
    running = counts.join(F.broadcast(opened), [*group, "cell"]).select(
        *group,
        "total_b",
        "total_c",
        (F.col("before_b") + F.sum("b").over(inside)).alias("upto_b"),
        (F.col("before_c") + F.sum("c").over(inside)).alias("upto_c"),
    )
    found = running.groupBy(*group).agg(F.expr("max(abs(try_divide(upto_b, total_b) - try_divide(upto_c, total_c)))").alias("found"))
    return known.join(F.broadcast(found), group, "left").selectExpr(
        *[name(g) for g in group], "if(found > known, found, known) AS statistic", "total_b", "total_c"
    )
