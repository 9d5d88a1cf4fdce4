"""Duplicate keys (C15, C16) and insert-if-absent.

None of these sorts a key's rows in one task. The first occurrence of each
key is found by a mergeable aggregate and compared with the rows by an
equi-join, which the adaptive planner broadcasts when the repeated keys are
few and splits when one key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _order(order_by: list[str]) -> Column:
    """One comparable value; a single column keeps the aggregate hash-based."""
    if len(order_by) == 1:
        return F.col(f"`{order_by[0]}`")
    return F.struct(*[F.col(f"`{c}`") for c in order_by])


def spread_nulls(key: Column, order_by: list[str]) -> Column:
    """Keyless rows get a unique non-matching key so that they do not meet in one task."""
    return F.coalesce(key, F.concat(F.lit("~"), F.xxhash64(*[F.col(f"`{c}`") for c in order_by]).cast("string")))


def mark_duplicates(df: DataFrame, key: Column, order_by: list[str], flag: str = "is_duplicate") -> DataFrame:
    """True for every row after the first of its key; rows without a key are exempt.

    ``order_by`` gives the arrival order and must be unique per row; ``key``
    must be text that does not start with ``~``.
    """
    keyed = df.withColumn("__key", key).withColumn("__order", _order(order_by))
    repeated = (
        keyed.filter(F.col("__key").isNotNull())
        .groupBy("__key")
        .agg(F.min("__order").alias("__first"), F.count("*").alias("__n"))
        .filter("__n > 1")
        .select(F.col("__key").alias("__repeated"), "__first")
    )
    return (
        keyed.withColumn("__key", spread_nulls(F.col("__key"), order_by))
        .join(repeated, F.col("__key") == F.col("__repeated"), "left")
        .withColumn(flag, F.coalesce(F.col("__order") > F.col("__first"), F.lit(False)))
        .drop("__key", "__order", "__repeated", "__first")
    )


def mark_duplicates_within(
    df: DataFrame,
    keys: list[str],
    ts: str,
    order_by: list[str],
    seconds: int = 3600,
    flag: str = "is_duplicate",
) -> DataFrame:
    """True when the same key occurred less than ``seconds`` earlier.

    Time is cut into cells of the lookback length. Within a cell every row but
    the first is a duplicate; the first is one when the latest row of an
    earlier cell is close enough. So only per-(key, cell) extremes are
    exchanged, and a key's cells - not its rows - are ordered.
    """
    micros = seconds * 1_000_000
    timed = (
        df.withColumn("__us", F.unix_micros(F.col(f"`{ts}`").cast("timestamp")))
        .withColumn("__cell", F.floor(F.col("__us") / micros))
        .withColumn("__order", F.struct(F.col("__us"), *[F.col(f"`{c}`") for c in order_by]))
    )
    has_key = F.lit(True)
    for k in keys:
        has_key = has_key & F.col(f"`{k}`").isNotNull()
    cells = (
        timed.filter(has_key)
        .groupBy(*keys, "__cell")
        .agg(F.min("__order").alias("__first"), F.max("__us").alias("__last"))
    )
    by_key = Window.partitionBy(*keys).orderBy("__cell")
    cells = cells.withColumn("__before", F.lag("__last").over(by_key)).select(
        *[F.col(f"`{k}`").alias(f"__k{n}") for n, k in enumerate(keys)],
        F.col("__cell").alias("__c"),
        "__first",
        "__before",
    )
    # Keyless rows: a unique negative cell spreads them and matches nothing.
    spread = F.when(has_key, F.col("__cell")).otherwise(
        -F.abs(F.xxhash64(*[F.col(f"`{c}`") for c in order_by])) - 1
    )
    on = F.col("__cell") == F.col("__c")
    for n, k in enumerate(keys):
        on = on & (F.col(f"`{k}`") == F.col(f"__k{n}"))
    repeated = (F.col("__order") > F.col("__first")) | (
        F.coalesce(F.col("__us") - F.col("__before") < micros, F.lit(False))
    )
    return (
        timed.withColumn("__cell", spread)
        .join(cells, on, "left")
        .withColumn(flag, F.coalesce(repeated, F.lit(False)))
        .drop("__us", "__cell", "__order", "__c", "__first", "__before", *[f"__k{n}" for n in range(len(keys))])
    )


def duplicates_against_history(
    batch: DataFrame,
    history: DataFrame,
    keys: list[str],
    ts: str,
    order_by: list[str],
    seconds: int = 3600,
    flag: str = "is_duplicate",
) -> DataFrame:
    """C16 against stored results: the batch rows, flagged by history and by each other.

    Only history that the lookback can reach is read: the batch's earliest time,
    one value looked up when the plan is built, becomes a predicate of the scan.
    """
    columns = batch.columns
    earliest = batch.agg(F.min(F.col(f"`{ts}`").cast("timestamp"))).first()[0]
    if earliest is not None:
        reach = F.lit(earliest) - F.expr(f"INTERVAL {int(seconds)} SECONDS")
        history = history.filter(F.col(f"`{ts}`") >= reach)
    both = batch.withColumn("__stored", F.lit(False)).unionByName(
        history.select(*keys, ts, *[c for c in order_by if c not in keys and c != ts]).withColumn(
            "__stored", F.lit(True)
        ),
        allowMissingColumns=True,
    )
    marked = mark_duplicates_within(both, keys, ts, order_by, seconds, flag)
    return marked.filter(~F.col("__stored")).select(*columns, flag)


def insert_if_absent(batch: DataFrame, target: DataFrame, key: str, order_by: list[str]) -> DataFrame:
    """The rows to append - first of each key, keys already stored left out.

    Rows without a key never conflict and are all kept.
    """
    fresh = first_per_key(batch, key, order_by)
    stored = target.select(F.col(f"`{key}`").alias("__stored")).filter(F.col("__stored").isNotNull())
    return fresh.join(stored, F.col(f"`{key}`") == F.col("__stored"), "left_anti")


def first_per_key(batch: DataFrame, key: str, order_by: list[str]) -> DataFrame:
    """First row of each key in the given order; rows without a key are all kept.

    ``row_number() <= 1`` is limited per map task before the exchange, so a
    hot key sends one row per task; keyless rows rank within their own hash.
    """
    order_cols = [F.col(f"`{c}`") for c in order_by]
    unkeyed = F.when(F.col(f"`{key}`").isNull(), F.struct(*order_cols))
    rank = F.row_number().over(Window.partitionBy(F.col(f"`{key}`"), unkeyed).orderBy(*order_cols))
    return batch.withColumn("__rank", rank).filter("__rank <= 1").drop("__rank")
