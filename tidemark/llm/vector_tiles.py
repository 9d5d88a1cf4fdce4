"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Vectors are compared within one label (and one length). Equal vectors form one
class first. The classes of a label are dealt to blocks of about ``BLOCK``; every
pair of blocks is one tile, worked on by one task at a time:

* each unit vector u is written as s q + d, q in int8 and e = |d| measured;
* the tile product of the q is exact in single precision (longer vectors are
  multiplied in stretches), and |u.v - s s' q.q'| <= e + e' + 3 e e';
* only pairs that this bound does not rule out are recomputed in double precision.

A tile sends one row per class with a link: how many vectors it links with, and
the root of a spanning forest, never its pairs. All pairs of one label are
compared: the work grows with the square of a label's distinct vectors, spread
over its tiles.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, and vectors with a null label, link with nothing; vectors of unequal
length do not link; a null vec_id takes no part (no links, ``component_id`` null,
kept); rows that repeat a vec_id are vectors of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.frames import components, forest, landed

BLOCK = 1024
#: Components up to which products of int8 sum exactly in single precision.
EXACT = 1024
TOLD = "class long, linked long, root long"


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision and without overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and error norm of unit vectors."""
    scale = np.abs(u).max(axis=1) / 127
    codes = np.rint(u / scale[:, None]).astype(np.int8)
    error = np.sqrt(((u - codes * scale[:, None]) ** 2).sum(axis=1)) + 1e-9
    return codes, scale, error


def possible(x: tuple, y: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two quantised blocks whose cosine may reach the threshold."""
    (q, s, e), (r, t, f) = x, y
    dots = np.zeros((len(q), len(r)), np.float32)
    for at in range(0, q.shape[1], EXACT):
        dots += q[:, at : at + EXACT].astype(np.float32) @ r[:, at : at + EXACT].astype(np.float32).T
    dots *= s[:, None].astype(np.float32)
    dots *= t[None, :].astype(np.float32)
    # e + f + 3 e f, and what single precision may have lost
    dots += ((1 + 3 * f)[None, :] * e[:, None]).astype(np.float32)
    dots += f[None, :].astype(np.float32)
    return np.nonzero(dots >= threshold - 1e-5)


def exact_links(u: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs reach the threshold in double precision."""
    step = max(1, 4_000_000 // u.shape[1])
    return np.concatenate(
        [np.einsum("ab,ab->a", u[i[k : k + step]], v[j[k : k + step]]) >= threshold for k in range(0, len(i), step)] or [np.zeros(0, bool)]
    )


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row."""
    rows = embeddings.select(
        F.col("vec_id").cast("long"),
        F.col("label").cast("string").alias("label"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vector"),
    ).withColumn(
        "valid",
        F.coalesce(
            F.expr(
                "vec_id IS NOT NULL AND label IS NOT NULL AND size(vector) > 0 AND exists(vector, x -> x != 0) "
                "AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
            ),
            F.lit(False),
        ),
    ).withColumn("class", F.when(F.col("valid"), F.xxhash64("label", "vector")))
    classes = landed(
        rows.filter("valid").groupBy("class").agg(
            F.min("vec_id").alias("lowest"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector")
        )
    )
    groups = classes.groupBy("label", F.size("vector").alias("length")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # the number of blocks of a label goes with its rows by a plain join the planner can split
    dealt = classes.withColumn("length", F.size("vector")).join(
        groups.select(F.reverse("label").alias("g"), F.col("length").alias("gl"), "blocks"),
        (F.reverse("label") == F.col("g")) & (F.col("length") == F.col("gl")),
    ).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    tiles = dealt.select(
        "label", "length", "class", "copies", "vector", "block",
        F.explode(F.expr("transform(sequence(0, blocks - 1), o -> struct(least(o, block) AS x, greatest(o, block) AS y))")).alias("t"),
    ).select("label", "length", "t.x", "t.y", "class", "copies", "vector", "block")

    def tile(table: pa.Table) -> pa.Table:
        table = table.sort_by("class")
        block = table.column("block").to_numpy()
        name = table.column("class").to_numpy()
        copies = table.column("copies").to_numpy()
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        values = table.column("vector").combine_chunks()
        u = unit(values.flatten().to_numpy(zero_copy_only=False).reshape(len(name), -1))
        at = np.flatnonzero(block == x)
        to = np.flatnonzero(block == y)
        codes, scale, error = quantised(u)
        i, j = possible((codes[at], scale[at], error[at]), (codes[to], scale[to], error[to]), threshold)
        i, j = at[i], to[j]
        if x == y:
            once = i < j
            i, j = i[once], j[once]
        ok = exact_links(u, u, i, j, threshold)
        i, j = i[ok], j[ok]
        linked = np.bincount(i, weights=copies[j], minlength=len(name)) + np.bincount(j, weights=copies[i], minlength=len(name))
        told = np.flatnonzero(linked > 0)
        root = forest(len(name), i, j)
        return pa.table({"class": name[told], "linked": linked[told].astype(np.int64), "root": name[root[told]]})

    told = landed(tiles.groupBy("label", "length", "x", "y").applyInArrow(tile, TOLD))
    links = told.groupBy(F.col("class").alias("k")).agg(F.sum("linked").alias("linked"))
    found = components(
        classes.select(F.col("class").alias("id")), told.select(F.col("class").alias("a"), F.col("root").alias("b"))
    )
    joined = landed(
        classes.select("class", "lowest", "copies").join(found, F.col("class") == F.col("id")).join(links, F.col("class") == F.col("k"), "left")
        .select("class", "lowest", "component", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    lowest = joined.groupBy("component").agg(F.min("lowest").alias("component_id"))
    # negated keys: plain exchanges on both sides, so the planner can split a hot one
    by_class = joined.join(
        lowest.select((-F.col("component")).alias("c"), "component_id"), -F.col("component") == F.col("c")
    ).select((-F.col("class")).alias("k"), "n_links", "component_id")
    return rows.select("vec_id", "class").join(by_class, -F.col("class") == F.col("k"), "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.expr("vec_id = component_id"), F.lit(True)))
