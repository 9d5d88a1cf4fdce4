"""What the operators of this subpackage share: shared storage, connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session inside one process may go without the setting; it gets a
    temporary folder. On a cluster a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def landed(df: DataFrame) -> DataFrame:
    """``df``, computed once and written to the shared folder.

    Spark's reference cleaner removes the files once no plan refers to them, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def landed_and_seen(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """``landed``, and aggregates of its rows taken while they are written."""
    seen = Observation()
    kept = landed(df.observe(seen, *(c.alias(k) for k, c in measures.items())))
    return kept, seen.get


#: Edges that a task contracts at once, and that are dealt to a task in the second contraction.
CONTRACTED, DEALT = 2_000_000, 500_000


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n by the links i-j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges ``(a, b)``, a < b, with the same components: each task replaces stretches of its edges by stars."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def stars() -> pa.RecordBatch:
            a, b = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in (0, 1))
            ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = ids[forest(len(ids), at[: len(a)], at[len(a) :])]
            return pa.RecordBatch.from_arrays([pa.array(root[root < ids]), pa.array(ids[root < ids])], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= CONTRACTED:
                yield stars()
                held.clear()
        if held:
            yield stars()

    return edges.select("a", "b").mapInArrow(work, "a long, b long")


def components(vertices: DataFrame, edges: DataFrame, dealt: int = DEALT) -> DataFrame:
    """Connected components: ``vertices(id)`` and ``edges(a, b)`` to ``(id, component)``.

    ``component`` is the smallest id reachable. Alternates the large-star and
    the small-star step of Kiveris et al. ("Connected Components in MapReduce
    and Beyond", 2014) on checkpointed edge lists until nothing changes.
    Neighbourhoods are never gathered: each star needs only the smallest
    neighbour, a mergeable minimum, joined back to the edges. Before the first
    step every task contracts the edges it holds, and what is left is dealt to
    one task for each ``dealt`` edges (at most ``CONTRACTED``) and contracted
    again; edges that need one task only are stars by then, and no step follows.
    Null ids are not allowed; vertices without an edge are their own component.
    """

    def lowest(pairs: DataFrame) -> DataFrame:
        """u -> v pairs with the smallest of u and its neighbours.

        The negated key keeps the aggregate's partitioning from being reused,
        so both sides are plain exchanges and the planner can split a hub.
        """
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select((-F.col("u")).alias("k"), F.least("u", "m").alias("m"))
        return pairs.join(least, -F.col("u") == F.col("k")).select("u", "v", "m")

    def stars(current: DataFrame) -> DataFrame:
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).union(current.select("b", "a"))
        large = lowest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: every vertex and its smaller neighbours move to the smallest of them
        linked = lowest(large)
        small = linked.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            linked.groupBy("u").agg(F.first("m").alias("v"))
        )
        return small.filter("u != v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()

    state = {"n": F.count(F.lit(1)), "mark": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    current, seen = landed_and_seen(contracted(edges.filter("a != b")), **state)
    tasks = max(1, -(-seen["n"] // dealt))
    current, seen = landed_and_seen(contracted(current.repartition(tasks)), **state)
    while tasks > 1:
        before = seen
        current, seen = landed_and_seen(stars(current), **state)
        if seen == before:
            break
    # now every b has one edge, to the smallest id of its component
    roots = current.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))
    return vertices.join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
