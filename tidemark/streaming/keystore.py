"""Keys that earlier micro-batches have seen, stored so that a batch reads few of them.

Keys lie in slices of event time and, within a slice, in folders by hash, one for each
``KEYS_PER_BUCKET`` keys (at most ``BUCKETS``).
Beside each slice lies a bloom filter, cut into parts of 32,768 bits: a key's hash names
one part and ``PROBES`` bits in it, so asking is an equi-join of the batch's keys with the
parts they name. A batch reads

* the filters of slices that its lookback reaches, about two bytes a stored key, and
* only those buckets in which a filter says that one of its keys may be.

Slices grow by merging folders of similar size, so each holds a number of folders that
grows with the logarithm of its keys. Slices that nothing can reach any more are dropped.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.streaming.commits import CommitLog, Entry, State

KEYS_PER_BUCKET, BUCKETS = 50_000, 256
#: Bits of a part (the size of Spark's bitmaps), bits a key sets, and bits for each key.
PART_BITS, PROBES, BITS_PER_KEY = 32_768, 4, 16
MICROS = 1_000_000

KEYS = "key string, seen timestamp"


def _bit(n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(n), "key"), PART_BITS)


def _part(parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("part"), "key"), parts)


def _bucket() -> Column:
    return F.pmod(F.xxhash64("key"), "of").cast("int").alias("bucket")


class KeyStore:
    """``key, seen`` rows in the table ``table`` of a commit log.

    With ``width``, slices are so many seconds of ``seen`` long; without, all keys lie in one.
    """

    def __init__(self, log: CommitLog, table: str, width: int | None = None):
        self.log, self.table, self.width = log, table, width

    def _slice(self) -> Column:
        if self.width is None:
            return F.lit(0).cast("long")
        return F.floor(F.unix_micros("seen") / F.lit(self.width * MICROS)).cast("long")

    def _live(self, state: State, reach: datetime | None) -> list[Entry]:
        """Entries of slices that end after ``reach``."""
        mine = [e for e in state.entries if e.table == self.table]
        if self.width is None or reach is None:
            return mine
        return [e for e in mine if (e.facts["slice"] + 1) * self.width > _seconds(reach)]

    def _read(self, entries: list[Entry], wanted: dict[str, set[int]] | None = None) -> DataFrame:
        """The keys of these entries, or of their wanted buckets only."""
        leaves = [
            f"{e.path}/bucket={b}" for e in entries for b in e.facts["buckets"] if wanted is None or b in wanted.get(e.path, ())
        ]
        spark = self.log.spark
        return spark.read.schema(KEYS).parquet(*leaves) if leaves else spark.createDataFrame([], KEYS)

    def lookup(self, state: State, asked: DataFrame, reach: datetime | None, held: list[DataFrame]) -> DataFrame:
        """When each of the keys ``asked`` was last seen, ``key, seen``; keys not seen after ``reach`` may be missing.

        Collects which buckets may hold one of the keys: at most one small number a bucket.
        """
        entries = self._live(state, reach)
        if not entries:
            return self.log.spark.createDataFrame([], KEYS)
        where = F.array(*(F.struct(F.lit(e.path).alias("entry"), F.lit(e.facts["parts"]).cast("long").alias("parts"), F.lit(e.facts["of"]).cast("long").alias("of")) for e in entries))
        probes = asked.select("key").distinct().select("key", F.inline(where)).withColumn("part", _part(F.col("parts")))
        parts = self.log.spark.read.parquet(*(e.facts["beside"] for e in entries))
        met = probes.join(parts, ["entry", "part"])
        for n in range(PROBES):
            byte = f"CAST(conv(hex(substring(bits, CAST(pmod(xxhash64({n}, key), {PART_BITS}) DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)"
            met = met.filter(f"getbit({byte}, CAST(pmod(xxhash64({n}, key), {PART_BITS}) % 8 AS INT)) = 1")
        maybe = met.select("key", "entry", _bucket()).persist()
        held.append(maybe)
        wanted: dict[str, set[int]] = {}
        for row in maybe.select("entry", "bucket").distinct().collect():
            wanted.setdefault(row["entry"], set()).add(row["bucket"])
        stored = self._read(entries, wanted)
        found = stored.join(maybe.select("key").distinct(), "key", "left_semi")
        return found.groupBy("key").agg(F.max("seen").alias("seen"))

    def write(self, state: State, fresh: DataFrame, horizon: datetime | None = None) -> tuple[list[Entry], list[Entry]]:
        """Store ``key, seen``, one row for each key; the entries to commit and those that they replace.

        Of one key and slice the latest time is kept; slices that end at or before ``horizon`` are not stored.
        """
        spark = self.log.spark
        path = self.log.attempt(self.table)
        staged = fresh.select("key", "seen", self._slice().alias("slice"))
        if horizon is not None and self.width is not None:
            staged = staged.filter((F.col("slice") + 1) * self.width > _seconds(horizon))
        staged = staged.persist()
        try:
            counts = {r["slice"]: r["count"] for r in staged.groupBy("slice").count().collect()}  # a row for each slice of a batch
            if not counts:
                return [], []
            merged: list[Entry] = []
            for number in counts:
                merged += (more := self._merged(state, number, counts[number]))
                counts[number] += sum(e.facts["rows"] for e in more)
            sizes = [(n, max(1, -(-c * BITS_PER_KEY // PART_BITS)), min(BUCKETS, max(1, c // KEYS_PER_BUCKET))) for n, c in counts.items()]
            sized = F.broadcast(spark.createDataFrame(sizes, "slice long, parts long, of long"))  # a row for each slice of the batch
            latest = staged
            if merged:
                keys = staged.union(self._read(merged).select("key", "seen", self._slice()))
                latest = keys.groupBy("key", "slice").agg(F.max("seen").alias("seen"))
            rows = latest.join(sized, "slice").select("key", "seen", "slice", _bucket())
            rows.repartition("slice", "bucket").write.partitionBy("slice", "bucket").parquet(f"{path}/keys")
            stored = latest
            if merged:
                stored = spark.read.parquet(f"{path}/keys").withColumn("slice", F.col("slice").cast("long"))
            bits = stored.join(sized, "slice").select(
                "slice", _part(F.col("parts")).alias("part"), F.explode(F.array(*(_bit(n) for n in range(PROBES)))).alias("bit")
            )
            filters = bits.groupBy("slice", "part").agg(F.bitmap_construct_agg("bit").alias("bits"))
            entry = F.concat(F.lit(f"{path}/keys/slice="), F.col("slice"))
            filters.withColumn("entry", entry).write.partitionBy("slice").parquet(f"{path}/bloom")
        finally:
            staged.unpersist()
        buckets: dict[int, list[int]] = {n: [0] for n, _, of in sizes if of == 1}
        if len(buckets) < len(sizes):
            written = spark.read.parquet(f"{path}/keys").select(F.col("slice").cast("long").alias("slice"), "bucket").distinct()
            for row in sorted(written.collect()):
                if row["slice"] not in buckets or buckets[row["slice"]][-1] < row["bucket"]:
                    buckets.setdefault(row["slice"], []).append(row["bucket"])
        entries = [
            Entry(
                self.table, f"{path}/keys/slice={n}",
                {"slice": n, "rows": counts[n], "parts": parts, "of": of, "buckets": buckets[n], "beside": f"{path}/bloom/slice={n}"},
            )
            for n, parts, of in sorted(sizes)
        ]
        return entries, merged

    def _merged(self, state: State, number: int, rows: int) -> list[Entry]:
        """The slice's entries to be written anew with so many fresh rows: each at most twice as large as all before it."""
        mine = sorted((e for e in state.entries if e.table == self.table and e.facts["slice"] == number), key=lambda e: e.facts["rows"])
        merged: list[Entry] = []
        for entry in mine:
            if entry.facts["rows"] > 2 * rows:
                break
            merged.append(entry)
            rows += entry.facts["rows"]
        return merged

    def expired(self, state: State, horizon: datetime | None) -> list[Entry]:
        """Entries of slices that end at or before ``horizon``."""
        if horizon is None or self.width is None:
            return []
        live = {e.path for e in self._live(state, horizon)}
        return [e for e in state.entries if e.table == self.table and e.path not in live]


def _seconds(moment: datetime) -> float:
    return (moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)).timestamp()
