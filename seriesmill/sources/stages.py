"""A keyed table that grows by runs, and survives one that ends half-way.

Keys are hashed into buckets. A run reads the buckets its rows touch, writes them anew into a
folder of its own, and then appends one small table to the manifest: for each touched bucket, the
run that now holds it. Readers go by the last complete version of the manifest, so a run that
was killed, or whose gates failed, leaves a folder that nobody reads and that breaks nothing.
Gates are counted by the write itself, in the same pass over the rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from seriesmill.session import exists
from seriesmill.sources.tables import keys_to_fetch, upsert_latest

BUCKET = "__bucket"
_MANIFEST = "version long, bucket int, run string"


class GateError(ValueError):
    """A run whose rows are not as they must be; it is not committed."""


class KeyedStage:
    """A stage below ``path`` with one row for each ``key``: the one with the highest ``sequence``."""

    def __init__(self, spark: SparkSession, path: str, key: str, sequence: str, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.sequence, self.buckets = spark, path.rstrip("/"), key, sequence, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _manifest(self) -> DataFrame | None:
        path = f"{self.path}/manifest"
        return self.spark.read.schema(_MANIFEST).parquet(path) if exists(self.spark, path) else None

    def holders(self) -> dict[int, str]:
        """The run that holds each bucket: at most ``buckets`` rows of the last version of each."""
        manifest = self._manifest()
        if manifest is None:
            return {}
        last = manifest.groupBy("bucket").agg(F.max_by("run", "version").alias("run"))
        return {r["bucket"]: r["run"] for r in last.collect()}

    def _read(self, holders: dict[int, str]) -> DataFrame | None:
        if not holders:
            return None
        paths = [f"{self.path}/run={run}/{BUCKET}={b}" for b, run in sorted(holders.items())]
        return self.spark.read.option("mergeSchema", "true").parquet(*paths)

    def read(self) -> DataFrame | None:
        """The rows as of the last committed run; none before the first."""
        return self._read(self.holders())

    def to_fetch(self, known: DataFrame, done: Column | None = None) -> DataFrame:
        """Keys of ``known`` that the stage has no row for, or none that is ``done``."""
        rows = self.read()
        if rows is not None and done is not None:
            rows = rows.filter(done)
        return keys_to_fetch(known, self.key, rows)

    def write(self, new: DataFrame, gates: dict[str, Column] | None = None) -> tuple[str, list[int], dict[str, int]]:
        """Write the touched buckets with ``new`` rows; nobody reads them before ``commit``.

        Returns the run, its buckets and, for each gate, the rows that break it.
        """
        ready = new.withColumn(BUCKET, self._bucket())
        touched = sorted(r[0] for r in ready.select(BUCKET).distinct().collect())  # at most ``buckets``
        holders = self.holders()
        before = self._read({b: holders[b] for b in touched if b in holders})
        rows = new if before is None else upsert_latest(before, new, self.key, self.sequence)
        rows = upsert_latest(rows, rows.limit(0), self.key, self.sequence) if before is None else rows
        run, broken = uuid.uuid4().hex, {}
        out = rows.withColumn(BUCKET, self._bucket())
        if gates:
            seen = Observation(f"gates-{run}")
            out = out.observe(seen, *[F.count_if(F.coalesce(~ok, F.lit(True))).alias(name) for name, ok in gates.items()])
        if touched:
            out.repartition(max(1, len(touched)), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/run={run}")
            broken = dict(seen.get) if gates else {}
        return run, touched, broken

    def commit(self, run: str, touched: list[int]) -> None:
        manifest = self._manifest()
        version = 0 if manifest is None else (manifest.agg(F.max("version")).first()[0] or 0)
        rows = [(version + 1, b, run) for b in touched]
        if rows:
            self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def upsert(self, new: DataFrame, gates: dict[str, Column] | None = None) -> None:
        """Write and commit; a gate (a condition that every row must meet) that fails stops the commit."""
        run, touched, broken = self.write(new, gates)
        bad = {name: n for name, n in broken.items() if n}
        if bad:
            raise GateError(", ".join(f"{name}: {n} rows" for name, n in bad.items()))
        self.commit(run, touched)
