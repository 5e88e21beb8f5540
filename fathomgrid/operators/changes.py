"""Processing only new or changed records: reread from the oldest open transaction, then drop what the ledger holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The newest row per key by `order`, as one aggregation with map-side combine. Nulls in `order` come first; a null key is a key."""
    top = F.max(F.struct(*[F.col(c) for c in dict.fromkeys([*order, *keep])])).alias("_top")
    return rows.groupBy(*key).agg(top).select(*key, *[F.col(f"_top.{c}").alias(c) for c in dict.fromkeys([*order, *keep])])


def not_in_ledger(rows: DataFrame, ledger: DataFrame, key: list[str], version: str) -> DataFrame:
    """Anti-join of key and version against the ledger; nulls match nulls."""
    seen = ledger.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate([*key, version])])
    same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate([*key, version])]
    return rows.join(seen, same, "left_anti")


def changed_keys(rows: DataFrame, runs: DataFrame, scope: str, key: list[str], version: str, at: str, tie: str, done: str = "success") -> DataFrame:
    """Newest row per key whose version the last successful run of its key has not processed.

    rows carry run_id, runs (run_id, status). A row is settled when its run
    ended in `done`; every other run (failed, aborted, running, unknown) is a
    transaction still open. Per scope, reading starts again at the oldest row
    of an open transaction: older rows are all settled, so a key whose newest
    row lies before that bound cannot have changed. The ledger holds, per
    key, the version of its newest settled row. Rows without a version are
    left out. An empty ledger leaves every key.
    """
    status = runs.groupBy("run_id").agg(F.max(F.col("status").eqNullSafe(done)).alias("_done"))
    seen = rows.where(F.col(version).isNotNull()).select(*key, *[c for c in (version, at, tie) if c not in key], "run_id")
    seen = seen.join(status, "run_id", "left").withColumn("_done", F.coalesce("_done", F.lit(False)))
    bounds = seen.where(~F.col("_done")).groupBy(F.col(scope).alias("_scope")).agg(F.min(at).alias("_from"), F.max(F.col(at).isNull()).alias("_any"))
    reread = seen.join(bounds, F.col(scope).eqNullSafe(F.col("_scope"))).where(F.col("_any") | F.col(at).isNull() | (F.col(at) >= F.col("_from")))
    ledger = latest(seen.where("_done"), key, [at, tie], [version])
    return not_in_ledger(latest(reread, key, [at, tie], [version, "run_id"]), ledger, key, version)


def since_last_run(rows: DataFrame, runs: DataFrame, scope: str, times: list[str], done: str = "success") -> DataFrame:
    """Rows with a time at or after the start of their scope's last successful run, or whose scope has had none.

    The start, not the end, of the run bounds the reread, since what arrived
    while it ran may have been missed. A row whose times are all null is kept
    only where its scope has had no run. runs has (scope, started_at, status).
    """
    last = runs.where(F.col("status") == done).groupBy(F.col(scope).alias("_scope")).agg(F.max("started_at").alias("_from"))
    new: Column = F.col("_scope").isNull()
    for c in times:
        new = new | (F.col(c) >= F.col("_from"))
    return rows.join(last, F.col(scope) == F.col("_scope"), "left").where(F.coalesce(new, F.lit(False))).drop("_scope", "_from")


@dataclass
class ProcessedLedger:
    """Key-and-version pairs of what runs have finished, kept as an append-only table below `path`.

    process() hands over what the ledger lacks, lets `work` write it to a
    folder of the batch's own, and only then appends the pairs, whose
    complete folder is the batch's mark. A run that fails before the mark
    leaves no pair that counts, and its half-written folders are overwritten
    when the batch is tried again; a batch with a mark is never touched
    again. So nothing is skipped or repeated. Output counts only once its
    batch is marked: outputs() lists what may be read.
    """

    spark: SparkSession
    path: str
    key: list[str]
    version: str

    def marked(self) -> list[str]:
        """The folders of pairs that were written to their end, one per batch."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/pairs")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        folders = [s.getPath() for s in fs.listStatus(root)]
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(str(p) for p in folders if fs.exists(done(p, "_SUCCESS")))

    def outputs(self) -> list[str]:
        """The output folders of all marked batches."""
        return [f"{self.path}/out/{p.rsplit('part=', 1)[1]}" for p in self.marked()]

    def pairs(self, like: DataFrame) -> DataFrame:
        folders = self.marked()
        wanted = like.select(*self.key, self.version)
        return self.spark.read.schema(wanted.schema).parquet(*folders) if folders else wanted.where("false")

    def pending(self, rows: DataFrame) -> DataFrame:
        one = rows.dropDuplicates([*self.key, self.version])
        return not_in_ledger(one, self.pairs(rows), self.key, self.version)

    def process(self, rows: DataFrame, batch: str, work) -> None:
        """work(df, folder) writes the pending rows of a batch; the pairs are those that were handed over. A batch that has its mark is left as it is."""
        if f"{self.path}/out/{batch}" in self.outputs():
            return
        todo = f"{self.path}/todo/{batch}"
        self.pending(rows).write.mode("overwrite").parquet(todo)
        fixed = self.spark.read.parquet(todo)
        work(fixed, f"{self.path}/out/{batch}")
        fixed.select(*self.key, self.version, F.lit(batch).alias("batch")).write.mode("overwrite").parquet(f"{self.path}/pairs/part={batch}")
