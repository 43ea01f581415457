"""B8 as a stream sink: a vector table bucketed by the hash of the id, kept by micro-batches.

A batch's points replace those of the same id. Only the buckets that a batch touches are written
again, into a folder of the epoch; its record then names the folder of every bucket. The record
before it stays valid until then, so a failed or repeated batch leaves each point once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vectors import upsert_vectors, vector_points
from ..schemas import VECTOR_ROW_DDL
from .records import Records, remove_folder

#: Buckets of a new table: enough that one is a small part of it and no task's load.
BUCKETS = 64


class VectorTable:
    """Points under ``path``: ``epoch=<epoch>/bucket=<bucket>`` and records of the live folders."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, encoder=None):
        self.spark, self.path, self.buckets, self.encoder = spark, path.rstrip("/"), buckets, encoder
        self.records = Records(spark, f"{self.path}/_epochs")

    def _live(self) -> tuple[int, dict[int, int]]:
        """The last epoch that counts, and the epoch whose folder holds each bucket."""
        done = self.records.numbers()
        if not done:
            return -1, {}
        told = self.records.read(done[-1])
        if told["buckets"] != self.buckets:
            raise ValueError(f"the table has {told['buckets']} buckets")
        return done[-1], {int(b): e for b, e in told["live"].items()}

    def _rows(self, live: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/epoch={e}/bucket={b}" for b, e in sorted(live.items())]
        if not paths:
            return self.spark.createDataFrame([], VECTOR_ROW_DDL)
        return self.spark.read.schema(VECTOR_ROW_DDL).parquet(*paths)

    def read(self) -> DataFrame:
        """All points, one row an id."""
        return self._rows(self._live()[1])

    def find(self, ids: list[str]) -> DataFrame:
        """Points of some ids: only their buckets are opened."""
        asked = self.spark.createDataFrame([(i,) for i in ids], "id string")
        want = {r.b for r in asked.select(self._bucket().alias("b")).distinct().collect()}
        return self._rows({b: e for b, e in self._live()[1].items() if b in want}).where(F.col("id").isin(*ids))

    def _bucket(self):
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")

    def write_epoch(self, batch: DataFrame, epoch: int) -> None:
        """Embed the log messages of a batch of events and put the points in."""
        last, live = self._live()
        if epoch <= last:
            return
        points = upsert_vectors(None, vector_points(batch, self.encoder)).withColumn("bucket", self._bucket()).persist()
        try:
            touched = sorted(r.bucket for r in points.select("bucket").distinct().collect())  # at most the buckets
            old = self._rows({b: e for b, e in live.items() if b in touched})
            merged = upsert_vectors(old, points.drop("bucket")).withColumn("bucket", self._bucket())
            # one file a bucket; readers of one id open one
            (merged.repartition(max(1, len(touched)), "bucket").sortWithinPartitions("bucket", "id").write.mode("overwrite")
             .partitionBy("bucket").parquet(f"{self.path}/epoch={epoch}"))
        finally:
            points.unpersist()
        now = {**live, **{b: epoch for b in touched}}
        self.records.create(epoch, {"buckets": self.buckets, "live": now})
        for e in {*live.values()} - {*now.values()}:  # folders that hold no live bucket any more
            remove_folder(self.spark, f"{self.path}/epoch={e}")
        for n in self.records.numbers():
            if n < last:  # readers that hold the record before keep it
                self.records.remove(n)


def start_vector_writer(events: DataFrame, path: str, checkpoint: str, trigger_seconds: int = 60, available_now: bool = False, **options):
    """B8 (stream): keep a vector table of the log messages of ``events``."""
    table = VectorTable(events.sparkSession, path, **options)
    w = events.writeStream.foreachBatch(table.write_epoch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()
