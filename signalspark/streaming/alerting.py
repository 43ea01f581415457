"""E11 as a stream: every micro-batch of anomalies becomes incidents and notifications.

All outputs of a batch, and the cooldown state after it, are written into folders of its epoch;
one record then makes them count. A batch that comes again starts from the state of the epoch
before it and writes the same rows over, or finds its record and does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import alerting
from .records import Records, remove_folder

OUTPUTS = ("incidents", "notifications", "rejects", "notification_rejects")


class AlertTables:
    """Outputs under ``path``: ``<output>/epoch=<epoch>``, ``_state/<epoch>`` and records."""

    def __init__(self, spark: SparkSession, path: str, rules, **options):
        """``rules``: a DataFrame, or a function that reads them, called once a batch."""
        self.spark, self.path, self.rules, self.options = spark, path.rstrip("/"), rules, options
        self.records = Records(spark, f"{self.path}/_epochs")

    def state(self, epoch: int | None = None) -> DataFrame | None:
        """Cooldown state before ``epoch`` (default: after all)."""
        done = [e for e in self.records.numbers() if epoch is None or e < epoch]
        return self.spark.read.schema(alerting.STATE_DDL).parquet(f"{self.path}/_state/{done[-1]}") if done else None

    def write_epoch(self, batch: DataFrame, epoch: int) -> None:
        done = self.records.numbers()
        if done and epoch <= done[-1]:
            return
        rules = self.rules() if callable(self.rules) else self.rules
        batch.persist()
        matched = None
        try:
            out = alerting.run_alerting(batch, rules, self.state(epoch), **self.options)
            matched = out["alerts"].persist()  # the other outputs and the state derive from the same rows
            for name in OUTPUTS:
                out[name].write.mode("overwrite").parquet(f"{self.path}/{name}/epoch={epoch}")
            out["state"].coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_state/{epoch}")
        finally:
            batch.unpersist()
            if matched is not None:
                matched.unpersist()
        self.records.create(epoch, {})
        for old in done[:-1]:  # the state before the last epoch is never asked for again
            remove_folder(self.spark, f"{self.path}/_state/{old}")

    def read(self, output: str) -> DataFrame | None:
        """Rows of an output over all epochs that count; None before the first."""
        base, done = f"{self.path}/{output}", self.records.numbers()
        return self.spark.read.option("basePath", base).parquet(*[f"{base}/epoch={e}" for e in done]) if done else None


def start_alerting(anomalies: DataFrame, rules, path: str, checkpoint: str, trigger_seconds: int = 5, available_now: bool = False, **options):
    """E11 (stream): anomalies (anomaly_id, tenant_id, metric_name, anomaly_score, ts, context) as they come."""
    tables = AlertTables(anomalies.sparkSession, path, rules, **options)
    w = anomalies.writeStream.foreachBatch(tables.write_epoch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()
