"""Log and metric tables fed by micro-batches, safe against replays.

An epoch's rows are staged, each table in a folder of the epoch; one record then says that the
whole epoch is staged. Staged epochs are flushed into the month-partitioned table once they hold
``FLUSH_ROWS`` rows or the oldest has waited ``FLUSH_SECONDS``: one sorted write of all of them
and a record that names the last epoch in it. Readers go by records alone, so a failed write is
never seen, and an epoch that comes again is known by its record and not staged twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..constants import FLUSH_ROWS, FLUSH_SECONDS
from ..operators.events import route_signals
from ..operators.rows import log_rows, metric_rows
from ..operators.storage import layout, with_month
from .records import Records, remove_folder

#: Tables by name: the rows that they take of a batch of events, and their layout (None: as it is).
TABLES: dict[str, tuple[Callable[[DataFrame], DataFrame], str | None]] = {
    "logs": (lambda events: log_rows(route_signals(events)["logs"]), "logs"),
    "metrics": (lambda events: metric_rows(route_signals(events)["metrics"]), "metrics"),
}


class EpochTables:
    """Tables in folders ``paths`` (by name): ``upto=<epoch>/yyyymm=<month>`` folders of rows, staged
    epochs and records in folders that start with an underscore, which plain readers skip.

    The folders belong to one streaming query: its checkpoint numbers the epochs."""

    def __init__(self, spark: SparkSession, paths: dict[str, str], tables=None, flush_rows: int = FLUSH_ROWS, flush_seconds: float = FLUSH_SECONDS,
                 clock: Callable[[], float] = time.time):
        self.spark, self.paths = spark, {name: path.rstrip("/") for name, path in paths.items()}
        self.tables = {name: (tables or TABLES)[name] for name in paths}
        self.flush_rows, self.flush_seconds, self.clock = flush_rows, flush_seconds, clock
        self._staged = Records(spark, f"{next(iter(self.paths.values()))}/_epochs")
        self._flushed = {t: Records(spark, f"{path}/_flushed") for t, path in self.paths.items()}

    def _stage(self, table: str, epoch: int) -> str:
        return f"{self.paths[table]}/_staged/{epoch}"

    def write_epoch(self, batch: DataFrame, epoch: int) -> None:
        """Stage the rows of a micro-batch and flush what is due. Any part may be repeated: an epoch
        without a record is written over, one with a record (or flushed and tidied) is skipped."""
        if epoch not in self._staged.numbers() and epoch > max(self._upto(t) for t in self.tables):
            batch.persist()
            try:
                rows = {}
                for name, (take, _) in self.tables.items():
                    take(batch).write.mode("overwrite").parquet(self._stage(name, epoch))
                    rows[name] = self.spark.read.parquet(self._stage(name, epoch)).count()  # from file footers
            finally:
                batch.unpersist()
            self._staged.create(epoch, {"rows": rows, "at": self.clock()})
        self.flush()

    def _upto(self, table: str) -> int:
        return max(self._flushed[table].numbers(), default=-1)

    def _pending(self, table: str) -> list[int]:
        upto = self._upto(table)
        return [e for e in self._staged.numbers() if e > upto]

    def flush(self, force: bool = False) -> None:
        """Move staged rows of each table that is full or old enough (or any, if ``force``) into it.

        To be called on a timer too: no micro-batch comes while no event does."""
        told = {e: self._staged.read(e) for e in self._staged.numbers()}
        for name, (_, kind) in self.tables.items():
            epochs = self._pending(name)
            rows = sum(told[e]["rows"][name] for e in epochs)
            old = bool(epochs) and self.clock() - told[epochs[0]]["at"] >= self.flush_seconds
            if epochs and (force or old or rows >= self.flush_rows):
                if rows:
                    out = self.spark.read.parquet(*[self._stage(name, e) for e in epochs])
                    # as many range partitions as full row groups, not one for every shuffle partition
                    out = layout(out, kind, num_partitions=max(1, rows // 1_000_000)) if kind else with_month(out)
                    out.write.mode("overwrite").partitionBy("yyyymm").parquet(f"{self.paths[name]}/upto={epochs[-1]}")
                self._flushed[name].create(epochs[-1], {"from": epochs[0], "rows": rows})
        self._tidy()

    def _tidy(self) -> None:
        """Drop staged folders and records of epochs that every table has flushed."""
        done = min(self._upto(t) for t in self.tables)
        for e in self._staged.numbers():
            if e <= done:
                for name in self.tables:
                    remove_folder(self.spark, self._stage(name, e))
                self._staged.remove(e)

    def read(self, table: str, schema: str, staged: bool = False) -> DataFrame:
        """Rows of all flushes (and, if ``staged``, of epochs that wait for one). Filters on
        ``yyyymm`` and columns go down to the files; folders without a record aren't opened."""
        base = self.paths[table]
        full = f"{schema}, upto BIGINT, yyyymm INT"
        found = [u for u in self._flushed[table].numbers() if self._flushed[table].read(u)["rows"]]
        out = self.spark.read.schema(full).option("basePath", base).parquet(*[f"{base}/upto={u}" for u in found]) if found else self.spark.createDataFrame([], full)
        out = out.drop("upto")
        waiting = self._pending(table) if staged else []
        if waiting:
            more = self.spark.read.schema(schema).parquet(*[self._stage(table, e) for e in waiting])
            out = out.unionByName(with_month(more) if "yyyymm" in out.columns else more)
        return out


def start_table_writer(events: DataFrame, logs_path: str, metrics_path: str, checkpoint: str, trigger_seconds: int = FLUSH_SECONDS,
                       available_now: bool = False, flush_rows: int | None = None, flush_seconds: float = FLUSH_SECONDS):
    """A streaming query that feeds the log and metric tables; traces are dropped.

    A query that runs on waits for ``FLUSH_ROWS`` rows or ``flush_seconds``; one that stops at the
    end of what is there (``available_now``) flushes every batch."""
    rows = flush_rows or (1 if available_now else FLUSH_ROWS)
    tables = EpochTables(events.sparkSession, {"logs": logs_path, "metrics": metrics_path}, flush_rows=rows, flush_seconds=flush_seconds)
    w = events.writeStream.foreachBatch(tables.write_epoch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()
