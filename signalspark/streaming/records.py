"""Commit records: small files whose names say which parts of a table count.

A record is created in one step after the data that it names is complete, so a reader that goes
by records never sees half of a write, and a writer that starts again sees how far it came.
Names are listed and created through Hadoop's file systems, wherever the table lies.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Records:
    """Records under a folder, by number."""

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark._jvm
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([folder, *parts]))
        self._jvm = jvm
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Numbers of all records, ascending."""
        if not self._fs.exists(self._path()):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path())]
        return sorted(int(n) for n in names if n.isdigit())

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._path(str(number)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def create(self, number: int, told: dict) -> None:
        """Make record ``number``, unless it is there: written aside, then renamed."""
        aside, place = self._path(f"_{number}.tmp"), self._path(str(number))
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        if not self._fs.rename(aside, place):
            self._fs.delete(aside, False)

    def remove(self, number: int) -> None:
        self._fs.delete(self._path(str(number)), False)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder with all in it, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
