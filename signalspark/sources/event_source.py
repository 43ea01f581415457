"""The event stream as a Spark data source, batch and streaming.

``spark.read.format("signal_events")`` reads a folder of append-only JSON-lines segments, as
a broker's topic keeps its partitions. A row is one complete line with the segment and the byte
at which it starts, so any row can be found again. Batch reads cut segments into byte ranges; a
stream's offset is the number of bytes taken from each segment, and a line that is still being
written stays for a later batch. Files are opened through ``pyarrow.fs``, so a path may lie in
any store that it knows. Decoding and the reject path are in ``events_io``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "signal_events"
SCHEMA = "value BINARY, segment STRING, position BIGINT"
#: Bytes of a range that one task reads, of one block, and lines of one Arrow batch.
SPLIT_BYTES, BLOCK_BYTES, BATCH_LINES = 64 * 1024 * 1024, 1024 * 1024, 10_000


class Range(InputPartition):
    """Lines of a segment whose first byte lies from ``start`` to ``end`` (exclusive)."""

    def __init__(self, segment: str, start: int, end: int):
        self.segment, self.start, self.end = segment, start, end


class _Folder:
    def __init__(self, options):
        self.path = options["path"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def _open(self):
        from pyarrow import fs
        path = self.path.replace("file:/", "file:///", 1) if self.path.startswith("file:/") and not self.path.startswith("file://") else self.path
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def sizes(self) -> dict[str, int]:
        """Segments by name; names that start with a dot or an underscore are no segments."""
        from pyarrow import fs
        store, root = self._open()
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return {f.base_name: f.size for f in sorted(found, key=lambda f: f.base_name) if f.type == fs.FileType.File and f.base_name[0] not in "._"}

    def ranges(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        return [Range(s, at, min(at + self.split, end[s])) for s in sorted(end) for at in range(start.get(s, 0), end[s], self.split)]

    def last_line_end(self, segment: str, size: int) -> int:
        """Bytes up to the last line break; the tail is read block by block."""
        store, root = self._open()
        with store.open_input_file(f"{root}/{segment}") as f:
            while size > 0:
                at = max(0, size - BLOCK_BYTES // 16)
                cut = f.read_at(size - at, at).rfind(b"\n")
                if cut >= 0:
                    return at + cut + 1
                size = at
        return 0

    def read(self, part: Range, last_line: bool) -> Iterator:
        """Arrow batches of a range. A range starts after the first line break from the byte before
        it on, and runs on to the end of its last line; ``last_line``: an unended one counts too."""
        import pyarrow as pa
        store, root = self._open()
        values, places = [], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), pa.array([part.segment] * len(values)), pa.array(places, pa.int64())],
                                              ["value", "segment", "position"])
        with store.open_input_file(f"{root}/{part.segment}") as f:
            size, at, rest = f.size(), max(0, part.start - 1), b""
            line = at  # where the line at hand starts
            skip = part.start > 0
            while line < part.end:
                block = f.read_at(min(BLOCK_BYTES, size - at), at) if at < size else b""
                at += len(block)
                if not block:
                    if rest.strip() and last_line and not skip:
                        values.append(rest)
                        places.append(line)
                    break
                lines = (rest + block).split(b"\n")
                rest = lines.pop()
                for text in lines:
                    if line >= part.end:
                        break
                    if not skip and text.strip():
                        values.append(text)
                        places.append(line)
                    skip, line = False, line + len(text) + 1
                if len(values) >= BATCH_LINES:
                    yield batch()
                    values, places = [], []
        if values:
            yield batch()


class _BatchReader(DataSourceReader):
    def __init__(self, folder: _Folder):
        self.folder = folder

    def partitions(self) -> list[Range]:
        return self.folder.ranges({}, self.folder.sizes()) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator:
        return self.folder.read(partition, last_line=True) if partition.end else iter(())


class _StreamReader(DataSourceStreamReader):
    """Offsets are bytes by segment; a segment that is gone leaves the offset with it."""

    def __init__(self, folder: _Folder):
        self.folder, self.seen = folder, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        sizes = self.folder.sizes()
        grown = {s: n for s, n in sizes.items() if self.seen.get(s, (-1, 0))[0] != n}
        self.seen = {s: (n, self.folder.last_line_end(s, n) if s in grown else self.seen[s][1]) for s, n in sizes.items()}
        return {s: end for s, (_, end) in self.seen.items()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.folder.ranges(start, end)

    def read(self, partition: Range) -> Iterator:
        return self.folder.read(partition, last_line=False)


class EventSource(DataSource):
    """Options: ``path`` (folder of segments), ``splitBytes`` (bytes a task reads)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(_Folder(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(_Folder(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(EventSource)
