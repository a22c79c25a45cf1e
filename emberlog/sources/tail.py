"""Files that grow and are rotated, as a source of Spark's own kind: each whole line once, over restarts too."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of one partition, about; and those that are read at once in search of a line's end.
PART_BYTES, BLOCK_BYTES = 64 << 20, 1 << 16


def _end_of_lines(path: str, size: int) -> int:
    """Where the last whole line of the first ``size`` bytes ends."""
    with open(path, "rb") as f:
        while size > 0:
            begin = max(0, size - BLOCK_BYTES)
            f.seek(begin)
            at = f.read(size - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            size = begin
    return 0


def _files(pattern: str) -> dict[str, str]:
    """File identity -> path. A file that is renamed keeps its identity."""
    found = {}
    for path in sorted(glob.glob(pattern)):
        if os.path.isfile(path):
            s = os.stat(path)
            found[f"{s.st_dev}:{s.st_ino}"] = path
    return found


@dataclass
class Stretch(InputPartition):
    """Bytes ``begin`` to ``end`` of a file: lines that begin in there."""

    file: str
    path: str
    begin: int
    end: int


class _Lines:
    def __init__(self, options: dict):
        self.pattern, self.part = options["path"], int(options.get("partBytes", PART_BYTES))

    def latestOffset(self) -> dict:
        return {key: _end_of_lines(path, os.path.getsize(path)) for key, path in _files(self.pattern).items()}

    def stretches(self, start: dict, end: dict) -> list[Stretch]:
        """What lies between two offsets. A file that has become shorter was emptied, and is read anew; one that is gone
        since ``end`` was taken is an error, as its lines are lost."""
        now, out = _files(self.pattern), []
        for key, upto in sorted(end.items()):
            begin = start.get(key, 0) if start.get(key, 0) <= upto else 0
            if begin == upto:
                continue
            if key not in now:
                raise FileNotFoundError(f"a file that holds bytes {begin} to {upto} is gone: {key}")
            cuts = [*range(begin, upto, self.part), upto]
            out += [Stretch(key, now[key], a, b) for a, b in zip(cuts, cuts[1:])]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        path = partition.path
        if not os.path.exists(path) or _files(path).get(partition.file) is None:  # renamed meanwhile
            path = _files(self.pattern)[partition.file]
        offsets, lines, held = [], [], 0
        with open(path, "rb") as f:
            at = partition.begin
            if at:  # a line that began before is the stretch's before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            while at < partition.end:
                line = f.readline()
                offsets.append(at)
                lines.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                at, held = at + len(line), held + len(line)
                if held > BLOCK_BYTES * 16 or not line:
                    yield self._batch(partition, offsets, lines)
                    offsets, lines, held = [], [], 0
        yield self._batch(partition, offsets, lines)

    @staticmethod
    def _batch(partition: Stretch, offsets: list, lines: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([partition.file] * len(lines), pa.string()), pa.array(offsets, pa.int64()), pa.array(lines, pa.string())], ["file", "offset", "value"])


class _Batch(_Lines, DataSourceReader):
    def partitions(self) -> list[Stretch]:
        return self.stretches({}, self.latestOffset()) or [Stretch("", "", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return super().read(partition) if partition.path else iter(())


class _Stream(_Lines, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return self.stretches(start, end)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """``file, offset, value``: lines of the files that ``path``, a pattern, names; also the rotated ones, so ``app.log*``.

    Files are told apart by device and inode, so one that is renamed isn't read again, and one that is made anew is. Only
    whole lines are taken: what a writer hasn't ended waits. Offsets are bytes by file, so a restart goes on where the
    checkpoint stands. A file that is emptied in place is read anew if it is found shorter than before; one that has grown past
    its old size by then can't be told from one that was appended to. ``partBytes`` is the size of a partition. All executors
    have to see the files under the same path.
    """

    @classmethod
    def name(cls) -> str:
        return "emberlog_tail"

    def schema(self) -> str:
        return "file string, offset long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    """Make ``spark.read`` and ``spark.readStream`` know the format ``emberlog_tail``."""
    spark.dataSource.register(TailSource)
