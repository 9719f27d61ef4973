"""Lines of files that grow, as a stream with byte offsets.

Offsets are the bytes read of each file, so a restart goes on in the middle of a file and neither loses nor repeats
a line. A line counts once its line feed is there. A micro-batch takes a bounded number of bytes; a batch's bytes
are cut into ranges that tasks read side by side. Files are opened by path, so the folder has to be mounted on the
driver and all executors; names must not be used again.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a micro-batch, and of a task's range, at most (a longer line is a batch or a range of its own).
BATCH, RANGE, CHUNK = 64 << 20, 8 << 20, 1 << 16


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def last_line_end(path: str, start: int, most: int) -> int:
    """The end of the last whole line within ``most`` bytes from ``start``; of the first one if it is longer; else ``start``."""
    with open(path, "rb") as f:
        size = os.fstat(f.fileno()).st_size
        at = min(size, start + most)
        while at > start:
            back = max(start, at - CHUNK)
            f.seek(back)
            found = f.read(at - back).rfind(b"\n")
            if found >= 0:
                return back + found + 1
            at = back
        at = start + most
        while at < size:
            f.seek(at)
            found = f.read(CHUNK).find(b"\n")
            if found >= 0:
                return at + found + 1
            at += CHUNK
    return start


class TailReader(DataSourceStreamReader):
    """``at``: the bytes read of each file so far, as far as this reader knows; null before it knows."""

    def __init__(self, folder: str, batch: int, size: int, checkpoint: str | None):
        self.folder, self.batch, self.size = folder, batch, size
        self.at = last_offset(checkpoint) if checkpoint else None

    def initialOffset(self) -> dict:
        self.at = {}
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        """From where the last batch ended, as many whole lines as a batch may have, files in the order of their names.

        Without knowing where that was, all whole lines there are: never less than what has been read.
        """
        offsets, left = dict(self.at or {}), self.batch if self.at is not None else 1 << 62
        for name in sorted(os.listdir(self.folder)):
            path = os.path.join(self.folder, name)
            if left <= 0:
                break
            if name.startswith((".", "_")) or not os.path.isfile(path):
                continue
            start = offsets.get(name, 0)
            end = last_line_end(path, start, left)
            # a line that is longer than what is left is taken only where a batch would be empty
            if end > start and (end - start <= left or offsets == (self.at or {})):
                offsets[name], left = end, left - (end - start)
        return {"files": json.dumps(offsets, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after, out = json.loads(start["files"]), json.loads(end["files"]), []
        self.at = after
        for name, upto in sorted(after.items()):
            at, path = before.get(name, 0), os.path.join(self.folder, name)
            while at < upto:
                cut = upto if upto - at <= self.size else min(upto, last_line_end(path, at, self.size))
                out.append(Range(path, at, cut))
                at = cut
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        name = os.path.basename(partition.path)
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            at = partition.start
            while at < partition.end:
                line = f.readline()
                yield name, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        if self.at is None:
            self.at = json.loads(end["files"])


def last_offset(checkpoint: str) -> dict:
    """What a query's checkpoint says was planned last."""
    folder = os.path.join(checkpoint.removeprefix("file://"), "offsets")
    numbers = [int(n) for n in os.listdir(folder) if n.isdigit()] if os.path.isdir(folder) else []
    if not numbers:
        return {}
    with open(os.path.join(folder, str(max(numbers)))) as f:
        return json.loads(json.loads(f.read().splitlines()[-1])["files"])


class GrowingFiles(DataSource):
    """``spark.readStream.format("growing_lines").option("path", folder)``: file, offset, value.

    Options: ``batchBytes``, ``rangeBytes``, and ``checkpoint``, the folder of the query's checkpoint, from which a
    restarted reader learns how far it had come, so that its first batch is bounded as well. One micro-batch follows
    another as long as there are new lines; with ``trigger(availableNow=True)`` there is one, so that bounded form
    needs a batch as large as what is there.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "file string, offset long, value string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return TailReader(self.options["path"], int(self.options.get("batchBytes", BATCH)), int(self.options.get("rangeBytes", RANGE)), self.options.get("checkpoint"))
