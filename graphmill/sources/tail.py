"""Following files that grow.

Spark's file source takes a file once and never sees what is appended to it later. ``line_tail`` is a streaming source whose
offset is a byte position in each file below a folder: a batch has the whole lines that were added since, and a line without
its end waits until the rest of it is there. Long additions are read in parts by several tasks; a line belongs to the part
in which it begins. The same offsets always give the same rows, so a batch that is replayed after a failure is the same
batch. Files are read through Arrow's file systems, from whatever store all executors see.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, byte long, value string"
#: Bytes of a file that one task reads, and that are looked at or decoded at a time.
PART, STEP = 64 << 20, 1 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def last_end(files: fs.FileSystem, path: str, start: int, size: int) -> int:
    """The byte behind the last whole line between ``start`` and ``size``: ``start`` if there is none."""
    with files.open_input_file(path) as f:
        end = size
        while end > start:
            begin = max(start, end - STEP)
            at = f.read_at(end - begin, begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return start


def lines_between(files: fs.FileSystem, path: str, begin: int, end: int, first: int, stop: int) -> Iterator[list[tuple[int, bytes]]]:
    """Lines that begin in ``[begin, end)``, with their bytes, in lists of bounded size. The addition is ``[first, stop)``
    and ends with a line's end; a part that doesn't begin it leaves the line that it falls into to the part before."""
    with files.open_input_file(path) as f:
        held, at, whole = b"", begin, begin == first
        if not whole:  # a line begins here only if the byte before ends one
            at = begin - 1
        place = at
        while at < stop:
            held += f.read_at(min(STEP, stop - at), at)
            at = min(at + STEP, stop)
            out = []
            while (cut := held.find(b"\n")) >= 0:
                if whole and place >= end:
                    break
                if whole:
                    out.append((place, held[:cut]))
                whole, place, held = True, place + cut + 1, held[cut + 1 :]
                if len(out) == 4096:
                    yield out
                    out = []
            if out:
                yield out
            if whole and place >= end:
                return


class _Part(InputPartition):
    def __init__(self, path: str, begin: int, end: int, first: int, stop: int):
        self.path, self.begin, self.end, self.first, self.stop = path, begin, end, first, stop


class _TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.part = options["path"], int(options.get("partBytes", PART))
        self.names = re.compile(options.get("names", ".*"))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, root = _opened(self.folder)
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
        own = [f for f in found if f.type == fs.FileType.File and not re.search(r"(^|/)[_.]", f.path.removeprefix(root)) and self.names.fullmatch(f.base_name)]
        ends = {f.path.removeprefix(root).lstrip("/"): last_end(files, f.path, 0, f.size) for f in own}
        return {name: end for name, end in sorted(ends.items()) if end}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for name, stop in end.items():
            first = start.get(name, 0)
            out += [_Part(name, b, min(stop, b + self.part), first, stop) for b in range(first, stop, self.part)]
        return out

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        files, root = _opened(self.folder)
        for lines in lines_between(files, f"{root}/{partition.path}", partition.begin, partition.end, partition.first, partition.stop):
            values = [v.removesuffix(b"\r").decode("utf-8", "replace") for _, v in lines]
            yield pa.record_batch([pa.array([partition.path] * len(lines)), pa.array([b for b, _ in lines], pa.int64()), pa.array(values)], ["file", "byte", "value"])


class LineTail(DataSource):
    """``file, byte, value``: the lines of the files in ``path`` (option ``names``: a pattern for file names; ``partBytes``)."""

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TailReader(dict(self.options))


def tail_lines(spark: SparkSession, folder: str, names: str = ".*", part_bytes: int = PART) -> DataFrame:
    """The whole lines of a folder's growing files as a stream; (file, byte) orders them."""
    spark.dataSource.register(LineTail)
    return spark.readStream.format("line_tail").option("path", folder).option("names", names).option("partBytes", str(part_bytes)).load()
