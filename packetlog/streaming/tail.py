"""Log files that grow, as a streaming source: lines appended to the given files, by
byte offsets.

A file is known by its first line (log lines carry their time), not by its name, so a
rotation loses and repeats nothing: after a rename the rest of the old file is read
under its new name, after copy-and-truncate from the copy, and the new file from its
beginning. Rotated names are those of ``fw.log.1`` or ``fw.log-20240131``; packed
ones are not looked at, so a file should be packed one rotation later. An offset is,
for each path, the end of the last whole line of every file of that name. It
depends on the files alone, and a batch is the difference of two offsets, so a batch
that is tried again reads the same bytes. A line counts once its LF is there.

The driver looks at the ends of the files only; the ranges of a batch are cut into
splits, which the executors read. Paths may be of any file system that Arrow opens.
"""

from __future__ import annotations

import contextlib
import hashlib
import io
import json
import re
import sys
import time
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# Executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "growing_log"
SPLIT_BYTES = 128 * 1024 * 1024
BLOCK = 1 << 16
BATCH_LINES = 8192
LISTINGS, LISTING_PAUSE = 100, 0.05

_SCHEMA = "value string, file_entry int, file_path string, file_block_start long, file_modification_time timestamp"


@dataclass
class LogFile:
    """One file of a followed name: where it is now, its place in the rotation (the
    larger, the newer), the end of its last whole line, its time of change."""
    path: str
    place: tuple
    end: int
    changed: float


def file_system(path: str):
    """Arrow's file system of a path or URI, and the path in it."""
    from pyarrow import fs
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)


def _place(name: str, log: str) -> tuple | None:
    """The place of the file ``name`` among the rotated files of ``log``."""
    if name == log:
        return (2, 0)
    if not name.startswith(log):
        return None
    turn = re.fullmatch(r"\.(\d{1,3})|[.-](\d{6,14})", name[len(log):])
    return turn and ((0, -int(turn[1])) if turn[1] else (1, int(turn[2])))


def _first_line(file) -> str | None:
    """What tells a file apart, or None while it has no whole line."""
    file.seek(0)
    head = file.read(BLOCK)
    end = head.find(b"\n") + 1
    if not end and len(head) < BLOCK:
        return None
    return hashlib.sha1(head[:end] if end else head).hexdigest()


def _whole_lines(file, size: int) -> int:
    """The end of the last line that has its LF, searched from the end."""
    while size > 0:
        start = max(0, size - BLOCK)
        file.seek(start)
        lf = file.read(size - start).rfind(b"\n")
        if lf >= 0:
            return start + lf + 1
        size = start
    return 0


def _names(fs, plain: str) -> list:
    """The files of a log, newest first."""
    from pyarrow import fs as arrow_fs
    folder, log = plain.rsplit("/", 1)
    files = [i for i in fs.get_file_info(arrow_fs.FileSelector(folder or "/", allow_not_found=True))
             if i.type == arrow_fs.FileType.File and _place(i.base_name, log)]
    return sorted(files, key=lambda i: _place(i.base_name, log), reverse=True)


def log_files(path: str) -> dict[str, LogFile]:
    """The files of a followed name by first line.

    Rotation moves files from newer names to older ones: read newest first, a file
    that moves meanwhile is seen twice, not missed. A listing during which names came
    or went is taken again."""
    fs, plain = file_system(path)
    for _ in range(LISTINGS):
        listed, found = _names(fs, plain), {}
        with contextlib.suppress(FileNotFoundError):
            for info in listed:
                with fs.open_input_file(info.path) as file:
                    known, end = _first_line(file), _whole_lines(file, file.size())
                if known and (known not in found or found[known].end < end):
                    found[known] = LogFile(info.path, _place(info.base_name, plain.rsplit("/", 1)[1]), end, info.mtime_ns / 1e9)
            if [i.path for i in _names(fs, plain)] == [i.path for i in listed]:
                return found
        time.sleep(LISTING_PAUSE)
    raise RuntimeError(f"the files of {path} change too fast to be listed")


def offsets(paths: list[str]) -> dict:
    """The end of the last whole line of every file of the followed names."""
    return {p: {known: f.end for known, f in sorted(log_files(p).items())} for p in paths}


def start_offsets(paths: list[str], from_start: bool) -> dict:
    """Where a feed begins: at the end of what is there or, ``from_start``, at the
    beginning of the present files (rotated ones are history in both cases)."""
    now = {p: log_files(p) for p in paths}
    return {p: {known: f.end for known, f in sorted(files.items()) if not (from_start and f.place == _place("", ""))}
            for p, files in now.items()}


@dataclass
class Split(InputPartition):
    """Lines that begin in ``[start, stop)`` of one file; a line begins at ``start``
    if ``first``."""
    entry: int
    log: str
    known: str
    path: str
    start: int
    stop: int
    first: bool
    changed: float


def splits(paths: list[str], start: dict, end: dict, split_bytes: int) -> list[Split]:
    """The splits between two offsets, in the order of the lines: paths as given, the
    files of a path from the oldest."""
    out: list[Split] = []
    entry = 0
    for p in paths:
        before = start.get(p, {})
        grown = {known: e for known, e in end.get(p, {}).items() if e > before.get(known, 0)}
        files = log_files(p) if grown else {}
        if lost := grown.keys() - files.keys():
            raise FileNotFoundError(f"{len(lost)} files of {p} went before their last lines were read")
        for known in sorted(grown, key=lambda k: files[k].place):
            at, stop, f = before.get(known, 0), grown[known], files[known]
            out += [Split(entry, p, known, f.path, a, min(a + split_bytes, stop), a == at, f.changed)
                    for a in range(at, stop, split_bytes)]
            entry += 1
    return out


def _open(split: Split):
    """The file of a split, also if it got another name since the split was made."""
    fs, _ = file_system(split.log)
    for look in (lambda: split.path, lambda: log_files(split.log)[split.known].path):
        with contextlib.suppress(FileNotFoundError, KeyError):
            file = fs.open_input_file(look())
            if _first_line(file) == split.known:
                return file
            file.close()
    raise FileNotFoundError(f"a file of {split.log} went before its lines were read")


def read_split(split: Split):
    """The lines of a split in order, in Arrow batches."""
    import pyarrow as pa
    types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.timestamp("us", tz="UTC")]
    names = [c.split()[0] for c in _SCHEMA.split(", ")]

    def batch(lines):
        fixed = (split.entry, split.path, split.start, int(split.changed * 1_000_000))
        columns = [pa.array(lines, types[0])] + [pa.repeat(pa.scalar(v, t), len(lines)) for v, t in zip(fixed, types[1:])]
        return pa.RecordBatch.from_arrays(columns, names=names)

    with _open(split) as file, io.BufferedReader(file, BLOCK) as reader:
        at = split.start
        if split.first:
            reader.seek(at)
        else:  # the line that goes on across the start belongs to the split before
            reader.seek(at - 1)
            at += len(reader.readline()) - 1
        lines, size = [], 0
        while at < split.stop:
            line = reader.readline()
            if not line:
                raise OSError(f"{split.path} is shorter than it was")
            at += len(line)
            size += len(line)
            lines.append(line.removesuffix(b"\n").decode("utf-8", "replace"))
            if len(lines) == BATCH_LINES or size > BATCH_LINES * 1024:
                yield batch(lines)
                lines, size = [], 0
        if lines:
            yield batch(lines)


class GrowingLog(DataSource):
    """``spark.readStream.format("growing_log")`` with the options ``paths`` (JSON
    list), ``start`` (JSON offset, as of ``start_offsets``) and ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(json.loads(self.options["paths"]), json.loads(self.options["start"]),
                       int(self.options.get("splitBytes", SPLIT_BYTES)))


class _Reader(DataSourceStreamReader):
    def __init__(self, paths: list[str], start: dict, split_bytes: int):
        self.paths, self.start, self.split_bytes = paths, start, split_bytes

    def initialOffset(self) -> dict:
        return self.start

    def latestOffset(self) -> dict:
        return offsets(self.paths)

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return splits(self.paths, start, end, self.split_bytes)

    def read(self, partition: Split):
        return read_split(partition)
