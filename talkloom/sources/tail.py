"""Log files that grow, as a data source: whole lines once, rewritten files anew, unfinished last lines only in batch reads.

    spark.dataSource.register(GrowingLines)
    spark.readStream.format("growing_lines").option("path", folder).load()   # appended lines
    spark.read.format("growing_lines").option("path", folder).load()         # the files as they are now
"""

from __future__ import annotations

import hashlib
import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes in front of a committed place whose digest tells whether the file only grew.
SEAM_BYTES = 64
#: Bytes that a batch of a stream reads at most, unless one line is longer; and that one task reads.
BATCH_BYTES, TASK_BYTES = 1 << 30, 32 << 20
#: Bytes that are read at once.
STEP = 1 << 20
SCHEMA = "file string, generation int, start long, value string, whole boolean"
ARROW = pa.schema([("file", pa.string()), ("generation", pa.int32()), ("start", pa.int64()), ("value", pa.string()), ("whole", pa.bool_())])
#: Lines of an Arrow batch.
ROWS = 4096


def system_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Files:
    """Files below a path, by any file system that Arrow knows; the path must mean the same on all executors."""

    def __init__(self, path: str, suffix: str = ".jsonl"):
        self.path, self.suffix = path, suffix
        self.system, self.root = system_of(path)

    def sizes(self) -> dict[str, int]:
        found = self.system.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True))
        return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.endswith(self.suffix) and not posixpath.basename(f.path).startswith((".", "_"))}

    def span(self, file: str, start: int, end: int) -> bytes:
        """The bytes from start to end, fewer where the file is shorter, none where it is gone."""
        try:
            with self.system.open_input_file(file) as f:
                return f.read_at(max(0, min(end, f.size()) - start), start) if start < f.size() else b""
        except FileNotFoundError:
            return b""

    def seam(self, file: str, at: int) -> str:
        return hashlib.sha256(self.span(file, max(0, at - SEAM_BYTES), at)).hexdigest()[:16]

    def line_end(self, file: str, start: int, end: int) -> int:
        """The place behind the last line end between start and end, or start; looks backward from the end."""
        while end > start:
            low = max(start, end - STEP)
            at = self.span(file, low, end).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            end = low
        return start

    def next_line_end(self, file: str, start: int, size: int) -> int:
        """The place behind the first line end from start on, or start if there is none."""
        low = start
        while low < size:
            at = self.span(file, low, low + STEP).find(b"\n")
            if at >= 0:
                return low + at + 1
            low += STEP
        return start


@dataclass
class Span(InputPartition):
    """Lines of a file that begin from start to before end; check: the seam at `until` when the batch was planned."""

    file: str
    generation: int
    start: int
    end: int
    first: int
    until: int
    check: str | None


def spans(file: str, generation: int, start: int, until: int, check: str | None, each: int) -> list[Span]:
    return [Span(file, generation, low, min(low + each, until), start, until, check) for low in range(start, until, each)]


def lines(files: Files, part: Span) -> Iterator[tuple[int, bytes, bool]]:
    """(place, line, whether it has its end) of the non-empty lines that begin inside the span; the last one is read past the span's end."""
    at = part.start
    if at > part.first and files.span(part.file, at - 1, at) != b"\n":
        at = files.next_line_end(part.file, at, part.until)
        if at == part.start:  # one line reaches through; it belongs to the span where it begins
            return
    place, rest = at, bytearray()
    while place < part.end and at < part.until:
        step = files.span(part.file, at, min(at + STEP, part.until))
        if not step:
            return
        at += len(step)
        begin, look = 0, len(rest)
        rest += step
        while (end := rest.find(b"\n", look)) >= 0:
            if place >= part.end:
                return
            if end > begin:
                yield place, bytes(rest[begin:end]), True
            place += end + 1 - begin
            begin = look = end + 1
        del rest[:begin]
    if rest and place < part.end:
        yield place, bytes(rest), False


def batches(files: Files, part: Span | None) -> Iterator[pa.RecordBatch]:
    """The rows of a span; none if the file is no longer the one that was planned, as it then comes again with a new generation.

    Spark asks for one empty partition where there are none.
    """
    if part is None:
        return
    if part.check is not None and files.seam(part.file, part.until) != part.check:
        return
    rows: list[tuple] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

    held = 0
    for place, line, whole in lines(files, part):
        rows.append((part.file, part.generation, place, line.decode("utf-8", "replace"), whole))
        held += len(line)
        if len(rows) == ROWS or held >= STEP:
            yield made()
            rows, held = [], 0
    if rows:
        yield made()


class LinesReader(DataSourceReader):
    """All files as they are now; a last line without an end is a row that is not whole."""

    def __init__(self, options: dict):
        self.files = Files(options["path"], options.get("suffix", ".jsonl"))
        self.each = int(options.get("taskBytes", TASK_BYTES))

    def partitions(self) -> list[Span]:
        return [s for file, size in self.files.sizes().items() for s in spans(file, 0, 0, size, None, self.each)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return batches(self.files, partition)


class LinesStreamReader(DataSourceStreamReader):
    """Offsets are {file: {at, seam, generation}}: bytes committed, a digest of the last of them, times begun anew.

    A file whose committed end no longer has its seam, or that is shorter, begins anew with the next generation;
    a reader keeps the rows of a file's last generation.  Files that vanish keep their offset.  at always
    lies behind a line end, so an unfinished line waits until it is whole and no line comes twice.

    Spark asks for the latest offset without saying where the query stands, so the offset given last is kept in
    the journal, written before it is returned: a restarted query goes on from there, and what lies between
    its own start and that offset is read as one batch.
    """

    def __init__(self, options: dict):
        if "journal" not in options:
            raise ValueError("a stream of growing lines needs the option journal: a file of its own that outlives restarts")
        self.files = Files(options["path"], options.get("suffix", ".jsonl"))
        self.each = int(options.get("taskBytes", TASK_BYTES))
        self.most = int(options.get("batchBytes", BATCH_BYTES))
        self.journal = system_of(options["journal"])
        self.known: dict | None = None
        self.served = ""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        if self.known is None:
            self.known = self._remembered()
        sizes = self.files.sizes()
        names = sorted(sizes)
        # files behind the one served last come first, so none waits for ever
        names = [n for n in names if n > self.served] + [n for n in names if n <= self.served]
        out, left = dict(self.known), self.most
        for file in names:
            if left <= 0:
                break
            size, old = sizes[file], out.get(file) or {"at": 0, "generation": 0, "seam": None}
            at, generation = old["at"], old["generation"]
            if size < at or (at and self.files.seam(file, at) != old["seam"]):
                at, generation = 0, generation + 1
            end = self.files.line_end(file, at, min(size, at + left))
            if end == at and left == self.most < size - at:  # a line longer than a whole batch goes by itself
                end = self.files.next_line_end(file, at, size)
            if (end, generation) != (old["at"], old["generation"]):
                out[file] = {"at": end, "seam": self.files.seam(file, end), "generation": generation}
                left -= end - at
                self.served = file
        if out != self.known:
            self._remember(out)
        self.known = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Span]:
        made = []
        for file, old in start.items():
            to = end.get(file)
            if to is None or (to["generation"], to["at"]) < (old["generation"], old["at"]):
                raise ValueError(f"the journal does not know how far {file} was read; it belongs to another query or was lost")
        for file, to in end.items():
            old = start.get(file)
            begin = old["at"] if old and old["generation"] == to["generation"] else 0
            made += spans(file, to["generation"], begin, to["at"], to["seam"], self.each)
        return made

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return batches(self.files, partition)

    def _remembered(self) -> dict:
        system, path = self.journal
        try:
            with system.open_input_stream(path) as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return {}

    def _remember(self, offset: dict) -> None:
        system, path = self.journal
        with system.open_output_stream(f"{path}.new") as f:
            f.write(json.dumps(offset).encode())
        system.move(f"{path}.new", path)


class GrowingLines(DataSource):
    """Lines of growing files: file, generation, start (the line's first byte), value, whole.

    Options: path (a folder, searched through), suffix (.jsonl), batchBytes and taskBytes; for streams journal (a
    file of the query's own, on a file system that outlives the driver).  Empty lines are left out.  Bytes that are not
    UTF-8 are replaced.  Offsets hold one entry for each file, so a folder should not keep millions of them.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LinesReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LinesStreamReader(self.options)


def latest_generation(rows: DataFrame, file: str = "file", generation: str = "generation") -> DataFrame:
    """The rows of each file's last generation: what a rewritten file holds now."""
    last = rows.groupBy(F.col(file).alias("__file")).agg(F.max(generation).alias("__last"))
    return rows.join(last, (F.col(file) == F.col("__file")) & (F.col(generation) == F.col("__last"))).drop("__file", "__last")


#: Bytes of a file's ends that are read for its fields.
HEAD_BYTES, TAIL_BYTES = 65_536, 65_536
HEADS = "file string, size long, modified timestamp, head string, tail string"


class EndsReader(DataSourceReader):
    """The first and the last kilobytes of each file; a task takes `files` files."""

    def __init__(self, options: dict):
        self.files = Files(options["path"], options.get("suffix", ".jsonl"))
        self.head, self.tail = int(options.get("headBytes", HEAD_BYTES)), int(options.get("tailBytes", TAIL_BYTES))
        self.each = int(options.get("files", 256))

    def partitions(self) -> list[InputPartition]:
        names = list(self.files.sizes())
        return [InputPartition(names[i : i + self.each]) for i in range(0, len(names), self.each)]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        for info in [] if partition is None else self.files.system.get_file_info(partition.value):
            if info.type == fs.FileType.File:
                head = self.files.span(info.path, 0, self.head)
                tail = self.files.span(info.path, max(self.head, info.size - self.tail), info.size)
                yield info.path, info.size, info.mtime, head.decode("utf-8", "replace"), tail.decode("utf-8", "replace")


class FileEnds(DataSource):
    """file, size, modified, head, tail of the files below a path; tail begins behind head, so short files have all in head.

    Options: path, suffix (.jsonl), headBytes and tailBytes (65,536), files (a task's number of files).
    """

    @classmethod
    def name(cls) -> str:
        return "file_ends"

    def schema(self) -> str:
        return HEADS

    def reader(self, schema) -> DataSourceReader:
        return EndsReader(self.options)


def json_field(text: Column, name: str) -> Column:
    """The first string field of this name in JSON lines, as it is escaped there; null if there is none."""
    found = F.regexp_extract(text, rf'"{name}":"((?:[^"\\]|\\.)*+)"', 1)
    return F.when(F.regexp_like(text, F.lit(rf'"{name}":"(?:[^"\\]|\\.)*+"')), found)


def folder_of() -> Column:
    """The working folder named first in a session's head."""
    return json_field(F.col("head"), "cwd")


def title_of() -> Column:
    """The title named first in a session's ends; titles in the middle of files larger than both ends are not seen."""
    return F.coalesce(json_field(F.col("head"), "aiTitle"), json_field(F.col("tail"), "aiTitle"))
