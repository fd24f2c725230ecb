"""Texts as files, written once: only files whose content changed, each whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from talkloom.sources.index import _exists
from talkloom.sources.tables import written
from talkloom.sources.tail import system_of

MANIFEST = "file string, sha string"


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has written under temporary names: (temporary, final)."""

    moves: list[tuple[str, str]]


class FilesWriter(DataSourceWriter):
    """Tasks write temporary files; the commit of the job gives them their names, an abort removes them.

    A task that is lost leaves temporary files only, whose names begin with a dot; its other try writes its own.
    """

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows: Iterator[Row]) -> Written:
        system, root = system_of(self.path)
        moves = []
        for row in rows:
            name = row["file"]
            if name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"a file outside the folder: {name}")
            final = f"{root}/{name}"
            folder, _, last = final.rpartition("/")
            temporary = f"{folder}/.{last}.{uuid.uuid4().hex}"
            system.create_dir(folder, recursive=True)
            with system.open_output_stream(temporary) as f:
                f.write(row["content"].encode())
            moves.append((temporary, final))
        return Written(moves)

    def commit(self, messages: list) -> None:
        system, _ = system_of(self.path)
        for message in messages:
            for temporary, final in message.moves if message else ():
                system.move(temporary, final)

    def abort(self, messages: list) -> None:
        system, _ = system_of(self.path)
        for message in messages:
            for temporary, _final in message.moves if message else ():
                system.delete_file(temporary)


class TextFiles(DataSource):
    """A sink of rows (file, content): one file for each row below the option path."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "file string, content string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FilesWriter(self.options)


def _versions(spark, folder: str) -> list[int]:
    if not _exists(spark, folder):
        return []
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(where)]
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and _exists(spark, f"{folder}/{n}/_SUCCESS"))


def manifest(spark, manifests: str) -> DataFrame:
    """(file, sha) of all files written so far."""
    found = _versions(spark, manifests)
    return spark.read.schema(MANIFEST).parquet(f"{manifests}/version={found[-1]}") if found else spark.createDataFrame([], MANIFEST)


def write_changed(rows: DataFrame, path: str, manifests: str) -> int:
    """Write the rows (file, content) whose content is not what the manifest has of that file; how many were written.

    Files are named by the driver once all tasks are done, then a new version of the manifest stands; a run that
    dies between the two writes the same contents again.  Of a file that rows repeat the greatest content
    counts.  Null contents are empty files, rows without a file are left out; files that no row names stay.
    """
    spark = rows.sparkSession
    spark.dataSource.register(TextFiles)
    wanted = rows.where("file is not null").groupBy("file").agg(F.max(F.coalesce("content", F.lit(""))).alias("content")).withColumn("sha", F.sha2("content", 256))
    known = manifest(spark, manifests)
    changed = written(wanted.join(known, ["file", "sha"], "left_anti"), "files-changed")
    n = changed.count()
    if n:
        changed.select("file", "content").write.format("text_files").option("path", path).mode("append").save()
        new = known.join(changed.select("file"), "file", "left_anti").union(changed.select("file", "sha"))
        new.write.mode("overwrite").parquet(f"{manifests}/version={max(_versions(spark, manifests), default=0) + 1}")
    return n
