"""Folders listed, read and written by tasks.

A Python data source whose partitions are folders: the driver goes down a few levels until it has folders
enough, and each task lists what is below its own.  No list of files is held by the driver, neither
Spark's file index nor a local relation; files without content are listed as all others.  Contents
are read in a second step, dealt evenly by file, so that one folder with most of the files is no matter.

Stores are reached through Arrow's file systems (local, HDFS, S3, GCS, Azure).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import translate
from itertools import product

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from webloom.session import cut_lineage, let_workers_import, shuffle_width

#: Folders that the driver looks into at most before tasks go on.
ENOUGH = 64
#: Rows of a batch of a listing, and bytes of a batch and of a partition of contents.
LISTED = 10_000
BATCH_BYTES = 8 << 20
PART_BYTES = 64 << 20
#: Schemes that Arrow knows by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, as the session's file systems understand it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.strip("/")
    authority, _, path = rest.lstrip("/").partition("/")
    system, base = fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{authority}")
    return system, f"{base.rstrip('/')}/{path.rstrip('/')}"


def name_test(glob: str) -> re.Pattern:
    """Names that fit a glob with alternatives in braces."""
    parts = [p.split(",") if k % 2 else [p] for k, p in enumerate(re.split(r"[{}]", glob))]
    return re.compile("|".join(translate("".join(choice)) for choice in product(*parts)))


def children(system: fs.FileSystem, folder: str) -> tuple[list[str], list[fs.FileInfo]]:
    """Folders and files right below a folder; one that is gone has none."""
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return (
        [i.path for i in found if i.type == fs.FileType.Directory],
        [i for i in found if i.type == fs.FileType.File],
    )


@dataclass
class Branch(InputPartition):
    """A folder, alone or with all that is below it."""

    folder: str
    deep: bool


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri, self.glob = options["path"], options.get("glob", "*")

    def partitions(self) -> list[Branch]:
        system, root = store(self.uri)
        if system.get_file_info(root).type != fs.FileType.Directory:
            raise FileNotFoundError(self.uri)
        level, out = [root], []
        while level and len(out) + len(level) <= ENOUGH:
            out += [Branch(folder, False) for folder in level]
            level = [below for folder in level for below in children(system, folder)[0]]
        return out + [Branch(folder, True) for folder in level]

    def read(self, partition: Branch) -> Iterator[pa.RecordBatch]:
        system, root = store(self.uri)
        fits, skip = name_test(self.glob), len(root.rstrip("/")) + 1
        waiting, rows = [partition.folder], []
        while waiting:
            folders, files = children(system, waiting.pop())
            if partition.deep:
                waiting += folders
            rows += [(i.path[skip:], i.size) for i in files if fits.match(i.base_name)]
            while len(rows) >= LISTED:
                yield self.batch(rows[:LISTED])
                rows = rows[LISTED:]
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple[str, int]]) -> pa.RecordBatch:
        paths, sizes = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "length"])


class FolderSource(DataSource):
    """``spark.read.format("webloom_folder").option("glob", "*.css").load(uri)``."""

    @classmethod
    def name(cls) -> str:
        return "webloom_folder"

    def schema(self) -> str:
        return "path string, length bigint"

    def reader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))


def listed(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, length) of all files below a folder whose names fit; paths are relative to it."""
    let_workers_import(spark)
    spark.dataSource.register(FolderSource)
    return spark.read.format("webloom_folder").option("glob", glob).load(qualified(spark, folder))


def contents(spark: SparkSession, folder: str, files: DataFrame, column: str) -> DataFrame:
    """(path, <column>) of the listed files as texts; invalid bytes are dropped, files that cannot be read are left out."""
    let_workers_import(spark)
    uri = qualified(spark, folder)
    files = cut_lineage(files.select("path", "length"))
    size = files.agg(F.sum("length")).first()[0] or 0
    parts = max(shuffle_width(spark), -(-size // PART_BYTES))

    def run(batches: Iterator[pa.RecordBatch]):
        system, root = store(uri)

        def closed(paths: list[str], texts: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], ["path", column])

        paths, texts, held = [], [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    with system.open_input_stream(f"{root}/{path}") as file:
                        text = file.read().decode(errors="ignore")
                except OSError:
                    continue
                paths.append(path)
                texts.append(text)
                held += len(text)
                if held >= BATCH_BYTES:
                    yield closed(paths, texts)
                    paths, texts, held = [], [], 0
        if paths:
            yield closed(paths, texts)

    return files.repartition(parts, "path").mapInArrow(run, f"path string, `{column}` string")


def write_texts(rows: DataFrame, column: str, folder: str) -> int:
    """Write each row's text to the file its ``path`` names below the folder; number of files.

    A file is written beside its place and then moved there, so a reader never sees half of it and a task
    that runs again does no harm.  A null text writes nothing.
    """
    spark = rows.sparkSession
    let_workers_import(spark)
    uri = qualified(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]):
        system, root = store(uri)
        made: set[str] = set()
        for batch in batches:
            count = 0
            for path, text in zip(batch.column("path"), batch.column(column)):
                path, text = path.as_py(), text.as_py()
                if path is None or text is None:
                    continue
                place = f"{root}/{path}"
                parent = place.rpartition("/")[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                beside = f"{place}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(beside) as file:
                    file.write(text.encode())
                system.move(beside, place)
                count += 1
            yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["written"])

    done = rows.select("path", column).mapInArrow(run, "written bigint")
    return done.agg(F.sum("written")).first()[0] or 0
