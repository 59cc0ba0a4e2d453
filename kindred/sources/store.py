"""The page store as a Spark data source: one gzipped JSON object a page, below host / first two digits / digest.

Reading makes tasks of a host's folders of digests (a host with most of the pages has many of these), so a scan is as
parallel as the store is large. A condition ``url = ...`` opens that page's one file. Files that can't be read are rows
marked as damaged; they never end a scan. Writing replaces a page's file by renaming, so a task that runs again does no
harm. Files are reached through pyarrow, so the root may be a path or an address of a file system that pyarrow knows.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage

from kindred.sources.pages import latest

SCHEMA = "url string, status int, body string, transport string, fetched_at double, file_bytes long, damaged boolean"
#: Folders of digests that one task reads, and bytes of bodies in a batch.
FOLDERS_PER_TASK, BATCH_BYTES = 16, 8 << 20
_TYPES = pa.schema([("url", pa.string()), ("status", pa.int32()), ("body", pa.string()), ("transport", pa.string()), ("fetched_at", pa.float64()), ("file_bytes", pa.int64()), ("damaged", pa.bool_())])


def place(url: str) -> str:
    """Where a page is kept below the root."""
    digest = hashlib.sha256(url.encode()).hexdigest()
    return f"{urlsplit(url).netloc or '_'}/{digest[:2]}/{digest}.json.gz"


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root, and the root's path in it."""
    if not re.match("[a-z0-9]+:", root):
        return fs.LocalFileSystem(), root.rstrip("/")
    system, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", root))
    return system, path.rstrip("/")


def children(system: fs.FileSystem, folder: str, kind: fs.FileType) -> list[str]:
    return sorted(x.base_name for x in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if x.type == kind)


def page_of(system: fs.FileSystem, path: str) -> tuple:
    """A row of ``SCHEMA``; nulls and a mark where the file isn't a page."""
    data = b""
    try:
        with system.open_input_stream(path, compression=None) as f:
            data = f.read()
        raw = json.loads(gzip.decompress(data))
        row = str(raw["url"]), int(raw["status"]), raw["body"], raw["transport"], float(raw["fetched_at"])
        return *row, len(data), False
    except (OSError, EOFError, ValueError, KeyError, TypeError):
        return None, None, None, None, None, len(data), True


@dataclass
class Folders(InputPartition):
    host: str
    folders: list[str]


@dataclass
class OnePage(InputPartition):
    path: str


class StoreReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.url = options["path"], options.get("url")

    def partitions(self) -> list[InputPartition]:
        if self.url is not None:
            return [OnePage(place(self.url))]
        system, root = opened(self.root)
        found = []
        for host in children(system, root, fs.FileType.Directory):
            folders = children(system, f"{root}/{host}", fs.FileType.Directory)
            found += [Folders(host, folders[i : i + FOLDERS_PER_TASK]) for i in range(0, len(folders), FOLDERS_PER_TASK)]
        return found or [Folders("", [])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.root)
        rows, size = [], 0
        for path in self.paths(system, root, partition):
            rows.append(page_of(system, path))
            size += len(rows[-1][2] or "")
            if size > BATCH_BYTES:
                yield batch_of(rows)
                rows, size = [], 0
        yield batch_of(rows)

    @staticmethod
    def paths(system: fs.FileSystem, root: str, partition: InputPartition) -> Iterator[str]:
        if isinstance(partition, OnePage):
            path = f"{root}/{partition.path}"
            return iter([path] if system.get_file_info(path).type == fs.FileType.File else [])
        folders = (f"{root}/{partition.host}/{x}" for x in partition.folders)
        return (f"{folder}/{name}" for folder in folders for name in children(system, folder, fs.FileType.File) if name.endswith(".json.gz"))


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _TYPES]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _TYPES, strict=True)], schema=_TYPES)


class PushingReader(StoreReader):
    """Takes ``url = ...`` from the query; Spark still checks the rows."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for x in filters:
            if isinstance(x, EqualTo) and x.attribute == ("url",):
                self.url = x.value
            yield x


class FilesReader(DataSourceReader):
    """Files of any kind; the driver lists folders of two levels, and tasks what is below these."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]

    def partitions(self) -> list[InputPartition]:
        system, root = opened(self.root)
        found = [Folders("", [""])]
        for top in children(system, root, fs.FileType.Directory):
            inner = [f"{top}/{x}/" for x in children(system, f"{root}/{top}", fs.FileType.Directory)]
            found += [Folders(top, [f"{top}/"])] + [Folders(top, inner[i : i + FOLDERS_PER_TASK]) for i in range(0, len(inner), FOLDERS_PER_TASK)]
        return found

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.root)
        rows, size = [], 0
        for folder in partition.folders:
            select = fs.FileSelector(f"{root}/{folder}".rstrip("/"), allow_not_found=True, recursive=folder.count("/") == 2)
            for x in system.get_file_info(select):
                if x.type == fs.FileType.File:
                    with system.open_input_stream(x.path, compression=None) as f:
                        rows.append((x.path[len(root) + 1 :], f.read()))
                    size += len(rows[-1][1])
                if size > BATCH_BYTES:
                    yield files_batch(rows)
                    rows, size = [], 0
        yield files_batch(rows)


def files_batch(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.binary())], names=["path", "content"])


class Files(DataSource):
    """``spark.read.format("files_below").load(root)``: (path, content), paths relative to the root."""

    @classmethod
    def name(cls) -> str:
        return "files_below"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return FilesReader(self.options)


def files_below(spark: SparkSession, root: str) -> DataFrame:
    """All files below a folder, listed by tasks: Spark's own file sources gather every file's status in the driver."""
    spark.dataSource.register(Files)
    return spark.read.format(Files.name()).load(root)


class StoreWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        system, root = opened(self.root)
        for r in rows:
            path = f"{root}/{place(r['url'])}"
            system.create_dir(path.rpartition("/")[0], recursive=True)
            half = f"{path}.{uuid.uuid4().hex}.tmp"
            page = {k: r[k] for k in ("url", "status", "body", "transport", "fetched_at")}
            with system.open_output_stream(half, compression=None) as f:
                f.write(gzip.compress(json.dumps(page).encode(), mtime=0))
            system.move(half, path)
        return WriterCommitMessage()


class PageStore(DataSource):
    """``spark.read.format("page_store").load(root)``, with an option ``url`` for one page; ``df.write`` appends."""

    @classmethod
    def name(cls) -> str:
        return "page_store"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return StoreReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return StoreWriter(self.options)


class PushingPageStore(PageStore):
    """The same, for sessions that let Python sources take conditions."""

    @classmethod
    def name(cls) -> str:
        return "pushing_page_store"

    def reader(self, schema) -> DataSourceReader:
        return PushingReader(self.options)


def read_store(spark: SparkSession, root: str, url: str | None = None) -> DataFrame:
    """All files of a store, or the one of a page. Conditions on url open one file where the session has
    spark.sql.python.filterPushdown.enabled; with ``url`` that needs no setting."""
    pushing = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true"
    source = PushingPageStore if pushing else PageStore
    spark.dataSource.register(source)
    reader = spark.read.format(source.name())
    return (reader if url is None else reader.option("url", url)).load(root)


def put_pages(pages: DataFrame, root: str) -> None:
    """Store pages (url, status, body, transport, fetched_at), of each address the one fetched last; pages that the store
    has are replaced."""
    spark = pages.sparkSession
    spark.dataSource.register(PageStore)
    latest(pages.select("url", "status", "body", "transport", "fetched_at")).write.format("page_store").mode("append").save(root)


def file_stats(files: DataFrame) -> DataFrame:
    """Entries, good and other pages (damaged files are entries that failed), and MB on disk."""
    ok = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    size = F.round(F.coalesce(F.sum("file_bytes"), F.lit(0)) / 1e6, 1)
    return files.agg(F.count("*").alias("entries"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), size.alias("disk_mb"))
