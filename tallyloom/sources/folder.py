"""A folder of documents as a data source, and a log folder as its sink.

``spark.read.format("document_folder").option("path", ...)``: a row per page of every
file. Files are listed once, in the order of their paths and within bounds of depth and
number; tasks get about equal bytes of them. ``log_folder`` writes delimited logs: what
tasks write lies apart until the job commits, so a failed job leaves nothing.
``file_folder`` writes a file per row, each replaced at once: a file is its old or its new
one at any time, and a task that runs again writes the same.

Places are URIs of Arrow's file systems (local, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tallyloom.operators.inventory import IGNORED_FILES
from tallyloom.session import ship_package

FILES = "path string, name string, ext string, depth int, size long, modified timestamp, page int, text string, error string, truncated boolean"
TASK_BYTES = 16 << 20
DEEPEST, MOST_FILES = 10, 4000  # of the bounded scan


def plain_text(raw: bytes, ext: str) -> list[str]:
    """The pages of a text: form feeds part them."""
    return raw.decode("utf-8-sig", "replace").split("\f")


def notebook_text(raw: bytes, ext: str) -> list[str]:
    """The sources of a notebook's cells, a page each."""
    return ["".join(c["source"]) for c in json.loads(raw)["cells"]]


def office_pages(raw: bytes, ext: str) -> list[str]:
    from tallyloom.sources.files import office_text

    return ["\n".join(office_text(raw, ext))]


#: Which loader reads which extension.
LOADERS: dict[str, Callable[[bytes, str], list[str]]] = {
    **dict.fromkeys((".txt", ".md", ".rst", ".log", ".csv", ".tsv", ".json", ".xml", ".html", ".htm", ".tex", ".yaml", ".yml", ".py", ".js", ".ts", ".sql", ".svg"), plain_text),
    ".ipynb": notebook_text,
    **dict.fromkeys((".docx", ".pptx", ".xlsx", ".odt", ".ods", ".odp", ".rtf"), office_pages),
}


@dataclass(frozen=True)
class Found:
    """A file of the listing; its path is relative to the folder."""

    path: str
    depth: int
    size: int
    modified: datetime


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else posixpath.abspath(path))


def ignored(name: str, folder: bool) -> bool:
    return name.startswith(".") if folder else name in IGNORED_FILES or name.startswith("~")


def listing(path: str, recursive: bool, deepest: int | None, most: int | None, extensions: set[str] | None) -> tuple[list[Found], bool]:
    """(files in the order of their paths, whether a bound left some out). Files of `path` itself have depth 1."""
    store, root = opened(path)
    out: list[Found] = []
    cut = False

    def walk(folder: str, depth: int) -> bool:
        nonlocal cut
        for info in sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda i: i.base_name):
            if info.type == fs.FileType.Directory:
                if not recursive or ignored(info.base_name, True):
                    continue
                if deepest is not None and depth + 1 > deepest:
                    cut = True
                elif not walk(info.path, depth + 1):
                    return False
            elif info.type == fs.FileType.File and not ignored(info.base_name, False):
                if extensions is not None and posixpath.splitext(info.base_name)[1].lower() not in extensions:
                    continue
                if most is not None and len(out) >= most:
                    cut = True
                    return False
                out.append(Found(info.path.removeprefix(root.rstrip("/") + "/"), depth, info.size, info.mtime or datetime.fromtimestamp(0, timezone.utc)))
        return True

    walk(root.rstrip("/"), 1)
    return out, cut


class Share(InputPartition):
    def __init__(self, files: list[Found], truncated: bool):
        super().__init__(0)
        self.files, self.truncated = files, truncated


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}  # Spark passes them in lower case
        self.path = options["path"]
        flag = lambda k: str(options.get(k.lower(), "false")).lower() == "true"
        bound = lambda k: int(options[k.lower()]) if options.get(k.lower()) else None
        self.recursive, self.listed_only = flag("recursive"), flag("listOnly")
        self.deepest, self.most, self.task_bytes = bound("maxDepth"), bound("maxFiles"), int(options.get("taskbytes", TASK_BYTES))
        self.extensions = {e.strip().lower() for e in options["extensions"].split(",")} if options.get("extensions") else None

    def partitions(self) -> list[Share]:
        files, cut = listing(self.path, self.recursive, self.deepest, self.most, self.extensions)
        shares, held, size = [], [], 0
        for f in files:
            if held and size + f.size > self.task_bytes:
                shares.append(Share(held, cut))
                held, size = [], 0
            held.append(f)
            size += f.size
        return [*shares, Share(held, cut)] if held or not shares else shares

    def read(self, partition: Share) -> Iterator[tuple]:
        store, root = opened(self.path)
        for f in partition.files:
            name = posixpath.basename(f.path)
            ext = posixpath.splitext(name)[1].lower()
            facts = (f.path, name, ext, f.depth, f.size, f.modified)
            loader = LOADERS.get(ext)
            if self.listed_only or loader is None:
                yield (*facts, None, None, None if self.listed_only else "kein_extraktor", partition.truncated)
                continue
            try:
                with store.open_input_stream(posixpath.join(root, f.path)) as stream:
                    pages = loader(stream.read(), ext)
            except Exception as e:  # a damaged file is a row, not a failed job
                yield (*facts, None, None, type(e).__name__, partition.truncated)
                continue
            for k, text in enumerate(pages):
                yield (*facts, k, text, None, partition.truncated)


class FolderSource(DataSource):
    """Options: path; recursive (false); extensions (".txt,.md"); maxDepth, maxFiles; taskBytes; listOnly (paths without texts)."""

    @classmethod
    def name(cls) -> str:
        return "document_folder"

    def schema(self) -> str:
        return FILES

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class LogWriter(DataSourceWriter):
    """Delimited files with a byte order mark and a header; each task writes one, aside."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.delimiter, self.header = options["path"], options.get("delimiter", ";"), schema.names
        self.overwrite, self.job = overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        store, root = opened(self.path)
        aside = posixpath.join(root, f"_open-{self.job}")
        store.create_dir(aside)
        name, n = posixpath.join(aside, f"part-{uuid.uuid4().hex}.csv"), 0
        with store.open_output_stream(name) as out:
            out.write("﻿".encode() + self._line(self.header))
            for row in rows:
                out.write(self._line(row))
                n += 1
        return Written(name, n)

    def _line(self, cells) -> bytes:
        shown = ["" if c is None else str(c) for c in cells]
        return (self.delimiter.join('"' + c.replace('"', '""') + '"' if any(x in c for x in (self.delimiter, '"', "\n", "\r")) else c for c in shown) + "\r\n").encode()

    def commit(self, messages: list[Written | None]) -> None:
        """Move what the tasks of this job have written; attempts that failed or ran twice stay behind and go."""
        store, root = opened(self.path)
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if info.type == fs.FileType.File and info.base_name.startswith("part-"):
                    store.delete_file(info.path)
        for m in messages:
            if m is not None and m.rows:
                store.move(m.file, posixpath.join(root, posixpath.basename(m.file)))
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        aside = posixpath.join(root, f"_open-{self.job}")
        if store.get_file_info(aside).type == fs.FileType.Directory:
            store.delete_dir(aside)


class LogSink(DataSource):
    """Options: path; delimiter (;). Modes append and overwrite."""

    @classmethod
    def name(cls) -> str:
        return "log_folder"

    def writer(self, schema: StructType, overwrite: bool) -> LogWriter:
        return LogWriter(dict(self.options), schema, overwrite)


@dataclass
class Replaced(WriterCommitMessage):
    files: int


class FileWriter(DataSourceWriter):
    """Rows of path (within the folder) and content; each file is written aside, then moved to its place."""

    def __init__(self, options: dict, schema: StructType):
        self.root_uri, self.job = options["path"], uuid.uuid4().hex
        self.at = [schema.names.index(c) for c in ("path", "content")]

    def write(self, rows: Iterator) -> Replaced:
        store, root = opened(self.root_uri)
        aside = posixpath.join(root, f".open-{self.job}")
        store.create_dir(aside)
        n, folders = 0, set()
        for row in rows:
            path, content = (row[k] for k in self.at)
            if path is None or content is None:
                continue
            inside = posixpath.normpath(path)
            if inside in (".", "..") or inside.startswith(("/", "../")):
                raise ValueError(f"not within the folder: {path}")
            target, made = posixpath.join(root, inside), posixpath.join(aside, uuid.uuid4().hex)
            if (folder := posixpath.dirname(target)) not in folders:
                store.create_dir(folder)
                folders.add(folder)
            with store.open_output_stream(made) as out:
                out.write(bytes(content))
            store.move(made, target)
            n += 1
        return Replaced(n)

    def commit(self, messages: list[Replaced | None]) -> None:
        self._clear()

    def abort(self, messages: list[Replaced | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = opened(self.root_uri)
        aside = posixpath.join(root, f".open-{self.job}")
        if store.get_file_info(aside).type == fs.FileType.Directory:
            store.delete_dir(aside)


class FileSink(DataSource):
    """Option: path. Mode append: files of the same paths are replaced, others stay; of several rows with one path, one whole content stays. Rows without path or content write nothing."""

    @classmethod
    def name(cls) -> str:
        return "file_folder"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("files are replaced one by one: use mode append")
        return FileWriter(dict(self.options), schema)


def register(spark: SparkSession) -> SparkSession:
    """Let the session read "document_folder" and write "log_folder" and "file_folder"."""
    ship_package(spark)
    spark.dataSource.register(FolderSource)
    spark.dataSource.register(LogSink)
    spark.dataSource.register(FileSink)
    return spark
