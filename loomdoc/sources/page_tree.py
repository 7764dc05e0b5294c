"""Trees of page files as a Python data source, ``loomdoc_pages``: read with partitions for each version, written file by file.

Files are reached through Arrow's file systems, so a root is a path or any URI that Arrow knows (file, hdfs, s3, gs), and
every executor has to reach it.

Reading. A version is dealt over ``slices`` partitions, each of which lists it and takes the files whose names fall to it; an error of
a listing is a row of each slice that met it. ``versions`` is a JSON list of {"version", "roots", "required"}. The first root that has files of a version is the
list of its pages; each page comes from the first root that has it, so a local tree goes before a remote one and the remote
one fills what it lacks. A page that no root has any more is left out without a word; any other failure is a row with its
error and no text, so one bad file never ends a job. A version that is required and has no page in any root ends it.

Writing. Rows are (version, path, text): one file each, under its version. Tasks write to a staging folder beside the tree;
only when all have ended is each version replaced that has rows (or, in the mode ``flat``, each file of the top level), so a
failed job leaves the old tree. A row with a null text asks that there be no such file. Two rows of one file are an error.
Versions are replaced one after another: a reader can meet a tree with the old ones of some, but no half of a version.
"""

from __future__ import annotations

import json
import re
import time
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

NAME = "loomdoc_pages"
#: Bytes of texts that a batch of ``file_texts`` has, or a file more.
BATCH = 1 << 22
#: Times that a staging folder is deleted, if tasks still write to it.
TRIES = 20
ROWS = "version string, path string, root string, text string, error string"


def reached(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root and the path there."""
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.rstrip("/"))


def listed(root: str, version: str, suffix: str) -> list[str]:
    """Paths of a version's files below its folder, in order; none if there is no such folder."""
    system, base = reached(root)
    top = f"{base}/{version}" if version else base
    found = system.get_file_info(fs.FileSelector(top, allow_not_found=True, recursive=bool(version)))
    return sorted(f.path[len(top) + 1 :] for f in found if f.is_file and f.path.endswith(suffix))


def fetched(root: str, version: str, path: str) -> str:
    system, base = reached(root)
    with system.open_input_stream("/".join(p for p in (base, version, path) if p)) as stream:
        return stream.read().decode()


def _made(system: fs.FileSystem, folder: str, made: set[str]) -> None:
    """The folder is there; each one is asked for once."""
    if folder not in made:
        system.create_dir(folder, recursive=True)
        made.add(folder)


def _made_below(system: fs.FileSystem, top: str, folder: str, made: set[str]) -> None:
    """The folder is there, made level by level below ``top``, which has to be there: what has been taken away stays away."""
    if folder not in made and folder != top:
        _made_below(system, top, folder.rpartition("/")[0], made)
        system.create_dir(folder, recursive=False)
        made.add(folder)


@dataclass
class Version(InputPartition):
    version: str
    roots: tuple[str, ...]
    required: bool
    number: int
    slices: int


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.versions, self.suffix = json.loads(options["versions"]), options.get("suffix", ".md")
        self.slices = int(options.get("slices", "1"))

    def partitions(self) -> list[InputPartition]:
        found = [(v["version"], tuple(v["roots"]), bool(v.get("required"))) for v in self.versions]
        return [Version(*v, number, self.slices) for v in found for number in range(self.slices)]

    def read(self, partition: Version) -> Iterator[tuple]:
        names, failed = [], None
        for root in partition.roots:
            try:
                names = listed(root, partition.version, self.suffix)
            except OSError as e:
                failed = (partition.version, None, root, None, str(e))
                yield failed
            if names:
                break
        if not names and not failed and partition.required:
            raise ValueError(f"no root has a page of {partition.version or 'the top level'}")
        for name in names:
            if zlib.crc32(name.encode()) % partition.slices != partition.number:
                continue
            row = self.page(partition, name)
            if row is not None:
                yield row

    def page(self, partition: Version, name: str) -> tuple | None:
        """The row of a page from the first root that has it."""
        for root in partition.roots:
            try:
                return partition.version, name, root, fetched(root, partition.version, name), None
            except (FileNotFoundError, NotADirectoryError):
                continue
            except (OSError, UnicodeDecodeError) as e:
                return partition.version, name, root, None, f"{type(e).__name__}: {e}"
        return None


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote, and the names of files that go, both packed: all messages meet in the driver."""

    task: str
    there: bytes
    gone: bytes

    def files(self) -> Iterator[tuple[str, str, bool]]:
        for names, there in ((self.there, True), (self.gone, False)):
            for target in unpacked(names):
                yield f"{self.task}/{target}", target, there


def packed(names: list[str]) -> bytes:
    return zlib.compress("\0".join(names).encode()) if names else b""


def unpacked(names: bytes) -> list[str]:
    return zlib.decompress(names).decode().split("\0") if names else []


def repeated(names: Callable[[], Iterator[str]]) -> str | None:
    """The least name that comes twice. Eight bytes of each are held, and the names of which these are the same."""
    hashes = np.sort(np.fromiter(map(hash, names()), np.int64))
    same = set(hashes[1:][hashes[1:] == hashes[:-1]].tolist())
    return min((n for n, k in Counter(n for n in names() if hash(n) in same).items() if k > 1), default=None) if same else None


class PageWriter(DataSourceWriter):
    """Writes to ``<root>.staging-<id>``; commit moves, abort deletes."""

    def __init__(self, options: dict[str, str]):
        self.root, self.flat = options["root"].rstrip("/"), options.get("mode") == "flat"
        self.staging = f"{self.root}.staging-{uuid.uuid4().hex}"
        system, base = reached(self.staging)
        system.create_dir(base, recursive=True)  # tasks do not: one that ends after abort() makes nothing anew

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, base = reached(self.staging)
        files, made, task = {True: [], False: []}, set(), uuid.uuid4().hex  # a task that is tried again writes elsewhere
        for row in iterator:
            version = "" if self.flat else row["version"]
            target = f"{version}/{row['path']}".lstrip("/")
            where = f"{base}/{task}/{target}"
            if ".." in f"{version}/{row['path']}".split("/") or (not self.flat and not version) or (self.flat and "/" in row["path"]):
                raise ValueError(f"no page file: {version}/{row['path']}")
            if row["text"] is not None:
                _made_below(system, base, where.rpartition("/")[0], made)
                with system.open_output_stream(where) as out:
                    out.write(row["text"].encode())
            files[row["text"] is not None].append(target)
        return Written(task, packed(files[True]), packed(files[False]))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        messages = [m for m in messages if m is not None]  # packed; the names of one task at a time are not
        files = lambda: (f for m in messages for f in m.files())
        twice = repeated(lambda: (target for _, target, _ in files()))
        if twice is not None:
            self.abort(messages)
            raise ValueError(f"two rows of one page: {twice}")
        (system, base), (_, staged) = reached(self.root), reached(self.staging)
        whole, made = f"{staged}/whole", set()
        for source, target, there in files():
            if there:
                _made(system, f"{whole}/{target}".rpartition("/")[0], made)
                system.move(f"{staged}/{source}", f"{whole}/{target}")
        system.create_dir(base, recursive=True)
        versions = ((t, there) for _, t, there in files()) if self.flat else sorted({(t.split("/")[0], True) for _, t, _ in files()})
        for target, there in versions:
            old, new = f"{base}/{target}", f"{whole}/{target}"
            kind = system.get_file_info(old).type
            if kind == fs.FileType.Directory:
                system.delete_dir(old)
            elif kind == fs.FileType.File:
                system.delete_file(old)
            if there and system.get_file_info(new).type != fs.FileType.NotFound:
                system.move(new, old)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Nothing is left of the staging folder."""
        system, staged = reached(self.staging)
        for left in reversed(range(TRIES)):
            try:
                if system.get_file_info(staged).type != fs.FileType.NotFound:
                    system.delete_dir(staged)
                return
            except OSError:  # a task that has not ended yet put a file there meanwhile
                if not left:
                    raise
                time.sleep(0.1)


class PageTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PageWriter(self.options)


def read_pages(spark: SparkSession, versions: list[dict], suffix: str = ".md", slices: int = 1) -> DataFrame:
    """(version, path, root, text, error) of the files of ``versions`` ({"version", "roots", "required"}); the version ``""`` is
    the top level of its roots. Each version is read by ``slices`` tasks."""
    spark.dataSource.register(PageTree)
    return spark.read.format(NAME).option("versions", json.dumps(versions)).option("suffix", suffix).option("slices", str(slices)).load()


def write_pages(pages: DataFrame, root: str, flat: bool = False) -> None:
    """Writes (version, path, text) as files below ``root``; with ``flat`` (path, text) at its top level."""
    pages.sparkSession.dataSource.register(PageTree)
    rows = pages.select("path", "text") if flat else pages.select("version", "path", "text")
    rows.write.format(NAME).mode("append").option("root", root).option("mode", "flat" if flat else "version").save()


def reachable(root: str) -> bool:
    """Whether Arrow knows the file system of a root."""
    try:
        reached(root)
    except (pa.ArrowException, ImportError, OSError):
        return False
    return True


def shown(path: str) -> bool:
    """Whether Spark's own readers would read a file: names of neither it nor its folders are hidden."""
    hidden = lambda name: name[0] == "." or (name[0] == "_" and "=" not in name) or name.endswith("._COPYING_")
    return not any(map(hidden, path.split("/")))


def file_names(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """(version, path) of the files below each folder of ``root``. A version is listed by a task, and the driver has versions only."""
    system, base = reached(root)
    folders = [f.base_name for f in system.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.Directory and shown(f.base_name)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for version in batch["version"].to_pylist():
                names = [n for n in listed(root, version, suffix) if shown(n)]
                for i in range(0, len(names), 1 << 14):
                    part = names[i : i + (1 << 14)]
                    yield pa.RecordBatch.from_arrays([pa.array([version] * len(part)), pa.array(part)], ["version", "path"])

    rows = spark.createDataFrame([(v,) for v in folders], "version string").repartition(max(len(folders), 1), "version")
    return rows.mapInArrow(of, "version string, path string")


def file_texts(names: DataFrame, root: str, tasks: int) -> DataFrame:
    """(version, path, text) of files of ``names`` (version, path), read by so many tasks. As with Spark's readers, what is no UTF-8
    is replaced, empty files have no rows, and names are as they stand in a URI."""
    told = lambda name: re.sub(r'[\x00-\x20\x7f"#%<>?\[\\\]^`{|}]', lambda m: f"%{ord(m[0]):02X}", name)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = reached(root)
        out, size = [], 0
        packed_up = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["version", "path", "text"])
        for batch in batches:
            for version, path in zip(batch["version"].to_pylist(), batch["path"].to_pylist(), strict=True):
                with system.open_input_stream(f"{base}/{version}/{path}") as stream:
                    text = stream.read().decode(errors="replace")
                if text:
                    out.append((told(version), told(path), text))
                    size += len(text) + len(path)
                if size >= BATCH:
                    yield packed_up()
                    out, size = [], 0
        if out:
            yield packed_up()

    return names.repartition(tasks, "version", "path").mapInArrow(of, "version string, path string, text string")
