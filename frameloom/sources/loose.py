"""Loose files as a Spark data source, in any store that Arrow knows (local and mounted folders, s3://, gs://, abfs://, hdfs://).

Reading. The driver lists the folder, and partitions hold files up to `partitionBytes`, so small files share a task and
large ones have their own. The driver holds `listedAtOnce` files at a time: what a folder has beyond goes into listings in the shared
folder, of which a partition names its part. What a row holds is a choice: the whole content, a sampled fingerprint, or nothing.
A fingerprint needs bounded memory whatever a file's size, and of a very large file only the sampled bytes.

Writing. Each task attempt writes into a folder of its own, in a hidden folder beside the target, and the names into a file
beside that. The driver moves the files of those attempts that Spark names as finished, and never holds more than one batch of
names and MARKS marks of names; what failed or lost attempts left goes with the hidden folder. A write that fails leaves the
target as it was.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
import stat
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from itertools import islice
from urllib.parse import unquote, urlparse
from weakref import WeakSet

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from frameloom.functions import fnv
from frameloom.sources.scratch import run_folder

NAME = "loosefiles"
#: Bytes of a partition, of one Arrow batch, and of one read from a store.
PARTITION_BYTES, BATCH_BYTES, WINDOW = 128 << 20, 16 << 20, 8 << 20
#: Bytes between two samples from which on single bytes are read instead of the whole file.
SEEK = 1 << 16
#: Files that the driver moves at once when a write is committed, and names that it compares at once.
MOVES, MARKS = 32, 1 << 20
#: Files that the driver holds at once when it lists a folder.
LISTED_AT_ONCE = 100_000
LISTED = "path string, name string, length long, modified timestamp"
HOLDS = {"whole": ", content binary", "fingerprint": ", fingerprint string", "nothing": ""}


def store_of(uri: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path or URI, the path in it, and what makes such paths URIs again."""
    scheme, rest = (uri.split(":", 1)[0], uri) if "://" in uri or uri.startswith("file:/") else ("file", uri)
    if scheme == "file":
        path = "/" + unquote(urlparse(rest).path).lstrip("/") if rest.startswith("file:") else rest
        return fs.LocalFileSystem(), path.rstrip("/") or "/", "file://"
    there, path = fs.FileSystem.from_uri(uri)
    host = urlparse(uri).netloc
    return there, path.rstrip("/"), f"{scheme}://" if path.startswith(host) else f"{scheme}://{host}"


def sampled_of(f: pa.NativeFile, n: int) -> np.ndarray:
    """What fnv.sampled() takes of a content of n bytes, from an open file."""
    step = max(1, n // fnv.SAMPLES)
    if step >= SEEK:
        picked = [f.read_at(1, at) for at in range(0, n, step)]
    else:
        picked, at = [], 0
        while at < n:
            raw = f.read_at(min(WINDOW, n - at), at)
            picked.append(raw[-at % step :: step])
            at += len(raw)
            if not raw:
                break
    return np.frombuffer(b"".join(picked) + f.read_at(fnv.TAIL, max(0, n - fnv.TAIL)), np.uint8)


def entries_of(there: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int, object]]:
    """(path, whether it is a folder, bytes, time of change) of the files and folders in a folder whose names have no leading dot
    or underscore. Local ones are read one by one, as a folder may hold more than memory does."""
    if not isinstance(there, fs.LocalFileSystem):
        for f in there.get_file_info(fs.FileSelector(folder)):
            if f.type in (fs.FileType.File, fs.FileType.Directory) and f.base_name[:1] not in ("", ".", "_"):
                yield f.path, not f.is_file, f.size, f.mtime
        return
    with os.scandir(folder) as found:
        for e in found:
            try:
                s = None if e.name[:1] in "._" else e.stat()
            except FileNotFoundError:  # gone meanwhile, or a link to nothing
                continue
            if s and (stat.S_ISREG(s.st_mode) or stat.S_ISDIR(s.st_mode)):
                yield e.path, stat.S_ISDIR(s.st_mode), s.st_size, datetime.fromtimestamp(0, UTC) + timedelta(microseconds=s.st_mtime_ns // 1000)


@dataclass
class Files(InputPartition):
    """Files of one task: path in the store, bytes, time of change; or the listing that has them, and which batch of it."""

    files: list[tuple[str, int, object]]
    listing: str | None = None
    batch: int = 0

    def held(self) -> list[tuple[str, int, object]]:
        if self.listing is None:
            return self.files
        there, path, _ = store_of(self.listing)
        with there.open_input_file(path) as f:
            return list(zip(*(c.to_pylist() for c in pa.ipc.open_file(f).get_batch(self.batch).columns), strict=True))


class LooseReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.pattern = options["path"], options.get("pattern", "*")
        self.holds = options.get("holds", "whole")
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.skip = options.get("ignoreMissingFiles", "false").lower() == "true"
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        self.at_once, self.listings = int(options.get("listedAtOnce", LISTED_AT_ONCE)), options.get("listings")

    def _found(self) -> Iterator[tuple[str, int, object]]:
        there, path, _ = store_of(self.folder)
        folders = [path]
        while folders:
            for at, folder, size, changed in entries_of(there, folders.pop()):
                if not folder and fnmatch.fnmatch(at.rpartition("/")[2], self.pattern):
                    yield at, size, changed
                elif folder and self.recursive:
                    folders.append(at)

    def _packed(self, files: list[tuple[str, int, object]]) -> list[Files]:
        out: list[Files] = []
        size = 0
        for f in files:
            if not out or size + f[1] > self.most:
                out.append(Files([]))
                size = 0
            out[-1].files.append(f)
            size += f[1]
        return out

    def _written(self, packed: list[Files]) -> list[Files]:
        """The same partitions, with their files in a listing."""
        uri = f"{self.listings}/{uuid.uuid4().hex}.arrow"
        there, path, _ = store_of(uri)
        there.create_dir(path.rpartition("/")[0], recursive=True)
        kind = pa.schema({"path": pa.string(), "size": pa.int64(), "changed": pa.timestamp("us", "UTC")})
        with there.open_output_stream(path) as out, pa.ipc.new_file(out, kind) as listing:
            for p in packed:
                listing.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*p.files, strict=True), kind.types, strict=True)], schema=kind))
        return [Files([], uri, k) for k in range(len(packed))]

    def partitions(self) -> list[Files]:
        found, out = self._found(), []
        while files := sorted(islice(found, self.at_once), key=lambda f: f[0]):
            packed = self._packed(files)
            # A folder that fits needs no listing.
            out += self._written(packed) if self.listings and (out or len(files) == self.at_once) else packed
        return out

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        there, _, prefix = store_of(self.folder)
        held: list[tuple] = []
        size = 0
        for path, n, changed in partition.held() if partition else ():
            made = None
            try:
                if self.holds != "nothing":
                    with there.open_input_file(path) as f:
                        made = f.read() if self.holds == "whole" else sampled_of(f, n)
            except FileNotFoundError:
                if self.skip:
                    continue
                raise
            held.append((prefix + path, path.rpartition("/")[2], n, changed, made))
            size += len(made) if made is not None else 1
            if size >= BATCH_BYTES:
                yield self._batch(held)
                held, size = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        paths, names, sizes, changed, made = zip(*rows, strict=True)
        columns = {"path": pa.array(paths), "name": pa.array(names), "length": pa.array(sizes, pa.int64()), "modified": pa.array(changed, pa.timestamp("us", "UTC"))}
        if self.holds == "whole":
            columns["content"] = pa.array(made, pa.binary())
        elif self.holds == "fingerprint":
            columns["fingerprint"] = pa.array([f"{n}:{h:x}" for n, h in zip(sizes, fnv.fold(list(made)).tolist(), strict=True)])
        return pa.RecordBatch.from_pydict(columns)


@dataclass
class Attempt(WriterCommitMessage):
    """A finished task's folder, and how many files it has; their names are in a file beside it."""

    folder: str
    files: int


#: Names of an attempt's files, with 128 bits that stand for each.
NAMED = pa.schema({"name": pa.string(), "mark": pa.binary(16)})


class LooseWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.folder, self.overwrite = options["path"], overwrite
        self.name, self.content = options.get("name", "name"), options.get("content", "content")
        self.job = uuid.uuid4().hex

    def _places(self) -> tuple[fs.FileSystem, str, str]:
        """The store, the target, and the hidden folder beside it."""
        there, path, _ = store_of(self.folder)
        parent, _, base = path.rpartition("/")
        return there, path, f"{parent}/.{base}.{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        there, _, hidden = self._places()
        task = TaskContext.get()
        mine = f"{hidden}/{task.partitionId()}-{task.taskAttemptId()}"
        there.create_dir(mine, recursive=True)
        files = 0
        try:
            with there.open_output_stream(f"{mine}.names") as out, pa.ipc.new_stream(out, NAMED) as named:
                for batch in iterator:
                    names = [(n or "").rpartition("/")[2] for n in batch.column(self.name).to_pylist()]
                    for last, content in zip(names, batch.column(self.content), strict=True):
                        if last in ("", ".", ".."):
                            raise ValueError("a file needs a name")
                        with there.open_output_stream(f"{mine}/{last}") as file:
                            if content.is_valid:
                                file.write(content.as_buffer())
                    marks = [hashlib.blake2b(n.encode(), digest_size=16).digest() for n in names]
                    named.write_batch(pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(marks, pa.binary(16))], schema=NAMED))
                    files += len(names)
        except BaseException:
            there.delete_dir(mine)
            raise
        return Attempt(mine, files)

    def _named(self, done: list[Attempt]) -> Iterator[tuple[str, pa.RecordBatch]]:
        """The finished attempts' folders with the names in them, a batch at a time."""
        there, _, _ = self._places()
        for m in done:
            with there.open_input_stream(f"{m.folder}.names") as f:
                for batch in pa.ipc.open_stream(f):
                    yield m.folder, batch

    def _twice(self, done: list[Attempt]) -> int:
        """How many files have the name of another: marks are compared in as many passes as keep MARKS or so in memory."""
        passes, twice = sum(m.files for m in done) // MARKS + 1, 0
        for k in range(passes):
            held = [np.empty((0, 2), np.uint64)]
            for _, batch in self._named(done):
                marks = np.frombuffer(batch.column("mark").buffers()[1], np.uint64, 2 * len(batch)).reshape(-1, 2) if len(batch) else held[0]
                held.append(marks[marks[:, 0] % passes == k])
            marks = np.concatenate(held)
            marks = marks[np.lexsort(marks.T)]
            twice += int((marks[1:] == marks[:-1]).all(axis=1).sum())
        return twice

    def commit(self, messages: list[Attempt | None]) -> None:
        there, path, _ = self._places()
        done = [m for m in messages if m is not None]
        if twice := self._twice(done):
            self.abort(messages)
            raise ValueError(f"{twice} files share their names with others")
        there.create_dir(path, recursive=True)
        if self.overwrite:
            there.delete_dir_contents(path)
        with ThreadPoolExecutor(MOVES) as pool:
            for folder, batch in self._named(done):
                list(pool.map(lambda n, at=folder: there.move(f"{at}/{n}", f"{path}/{n}"), batch.column("name").to_pylist()))
        self.abort(messages)

    def abort(self, messages: list[Attempt | None]) -> None:
        there, _, hidden = self._places()
        if there.get_file_info(hidden).type != fs.FileType.NotFound:
            there.delete_dir(hidden)


class LooseFiles(DataSource):
    """format("loosefiles"); options of readers: pattern, recursive, holds (whole, fingerprint, nothing), partitionBytes,
    ignoreMissingFiles, listings (a folder that driver and executors share; without it partitions carry the names of all files),
    listedAtOnce; of writers: name, content (columns)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return LISTED + HOLDS[self.options.get("holds", "whole")]

    def reader(self, schema) -> LooseReader:
        return LooseReader(self.options)

    def writer(self, schema, overwrite: bool) -> LooseWriter:
        return LooseWriter(self.options, overwrite)


#: Sessions that know the source.
_KNOWN: WeakSet[SparkSession] = WeakSet()


def register(spark: SparkSession) -> None:
    """Make the format known in a session."""
    if spark not in _KNOWN:
        spark.dataSource.register(LooseFiles)
        _KNOWN.add(spark)


def _listings(spark: SparkSession) -> dict[str, str]:
    """Where listings go, until the application ends; nowhere if no folder is shared or Arrow does not know its store."""
    try:
        folder = f"{run_folder(spark)}/listings"
        store_of(folder)
    except (ValueError, NotImplementedError):  # Arrow's error for schemes that it does not know is a ValueError
        return {}
    return {"listings": folder}


def read_loose(spark: SparkSession, folder: str, pattern: str = "*", holds: str = "whole", **options) -> DataFrame:
    """files(path, name, length, modified) and content, fingerprint or nothing, below a folder. Names with a leading dot or
    underscore, and all below such folders, are left out; an empty folder gives no rows."""
    register(spark)
    return spark.read.format(NAME).options(pattern=pattern, holds=holds, **_listings(spark) | options).load(folder)


def write_loose(df: DataFrame, folder: str, name: str = "name", content: str = "content", mode: str = "overwrite") -> None:
    """A file for each row. Names keep their last part; rows that share one, or have none, refuse the whole write; null
    contents make empty files."""
    register(df.sparkSession)
    df.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content")).write.format(NAME).mode(mode).save(folder)


def digest_named(rows: DataFrame, path: str = "path") -> DataFrame:
    """rows with sha256, of the files they name, each read once in windows; null for files that are gone."""
    if "sha256" in rows.columns:
        raise ValueError("a column is named as the result")
    at = rows.columns.index(path)

    def digest(uri: str | None) -> str | None:
        if uri is None:
            return None
        there, p, _ = store_of(uri)
        try:
            with there.open_input_stream(p) as f:
                made = hashlib.sha256()
                while raw := f.read(WINDOW):
                    made.update(raw)
        except FileNotFoundError:
            return None
        return made.hexdigest().upper()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([digest(u) for u in batch.column(at).to_pylist()], pa.string())], [*batch.schema.names, "sha256"])

    return rows.mapInArrow(run, rows.withColumn("sha256", F.lit(None).cast("string")).schema)
