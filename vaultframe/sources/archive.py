"""spark.read.format("archive"): archives as rows of entries, and the sink of that name.

The driver lists local or mounted paths and groups them into volumes; one partition
holds some archives of about partitionBytes, and a task reads them one after another.
Files are mapped, so that metadata alone (content false), or some keys, cost the headers
and those entries rather than the archive. A zip, a plain tar or a 7z larger than
partitionBytes is dealt to several tasks by its entries or folders. For paths that only
Spark reaches, read_archives() does the same over the binaryFile source.

Options: content (false: metadata alone), format, password, encoding, forceEncoding,
lookForHeader, streaming, key, keyGlob, onError (fail, null), maxEntryBytes, maxRatio, maxWholeBytes,
partitionBytes, pathGlobFilter."""

from __future__ import annotations

import fnmatch
import mmap
import os
import shutil
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from vaultframe.sources import detect
from vaultframe.sources.model import CONTENT, SCHEMA, Options
from vaultframe.sources.writers import EXTENSION, Item, WriteOptions, write


def options_of(o: dict[str, str]) -> Options:
    low = {k.lower(): v for k, v in o.items()}
    return Options(low.get("password"), low.get("encoding", "cp437"), low.get("lookforheader", "false") == "true", low.get("streaming", low.get("mode", "") == "streaming" and "true" or "false") == "true", int(low.get("maxentrybytes", 1 << 30)), int(low.get("maxratio", 100_000)), low.get("extensionhint", ""), low.get("forceencoding", "false") == "true", int(low.get("maxwholebytes", 4 << 30)))


def rows_of(path: str, data: bytes, o: Options, content: bool, on_error: str = "fail", keep: Any = None, kind: str | None = None, share: tuple[int, int] = (0, 1)) -> Iterator[tuple]:
    """Rows of one archive, as SCHEMA or CONTENT has them. Under on_error "null", what
    can't be read is a row or a content with the reason in error. share (k, n): of the
    entries, or folders where several entries are packed as one, every n-th from k."""
    blank = (None,) * (len(SCHEMA) - 3)
    try:
        found = detect.FORMATS[kind][1](data, o, detect.DEFAULT) if kind else detect.entries(data, o)
        for i, e in enumerate(found):
            if (i if e.folder is None else e.folder) % share[1] != share[0] or keep and not keep(e):
                continue
            if not i:
                e.format_meta["archive_size"] = str(len(data))
            error, body, fine = None, None, None
            if content:
                try:
                    body = e.content()
                    fine = None if body is None or e.check is None else e.check(body) == e.crc
                except ValueError as x:
                    if on_error == "fail":
                        raise
                    error, body = f"{type(x).__name__}: {x}", None
            row = (path, i, e.archive_type, e.outer_compression, e.key, e.link_target, e.compression_type, e.size, e.compressed_size, e.crc, e.last_modified, e.created, e.last_accessed, e.archived, e.is_directory, e.is_encrypted, e.is_split_after, e.is_solid, e.is_complete, e.volume_index_first, e.volume_index_last, e.attrib, e.folder, e.format_meta, error)
            yield (*row, body, fine) if content else row
    except (ValueError, IndexError, KeyError) as x:
        if on_error == "fail":
            raise
        row = (path, -1, *blank, f"{type(x).__name__}: {x}")
        yield (*row, None, None) if content else row


def mapped(parts: list[str]) -> bytes | mmap.mmap:
    """A file as bytes that are read when they are touched; several files joined."""
    if len(parts) == 1 and os.path.getsize(parts[0]):
        with open(parts[0], "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    out = bytearray()
    for p in parts:
        with open(p, "rb") as f:
            out += f.read()
    return bytes(out)


def divisible(path: str) -> bool:
    """Whether entries can be read apart from one another, as the first bytes tell."""
    with open(path, "rb") as f:
        head = f.read(512)
    return head[:2] == b"PK" or head[:6] == b"7z\xbc\xaf\x27\x1c" or head[257:262] == b"ustar"


class Group(InputPartition):
    def __init__(self, archives: list[tuple[str, list[str]]], share: tuple[int, int] = (0, 1)):
        self.archives, self.share = archives, share


def _visible(folders: list[str]) -> bool:
    """Keeps a walk out of folders that hold no data."""
    folders[:] = [f for f in folders if not f.startswith(("_", "."))]
    return True


class ArchiveReader(DataSourceReader):
    """Reads local and mounted paths."""

    def __init__(self, schema: StructType, options: dict[str, str], formats: dict | None = None):
        self.o, self.formats = {k.lower(): v for k, v in options.items()}, formats or {}
        self.content = "content" in schema.fieldNames()
        self.wanted: dict[str, Any] = {}

    def partitions(self) -> Sequence[InputPartition]:
        root = self.o["path"].removeprefix("file://")
        pattern = self.o.get("pathglobfilter", "*")
        if os.path.isdir(root):
            paths = sorted(os.path.join(d, f) for d, folders, names in os.walk(root) if folders.sort() is None and _visible(folders) for f in names if fnmatch.fnmatch(f, pattern) and not f.startswith(("_", ".")))
        else:
            paths = [root]
        limit, out, size = int(self.o.get("partitionbytes", 64 << 20)), [[]], 0
        shares: list[Group] = []
        for whole, parts in detect.volumes(paths).items():
            n = sum(os.path.getsize(p) for p in parts)
            if n > limit and len(parts) == 1 and "format" not in self.o and self.o.get("streaming") != "true" and divisible(parts[0]):
                k = -(-n // limit)
                shares += [Group([(whole, parts)], (i, k)) for i in range(k)]
                continue
            if out[-1] and size + n > limit:
                out.append([])
                size = 0
            out[-1].append((whole, parts))
            size += n
        return [Group(x) for x in out if x] + shares

    def read(self, partition: Group) -> Iterator[tuple]:
        detect.FORMATS.update(self.formats)
        o = options_of(self.o)
        key, glob = self.wanted.get("key", self.o.get("key")), self.o.get("keyglob")
        path = self.wanted.get("archive_path")
        folder = self.wanted.get("is_directory")

        def keep(e) -> bool:
            return (key is None or e.key == key) and (glob is None or fnmatch.fnmatch(e.key or "", glob)) and (folder is None or e.is_directory == folder)

        for whole, parts in partition.archives:
            if path is not None and path != whole:
                continue
            data = mapped(parts)
            sizes = tuple(map(os.path.getsize, parts)) if len(parts) > 1 else ()
            hint = replace(o, extension=o.extension or detect.extension_of(whole), volumes=sizes)
            yield from rows_of(whole, data, hint, self.content, self.o.get("onerror", "fail"), keep, self.o.get("format"), partition.share)


class PushingReader(ArchiveReader):
    """Takes equality on key, archive_path and is_directory, if the session has filter
    pushdown for Python sources on."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in ("key", "archive_path", "is_directory"):
                self.wanted[f.attribute[0]] = f.value
            yield f  # Spark checks again, which costs little and settles nulls


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class ArchiveWriter(DataSourceWriter):
    """Archives of each task's rows, in their order, a new one where maxArchiveBytes of
    content would be passed, so that none grows with the table. Rows:
    key, content, and perhaps is_directory, last_modified, codec, level, comment.

    Tasks write below _temporary, under the job's and the attempt's own name; the driver
    moves the files of the attempts that count when all tasks are done, and removes the
    others. What the folder held stays, beside the new files, or goes on overwrite."""

    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool):
        self.o, self.names, self.overwrite = {k.lower(): v for k, v in options.items()}, schema.fieldNames(), overwrite
        self.job = uuid.uuid4().hex
        self.root = self.o["path"].removeprefix("file://")
        self.temporary = os.path.join(self.root, "_temporary", self.job)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        t = TaskContext.get()
        kind = self.o.get("type", "zip").lower()
        o = WriteOptions(self.o.get("codec"), int(self.o["level"]) if "level" in self.o else None, self.o.get("comment", ""), self.o.get("zip64") == "true", self.o.get("tarformat", "gnu"), self.o.get("finalize", "true") == "true", self.o.get("compressedheader") == "true", dictionary=int(self.o.get("dictionary", 1 << 20)), fast_bytes=int(self.o.get("fastbytes", 32)))
        limit = int(self.o.get("maxarchivebytes", 256 << 20))
        where = os.path.join(self.temporary, f"{t.partitionId()}-{t.taskAttemptId()}")
        items: list[Item] = []
        files: list[tuple[str, str]] = []
        size = 0

        def flush() -> None:
            os.makedirs(where, exist_ok=True)
            name = f"part-{t.partitionId():05d}-{self.job}-{len(files):04d}.{EXTENSION[kind]}"
            with open(os.path.join(where, name), "wb") as f:
                f.write(write(kind, items, o))
            files.append((os.path.join(where, name), name))

        for r in iterator:
            x = dict(zip(self.names, r, strict=True))
            item = Item(x["key"], None if x.get("is_directory") else bytes(x["content"] or b""), x.get("last_modified"), x.get("codec"), x.get("level"), x.get("comment") or "")
            if items and (size + len(item.content or b"") > limit or kind == "gzip"):
                flush()
                items, size = [], 0
            items.append(item)
            size += len(item.content or b"")
        if items:
            flush()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        os.makedirs(self.root, exist_ok=True)
        old = [os.path.join(d, f) for d, folders, names in os.walk(self.root) if _visible(folders) for f in names if not f.startswith(("_", "."))] if self.overwrite else []
        for m in messages:
            for path, name in m.files if m else ():
                os.replace(path, os.path.join(self.root, name))
        for path in old:
            os.remove(path)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.temporary, ignore_errors=True)
        try:
            os.rmdir(os.path.dirname(self.temporary))
        except OSError:  # another job writes here
            pass


class ArchiveSource(DataSource):
    #: Formats beside the built-in ones.
    formats: dict = {}

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> StructType:
        return CONTENT if str(self.options.get("content", "true")).lower() == "true" else SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        pushing = str(self.options.get("pushdown", "false")).lower() == "true"
        return (PushingReader if pushing else ArchiveReader)(schema, dict(self.options), self.formats)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ArchiveWriter(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Formats added by detect.register() before this go along to the tasks."""
    own = dict(detect.added())

    class Source(ArchiveSource):
        formats = own

    spark.dataSource.register(Source)


def explode_archives(files: DataFrame, content: bool = True, on_error: str = "fail", **options: str) -> DataFrame:
    """files (path string, content binary) -> entries: the same rows as the source's, over
    any source of files that Spark has, batch or streaming."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = CONTENT if content else SCHEMA
    arrow = to_arrow_schema(schema)
    o = options_of(options)
    own = detect.added()

    def step(batches):
        detect.FORMATS.update(own)
        for b in batches:
            volumes = b.column("sizes").to_pylist() if "sizes" in b.schema.names else [()] * len(b)
            for path, data, sizes in zip(b.column("path").to_pylist(), b.column("content"), volumes, strict=True):
                rows: list[tuple] = []
                size = 0
                hint = replace(o, extension=o.extension or detect.extension_of(path), volumes=tuple(sizes) if sizes else ())
                for r in rows_of(path, data.as_py(), hint, content, on_error):
                    rows.append(r)
                    size += len(r[-2] or b"") if content else 0
                    if len(rows) >= 4096 or size > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return files.select("path", "content", *(["sizes"] if "sizes" in files.columns else [])).mapInArrow(step, schema)


#: Names of parts of volume sets that are broadcast; more are joined by a shuffle.
MAX_PARTS = 100_000


def read_archives(spark: SparkSession, path: str, content: bool = True, on_error: str = "fail", glob: str = "*", **options: str) -> DataFrame:
    """Archives at any path that Spark reads. Names alone tell which files belong to a
    volume set of several; only these are shuffled, to be joined."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)

    @F.pandas_udf("whole string, n int")
    def volume(s):
        import pandas as pd

        return pd.DataFrame([detect.volume_of(x) for x in s], columns=["whole", "n"])

    parts = files.select("path").withColumn("v", volume("path")).select("path", "v.*")
    several = parts.groupBy("whole").agg(F.count("*").alias("c")).filter("c > 1").select("whole")
    parts = parts.join(several, "whole", "left_semi")
    if parts.count() <= MAX_PARTS:
        parts = F.broadcast(parts)
    files = files.select("path", "content")
    lone = files.join(parts.select("path"), "path", "left_anti").withColumn("sizes", F.array().cast("array<long>"))
    whole = files.join(parts, "path").groupBy(F.col("whole").alias("path")).agg(F.array_sort(F.collect_list(F.struct("n", "content"))).alias("parts"))
    sizes = F.transform("parts", lambda x: F.octet_length(x.content).cast("long"))
    joined = whole.select("path", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x.content)).alias("content"), sizes.alias("sizes"))
    return explode_archives(lone.unionByName(joined), content, on_error, **options)
