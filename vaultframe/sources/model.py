"""The entry relation: one row for each entry of each archive."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import types as T


class ArchiveError(ValueError):
    """Root of what goes wrong with an archive."""


class Unsupported(ArchiveError):
    """A known feature that can't be read."""


class Incomplete(ArchiveError):
    """Parts or bytes are missing."""


class Damaged(ArchiveError):
    """The bytes contradict themselves."""


@dataclass
class Entry:
    archive_type: str
    key: str | None
    compression_type: str = "None"
    size: int | None = None
    compressed_size: int | None = 0
    crc: int | None = 0
    last_modified: dt.datetime | None = None
    created: dt.datetime | None = None
    last_accessed: dt.datetime | None = None
    archived: dt.datetime | None = None
    link_target: str | None = None
    is_directory: bool = False
    is_encrypted: bool = False
    is_split_after: bool = False
    is_solid: bool = False
    is_complete: bool = True
    volume_index_first: int = 0
    volume_index_last: int = 0
    attrib: int | None = None
    outer_compression: str = "None"
    folder: int | None = None
    format_meta: dict[str, str] = field(default_factory=dict)
    #: How crc is computed from the content; None where it isn't available.
    check: Callable[[bytes], int] | None = None
    read: Callable[[], bytes] | None = None

    def content(self) -> bytes | None:
        return None if self.is_directory or self.read is None else self.read()


SCHEMA = T.StructType(
    [
        T.StructField("archive_path", T.StringType(), False), T.StructField("entry_index", T.LongType(), False),
        T.StructField("archive_type", T.StringType()), T.StructField("outer_compression", T.StringType()),
        T.StructField("key", T.StringType()), T.StructField("link_target", T.StringType()), T.StructField("compression_type", T.StringType()),
        T.StructField("size", T.LongType()), T.StructField("compressed_size", T.LongType()), T.StructField("crc", T.LongType()),
        T.StructField("last_modified", T.TimestampNTZType()), T.StructField("created", T.TimestampNTZType()), T.StructField("last_accessed", T.TimestampNTZType()), T.StructField("archived", T.TimestampNTZType()),
        T.StructField("is_directory", T.BooleanType()), T.StructField("is_encrypted", T.BooleanType()), T.StructField("is_split_after", T.BooleanType()), T.StructField("is_solid", T.BooleanType()),
        T.StructField("is_complete", T.BooleanType()), T.StructField("volume_index_first", T.IntegerType()), T.StructField("volume_index_last", T.IntegerType()), T.StructField("attrib", T.IntegerType()),
        T.StructField("folder", T.IntegerType()), T.StructField("format_meta", T.MapType(T.StringType(), T.StringType())), T.StructField("error", T.StringType()),
    ]
)
CONTENT = T.StructType([*SCHEMA.fields, T.StructField("content", T.BinaryType()), T.StructField("checksum_ok", T.BooleanType())])


@dataclass(frozen=True)
class Options:
    password: str | None = None
    encoding: str = "cp437"
    look_for_header: bool = False
    streaming: bool = False
    max_entry_bytes: int = 1 << 30
    #: Content may be so many times the size of its archive.
    max_ratio: int = 100_000
    extension: str = ""
    #: Names are in this encoding whatever the archive says.
    force_encoding: bool = False
    #: Bytes of what is decompressed as one: a tar's wrapper, a 7z folder.
    max_whole_bytes: int = 4 << 30
    #: Sizes of the volumes that make up the bytes, where there are several.
    volumes: tuple[int, ...] = ()

    def limit(self, packed: int) -> int:
        """Most bytes that a content packed in so many may have."""
        return min(self.max_entry_bytes, self.max_ratio * max(packed, 1))

    def whole(self, packed: int) -> int:
        return min(self.max_whole_bytes, self.max_ratio * max(packed, 1))
