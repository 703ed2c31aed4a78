"""Entries to files below a folder, guarded against leaving it."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.functions.times import EPOCH, is_safe, is_safe_col


_REFUSED = re.compile(r'[<>:"|?*\x00-\x1F]')


@dataclass(frozen=True)
class Extraction:
    overwrite: bool = True
    full_path: bool = True
    preserve_time: bool = True
    check: str = "fail"  # a checksum that doesn't match: fail, skip or ignore
    check_first: bool = True
    preserve_attributes: bool = False
    #: Characters that some file systems refuse become "_".
    plain_names: bool = False
    #: Called with a link's path and target; without it links are left out.
    link: Callable[[str, str], None] | None = None


SAFE, FLAT, PRESERVE = Extraction(overwrite=False), Extraction(full_path=False), Extraction(preserve_attributes=True)


def mode_of(meta: dict | None, attrib: int | None) -> int | None:
    """Permission bits: a tar's mode, or the high half of a zip's or a RAR's attributes;
    read-only of DOS."""
    if meta and "mode" in meta:
        return int(meta["mode"]) & 0o777
    if attrib is None:
        return None
    unix = attrib >> 16 & 0o777
    return unix or (0o444 if attrib & 1 else None)


def unsafe(entries: DataFrame) -> DataFrame:
    """Entries that would be written outside the folder."""
    return entries.filter(~is_safe_col(F.coalesce("key", F.lit(""))))


def extract(entries: DataFrame, root: str, options: Extraction = Extraction()) -> DataFrame:
    """Writes entries (key, content, is_directory, ...) below root, a folder that all
    executors share, and returns (key, path, bytes). Nothing is written if any key is
    unsafe; without check_first the job fails at that entry instead, and archives are
    decoded once rather than twice. Links go to options.link. Directories are made."""
    plain = entries if options.link else entries.filter("link_target is null")
    bad = unsafe(plain).select("key").first() if options.check_first else None
    if bad is not None:
        raise ValueError(f"entry would leave the folder: {bad[0]!r}")
    schema = pa.schema([("key", pa.string()), ("path", pa.string()), ("bytes", pa.int64())])

    def step(batches) -> Iterator[pa.RecordBatch]:
        top = os.path.realpath(root)
        for b in batches:
            out = []
            for r in b.to_pylist():
                name = r["key"] if options.full_path else r["key"].rstrip("/").rsplit("/", 1)[-1]
                if options.plain_names:
                    name = _REFUSED.sub("_", name)
                path = os.path.join(top, name)
                where = os.path.realpath(os.path.dirname(path.rstrip("/")))
                if not is_safe(r["key"]) or (where != top and not where.startswith(top + os.sep)) or os.path.islink(path):
                    raise ValueError(f"entry would leave the folder: {r['key']!r}")
                if r["link_target"] is not None:
                    options.link(path, r["link_target"])
                    continue
                if r["is_directory"]:
                    if options.full_path:
                        os.makedirs(path, exist_ok=True)
                    continue
                if r["checksum_ok"] is False and options.check != "ignore":
                    if options.check == "fail":
                        raise ValueError(f"checksum of {r['key']!r} does not match")
                    continue
                if os.path.exists(path) and not options.overwrite:
                    raise FileExistsError(path)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                temp = f"{path}.{os.getpid()}.tmp"
                with open(temp, "wb") as f:
                    f.write(r["content"] or b"")
                os.replace(temp, path)
                if options.preserve_time and r["last_modified"]:
                    t = (r["last_modified"] - EPOCH).total_seconds()
                    os.utime(path, (t, t))
                mode = mode_of(dict(r["format_meta"] or {}), r["attrib"]) if options.preserve_attributes else None
                if mode is not None:
                    os.chmod(path, mode)
                out.append((r["key"], path, len(r["content"] or b"")))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return plain.select("key", "content", "is_directory", "checksum_ok", "last_modified", "link_target", "format_meta", "attrib").mapInArrow(step, "key string, path string, bytes long")
