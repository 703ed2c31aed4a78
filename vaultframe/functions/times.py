"""Times, numbers and names as archive headers write them, in Python and as columns."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = dt.datetime(1970, 1, 1)


def dos_time(packed: int) -> dt.datetime | None:
    """A packed DOS date and time; absent dates are 1980-01-01, impossible ones null."""
    date, time = packed >> 16 & 0xFFFF, packed & 0xFFFF
    if date == 0xFFFF or not date >> 5 & 15 or not date & 31:
        year, month, day = 1980, 1, 1
    else:
        year, month, day = 1980 + (date >> 9), date >> 5 & 15, date & 31
    hour, minute, second = (0, 0, 0) if time == 0xFFFF else (time >> 11, time >> 5 & 63, 2 * (time & 31))
    try:
        return dt.datetime(year, month, day, hour, minute, second)
    except ValueError:
        return None


def to_dos(when: dt.datetime) -> int:
    if when.year < 1980:
        return 0x210000
    return (min(when.year, 2107) - 1980) << 25 | when.month << 21 | when.day << 16 | when.hour << 11 | when.minute << 5 | when.second // 2


def unix_time(seconds: float) -> dt.datetime:
    return EPOCH + dt.timedelta(seconds=seconds)


def file_time(ticks: int) -> dt.datetime:
    """Hundred-nanosecond ticks since 1601."""
    return dt.datetime(1601, 1, 1) + dt.timedelta(microseconds=ticks // 10)


def octal(field: bytes) -> int:
    """A tar number: octal text, or base 256 behind a high bit."""
    if field[:1] and field[0] & 0x80:
        value = int.from_bytes(field, "big")
        value &= (1 << (8 * len(field) - 1)) - 1
        return value - (1 << (8 * len(field) - 2) + 1) if field[0] & 0x40 else value
    text = field.replace(b"\0", b" ").strip()
    return int(text, 8) if text else 0


def dos_time_col(packed: Column) -> Column:
    """dos_time() as a column."""
    packed = packed.cast("long")
    date, time = F.shiftright(packed, 16).bitwiseAND(0xFFFF), packed.bitwiseAND(0xFFFF)
    month, day = F.shiftright(date, 5).bitwiseAND(15), date.bitwiseAND(31)
    none, still = (date == 0xFFFF) | (month == 0) | (day == 0), time == 0xFFFF
    pick = lambda c, a, b: F.when(c, F.lit(a)).otherwise(b).cast("int")
    return F.try_make_timestamp_ntz(
        pick(none, 1980, F.shiftright(date, 9) + 1980), pick(none, 1, month), pick(none, 1, day),
        pick(still, 0, F.shiftright(time, 11)), pick(still, 0, F.shiftright(time, 5).bitwiseAND(63)), pick(still, 0, time.bitwiseAND(31) * 2),
    )


def to_dos_col(when: Column) -> Column:
    part = lambda f, by: F.shiftleft(f.cast("long"), by)
    packed = part(F.least(F.year(when), F.lit(2107)) - 1980, 25) + part(F.month(when), 21) + part(F.dayofmonth(when), 16) + part(F.hour(when), 11) + part(F.minute(when), 5) + F.floor(F.second(when) / 2).cast("long")
    return F.when(F.year(when) < 1980, F.lit(0x210000).cast("long")).otherwise(packed)


def octal_col(text: Column) -> Column:
    return F.conv(F.trim(F.translate(text, "\0", " ")), 8, 10).cast("long")


def tar_name(key: str) -> str:
    """A key as tar writers put it: slashes only, no drive, none at the ends."""
    key = key.replace("\\", "/")
    return key.split(":", 1)[-1].strip("/")


def tar_name_col(key: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(key, "\\", "/"), r"^[^:]*:", ""), F.lit("/"))


def safe_name_col(key: Column) -> Column:
    """The leaf with characters replaced that file systems refuse."""
    return F.regexp_replace(F.element_at(F.split(key, "/"), -1), r'[<>:"|?*\x00-\x1F]', "_")


def is_safe(key: str) -> bool:
    """Whether a key stays below the folder that it is extracted to."""
    parts = key.replace("\\", "/").split("/")
    return bool(key) and not key.startswith(("/", "\\")) and not re.match(r"^[A-Za-z]:", key) and ".." not in parts and "\0" not in key


def is_safe_col(key: Column) -> Column:
    flat = F.translate(key, "\\", "/")
    return (F.length(key) > 0) & ~flat.startswith("/") & ~flat.rlike(r"^[A-Za-z]:") & ~flat.rlike(r"(^|/)\.\.(/|$)") & ~key.contains("\0")
