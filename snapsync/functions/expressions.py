"""Column expressions of manifests and reports."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

KIB, SMALL_FILE, CHUNK = 1024, 4 << 20, 1 << 20

#: Extensions of files that are compressed already.
COMPRESSED = (
    ".gz .bz2 .xz .zst .lz4 .br .zip .7z .rar .tar "
    ".jpg .jpeg .png .gif .webp .avif .heic "
    ".mp4 .mkv .avi .mov .wmv .flv .webm .mp3 .aac .ogg .flac .opus .m4a .pdf"
).split()


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of two non-negative numbers, exact for longs."""
    return F.call_function("div", a, b)


def is_small(size: Column, limit: int = SMALL_FILE) -> Column:
    return size <= F.lit(limit)


def extension(path: Column) -> Column:
    """From the last dot of the whole path on, in lower case; empty without a dot."""
    return F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1))


def should_compress(path: Column) -> Column:
    return ~extension(path).isin(*COMPRESSED)


def unsafe_reason(path: Column) -> Column:
    """Why a path must not be written below a root; null for safe ones."""
    return F.when(F.coalesce(path, F.lit("")) == "", "empty").when(path.rlike(r"^[/\\]"), "absolute").when(path.contains(".."), "parent").when(path.contains("\0"), "nul")


def safe_path(path: Column) -> Column:
    return unsafe_reason(path).isNull()


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def chunk_count(size: Column, chunk: int = CHUNK) -> Column:
    chunk = chunk or CHUNK
    return _div(size + F.lit(chunk - 1), F.lit(chunk))


def last_chunk_size(size: Column, chunk: int = CHUNK) -> Column:
    return F.when(size == 0, F.lit(0).cast("long")).otherwise(size - (chunk_count(size, chunk) - 1) * chunk)


def format_bytes(n: Column) -> Column:
    """Bytes with two decimals from KB on; ties round to even, as binary fractions print them."""
    shown = lambda power: F.format_string("%.2f", F.bround(n / float(KIB**power), 2))
    return F.when(n < KIB, F.concat(n.cast("string"), F.lit(" B"))).when(n < KIB**2, F.concat(shown(1), F.lit(" KB"))).when(n < KIB**3, F.concat(shown(2), F.lit(" MB"))).otherwise(F.concat(shown(3), F.lit(" GB")))


def format_speed(rate: Column) -> Column:
    shown = lambda power, digits: F.format_string(f"%.{digits}f", F.bround(rate / float(KIB**power), digits))
    return F.when(rate < KIB, F.concat(shown(0, 1), F.lit(" B/s"))).when(rate < KIB**2, F.concat(shown(1, 2), F.lit(" KB/s"))).when(rate < KIB**3, F.concat(shown(2, 2), F.lit(" MB/s"))).otherwise(F.concat(shown(3, 2), F.lit(" GB/s")))


def format_duration(seconds: Column) -> Column:
    h, m, s = _div(seconds, F.lit(3600)), _div(seconds % 3600, F.lit(60)), seconds % 60
    part = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(seconds < 60, part(s, "s")).when(seconds < 3600, F.concat_ws(" ", part(m, "m"), part(s, "s"))).otherwise(F.concat_ws(" ", part(h, "h"), part(m, "m"), part(s, "s")))


def format_percent(part: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit("100%")).otherwise(F.concat(F.format_string("%.1f", F.bround(100.0 * part / total, 1)), F.lit("%")))


#: 100-ns ticks between 1601 and 1970.
TICKS_TO_EPOCH = 116444736000000000


def mtime_ns(seconds: Column, nanos: Column) -> Column:
    return seconds * 1_000_000_000 + nanos


def ticks_to_ns(ticks: Column) -> Column:
    return F.when(ticks < TICKS_TO_EPOCH, F.lit(0).cast("long")).otherwise((ticks - TICKS_TO_EPOCH) * 100)


def ns_to_ticks(ns: Column) -> Column:
    return _div(ns, F.lit(100)) + TICKS_TO_EPOCH


@F.pandas_udf(LongType())
def weak_checksum(data: pd.Series) -> pd.Series:
    """Adler-32 of a binary column, by Arrow batches."""
    return data.map(lambda x: None if x is None else zlib.adler32(x))


@F.pandas_udf(IntegerType())
def encoded_size(data: pd.Series) -> pd.Series:
    """Size of a binary column's values when deflated at the fastest level."""
    return data.map(lambda x: None if x is None else len(zlib.compress(x, 1)))


def row_digest(*parts: Column) -> Column:
    """MD5 of the parts with a separator that no part holds."""
    return F.md5(F.concat_ws("\0", *(p.cast("string") for p in parts)))
