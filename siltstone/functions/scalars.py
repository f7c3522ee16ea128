"""Scalar functions on inventory columns, as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import HASH_NAMES, HASH_SIZES, MAX_FILE_SIZE, SECOND, SETGID, SETUID, STICKY

#: Seconds that the packed wall time adds to Unix time: a fixed value of the binary format.
WALL_OFFSET = 2_682_374_400


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digest(content: Column, hash_type: int) -> Column:
    """Hex digest of a string or binary column; an unknown type gives null."""
    return {1: F.sha1(content), 2: F.sha2(content, 256), 3: F.sha2(content, 512)}.get(hash_type, F.lit(None).cast("string"))


def hash_name(hash_type: Column) -> Column:
    pick = reduce(lambda c, k: c.when(hash_type == k, HASH_NAMES[k]), HASH_NAMES, F)
    return pick.otherwise("unknown")


def hash_hex_length(hash_type: Column) -> Column:
    """Hex digits of a digest; 40 for unknown types."""
    pick = reduce(lambda c, k: c.when(hash_type == k, 2 * HASH_SIZES[k]), HASH_SIZES, F)
    return pick.otherwise(40)


def wall_encode(ns: Column) -> Column:
    """Packed wall time: offset seconds in the upper 34 bits, nanoseconds in the lower 30."""
    part = F.pmod(ns, F.lit(SECOND))
    seconds = F.call_function("div", ns - part, F.lit(SECOND))
    return F.shiftleft(seconds + WALL_OFFSET, 30).bitwiseOR(part)


def wall_decode(wall: Column) -> Column:
    """Nanoseconds since 1970. The shift is unsigned: the packed value passes 2^63 in the year 2157."""
    return (F.shiftrightunsigned(wall, 30) - WALL_OFFSET) * SECOND + wall.bitwiseAND(F.lit((1 << 30) - 1))


def iso_time(ns: Column) -> Column:
    seconds = F.call_function("div", ns - F.pmod(ns, F.lit(SECOND)), F.lit(SECOND))
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(F.pmod(ns, F.lit(SECOND)).cast("string"), 9, "0"), F.lit("Z"))


def posix_mode(mode: Column) -> Column:
    """Permission bits with setuid, setgid and sticky where POSIX has them."""
    special = reduce(lambda a, b: a.bitwiseOR(b), (F.when(mode.bitwiseAND(F.lit(bit)) != 0, F.lit(to)).otherwise(F.lit(0)) for bit, to in ((SETUID, 0o4000), (SETGID, 0o2000), (STICKY, 0o1000))))
    return mode.bitwiseAND(F.lit(0o777)).bitwiseOR(special.cast("long"))


def snapshot_id(ns: Column) -> Column:
    """The id of a snapshot taken at this time: 20230615T120000.000000000Z."""
    part = F.pmod(ns, F.lit(SECOND))
    seconds = F.call_function("div", ns - part, F.lit(SECOND))
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyyMMdd'T'HHmmss"), F.lit("."), F.lpad(part.cast("string"), 9, "0"), F.lit("Z"))


def human_size(size: Column) -> Column:
    """1.5 MB: base 1024, one decimal; whole bytes below 1024."""
    out = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for power, unit in enumerate("KMGTPE", 1):
        rounded = F.bround(size / F.lit(float(1024**power)), 1)  # ties to even
        text = F.concat(F.format_string("%.1f", rounded), F.lit(f" {unit}B"))
        out = out.when(size < 1024 ** (power + 1), text) if power < 6 else out.otherwise(text)
    return out


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, ".").otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def under(path: Column, parent: str) -> Column:
    """Whether a path is the parent or lies below it; the empty parent holds everything."""
    return F.lit(True) if parent == "" else (path == parent) | path.startswith(parent + "/")


def matches_any(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns), F.lit(False))


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a rule matches the path or one of the directories above it, whose subtree is then hidden."""
    if not patterns:
        return F.lit(False)
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.exists(prefixes, lambda p: matches_any(p, patterns))


def zero_hash(h: Column) -> Column:
    return h == F.repeat(F.lit("0"), F.length(h))


def hexadecimal(h: Column) -> Column:
    return h.rlike("^[0-9a-fA-F]*$")


def valid(path="path", h="hash", hash_type="hash_type", size="file_size") -> Column:
    """The quick check of an entry: names, known hash type, digest length, size."""
    path, h, hash_type, size = map(col, (path, h, hash_type, size))
    return (path != "") & (h != "") & hash_type.between(1, 3) & (F.length(h) == hash_hex_length(hash_type)) & (size <= MAX_FILE_SIZE)


def corruption(path="path", h="hash", hash_type="hash_type", size="file_size") -> Column:
    """The signs of corruption that an entry shows, as an array of texts. Not the complement of valid()."""
    path, h, hash_type, size = map(col, (path, h, hash_type, size))
    signs = [
        (zero_hash(h), F.lit("all-zero hash")),
        (~hash_type.between(1, 3), F.concat(F.lit("invalid hash type: "), hash_type.cast("string"))),
        (size > MAX_FILE_SIZE, F.concat(F.lit("unreasonable file size: "), size.cast("string"), F.lit(" bytes"))),
        (path == "", F.lit("empty file path")),
        (h == "", F.lit("empty hash")),
        (~hexadecimal(h), F.lit("hash contains non-hex characters")),
    ]
    return F.filter(F.array(*[F.when(test, text) for test, text in signs]), lambda x: x.isNotNull())
