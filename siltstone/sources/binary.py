"""The binary index layout: a checksummed header and one record of variable length a file, sorted by path.

Native alignment, little-endian. A record is 136 fixed bytes, the path, a NUL, and padding to 8.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import struct
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.literals import integer
from ..functions.scalars import WALL_OFFSET
from ..schema import COLUMNS, ENTRY, HASH_NAMES, HASH_SIZES, SECOND

# Fixed values of the layout.
HEADER, FIXED, LARGEST = 88, 136, 4096
BYTE_ORDER, VERSION = 0x0102030405060708, 1
CLEAN, DELETED = 1 << 1, 1 << 0
HEAD = struct.Struct("<4s4xQIIHH")  # signature, byte order, version, entries, flags, checksum type
RECORD = struct.Struct("<I4xQQIIIII4xQHH64s")  # size, ctime, mtime, dev, ino, mode, uid, gid, file size, flags, hash type, hash


class CorruptIndex(ValueError):
    """The bytes are no index, or were changed."""


def wall(ns: int) -> int:
    return (ns // SECOND + WALL_OFFSET) << 30 | ns % SECOND


def unwall(w: int) -> int:
    return ((w >> 30) - WALL_OFFSET) * SECOND + (w & ((1 << 30) - 1))


def record_size(path: bytes) -> int:
    return (FIXED + len(path) + 8) // 8 * 8


def record(r: dict) -> bytes:
    """One row of ENTRY as a record."""
    path = r["path"].encode()
    size = record_size(path)
    if size > LARGEST:
        raise ValueError(f"the path is too long: {r['path'][:40]!r}")
    fixed = RECORD.pack(size, wall(r["ctime_ns"]), wall(r["mtime_ns"]), r["dev"], r["ino"], r["mode"], r["uid"], r["gid"], r["file_size"], DELETED if r["is_deleted"] else 0, r["hash_type"], bytes.fromhex(r["hash"]))
    return (fixed + bytes(FIXED - len(fixed)) + path).ljust(size, b"\0")


def write_records(f: BinaryIO, rows: Iterable[dict], count: int, signature: bytes, checksum_type: int = 1, clean: bool = True) -> None:
    """An index file of `count` rows that come in path order, one record at a time. It is marked clean, with its checksum, at the end."""
    head = HEAD.pack(signature, BYTE_ORDER, VERSION, count, CLEAN if clean else 0, checksum_type)
    made, seen = hashlib.new(HASH_NAMES[checksum_type], head), 0
    f.write(HEAD.pack(signature, BYTE_ORDER, VERSION, count, 0, checksum_type).ljust(HEADER, b"\0"))
    for r in rows:
        x = record(r)
        made.update(x)
        f.write(x)
        seen += 1
    if seen != count:
        raise ValueError(f"{seen} rows instead of {count}")
    f.seek(0)
    f.write((head + made.digest()).ljust(HEADER, b"\0")[:HEADER])


def encode(rows: list[dict], signature: bytes, clean: bool = True, checksum_type: int = 1) -> bytes:
    """An index file of the rows (ENTRY as dicts), in path order."""
    out = io.BytesIO()
    write_records(out, sorted(rows, key=lambda r: r["path"].encode()), len(rows), signature, checksum_type, clean)
    return out.getvalue()


def header(data: bytes) -> dict:
    if len(data) < HEADER:
        raise CorruptIndex("shorter than a header")
    signature, order, version, count, flags, kind = HEAD.unpack_from(data)
    return {"signature": signature, "byte_order": order, "version": version, "entry_count": count, "flags": flags, "checksum_type": kind, "checksum": data[HEAD.size : HEAD.size + HASH_SIZES.get(kind, 20)].hex()}


def check_header(data: bytes, signature: bytes | None = None) -> dict:
    """Signature (if given), byte order, version, and the checksum of files marked clean."""
    h = header(data)
    if signature is not None and h["signature"] != signature:
        raise CorruptIndex("another signature")
    if h["byte_order"] != BYTE_ORDER or h["version"] != VERSION:
        raise CorruptIndex("another byte order or version")
    if h["flags"] & CLEAN:
        if h["checksum_type"] not in HASH_NAMES:
            raise CorruptIndex("unknown checksum type")
        if not hashlib.new(HASH_NAMES[h["checksum_type"]], data[: HEAD.size] + data[HEADER:]).hexdigest()[: 2 * (HEADER - HEAD.size)] == h["checksum"][: 2 * (HEADER - HEAD.size)]:
            raise CorruptIndex("checksum differs")
    return h


#: A file with more bad records than these is given up.
MOST_BAD = 100


def plausible(data: bytes, at: int, size: int) -> bool:
    """Whether a record of this size may begin here: a path of text, then nothing but padding."""
    path = data[at + FIXED : at + size].rstrip(b"\0")
    return bool(path) and b"\0" not in path and record_size(path) == size


def records(data: bytes, context: str) -> Iterator[tuple[int, tuple | None, str | None]]:
    """(offset, row, None) or (offset, None, what is wrong) for all of an index file. After a bad record the next one is looked for in steps
    of 8 bytes; more than MOST_BAD bad ones end the reading with an error."""
    at, bad, lost = HEADER, 0, False
    while at < len(data):
        size = struct.unpack_from("<I", data, at)[0] if at + 4 <= len(data) else 0
        if not (FIXED <= size <= LARGEST and size % 8 == 0 and at + size <= len(data) and (not lost or plausible(data, at, size))):
            if not lost:
                bad, lost = bad + 1, True
                if bad > MOST_BAD:
                    raise CorruptIndex(f"more than {MOST_BAD} bad records")
                yield at, None, f"impossible size {size}"
            at += 8
            continue
        lost = False
        _, ctime, mtime, dev, ino, mode, uid, gid, file_size, flags, kind, digest = RECORD.unpack_from(data, at)
        path = data[at + FIXED : at + size].rstrip(b"\0").decode("utf-8", "replace")
        yield at, (path, file_size, mode, uid, gid, dev, ino, unwall(ctime), unwall(mtime), bool(flags & DELETED), kind, digest[: HASH_SIZES.get(kind, 20)].hex(), context), None
        at += size


def decode(data: bytes, context: str, lenient: bool = False) -> Iterator[tuple]:
    """The rows of an index file. A record of an impossible size ends the reading with an error; if lenient, it is skipped."""
    rows = 0
    for at, row, wrong in records(data, context):
        if row is None and not lenient:
            raise CorruptIndex(f"bad record at {at}: {wrong}")
        if row is not None:
            rows += 1
            yield row
    if not lenient and rows != header(data)["entry_count"]:
        raise CorruptIndex("another number of entries")


#: Header fields that can be edited, with their readers; the others are calculated or fixed.
EDITABLE = {"signature": lambda x: x.encode("latin-1"), "version": lambda x: integer(x, 32), "flags": lambda x: integer(x, 16), "checksum_type": lambda x: integer(x, 16)}


def edit_header(data: bytes, changes: dict[str, str]) -> bytes:
    """The file with other header fields, and the checksum that belongs to them."""
    h = header(data)
    for name, text in changes.items():
        if name not in EDITABLE:
            raise ValueError(f"not an editable header field: {name!r}")
        h[name] = EDITABLE[name](text)
    if len(h["signature"]) != 4:
        raise ValueError("a signature has four characters")
    if h["checksum_type"] not in HASH_NAMES:
        raise ValueError(f"unknown checksum type: {h['checksum_type']}")
    head = HEAD.pack(h["signature"], h["byte_order"], h["version"], h["entry_count"], h["flags"], h["checksum_type"])
    digest = hashlib.new(HASH_NAMES[h["checksum_type"]], head + data[HEADER:]).digest()
    return (head + digest).ljust(HEADER, b"\0")[:HEADER] + data[HEADER:]


def header_json(h: dict) -> str:
    """A header as people and programs read it."""
    shown = h | {"signature": h["signature"].decode("latin-1"), "byte_order": f"0x{h['byte_order']:016x}", "flags": f"0x{h['flags']:08x}"}
    return json.dumps(shown, indent=2)


def read_index(spark: SparkSession, path: str, signature: bytes | None = None, context: str = "main", lenient: bool = False) -> DataFrame:
    """ENTRY rows of the index files at a path or glob that Spark can read: one file a row, decoded by tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["content"]:
                if not lenient:
                    check_header(data, signature)
                rows = list(decode(data, context, lenient))
                if rows:
                    yield pd.DataFrame(rows, columns=COLUMNS)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ENTRY)


def read_corrupt(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, reason): the bad records of the index files at a path or glob."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, data in zip(frame["path"], frame["content"]):
                yield pd.DataFrame([(file, at, wrong) for at, row, wrong in records(data, "") if row is None], columns=["file", "offset", "reason"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, offset long, reason string")


def write_index(df: DataFrame, path: str, signature: bytes, checksum_type: int = 1) -> None:
    """Write one index file: the format is a single file of one node's inventory, so its rows pass through the driver, in path order and a
    partition at a time."""
    rows = df.select(*COLUMNS).orderBy("path")
    with open(f"{path}.new", "wb") as f:
        write_records(f, (r.asDict() for r in rows.toLocalIterator()), rows.count(), signature, checksum_type)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{path}.new", path)
