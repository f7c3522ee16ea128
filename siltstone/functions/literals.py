"""Literals of the command languages, and globs. All of these run on the driver, on what a user typed."""

from __future__ import annotations

import datetime as dt
import posixpath
import re

from ..schema import HASH_NAMES, SECOND

#: Units of size tests, and of sizes in settings: fixed values of the languages.
SIZE_UNITS = {"c": 1, "w": 2, "b": 512, "k": 1024, "M": 1024**2, "G": 1024**3}
HUMAN_UNITS = {"": 1, "B": 1, "K": 1024, "KB": 1024, "M": 1024**2, "MB": 1024**2, "G": 1024**3, "GB": 1024**3}
TRUE, FALSE = {"true", "1", "yes", "on"}, {"false", "0", "no", "off"}


def signed(text: str) -> tuple[str, str]:
    """The comparison that a leading sign stands for, and the rest."""
    if text[:1] in ("+", "-"):
        return (">" if text[0] == "+" else "<"), text[1:]
    return "=", text


def size_test(text: str) -> tuple[str, int]:
    """[+-]N[cwbkMG] as a comparison and a number of bytes; fractions are cut off after scaling."""
    op, rest = signed(text)
    unit = 1
    if rest and rest[-1] in SIZE_UNITS:
        unit, rest = SIZE_UNITS[rest[-1]], rest[:-1]
    if not re.fullmatch(r"\d+(\.\d*)?|\.\d+", rest):
        raise ValueError(f"not a size: {text!r}")
    return op, int(float(rest) * unit)


def age_test(text: str) -> tuple[str, int]:
    op, rest = signed(text)
    if not rest.isascii() or not rest.isdigit():
        raise ValueError(f"not an age: {text!r}")
    return op, int(rest)


def human_size(text: str) -> int:
    """2M, 512k, 1.5GB: a positive number of bytes."""
    found = re.fullmatch(r"([0-9.]+)([A-Z]*)", text.strip().upper())
    if not found or found[2] not in HUMAN_UNITS:
        raise ValueError(f"not a size: {text!r}")
    size = int(float(found[1]) * HUMAN_UNITS[found[2]])
    if not 0 < size < 1 << 63:
        raise ValueError(f"size out of range: {text!r}")
    return size


def integer(text: str, bits: int) -> int:
    """Decimal, 0x hexadecimal, or octal with a leading 0, unsigned and at most so many bits wide."""
    base = 16 if text[:2].lower() == "0x" else 8 if len(text) > 1 and text[0] == "0" else 10
    value = int(text[2:] if base == 16 else text, base)
    if not 0 <= value < 1 << bits:
        raise ValueError(f"out of range: {text!r}")
    return value


def time_ns(text: str) -> int:
    """ISO time in UTC, with Z and with or without a fraction, or Unix seconds."""
    if found := re.fullmatch(r"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?Z", text):
        whole = dt.datetime.fromisoformat(found[1]).replace(tzinfo=dt.UTC)
        return int(whole.timestamp()) * SECOND + int((found[2] or "0").ljust(9, "0"))
    return int(text) * SECOND


def iso(ns: int) -> str:
    return dt.datetime.fromtimestamp(ns // SECOND, dt.UTC).strftime("%Y-%m-%dT%H:%M:%S") + f".{ns % SECOND:09d}Z"


def hash_text(text: str) -> str:
    """A digest of 20, 32 or 64 bytes in hex, with or without 0x."""
    bare = text[2:] if text[:2].lower() == "0x" else text
    if not re.fullmatch(r"(?:[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|[0-9a-fA-F]{128})", bare):
        raise ValueError(f"not a digest: {text!r}")
    return bare.lower()


def hash_type(text: str) -> int:
    names = {v: k for k, v in HASH_NAMES.items()}
    if text.lower() in names:
        return names[text.lower()]
    if text.isdigit() and int(text) in HASH_NAMES:
        return int(text)
    raise ValueError(f"not a hash type: {text!r}")


def boolean(text: str) -> bool:
    if text.lower() in TRUE | FALSE:
        return text.lower() in TRUE
    raise ValueError(f"not a boolean: {text!r}")


def clean(path: str) -> str:
    """A key path in its shortest form; the root is empty."""
    short = posixpath.normpath(path) if path else ""
    return "" if short == "." else short


def prune_roots(paths: list[str]) -> list[str]:
    """Sorted roots without those that lie under another one."""
    out: list[str] = []
    for p in sorted({clean(x) for x in paths}):
        if not any(q == "" or p == q or p.startswith(q + "/") for q in out):
            out.append(p)
    return out


def flags(text: str) -> dict[str, bool]:
    """a,b:false as {a: True, b: False}."""
    out = {}
    for part in filter(None, (x.strip() for x in text.split(","))):
        name, _, value = part.partition(":")
        out[name.strip()] = boolean(value.strip()) if value else True
    return out


def glob_regex(glob: str, ignore_case: bool = False) -> str:
    """An anchored regular expression for a shell glob: * and ? stop at /, [a-z] and [^a-z], \\ escapes."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if i == len(glob):
                raise ValueError(f"glob ends with an escape: {glob!r}")
            out.append(re.escape(glob[i]))
            i += 1
        elif c == "[":
            negate = glob[i : i + 1] == "^"
            i += negate
            ranges = []
            while glob[i : i + 1] != "]" or not ranges:
                ends = []
                for _ in range(2):
                    if i >= len(glob) or glob[i] in "]-" and glob[i] != "\\":
                        raise ValueError(f"bad class in glob: {glob!r}")
                    if glob[i] == "\\":
                        i += 1
                    if i >= len(glob):
                        raise ValueError(f"bad class in glob: {glob!r}")
                    ends.append(glob[i])
                    i += 1
                    if len(ends) == 2 or glob[i : i + 1] != "-":
                        break
                    i += 1
                if i >= len(glob):
                    raise ValueError(f"bad class in glob: {glob!r}")
                ranges.append("-".join(f"\\x{{{ord(e):x}}}" for e in ends))
            i += 1
            out.append(f"[{'^/' if negate else ''}{''.join(ranges)}]")
        else:
            out.append(re.escape(c))
    return ("(?i)" if ignore_case else "") + "^" + "".join(out) + "$"
