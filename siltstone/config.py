"""Settings: an INI file, overrides of the form key:value, and checks."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, field, fields

from .functions import literals
from .schema import HASH_NAMES

FORMATS = ("human", "json", "fdupes")


@dataclass
class Config:
    hash_default: str = "sha256"
    output_format: str = "human"
    verbose_level: int = 0
    symlink_mode: str = "all"
    hash_workers: int = 4
    buffer: str = "2M"
    retention: dict[str, int] = field(default_factory=lambda: {"hourly": 0, "daily": 7, "weekly": 4, "monthly": 12, "yearly": 3})
    debug: dict[str, bool] = field(default_factory=dict)

    def check(self) -> Config:
        if self.hash_default.lower() not in HASH_NAMES.values():
            raise ValueError(f"unknown hash: {self.hash_default!r}")
        if self.output_format not in FORMATS:
            raise ValueError(f"unknown format: {self.output_format!r}")
        if not 0 <= self.verbose_level <= 3:
            raise ValueError(f"verbose level out of range: {self.verbose_level}")
        if self.symlink_mode not in ("none", "contained", "all"):
            raise ValueError(f"unknown symlink mode: {self.symlink_mode!r}")
        if not 1 <= self.hash_workers <= 64:
            raise ValueError(f"hash workers out of range: {self.hash_workers}")
        literals.human_size(self.buffer)
        return self

    def override(self, *settings: str) -> Config:
        """default:sha1, format:json, level:2, mode:none, hash_workers:8, debug:a or debug:a,b:false."""
        names = {"default": "hash_default", "format": "output_format", "level": "verbose_level", "mode": "symlink_mode", "hash_workers": "hash_workers"}
        for s in settings:
            key, _, value = s.partition(":")
            if key == "debug":
                self.debug |= literals.flags(value)
            elif key in names:
                kind = type(getattr(self, names[key]))
                setattr(self, names[key], kind(value))
            else:
                raise ValueError(f"unknown setting: {key!r}")
        return self.check()

    def save(self, path: str) -> None:
        made = configparser.ConfigParser()
        made["settings"] = {f.name: str(getattr(self, f.name)) for f in fields(self) if f.name not in ("retention", "debug")}
        made["retention"] = {k: str(v) for k, v in self.retention.items()}
        made["debug"] = {k: str(v).lower() for k, v in self.debug.items()}
        with open(path, "w", encoding="utf-8") as f:
            made.write(f)

    @classmethod
    def load(cls, path: str) -> Config:
        read = configparser.ConfigParser()
        read.read(path, encoding="utf-8")
        out = cls()
        for f in fields(cls):
            if read.has_option("settings", f.name):
                setattr(out, f.name, type(getattr(out, f.name))(read["settings"][f.name]))
        if read.has_section("retention"):
            out.retention |= {k: int(v) for k, v in read["retention"].items()}
        if read.has_section("debug"):
            out.debug = {k: literals.boolean(v) for k, v in read["debug"].items()}
        return out.check()


class IgnoreRules:
    """Regular expressions, one a line of a file; # starts a comment line."""

    def __init__(self, patterns: list[str] | None = None) -> None:
        self.patterns: list[str] = []
        for p in patterns or []:
            self.add(p)

    def add(self, pattern: str) -> None:
        import re

        re.compile(pattern)
        if "(?=" in pattern or "(?!" in pattern or "(?<=" in pattern or "(?<!" in pattern or re.search(r"\\[1-9]", pattern):
            raise ValueError(f"look-around and back references are not allowed: {pattern!r}")
        self.patterns.append(pattern)

    @classmethod
    def load(cls, path: str) -> IgnoreRules:
        try:
            with open(path, encoding="utf-8") as f:
                return cls([x.strip() for x in f if x.strip() and not x.strip().startswith("#")])
        except FileNotFoundError:
            return cls()

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write("# One regular expression a line; a matching folder hides what is below it.\n" + "".join(f"{p}\n" for p in self.patterns))
