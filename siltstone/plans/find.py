"""A find language over indices: tokens become one boolean column, and actions become projections.

    list := or*   (all must hold)        or := and ('--or' and)*
    and  := not (('--and')? not)*        not := ('--not' | '!') primary | primary
    primary := '(' or ')' | test | action | option

Actions and options stand outside the expression wherever they are written, and actions run on all matching rows. --quit leaves the
first of them by path. Actions are frames here; what writes (--fix, --delete, --update-hash, --fls, --export, --extract) is carried
out by the index that runs the query.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import literals
from ..functions.scalars import basename, corruption, dirname, hash_name, iso_time, posix_mode, valid
from ..schema import CHAR_DEVICE, DEVICE, DIR, LINK, NAMED_PIPE, SECOND, SOCKET

#: A type letter and the mode bits that mean it; a regular file has none of them.
TYPE_BITS = {"d": DIR, "l": LINK, "p": NAMED_PIPE, "s": SOCKET, "b": DEVICE, "c": DEVICE | CHAR_DEVICE}
ALL_TYPES = DIR | LINK | NAMED_PIPE | SOCKET | DEVICE | CHAR_DEVICE
FIX_MODES = ("auto", "manual", "none")


#: Tests and actions that users have added: an argument becomes a boolean column, and matching rows become a frame.
MORE_TESTS: dict[str, Callable[[str], Column]] = {}
MORE_ACTIONS: dict[str, Callable[[DataFrame], DataFrame]] = {}


class FindError(ValueError):
    """The expression cannot be understood."""


def compare(c: Column, op: str, n: int) -> Column:
    return {"=": c == n, ">": c > n, "<": c < n}[op]


def type_test(letter: str) -> Column:
    bits = F.col("mode").bitwiseAND(F.lit(ALL_TYPES))
    if letter == "f":
        return bits == 0
    if letter not in TYPE_BITS:
        raise FindError(f"unknown type: {letter!r}")
    return bits == TYPE_BITS[letter]


def target_type_test(letter: str) -> Column:
    """The type after links are followed: a link in an inventory leads to a regular file."""
    linked = F.col("mode").bitwiseAND(F.lit(LINK)) != 0
    return type_test(letter) | linked if letter == "f" else F.lit(False) if letter == "l" else type_test(letter)


def perm_test(text: str) -> Column:
    how, digits = (text[0], text[1:]) if text[:1] in ("-", "/") else ("", text)
    if not digits or set(digits) - set("01234567"):
        raise FindError(f"not a mode: {text!r}")
    want, have = int(digits, 8), posix_mode(F.col("mode"))
    if how == "-":
        return have.bitwiseAND(F.lit(want)) == want
    if how == "/":
        return have.bitwiseAND(F.lit(want)) != 0 if want else F.lit(True)
    return have == want


def glob(c: Column, pattern: str, ignore_case: bool) -> Column:
    return c.rlike(literals.glob_regex(pattern, ignore_case))


@dataclass
class Query:
    """What a command line asks for."""

    starts: list[str]
    condition: Column | None = None
    actions: list[tuple[str, str | None]] = field(default_factory=list)
    options: dict[str, str] = field(default_factory=dict)
    missing: bool = False  # whether --missing is used: rows then need the column on_disk
    clean: bool = False  # whether --index-clean is used: rows then need the column index_clean


class Parser:
    def __init__(self, tokens: list[str], now_ns: int) -> None:
        self.tokens, self.at, self.now = tokens, 0, now_ns
        self.query = Query([])
        path, name = F.col("path"), basename(F.col("path"))
        age = lambda c, unit: F.floor((F.lit(self.now) - F.col(c)) / F.lit(unit * SECOND))
        self.tests: dict[str, Callable[[str], Column]] = {
            "--name": lambda v: glob(name, v, False),
            "--iname": lambda v: glob(name, v, True),
            "--path": lambda v: glob(path, v, False),
            "--ipath": lambda v: glob(path, v, True),
            "--regex": lambda v: path.rlike(v),
            "--size": lambda v: compare(F.col("file_size"), *literals.size_test(v)),
            "--mtime": lambda v: compare(age("mtime_ns", 86_400), *literals.age_test(v)),
            "--mmin": lambda v: compare(age("mtime_ns", 60), *literals.age_test(v)),
            "--ctime": lambda v: compare(age("ctime_ns", 86_400), *literals.age_test(v)),
            "--cmin": lambda v: compare(age("ctime_ns", 60), *literals.age_test(v)),
            "--hash": lambda v: F.lower("hash") == v.lower(),
            "--hash-prefix": lambda v: F.lower("hash").startswith(v.lower()),
            "--hash-type": lambda v: F.col("hash_type") == literals.hash_type(v),
            "--type": type_test,
            "--xtype": target_type_test,
            "--perm": perm_test,
            "--dev": lambda v: F.col("dev") == literals.integer(v, 32),
            "--in-index": lambda v: F.col("index_type") == v,
        }
        self.plain: dict[str, Callable[[], Column]] = {
            "--empty": lambda: F.col("file_size") == 0,
            "--deleted": lambda: F.col("is_deleted"),
            "--valid": valid,
            "--corrupt": lambda: F.size(corruption()) > 0,
            "--missing": self._missing,
            "--index-clean": self._clean,
        }

    def _missing(self) -> Column:
        self.query.missing = True
        return ~F.col("on_disk")

    def _clean(self) -> Column:
        self.query.clean = True
        return F.col("index_clean")

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def argument(self, name: str) -> str:
        if self.at >= len(self.tokens):
            raise FindError(f"{name} needs an argument")
        self.at += 1
        return self.tokens[self.at - 1]

    def parse(self) -> Query:
        while (t := self.peek()) is not None and not (t.startswith("--") or t in ("!", "(", ")")):
            self.query.starts.append(t)
            self.at += 1
        found = []
        while self.peek() is not None:
            before = self.at
            found.append(self.either())
            if self.at == before:
                raise FindError(f"unexpected {self.peek()!r}")
        self.query.starts = self.query.starts or ["all"]
        found = [x for x in found if x is not None]
        self.query.condition = reduce(lambda a, b: a & b, found) if found else None
        self.query.actions = self.query.actions or [("print", None)]
        return self.query

    def either(self) -> Column | None:
        left = self.both()
        while self.peek() == "--or":
            self.at += 1
            right = self.both()
            if left is None or right is None:
                raise FindError("--or needs a test on both sides")
            left = left | right
        return left

    def both(self) -> Column | None:
        left = self.negated()
        while (t := self.peek()) is not None and t not in ("--or", ")"):
            self.at += t == "--and"
            right = self.negated()
            if t == "--and" and (left is None or right is None):
                raise FindError("--and needs a test on both sides")
            left = right if left is None else left if right is None else left & right
        return left

    def negated(self) -> Column | None:
        if self.peek() in ("--not", "!"):
            self.at += 1
            found = self.primary()
            if found is None:
                raise FindError("--not needs a test")
            return ~found
        return self.primary()

    def primary(self) -> Column | None:
        token = self.peek()
        if token is None:
            raise FindError("a test is missing at the end")
        if token in (")", "--or", "--and", "--not", "!"):
            raise FindError(f"unexpected {token!r}")
        self.at += 1
        if token == "(":
            inner = self.either()
            if self.peek() != ")":
                raise FindError("a parenthesis is not closed")
            self.at += 1
            return inner
        if token in self.tests:
            try:
                return self.tests[token](self.argument(token))
            except ValueError as e:
                raise FindError(str(e)) from None
        if token in self.plain:
            return self.plain[token]()
        if token in ("--print", "--print0", "--ls", "--validate", "--checksum", "--delete", "--update-hash"):
            self.query.actions.append((token[2:], None))
        elif token in ("--printf", "--fix", "--fls", "--export", "--extract"):
            value = self.argument(token)
            if token == "--fix" and value not in FIX_MODES:
                raise FindError(f"not a fix mode: {value!r}")
            self.query.actions.append((token[2:], value))
        elif token in ("--maxdepth", "--mindepth", "--repo"):
            self.query.options[token[2:]] = self.argument(token)
        elif token in MORE_TESTS:
            return MORE_TESTS[token](self.argument(token))
        elif token in MORE_ACTIONS:
            self.query.actions.append((token[2:], None))
        elif token == "--quit":
            self.query.options["quit"] = "True"
        elif token in ("--warn", "--nowarn"):
            self.query.options["warn"] = str(token == "--warn")
        else:
            raise FindError(f"unknown expression: {token!r}")
        return None


def parse(tokens: list[str], now_ns: int) -> Query:
    return Parser(tokens, now_ns).parse()


def in_depth(entries: DataFrame, query: Query) -> DataFrame:
    out = entries
    depth = F.size(F.split("path", "/"))
    if "maxdepth" in query.options:
        out = out.filter(depth <= literals.integer(query.options["maxdepth"], 31))
    if "mindepth" in query.options:
        out = out.filter(depth >= literals.integer(query.options["mindepth"], 31))
    return out


def matching(entries: DataFrame, query: Query) -> DataFrame:
    """Rows for which the condition holds; where it is null it does not."""
    out = in_depth(entries, query)
    out = out if query.condition is None else out.filter(F.coalesce(query.condition, F.lit(False)))
    return out.orderBy("path", "index_type").limit(1) if "quit" in query.options else out


def undecided(entries: DataFrame, query: Query) -> DataFrame:
    """(path, index_type) of the rows for which the condition is null, as where a field is missing: what --warn reports."""
    out = in_depth(entries, query)
    return (out.limit(0) if query.condition is None else out.filter(query.condition.isNull())).select("path", "index_type")


def permissions(mode: Column) -> Column:
    """-rw-r--r--, with the type letter first."""
    letters = F.when(type_test("l"), "l").when(type_test("d"), "d").when(type_test("p"), "p").when(type_test("s"), "s").when(type_test("b"), "b").when(type_test("c"), "c").otherwise("-")
    bits = [F.when(mode.bitwiseAND(F.lit(1 << (8 - i))) != 0, "rwx"[i % 3]).otherwise("-") for i in range(9)]
    return F.concat(letters, *bits)


def directives() -> dict[str, Column]:
    octal = F.lower(F.conv(posix_mode(F.col("mode")).cast("string"), 10, 8))
    text = lambda c: F.col(c).cast("string")
    return {
        "p": F.col("path"),
        "f": basename(F.col("path")),
        "h": dirname(F.col("path")),
        "t": iso_time(F.col("mtime_ns")),
        "c": iso_time(F.col("ctime_ns")),
        "i": F.col("index_type"),
        "d": text("dev"),
        "s": text("file_size"),
        "m": octal,
        "u": text("uid"),
        "g": text("gid"),
        "H": F.col("hash"),
        "Y": hash_name(F.col("hash_type")),
        "%": F.lit("%"),
    }


def printf(template: str) -> Column:
    """A template of %-directives and the escapes \\n \\t \\r \\\\ as one column; other directives and escapes stay as they are."""
    known, parts, plain, i = directives(), [], "", 0
    while i < len(template):
        pair = template[i : i + 2]
        if len(pair) == 2 and pair[0] == "%" and pair[1] in known:
            parts += [F.lit(plain)] * bool(plain) + [known[pair[1]]]
            plain, i = "", i + 2
        elif len(pair) == 2 and pair[0] == "\\" and pair[1] in "ntr\\":
            plain += {"n": "\n", "t": "\t", "r": "\r", "\\": "\\"}[pair[1]]
            i += 2
        else:
            plain += template[i]
            i += 1
    return F.concat(*parts, F.lit(plain))


def listing() -> Column:
    parts = permissions(F.col("mode")), F.lit("1"), F.col("uid").cast("string"), F.col("gid").cast("string"), F.col("file_size").cast("string"), iso_time(F.col("mtime_ns"))
    return F.concat_ws(" ", *parts, F.concat(F.lit("["), F.col("index_type"), F.lit("]")), F.col("path"))


def act(rows: DataFrame, action: str, value: str | None = None, disk: DataFrame | None = None, accepted: DataFrame | None = None, hash_type: int = 2) -> DataFrame:
    """The rows of an action. checksum and fix need the files on disk as ENTRY, with fresh hashes; fix manual takes what is accepted of
    validate.fix_plan() as (path, type)."""
    if f"--{action}" in MORE_ACTIONS:
        return MORE_ACTIONS[f"--{action}"](rows)
    if action == "print":
        return rows.select(F.col("path").alias("line"))
    if action == "print0":
        return rows.select(F.concat("path", F.lit("\0")).alias("line"))
    if action in ("ls", "fls"):
        return rows.select(listing().alias("line"))
    if action == "printf":
        return rows.select(printf(value).alias("line"))
    if action == "extract":
        return rows.filter("not is_deleted").select("path")
    if action == "export":
        return rows
    if action == "delete":
        return rows.withColumn("is_deleted", F.lit(True))
    if action == "validate":
        return rows.select("path", valid().alias("valid"))
    if disk is None:
        raise FindError(f"--{action} needs the files on disk")
    if action == "checksum":
        fresh = disk.select("path", F.col("hash").alias("now"))
        same = F.when(F.col("now").isNull(), "missing").when(F.lower("now") == F.lower("hash"), "ok").otherwise("differs")
        return rows.join(fresh, "path", "left").select("path", same.alias("checksum"))
    if action == "update-hash":
        fresh = disk.select("path", F.col("hash").alias("now"), F.col("hash_type").alias("kind")).filter("now <> ''")
        both = rows.join(fresh, "path", "left")
        return both.withColumns({"hash": F.coalesce("now", "hash"), "hash_type": F.coalesce("kind", "hash_type")}).select(*rows.columns)
    from ..operators.validate import fix

    return fix(rows, disk, value, accepted, hash_type)


def index_type(path: str) -> str:
    """main, cache, or scan by the name of an index file; file for others."""
    bare = path.rsplit("/", 1)[-1].removesuffix(".idx")
    return bare if bare in ("main", "cache") else "scan" if bare.startswith("scan-") else "file"


def resolve(indices: dict[str, DataFrame], starts: list[str], load: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """UNION ALL of the named indices, each once, with index_type; `scan` is every scan index, `all` is everything, and what contains a slash
    is the path of an index file for load(). Unknown names are skipped unless nothing is left."""
    names: list[str] = []
    indices = dict(indices)
    types = {n: n for n in indices}
    for start in starts:
        if "/" in start and load is not None:
            if start not in indices:
                indices[start], types[start] = load(start), index_type(start)
            names += [start] if start not in names else []
            continue
        bare = start.removesuffix(".idx")
        pick = [n for n in indices if "/" not in n] if bare == "all" else [n for n in indices if n == bare or bare == "scan" and n.startswith("scan-")]
        names += [n for n in pick if n not in names]
    if not names:
        raise FindError(f"no index: {' '.join(starts)}")
    return reduce(DataFrame.unionByName, [indices[n].withColumn("index_type", F.lit(types[n])) for n in names])


def selected(indices: dict[str, DataFrame], query: Query, disk: DataFrame | None = None, load: Callable[[str], DataFrame] | None = None, clean: list[str] | None = None) -> DataFrame:
    """The rows of the starting points, with on_disk and index_clean where the query needs them; clean names the clean indices (none given:
    all are)."""
    rows = resolve(indices, query.starts, load)
    if query.clean:
        rows = rows.withColumn("index_clean", F.lit(True) if clean is None else F.col("index_type").isin(clean))
    if query.missing:
        if disk is None:
            raise FindError("--missing needs the files on disk")
        there = disk.select("path").distinct().withColumn("on_disk", F.lit(True))
        rows = rows.join(there, "path", "left").withColumn("on_disk", F.coalesce("on_disk", F.lit(False)))
    return rows


def find(indices: dict[str, DataFrame], tokens: list[str], now_ns: int, disk: DataFrame | None = None, load: Callable[[str], DataFrame] | None = None, accepted: DataFrame | None = None, hash_type: int = 2, clean: list[str] | None = None, ordered: bool = False) -> list[DataFrame]:
    """One DataFrame for each action of the command line; if ordered, for a sink, with its rows in path order."""
    query = parse(tokens, now_ns)
    rows = matching(selected(indices, query, disk, load, clean), query)
    if not ordered:
        return [act(rows, action, value, disk, accepted, hash_type) for action, value in query.actions]
    out = []
    for action, value in query.actions:
        made = act(rows.orderBy("path", "index_type"), action, value, disk, accepted, hash_type)
        out.append(made.orderBy("path") if "path" in made.columns else made)  # a join on the way loses the order
    return out
