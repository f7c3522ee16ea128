"""Command lines: find, fix, and the index of a directory tree.

    python -m siltstone find [STARTING-POINT...] [EXPRESSION]
    python -m siltstone fix INDEX header show|edit [FIELD VALUE]
    python -m siltstone fix INDEX entry show|edit|append|remove|resort [FIELD=VALUE...] [JSON] [PATH...]
    python -m siltstone fix INDEX fixes list|pop|discard|clear [VERSION]
    python -m siltstone init|update|status|dupes|stats|recover|snapshot|snapshots|forget [...]

INDEX is the name of a table (main, cache, scan-...); header also takes the path of a binary index file.
"""

from __future__ import annotations

import argparse
import itertools
import json
import os
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from .api import FileIndex, find_root
from .operators import report
from .plans.find import FindError
from .sources import binary

Print = Callable[[str], None]


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siltstone", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("-C", "--directory", default=".", help="where to look for the index")
    p.add_argument("-v", "--verbose", action="count", default=None, help="more detail; may be repeated")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("-n", "--dry-run", action="store_true", help="change nothing")
    p.add_argument("--format", choices=("human", "json", "fdupes"))
    p.add_argument("--set", action="append", default=[], metavar="KEY:VALUE", help="a setting, as default:sha1")
    p.add_argument("--fix", default="auto", choices=("auto", "none"), help="for recover")
    p.add_argument("--tag", action="append", default=[])
    p.add_argument("command")
    p.add_argument("rest", nargs=argparse.REMAINDER)
    return p


def show_entries(index: FileIndex, name: str, paths: list[str], form: str, quiet: bool, out: Print) -> None:
    rows, missing = index.show(paths, name)
    gone = sorted(r["path"] for r in missing.collect())  # at most the paths of the command line
    if form == "json":
        found = [json.loads(r["json"]) for r in report.entry_json(rows).orderBy("path").toLocalIterator()]
        out(json.dumps({"entries": found} | ({"not_found": gone} if gone and not quiet else {}), indent=2))
        return
    found = [r["text"] for r in report.entry_text(rows).orderBy("path").toLocalIterator()]
    if not quiet:
        out(f"Found {len(found)} entries:\n" if found else "No entries found.")
    for text in found:
        out(text + "\n")
    if gone and not quiet:
        out("Paths not found in index:\n" + "".join(f"  {p}\n" for p in gone))


def header(index: FileIndex, name: str, words: list[str], dry_run: bool, out: Print) -> None:
    path = name if "/" in name else os.path.join(index.home, f"{name.removesuffix('.idx')}.idx")
    with open(path, "rb") as f:
        data = f.read()
    if words[:1] == ["show"]:
        out(binary.header_json(binary.header(data)))
    elif words[:1] == ["edit"] and len(words) == 3:
        changes = json.loads(words[2]) if words[1] == "json" else {words[1]: words[2]}
        new = binary.edit_header(data, {k: str(v) for k, v in changes.items()})
        if dry_run:
            out(f"would edit {', '.join(changes)}")
            return
        with open(f"{path}.bak", "wb") as f:
            f.write(data)
        with open(f"{path}.new", "wb") as f:
            f.write(new)
        os.replace(f"{path}.new", path)
    else:
        raise ValueError("header show, or header edit FIELD VALUE")


def entry(index: FileIndex, name: str, words: list[str], args: argparse.Namespace, form: str, out: Print) -> None:
    what, rest = (words or [""])[0], words[1:]
    if what == "show":
        show_entries(index, name, rest, form, args.quiet, out)
    elif what == "edit":
        changes = dict(x.split("=", 1) for x in rest if "=" in x)
        index.edit(changes, [x for x in rest if "=" not in x], name, args.dry_run)
    elif what == "append":
        for row in rest:
            index.append(row, name, args.dry_run)
    elif what == "remove":
        index.remove(rest, name, args.dry_run)
    elif what == "resort":
        if not args.dry_run:
            index.resort(name)
    else:
        raise ValueError("entry show, edit, append, remove or resort")


def fixes(index: FileIndex, name: str, words: list[str], dry_run: bool, out: Print) -> None:
    what = (words or [""])[0]
    if what == "list":
        for v in index.fixes(name):
            out(f"{v['version']}  {v['operation']}  {v['description']}".rstrip())
    elif what == "pop":
        out(f"undone: {(index.fixes(name)[0] if dry_run else index.undo(name))['version']}")
    elif what == "discard" and len(words) == 2:
        if not dry_run:
            index.discard(words[1], name)
    elif what == "clear":
        if not dry_run:
            index.clear(name)
    else:
        raise ValueError("fixes list, pop, discard VERSION or clear")


def accept(index: FileIndex, tokens: list[str], ask: Callable[[str], str]) -> list[tuple[str, str]] | None:
    """The issues that the user agrees to, one question each, for --fix manual; None for other command lines."""
    if ("--fix", "manual") not in zip(tokens, tokens[1:]):
        return None
    starts = [t.removesuffix(".idx") for t in itertools.takewhile(lambda t: not t.startswith("--") and t not in ("!", "("), tokens)] or ["all"]
    names = [n for n in index.store.names() if "all" in starts or n in starts or "scan" in starts and n.startswith("scan-")]
    found = dict.fromkeys((r["path"], r["type"]) for n in names for r in index.issues(n).toLocalIterator())
    return [(path, kind) for path, kind in found if ask(f"fix {kind} of {path}? [y/N] ").strip().lower() in ("y", "yes")]


def run(spark: SparkSession, argv: list[str], out: Print = print, ask: Callable[[str], str] = input) -> int:
    """The exit status of a command line."""
    args = options().parse_args(argv)
    try:
        root = os.path.realpath(args.directory) if args.command == "init" else find_root(args.directory)
        index = FileIndex(spark, root)
        index.config = index.config.override(*args.set)
        form = args.format or index.config.output_format
        rest = args.rest
        match args.command:
            case "init":
                out(index.repository_id)
            case "find":
                for frame in index.find(rest, accepted=accept(index, rest, ask), dry_run=args.dry_run):
                    for r in frame.toLocalIterator():
                        out("\t".join(map(str, r)))
            case "fix" if len(rest) >= 2:
                name, what, words = rest[0], rest[1], rest[2:]
                if what == "header":
                    header(index, name, words, args.dry_run, out)
                elif what == "entry":
                    entry(index, name.removesuffix(".idx"), words, args, form, out)
                elif what == "fixes":
                    fixes(index, name.removesuffix(".idx"), words, args.dry_run, out)
                else:
                    raise ValueError("fix INDEX header, entry or fixes")
            case "update":
                if not args.dry_run:
                    index.update(rest or None)
            case "status":
                if form == "json":
                    out(json.dumps(index.status_report(args.verbose)))
                else:
                    for r in index.status().filter("status <> 'unchanged'").toLocalIterator():
                        out(f"{r['status']}\t{r['path']}")
                    if args.verbose or index.config.verbose_level:
                        out(json.dumps(index.status_report(args.verbose)))
            case "dupes":
                out(index.format_duplicates(form))
            case "stats":
                out("{} files, {} bytes".format(*index.stats()))
            case "recover":
                index.recover(fix=args.fix, how=rest[0] if rest else "auto")
                out(json.dumps(index.recovered))
            case "snapshot":
                out(index.snapshot(args.tag)["id"])
            case "snapshots":
                for m in index.snapshots():
                    out("\t".join([m["id"], *m["tags"]]))
            case "forget":
                for gone in index.forget({k: int(v) for k, v in (x.split("=") for x in rest)} if rest else None, args.dry_run):
                    out(gone)
            case _:
                raise ValueError(f"unknown command: {args.command!r}")
    except (FindError, ValueError, OSError) as e:
        print(f"siltstone: {e}", file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        spark.sparkContext.cancelAllJobs()  # versions are committed at the end, so what was there stays
        return 130
    return 0


def main() -> int:
    spark = SparkSession.builder.appName("siltstone").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return run(spark, sys.argv[1:])

