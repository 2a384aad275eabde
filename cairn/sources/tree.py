"""A directory tree as a data source: one partition per subtree, never following links, pruned while walking."""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairn.functions.paths import glob_regex
from cairn.session import ship

IGNORE_FILE = ".cairnignore"
#: Partitions that a scan aims at.
SPLIT = 64
SCHEMA = (
    "kind string, relative_path string, parent_path string, name string, entry_type string, logical_size bigint, modified_time_ns bigint, "
    "change_time_ns bigint, posix_mode bigint, symlink_target string, device bigint, inode bigint, code string, message string"
)


def read_rules(root: str, explicit: str | None = None) -> list[str]:
    """Lines of an ignore file without comments and blanks; an explicit file replaces the tree's own and must exist."""
    path = explicit or os.path.join(root, IGNORE_FILE)
    if not explicit and not os.path.exists(path):
        return []
    with open(path, encoding="utf-8", newline="\n") as f:
        lines = [x.rstrip("\n").removesuffix("\r") for x in f]
    return [x for x in lines if x and not x.startswith("#")]


class Rules:
    def __init__(self, rules: list[str], ignore_case: bool = False) -> None:
        flags = re.IGNORECASE | re.ASCII if ignore_case else 0
        self.rules = [(re.compile(rx[2:-2], flags), whole, dirs) for rx, whole, dirs in (glob_regex(r) for r in rules if r not in ("/", "\\"))]

    def match(self, path: str, is_dir: bool) -> bool:
        p = path.replace("\\", "/")
        return any((is_dir or not dirs) and rx.fullmatch(p if whole else p.rpartition("/")[2]) for rx, whole, dirs in self.rules)


def entry(path: str, full: str) -> tuple:
    """An entry or warning row for one path, from lstat alone."""
    parent, _, name = path.rpartition("/")

    def warn(code: str, message: str) -> tuple:
        return ("warning", path, parent, name, *[None] * 8, code, message)

    try:
        path.encode("utf-8")
    except UnicodeEncodeError:
        shown = path.encode("utf-8", "replace").decode()
        return ("warning", shown, shown.rpartition("/")[0], shown.rpartition("/")[2], *[None] * 8, "unsupported_path_encoding", "not UTF-8")
    try:
        s = os.lstat(full)
    except OSError as e:
        return warn("metadata_unavailable", str(e))
    kind = "directory" if stat.S_ISDIR(s.st_mode) else "symlink" if stat.S_ISLNK(s.st_mode) else "file" if stat.S_ISREG(s.st_mode) else None
    if kind is None:
        return warn("unsupported_file_type", "neither file, directory nor link")
    target = None
    if kind == "symlink":
        try:
            target = os.readlink(full)
        except OSError as e:
            return warn("symlink_target_unavailable", str(e))
    return ("entry", path, parent, name, kind, s.st_size if kind == "file" else 0, s.st_mtime_ns, s.st_ctime_ns, stat.S_IMODE(s.st_mode), target, s.st_dev, s.st_ino, None, None)


class Walk:
    def __init__(self, root: str, rules: list[str], ignore_case: bool, skip_hidden: bool, one_file_system: bool) -> None:
        self.root, self.rules, self.skip_hidden = root, Rules(rules, ignore_case), skip_hidden
        self.device = os.lstat(root).st_dev if one_file_system else None

    def children(self, path: str) -> Iterator[tuple]:
        """Rows of what stands directly in a directory; ignored and skipped entries don't appear."""
        full = os.path.join(self.root, path) if path else self.root
        try:
            names = sorted(os.listdir(full))
        except OSError as e:
            yield ("warning", path, path.rpartition("/")[0], path.rpartition("/")[2], *[None] * 8, "directory_enumeration_failed", str(e))
            return
        for name in names:
            below = f"{path}/{name}" if path else name
            row = entry(below, os.path.join(full, name))
            if self.rules.match(below, row[4] == "directory") or self.skip_hidden and name.startswith("."):
                continue
            if self.device is not None and row[0] == "entry" and row[10] != self.device:
                yield ("warning", below, path, name, *[None] * 8, "filesystem_boundary", "another file system")
                continue
            yield row

    def below(self, path: str) -> Iterator[tuple]:
        """Depth first, iteratively: trees may be deeper than the stack."""
        stack = [self.children(path)]
        while stack:
            row = next(stack[-1], None)
            if row is None:
                stack.pop()
                continue
            yield row
            if row[4] == "directory":
                stack.append(self.children(row[1]))


class Subtree(InputPartition):
    """What stands directly in a directory (None: the root, with itself), or all below it."""

    def __init__(self, path: str | None, whole: bool) -> None:
        self.path, self.whole = path, whole


class TreeReader(DataSourceReader):
    def __init__(self, o: dict[str, str]) -> None:
        flag = lambda k: o.get(k, "false") == "true"
        self.args = (os.path.abspath(o["path"]), o["rules"].split("\n") if o.get("rules") else [], flag("ignorecase"), flag("skiphidden"), flag("onefilesystem"))
        if not stat.S_ISDIR(os.lstat(self.args[0]).st_mode):
            raise ValueError("the root of a scan must be a directory and no link")

    def partitions(self) -> list[Subtree]:
        """The root with its direct children; and level by level, until there are SPLIT, directories with their direct children,
        the inside of the last level's whole."""
        walk, flat, level = Walk(*self.args), [None], [r[1] for r in Walk(*self.args).children("") if r[4] == "directory"]
        while level and len(flat) + len(level) < SPLIT:
            inner = [r[1] for d in level for r in walk.children(d) if r[4] == "directory"]
            if len(inner) > 8 * SPLIT:
                break
            flat += level
            level = inner
        return [*(Subtree(d, False) for d in flat), *(Subtree(d, True) for d in level)]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        walk = Walk(*self.args)
        if partition.path is None:
            root = entry("", walk.root)
            yield (root[0], "", "", "", *root[4:])
            yield from walk.children("")
        elif partition.whole:
            yield from walk.below(partition.path)
        else:
            yield from walk.children(partition.path)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cairn_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def scan(spark: SparkSession, root: str, ignore_file: str | None = None, *, ignore_case: bool = False, skip_hidden: bool = False, one_file_system: bool = False) -> DataFrame:
    """Entry and warning rows of a tree on a file system that driver and executors share."""
    ship(spark)
    spark.dataSource.register(TreeSource)
    o = {"path": root, "rules": "\n".join(read_rules(root, ignore_file)), "ignorecase": ignore_case, "skiphidden": skip_hidden, "onefilesystem": one_file_system}
    return spark.read.format("cairn_tree").options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in o.items()}).load()


def identity(s: os.stat_result) -> tuple[int, ...]:
    return s.st_size, s.st_mtime_ns, s.st_ctime_ns, s.st_dev, s.st_ino


def stable_chunks(path: str, size: int, attempts: int = 2, offset: int = 0, most: int | None = None, state: tuple[int, ...] | None = None) -> list[bytes] | None:
    """The chunks of a file, or of `most` bytes of it from `offset`, if it is the same before and after the read (and as in
    `state`); None after so many attempts."""
    for _ in range(attempts):
        before = os.lstat(path)
        fd = os.open(path, os.O_RDONLY | os.O_NOFOLLOW)
        with os.fdopen(fd, "rb") as f:
            f.seek(offset)
            parts, left = [], most
            while left != 0 and (part := f.read(size if left is None else min(size, left))):
                parts.append(part)
                left = left if left is None else left - len(part)
        if identity(before) == identity(os.lstat(path)) and state in (None, identity(before)):
            return parts
    return None
