"""Column functions on stored paths, hashes and scan facts. All stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_PATTERN = r"\A[0-9a-f]{64}\z"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parent_path(path: Column | str) -> Column:
    """Text before the last slash, else ''."""
    return F.regexp_extract(_col(path), r"(?s)\A(.*)/[^/]*\z", 1)


def entry_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def path_depth(path: Column | str) -> Column:
    """Number of components; the root '' has 0."""
    p = _col(path)
    return F.when(p == "", F.lit(0)).otherwise(F.size(F.split(p, "/"))).cast("long")


def ancestors(path: Column | str) -> Column:
    """Array of all proper ancestors below the root, nearest last; empty for top-level paths."""
    parts = F.split(_col(path), "/")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def object_path(digest: Column | str) -> Column:
    h = _col(digest)
    return F.concat(F.lit("objects/"), F.substring(h, 1, 2), F.lit("/"), h, F.lit(".zst"))


def shard_index(digest: Column | str) -> Column:
    """First byte of a hex digest as a number."""
    return F.conv(F.substring(_col(digest), 1, 2), 16, 10).cast("long")


def is_hash(digest: Column | str) -> Column:
    return F.coalesce(_col(digest).rlike(HASH_PATTERN), F.lit(False))


def is_safe_path(path: Column | str) -> Column:
    """Relative, without empty, '.' or '..' components."""
    p = _col(path)
    return (p != "") & F.forall(F.split(p, "/"), lambda c: ~c.isin("", ".", ".."))


def contains_path(outer: Column | str, inner: Column | str) -> Column:
    """inner is outer or lies below it, by whole components."""
    return (_col(inner) == _col(outer)) | F.startswith(_col(inner), F.concat(_col(outer), F.lit("/")))


def floor_seconds(ns: str) -> tuple[Column, Column]:
    """(seconds, nanoseconds 0 .. 999999999) of a column of epoch nanoseconds, floored below zero as well."""
    return F.expr(f"({ns} - pmod({ns}, 1000000000L)) div 1000000000L"), F.expr(f"pmod({ns}, 1000000000L)")


def glob_regex(pattern: str, ignore_case: bool = False) -> tuple[str, bool, bool]:
    """(anchored regex, matches whole paths, directories only) of one ignore rule.

    '*' and '?' stay within a component and '?' is one code point; everything else is literal. A trailing slash limits the
    rule to directories; a rule without a slash is held against names at any depth.
    """
    text = pattern.replace("\\", "/")
    only_dirs = text.endswith("/")
    text = text[:-1] if only_dirs else text  # one slash alone; a rule of nothing else is dropped by its readers
    special = set(r"\.[]{}()+^$|-&~#")
    body = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else f"\\{c}" if c in special else c for c in text)
    return ("(?i)" if ignore_case else "") + rf"\A{body}\z", "/" in text, only_dirs


def ignored(rules: list[str], path: Column | str, is_dir: Column, ignore_case: bool = False) -> Column:
    """Some rule matches the entry itself (not its ancestors)."""
    p = F.translate(_col(path), "\\", "/")
    out = F.lit(False)
    for rule in rules:
        if rule in ("/", "\\"):
            continue
        regex, whole, only_dirs = glob_regex(rule, ignore_case)
        hit = (p if whole else entry_name(p)).rlike(regex)
        out = out | (hit & is_dir if only_dirs else hit)
    return out


def scan_decision(hidden: Column, cloud: Column, mount: Column, reparse: Column, boundary: Column, link: Column, *, skip_hidden: bool = False, one_file_system: bool = False) -> Column:
    """What a scan does with an entry; the first that applies, in this order."""
    return (
        F.when(hidden & F.lit(skip_hidden), "skip").when(cloud, "warn:cloud_placeholder").when(mount, "warn:volume_mount_point")
        .when(reparse, "warn:unsupported_reparse_point").when(boundary & F.lit(one_file_system), "warn:filesystem_boundary").when(link, "capture_link").otherwise("capture")
    )


#: Types of entries in the order of their codes.
ENTRY_TYPES = ("file", "directory", "symlink")
STATUSES = ("pending", "complete", "failed", "cancelled", "deleting")

# fixed values: names that file systems go by
NETWORK = ["nfs", "nfs4", "smb", "smb2", "smb3", "smbfs", "cifs", "9p", "afs", "coda", "ncp", "ncpfs", "davfs", "davfs2", "drive_remote", "fuse.rclone", "fuse.s3fs", "fuse.gcsfuse"]
FAT = ["fat", "fat12", "fat16", "fat32", "vfat", "msdos", "msdosfs", "exfat"]
LOCAL = ["ext2", "ext3", "ext4", "xfs", "btrfs", "zfs", "apfs", "hfs", "hfsplus", "ufs", "ntfs", "refs", "tmpfs", "ramfs", "overlay", "aufs"]


def encode_enum(value: Column | str, values: tuple[str, ...]) -> Column:
    """The code of a name, null for an unknown one."""
    c = _col(value)
    return F.coalesce(*(F.when(c == v, F.lit(i)) for i, v in enumerate(values)))


def decode_enum(code: Column | str, values: tuple[str, ...]) -> Column:
    """The name of a code, null for an unknown one."""
    return F.get(F.array(*(F.lit(v) for v in values)), _col(code).cast("int"))


def narrowed(value: Column | str, least: int, most: int) -> Column:
    """The value if it lies within the bounds, else null: what a narrower type can't hold is never cut off."""
    c = _col(value)
    return F.when((c >= least) & (c <= most), c)


def is_utf8(data: Column | str) -> Column:
    """Whether a binary column is valid UTF-8; null stays null."""
    return F.is_valid_utf8(_col(data).cast("string"))


def filesystem_class(name: Column | str) -> Column:
    """network, fat, local or unknown, by the name of a file system in any case."""
    c = F.lower(_col(name))
    return F.when(c.isin(NETWORK) | F.contains(c, F.lit("sshfs")), "network").when(c.isin(FAT), "fat").when(c.isin(LOCAL), "local").otherwise("unknown")


def filesystem_policy(kind: Column | str, allow_risky: bool = False) -> Column:
    """allow, warn or refuse for a repository on a file system of a class."""
    c = _col(kind)
    return F.when(c == "network", F.lit("allow" if allow_risky else "refuse")).when(c == "fat", "warn").otherwise("allow")


def most_stored(chunk_size: int) -> int:
    """Bytes that a stored chunk may have at most: incompressible data grows a little."""
    return chunk_size + chunk_size // 8 + (64 << 10)
