"""Deterministic trees of files to measure snapshots on: many small files, or a few large ones.

The shapes (sizes, kinds, directories, variants) are fixed values of the workload; contents depend on the seed alone. Files
are written by tasks, each a run of indices.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from cairn.session import ship

SIZES = (0, 16, 64, 256, 1024, 4096, 8192, 16 * 1024)
KINDS = ("txt", "json", "cpp", "bin")
VARIANTS, WIDE, BRANCHES, DEEP = 32, 64, 16, 8
BLOCK = 1 << 20
_FILL = {"txt": (b"a small text\n", b"deterministic text line\n", b""), "json": (b'{"data":"', b"json-data-", b'"}'), "cpp": (b"// a small source\n", b"int value = 42;\n", b"")}


def small_file(index: int, seed: int) -> tuple[str, bytes]:
    """(relative path, content) of a small file: kinds and sizes alternate, and variants of random bytes recur."""
    kind, size = KINDS[index % 4], SIZES[index // 4 % 8]
    folders = [f"wide-{index % WIDE:02d}", f"branch-{index // WIDE % BRANCHES:02d}", *(f"deep-{k}" for k in range(index // (WIDE * BRANCHES) % DEEP + 1)), kind]
    if kind == "bin":
        body = hashlib.shake_256(f"{seed}:{index // 32 % VARIANTS}:{size}".encode()).digest(size)
    else:
        head, fill, tail = _FILL[kind]
        inner = max(size - len(head) - len(tail), 0)
        body = (head + fill * (inner // len(fill) + 1))[: size - len(tail)] + tail if size >= len(head) + len(tail) else (head + tail)[:size].ljust(size, b" ")
    return "/".join([*folders, f"file-{index:05d}.{kind}"]), body


def _write_small(root: str, seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: set[str] = set()
        for frame in frames:
            total = 0
            for i in frame["id"]:
                path, body = small_file(int(i), seed)
                full = os.path.join(root, path)
                if (folder := os.path.dirname(full)) not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                with open(full, "wb") as f:
                    f.write(body)
                total += len(body)
            yield pd.DataFrame({"files": [len(frame)], "bytes": [total]})

    return run


def _write_blocks(root: str, seed: int, size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            total = 0
            for file, block in zip(frame["file"], frame["block"], strict=True):
                body = hashlib.shake_256(f"{seed}:{file}:{block}".encode()).digest(min(BLOCK, size - int(block) * BLOCK))
                fd = os.open(os.path.join(root, f"large-{file:03d}.bin"), os.O_WRONLY | os.O_CREAT, 0o644)
                with os.fdopen(fd, "wb") as f:
                    f.seek(int(block) * BLOCK)
                    f.write(body)
                total += len(body)
            yield pd.DataFrame({"files": [0], "bytes": [total]})

    return run


def many_small(spark: SparkSession, root: str, files: int = 50_000, seed: int = 12345) -> dict:
    """Write the small files below `root`; {files, bytes}."""
    ship(spark)
    return _sums(spark.range(0, files, 1, 32).mapInPandas(_write_small(root, seed), "files bigint, bytes bigint"))


def large_files(spark: SparkSession, root: str, size: int = 2 << 30, seed: int = 12345, files: int = 4) -> dict:
    """Write `files` large files of equal size, `size` bytes in all, block by block; {files, bytes}."""
    ship(spark)
    os.makedirs(root, exist_ok=True)
    each = size // files
    blocks = spark.range(0, files * -(-each // BLOCK), 1, 64).selectExpr(f"id % {files} as file", f"id div {files} as block")
    return _sums(blocks.mapInPandas(_write_blocks(root, seed, each), "files bigint, bytes bigint")) | {"files": files}


def _sums(done: DataFrame) -> dict:
    return done.groupBy().sum().toDF("files", "bytes").first().asDict()
