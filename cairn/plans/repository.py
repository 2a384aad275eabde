"""Snapshots of directory trees in Parquet: create, snapshot, verify, restore, delete, recover.

Layout: <root>/<table>/snapshot_id=N/*.parquet for entries, entry_chunks, snapshot_warnings, chunks and objects, and one
manifest _snapshots/N.json per snapshot. A snapshot exists once its manifest says `complete`; the manifest is written
beside its place, synced and renamed, so readers see it whole or not at all. Rows of other snapshots are never read.
The root lies on a POSIX file system that driver and executors share, and one process writes at a time.
"""

from __future__ import annotations

import fcntl
import json
import os
import shutil
import time
import uuid
import warnings
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain, groupby
from threading import Event, Thread

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.codecs import blake3, compress_frame, decompress_frame, join, subtrees
from cairn.functions.paths import is_safe_path, object_path
from cairn.operators import integrity
from cairn.operators.trees import plan_order, restore_actions, select_for_restore
from cairn.session import drop_stage, ship, stage
from cairn.sources.tree import TreeSource, scan, stable_chunks

MAX_CHUNK = 4 << 20
TABLES = {
    "entries": "relative_path string, parent_path string, name string, entry_type string, logical_size bigint, modified_time_ns bigint, change_time_ns bigint, posix_mode bigint, file_hash string, symlink_target string, device bigint, inode bigint, snapshot_id bigint",
    "entry_chunks": "relative_path string, sequence_number bigint, chunk_hash string, raw_offset bigint, raw_length bigint, snapshot_id bigint",
    "snapshot_warnings": "relative_path string, warning_code string, message string, snapshot_id bigint",
    "chunks": "hash string, raw_size bigint, compressed_size bigint, object_path string, snapshot_id bigint",
    "objects": "hash string, raw_size bigint, payload binary, snapshot_id bigint",
}
#: Tables that every repository has, and the version of their layout.
SCHEMA_VERSION = 1
#: Bytes of a file that one row of work reads (a power of two, so that the file's hash can be joined from its pieces), bytes of
#: files that are hashed together, and references that may be broadcast to find the owners of new chunks.
PIECE, TOGETHER, OWNERS = 16 << 20, 8 << 20, 200_000
POINTS = ("after_pending", "after_scan", "after_read", "after_objects", "after_metadata", "before_publish", "after_publish")


class RepositoryError(Exception):
    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


class Repository:
    def __init__(self, spark: SparkSession, root: str, *, read_only: bool = False, injector: Callable[[str], None] | None = None) -> None:
        self.spark, self.root, self.read_only = spark, os.path.realpath(root), read_only
        self.hit = injector or (lambda point: None)
        try:
            with open(self._at("repository_info.json")) as f:
                self.info = json.load(f)
        except OSError as e:
            raise RepositoryError("invalid_repository", str(e)) from e
        if self.info["format_version"] != 1 or not 0 < self.info["chunk_size_bytes"] <= MAX_CHUNK or self.info["hash_algorithm"] != "blake3":
            raise RepositoryError("invalid_repository", "unknown format, chunk size or hash")
        self._check_layout()
        ship(spark)
        if not read_only:  # a writer that finds the lock free mends what an interrupted one left
            try:
                with self._lock():
                    self.recover()
            except RepositoryError as e:
                if e.code != "repository_busy":
                    raise

    def _check_layout(self) -> None:
        """Range and type of every setting, the layout's version, and the folders that must be there."""
        known = {"zstd_level": (1, 22), "chunk_size_bytes": (1, MAX_CHUNK), "created_at_ns": (0, 2**63 - 1), "format_version": (1, 1)}
        for field, (least, most) in known.items():
            if not isinstance(self.info.get(field), int) or not least <= self.info[field] <= most:
                raise RepositoryError("invalid_repository", f"{field} is out of range")
        if self.info.get("path_encoding") != "utf-8" or len(str(self.info.get("repository_uuid", ""))) != 36:
            raise RepositoryError("invalid_repository", "unknown path encoding or no identifier")
        versions = [m["version"] for m in self.migrations()]
        if versions != list(range(1, SCHEMA_VERSION + 1)):
            raise RepositoryError("invalid_repository", f"layout versions {versions}")
        if missing := [n for n in ("_snapshots", *TABLES) if not os.path.isdir(self._at(n))]:
            raise RepositoryError("invalid_repository", f"missing {missing}")

    def migrations(self) -> list[dict]:
        """Steps that made the layout, by version."""
        try:
            with open(self._at("migrations.json")) as f:
                return sorted(json.load(f), key=lambda m: m["version"])
        except OSError as e:
            raise RepositoryError("invalid_repository", str(e)) from e

    @classmethod
    def create(cls, spark: SparkSession, root: str, *, chunk_size: int = MAX_CHUNK, level: int = 3) -> Repository:
        if not 0 < chunk_size <= MAX_CHUNK:
            raise RepositoryError("invalid_argument", "the chunk size must be within 4 MiB")
        if os.path.isdir(root) and os.listdir(root):
            raise RepositoryError("already_exists", "the folder isn't empty")
        new, root = not os.path.isdir(root), os.path.abspath(root)
        info = {"repository_uuid": str(uuid.uuid4()), "format_version": 1, "created_at_ns": time.time_ns(), "chunk_size_bytes": chunk_size, "zstd_level": level, "hash_algorithm": "blake3", "path_encoding": "utf-8"}
        try:
            for name in ("_snapshots", *TABLES):
                os.makedirs(os.path.join(root, name))
            _publish(os.path.join(root, "migrations.json"), [{"version": 1, "applied_at_ns": time.time_ns(), "description": "tables by snapshot"}])
            _publish(os.path.join(root, "repository_info.json"), info)  # last: a folder without it is no repository
        except OSError as e:
            shutil.rmtree(root, ignore_errors=True)
            if not new:
                os.makedirs(root, exist_ok=True)
            raise RepositoryError("io_error", str(e)) from e
        return cls(spark, root)

    def _at(self, *parts: str) -> str:
        return os.path.join(self.root, *parts)

    @contextmanager
    def _lock(self) -> Iterator[None]:
        if self.read_only:
            raise RepositoryError("read_only", "opened for reading")
        with open(self._at("lock"), "w") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError as e:
                raise RepositoryError("repository_busy", "another writer holds the lock") from e
            yield

    # manifests

    def manifests(self) -> list[dict]:
        out = []
        for name in os.listdir(self._at("_snapshots")):
            if name.endswith(".json"):
                with open(self._at("_snapshots", name)) as f:
                    out.append(json.load(f))
        return sorted(out, key=lambda m: m["id"])

    def list_snapshots(self) -> list[dict]:
        """Complete ones, the latest first."""
        return sorted((m for m in self.manifests() if m["status"] == "complete"), key=lambda m: (-m["created_at_ns"], -m["id"]))

    def _save(self, manifest: dict) -> None:
        _publish(self._at("_snapshots", f"{manifest['id']}.json"), manifest)

    def require_complete(self, snapshot: int) -> dict:
        found = next((m for m in self.manifests() if m["id"] == snapshot), None)
        if found is None or found["status"] != "complete":
            raise RepositoryError("snapshot_not_found", f"no complete snapshot {snapshot}")
        return found

    # tables

    def table(self, name: str, ids: list[int] | None = None) -> DataFrame:
        """Rows of the given snapshots, by default of all complete ones; other folders aren't opened."""
        ids = [m["id"] for m in self.manifests() if m["status"] == "complete"] if ids is None else ids
        paths = [p for i in ids if os.path.isdir(p := self._at(name, f"snapshot_id={i}"))]
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).option("basePath", self._at(name)).parquet(*paths)

    def _write(self, df: DataFrame, name: str, snapshot: int) -> DataFrame:
        columns = [c.split()[0] for c in TABLES[name].split(", ")][:-1]
        df.select(*columns).write.mode("overwrite").parquet(self._at(name, f"snapshot_id={snapshot}"))
        return self.table(name, [snapshot])

    def list_entries(self, snapshot: int) -> DataFrame:
        self.require_complete(snapshot)
        return self.table("entries", [snapshot]).orderBy("relative_path")

    def list_children(self, snapshot: int, path: str) -> DataFrame:
        self.require_complete(snapshot)
        return self.table("entries", [snapshot]).where((F.col("parent_path") == path) & (F.col("relative_path") != "")).orderBy("name", "relative_path")

    # snapshots

    def snapshot(self, source: str, message: str = "", *, progress: Callable[[dict], None] | None = None, cancel: Event | None = None, force_rehash: bool = False, **scan_options) -> dict:
        """Scan `source`, store what is new and publish; returns the manifest.

        `progress` is called on the driver after each step with its name and the seconds so far; what it raises before
        publishing fails the snapshot, afterwards it is only reported. `cancel`, once set, ends the snapshot at the next
        step as `cancelled`, and the jobs that run then are stopped. Files whose size, times, device and inode are those of
        the last complete snapshot of the same source aren't read again, unless `force_rehash` asks for it.
        """
        source = os.path.realpath(source)
        for a, b in ((source, self.root), (self.root, source)):
            if a == b or b.startswith(a.rstrip("/") + "/"):
                raise RepositoryError("invalid_argument", "source and repository must not contain each other")
        with self._lock():
            self.recover()
            began = time.time_ns()
            new_id = max((m["id"] for m in self.manifests()), default=0) + 1
            manifest = {"id": new_id, "created_at_ns": began, "source_root": source, "message": message, "status": "pending"}
            self._save(manifest)

            def step(point: str) -> None:
                self.hit(point)
                if cancel is not None and cancel.is_set():
                    raise RepositoryError("cancelled", point)
                if progress is not None:
                    progress({"snapshot": new_id, "step": point, "seconds": (time.time_ns() - began) / 1e9})

            try:
                step("after_pending")
                with _cancelling(self.spark, cancel):
                    manifest |= self._ingest(new_id, source, scan_options, step, force_rehash)
                step("before_publish")
                manifest |= {"status": "complete", "completed_at_ns": time.time_ns(), "duration_ms": (time.time_ns() - began) // 1_000_000}
                self._save(manifest)
            except Exception as e:
                stopped = cancel is not None and cancel.is_set()
                status = "cancelled" if stopped or isinstance(e, RepositoryError) and e.code == "cancelled" else "failed"
                self._save(manifest | {"status": status, "failure_message": str(e)[:500]})
                self._clean(new_id)
                if stopped and not isinstance(e, RepositoryError):
                    raise RepositoryError("cancelled", "a running job was stopped") from e
                raise
            self.hit("after_publish")
            if progress is not None:
                try:
                    progress({"snapshot": new_id, "step": "complete", "seconds": (time.time_ns() - began) / 1e9})
                except Exception as e:  # the snapshot is published and stays so
                    warnings.warn(f"progress callback: {e}", stacklevel=2)
            return manifest

    def _unchanged(self, found: DataFrame, source: str) -> tuple[DataFrame, int] | None:
        """Files (relative_path, file_hash) that are as the last complete snapshot of the source has them, and its id."""
        last = next((m for m in self.list_snapshots() if m["source_root"] == source), None)
        if last is None:
            return None
        same = ["relative_path", "logical_size", "modified_time_ns", "change_time_ns", "device", "inode"]
        old = self.table("entries", [last["id"]]).where("entry_type = 'file' and change_time_ns is not null").select(*same, "file_hash")
        return found.where("kind = 'entry' and entry_type = 'file'").select(*same).join(old, same).select("relative_path", "file_hash"), last["id"]

    def _ingest(self, new_id: int, source: str, scan_options: dict, step: Callable[[str], None], force_rehash: bool) -> dict:
        size, level = self.info["chunk_size_bytes"], self.info["zstd_level"]
        staged = self._at("staging", f"read-{new_id}")
        scan(self.spark, source, **scan_options).write.mode("overwrite").parquet(f"{staged}/scan")
        found = self.spark.read.parquet(f"{staged}/scan")
        step("after_scan")
        piece = PIECE if PIECE % size == 0 else None  # else files are read whole

        # one row per chunk, and one (sequence -1) per piece with its part of the file's hash; a changing file gives a warning
        cut_columns = ["relative_path", "sequence_number", "chunk_hash", "raw_offset", "raw_length", "data", "warning"]

        def hashed(held: list[tuple[str, int, int | None, list[bytes]]]) -> pd.DataFrame:
            chunks = blake3([p for _, _, _, parts in held for p in parts])
            single = [len(parts) < 2 and number in (None, 0) for _, number, _, parts in held]
            whole = iter(blake3([b"".join(parts) for (_, number, _, parts), one in zip(held, single, strict=True) if not one and number is None]))
            split = iter(subtrees([b"".join(parts) for _, number, _, parts in held if number is not None], [n for _, n, _, _ in held if n is not None], piece or 0))
            rows, at = [], 0
            for (path, number, offset, parts), one in zip(held, single, strict=True):
                own = chunks[at : at + len(parts)]
                at += len(parts)
                first = offset // size
                rows += [(path, first + i, h, offset + i * size, len(p), p, None) for i, (p, h) in enumerate(zip(parts, own, strict=True))]
                n = sum(map(len, parts))
                mark = next(split).hex() if number is not None else (own[0] if parts else blake3([b""])[0]) if one else next(whole)
                rows.append((path, -1, mark, offset, n, None, None))
            return pd.DataFrame(rows, columns=cut_columns)

        def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, bytes_held = [], 0
            for frame in frames:
                for path, number, *state in frame[["relative_path", "piece", "logical_size", "modified_time_ns", "change_time_ns", "device", "inode"]].itertuples(index=False):
                    number = None if number < 0 else int(number)
                    offset = (number or 0) * (piece or 0)
                    try:
                        full = os.path.join(source, path)
                        # pieces of one file are read in several tasks, which must all see the file that was scanned
                        parts = stable_chunks(full, size) if number is None else stable_chunks(full, size, 1, offset, piece, tuple(int(x) for x in state))
                        warning = "source_changed" if parts is None else None
                    except OSError:
                        parts, warning = None, "source_unavailable"
                    if parts is None:
                        yield pd.DataFrame([(path, -1, None, 0, 0, None, warning)], columns=cut_columns)
                        continue
                    held.append((path, number, offset, parts))
                    bytes_held += sum(map(len, parts))
                    if bytes_held >= TOGETHER or len(held) >= 2000:
                        yield hashed(held)
                        held, bytes_held = [], 0
            if held:
                yield hashed(held)

        files = found.where("kind = 'entry' and entry_type = 'file'")
        known_files = None if force_rehash else self._unchanged(found, source)
        if known_files is not None:
            files = files.join(known_files[0].select("relative_path"), "relative_path", "left_anti")
        pieces = F.when(F.col("logical_size") > (piece or 1 << 62), F.sequence(F.lit(0).cast("long"), F.expr(f"(logical_size - 1) div {piece or 1}"))).otherwise(F.array(F.lit(-1).cast("long")))
        work = files.select("relative_path", "logical_size", "modified_time_ns", "change_time_ns", "device", "inode", F.explode(pieces).alias("piece"))
        parts_wanted = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 2 * self.spark.sparkContext.defaultParallelism)
        schema = "relative_path string, sequence_number bigint, chunk_hash string, raw_offset bigint, raw_length bigint, data binary, warning string"
        work.repartition(parts_wanted, "relative_path", "piece").mapInPandas(cut, schema).write.mode("overwrite").parquet(f"{staged}/cut")
        read = self.spark.read.schema(schema).parquet(f"{staged}/cut")
        lost = read.where("warning is not null").groupBy("relative_path").agg(F.min("warning").alias("code"))
        good = read.join(lost.select("relative_path"), "relative_path", "left_anti") if not lost.isEmpty() else read
        refs = good.where("sequence_number >= 0")
        step("after_read")

        # hash first, compress only what no snapshot has; owners are chosen on narrow rows, so no chunk's data is shuffled where
        # the owners can be broadcast
        known = self.table("chunks").select(F.col("hash").alias("chunk_hash")).distinct()
        owner = refs.groupBy("chunk_hash").agg(F.min(F.struct("relative_path", "sequence_number")).alias("at")).join(known, "chunk_hash", "left_anti").select("at.relative_path", "at.sequence_number")
        owner.write.mode("overwrite").parquet(f"{staged}/owner")
        owner = self.spark.read.parquet(f"{staged}/owner")
        owner = F.broadcast(owner) if owner.count() <= OWNERS else owner
        fresh = refs.select("relative_path", "sequence_number", "chunk_hash", "raw_length", "data").join(owner, ["relative_path", "sequence_number"], "left_semi")

        def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame({"hash": f["chunk_hash"], "raw_size": f["raw_length"], "payload": [compress_frame(bytes(x), level) for x in f["data"]]})

        objects = self._write(fresh.mapInPandas(pack, "hash string, raw_size bigint, payload binary"), "objects", new_id)
        step("after_objects")
        chunks = self._write(objects.select("hash", "raw_size", F.octet_length("payload").cast("long").alias("compressed_size"), object_path("hash").alias("object_path")), "chunks", new_id)

        @F.pandas_udf("string")
        def join_pieces(values: pd.Series) -> pd.Series:
            return values.map(lambda v: v[0] if len(v) == 1 else join([bytes.fromhex(x) for x in v]))

        marks = good.where("sequence_number = -1").groupBy("relative_path").agg(F.array_sort(F.collect_list(F.struct("raw_offset", "chunk_hash"))).alias("p"), F.sum("raw_length").alias("read_size"))
        whole = marks.select("relative_path", join_pieces(F.transform("p", lambda x: x["chunk_hash"])).alias("file_hash"), "read_size")
        rows = refs.select("relative_path", "sequence_number", "chunk_hash", "raw_offset", "raw_length")
        if known_files is not None:
            kept, last = known_files
            whole = whole.unionByName(kept.withColumn("read_size", F.lit(None).cast("long")))
            rows = rows.unionByName(self.table("entry_chunks", [last]).drop("snapshot_id").join(kept.select("relative_path"), "relative_path", "left_semi"))
        joined = found.where("kind = 'entry'").join(whole, "relative_path", "left").where("entry_type <> 'file' or file_hash is not null")
        entries = self._write(joined.withColumn("logical_size", F.coalesce("read_size", "logical_size")), "entries", new_id)
        self._write(rows, "entry_chunks", new_id)
        lost = lost.select("relative_path", "code", F.lit("the file could not be read whole").alias("message"))
        self._write(found.where("kind = 'warning'").select("relative_path", "code", "message").unionByName(lost).withColumnRenamed("code", "warning_code"), "snapshot_warnings", new_id)
        step("after_metadata")
        count = lambda k: F.count(F.when(F.col("entry_type") == k, 1)).alias(f"{k}_count")
        out = entries.agg(count("file"), count("directory"), count("symlink"), F.coalesce(F.sum("logical_size"), F.lit(0)).alias("logical_size"), F.count(F.when((F.col("entry_type") == "file") & F.col("file_hash").isNull(), 1)).alias("unhashed")).first().asDict()
        if out.pop("unhashed"):
            raise RepositoryError("corrupt_data", "a file has no hash")
        new = chunks.agg(F.count("*").alias("n"), F.coalesce(F.sum("compressed_size"), F.lit(0)).alias("b")).first()
        shutil.rmtree(staged, ignore_errors=True)
        return out | {"new_chunk_count": new.n, "new_stored_size": new.b, "reused_chunk_count": self.table("entry_chunks", [new_id]).count() - new.n}

    def _clean(self, snapshot: int) -> None:
        for name in TABLES:
            shutil.rmtree(self._at(name, f"snapshot_id={snapshot}"), ignore_errors=True)
        shutil.rmtree(self._at("staging", f"read-{snapshot}"), ignore_errors=True)

    def recover(self) -> None:
        """Under the lock: unfinished snapshots become failed and lose their rows, deletions are finished, staging goes."""
        for m in self.manifests():
            if m["status"] == "deleting":
                self._finish_delete(m["id"])
            elif m["status"] != "complete":
                if m["status"] not in ("failed", "cancelled"):
                    self._save(m | {"status": "failed", "failure_message": "interrupted before it was published"})
                self._clean(m["id"])
        shutil.rmtree(self._at("staging"), ignore_errors=True)

    def forget(self, snapshot: int) -> None:
        """Remove the record of a snapshot that failed or was cancelled, and whatever it left."""
        with self._lock():
            found = next((m for m in self.manifests() if m["id"] == snapshot), None)
            if found is None or found["status"] not in ("failed", "cancelled"):
                raise RepositoryError("snapshot_not_found", f"no failed snapshot {snapshot}")
            self._clean(snapshot)
            os.unlink(self._at("_snapshots", f"{snapshot}.json"))

    def delete(self, snapshot: int, *, cancel: Event | None = None) -> None:
        """Delete a snapshot. Once marked it is gone for readers; cancelled or interrupted, the rest is done by the next writer."""
        with self._lock():
            self._save(self.require_complete(snapshot) | {"status": "deleting"})
            self.hit("after_deleting")
            if cancel is not None and cancel.is_set():
                raise RepositoryError("cancelled", f"snapshot {snapshot} will be deleted by the next writer")
            self._finish_delete(snapshot)

    def _finish_delete(self, snapshot: int) -> None:
        """Rows go; chunks and objects that other snapshots use move to the first of those."""
        keep = [m["id"] for m in self.manifests() if m["status"] == "complete"]
        used = self.table("entry_chunks", keep).select(F.col("chunk_hash").alias("hash")).distinct()
        for name in ("objects", "chunks"):
            if keep and os.path.isdir(self._at(name, f"snapshot_id={snapshot}")):
                have = self.table(name, [keep[0]]).select("hash")
                columns = [c.split()[0] for c in TABLES[name].split(", ")][:-1]
                moved = self.table(name, [snapshot]).join(used, "hash", "left_semi").join(have, "hash", "left_anti").select(*columns)
                moved.write.mode("append").parquet(self._at(name, f"snapshot_id={keep[0]}"))
                self.hit("after_move")  # moved again after an interruption, a chunk is found there and stays behind
        for name in TABLES:  # table by table: a batch that was deleted stays deleted
            shutil.rmtree(self._at(name, f"snapshot_id={snapshot}"), ignore_errors=True)
            self.hit("after_delete_batch")
        self._clean(snapshot)
        os.unlink(self._at("_snapshots", f"{snapshot}.json"))

    # reading

    def verify(self, full: bool = False) -> DataFrame:
        """(violation, n): relations and sizes; `full` also decodes and hashes every object."""
        refs, chunks = self.table("entry_chunks"), self.table("chunks")
        every = self.manifests()
        states = self.spark.createDataFrame([(m["id"], m["status"]) for m in every], "id bigint, status string")
        ids = [m["id"] for m in every]
        out = integrity.relationship_check(states, self.table("entries", ids), self.table("snapshot_warnings", ids), refs, chunks)
        sized = chunks.dropDuplicates(["hash"]).select("hash", "raw_size", F.col("compressed_size").alias("stored_size"))
        layouts = integrity.bad_layouts(self.table("entries").where("entry_type = 'file'"), refs, sized, self.info["chunk_size_bytes"], ["snapshot_id", "relative_path"])
        out = out.unionByName(layouts.agg(F.count("*").alias("n")).select(F.lit("bad chunk layout").alias("violation"), "n"))
        out = out.unionByName(integrity.orphans(chunks, ["hash"], self.table("objects"), ["hash"], "chunk without object"))
        if not full:
            return out

        def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # objects are hashed together: the cost of a hash is that of its steps, however many lanes they have
            for f in frames:
                bad, want, held, bytes_held = 0, [], [], 0
                for h, n, p in zip(f["hash"], f["raw_size"], f["payload"], strict=True):
                    try:
                        held.append(decompress_frame(bytes(p), int(n), MAX_CHUNK))
                    except Exception:  # any damage counts, whatever the decoder calls it
                        bad += 1
                        continue
                    want.append(h)
                    bytes_held += len(held[-1])
                    if bytes_held >= TOGETHER:
                        bad += sum(a != b for a, b in zip(blake3(held), want, strict=True))
                        want, held, bytes_held = [], [], 0
                bad += sum(a != b for a, b in zip(blake3(held), want, strict=True))
                yield pd.DataFrame({"n": [bad]})

        damaged = self.table("objects").select("hash", "raw_size", "payload").mapInPandas(check, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        return out.unionByName(damaged.select(F.lit("damaged object").alias("violation"), "n"))

    def _actions(self, entries: DataFrame, target: str, on_conflict: str | Callable[[str, str], str]) -> DataFrame:
        """Entries with their action: create, merge, replace or skip. Conflicts are settled here, before any write."""
        if not os.path.isdir(target):
            return entries.withColumn("action", F.lit("create"))
        self.spark.dataSource.register(TreeSource)
        there = self.spark.read.format("cairn_tree").option("path", target).load().where("relative_path <> ''").select("relative_path", F.coalesce("entry_type", F.lit("other")).alias("existing_type"))
        clash = entries.join(there, "relative_path").where("not (entry_type = 'directory' and existing_type = 'directory')").select("relative_path", "existing_type").orderBy("relative_path")
        if on_conflict == "fail":
            if first := clash.first():
                raise RepositoryError("conflict", first.relative_path)
        if callable(on_conflict):
            asked = [(r.relative_path, on_conflict(r.relative_path, r.existing_type)) for r in clash.toLocalIterator()]
            there = there.join(self.spark.createDataFrame(asked, "relative_path string, decision string"), "relative_path", "left")
            for path, decision in asked:
                if decision not in ("skip", "replace"):
                    raise RepositoryError("cancelled" if decision == "cancel" else "invalid_argument", path)
        else:
            there = there.withColumn("decision", F.lit(on_conflict))
        plan = restore_actions(entries, there, F.coalesce("decision", F.lit("skip"))).drop("decision")
        kept = plan.where("action = 'replace'").join(there.where("existing_type = 'directory'"), "relative_path", "left_semi").first()
        if kept:  # a tree is never replaced by a file or link
            raise RepositoryError("conflict", kept.relative_path)
        return plan

    def restore(self, snapshot: int, target: str, paths: list[str] | None = None, on_conflict: str | Callable[[str, str], str] = "fail", *, cancel: Event | None = None) -> dict:
        """Write the selection below `target`, every file verified.

        on_conflict is fail, skip or replace, or a function of a path and the type found there that returns skip, replace
        or cancel. A skipped directory skips all below it. Nothing is written before all conflicts are settled and all chunk
        layouts checked. `cancel`, once set, stops the job that runs; files already written stay, each whole.
        """
        with _cancelling(self.spark, cancel):
            return self._restore(snapshot, target, paths, on_conflict)

    def _restore(self, snapshot: int, target: str, paths: list[str] | None, on_conflict: str | Callable[[str, str], str]) -> dict:
        if not callable(on_conflict) and on_conflict not in ("fail", "skip", "replace"):
            raise RepositoryError("invalid_argument", on_conflict)
        self.require_complete(snapshot)
        target = os.path.realpath(target)
        if target == self.root or target.startswith(self.root + "/") or self.root.startswith(target + "/"):
            raise RepositoryError("invalid_argument", "target and repository must not contain each other")
        entries = self.table("entries", [snapshot])
        if entries.where((F.col("relative_path") != "") & ~is_safe_path("relative_path")).limit(1).count():
            raise RepositoryError("corrupt_data", "an unsafe path is stored")
        if paths:
            asked = self.spark.createDataFrame([(snapshot, p) for p in paths], "snapshot_id bigint, relative_path string")
            missing = asked.join(entries, ["snapshot_id", "relative_path"], "left_anti").first()
            if missing:
                raise RepositoryError("not_found", missing.relative_path)
            entries = select_for_restore(entries, asked)
        plan = stage(self._actions(entries, target, on_conflict), "restore")
        skipped = plan.where("action = 'skip' and entry_type = 'file'").count()
        entries = plan.where("action <> 'skip'")
        folders = plan_order(entries.where("entry_type = 'directory'")).collect()
        for d in folders:
            full = os.path.join(target, d.relative_path)
            if os.path.lexists(full) and (os.path.islink(full) or not os.path.isdir(full)):
                if d.action != "replace":
                    raise RepositoryError("conflict", d.relative_path)
                os.unlink(full)
            os.makedirs(full, exist_ok=True)
        files = entries.where("entry_type = 'file'").select("relative_path", "file_hash", "logical_size", "modified_time_ns", "posix_mode", "action")
        refs = self.table("entry_chunks", [snapshot]).join(files.select("relative_path"), "relative_path", "left_semi")
        # only what is needed of the objects is read on, and each object once
        needed = refs.select(F.col("chunk_hash").alias("hash")).distinct()
        held = self.table("objects").join(needed, "hash", "left_semi")
        stored = held.select("hash", "raw_size", F.octet_length("payload").cast("long").alias("stored_size")).groupBy("hash").agg(F.max("raw_size").alias("raw_size"), F.max("stored_size").alias("stored_size"))
        fault = integrity.bad_layouts(files, refs, stored, self.info["chunk_size_bytes"], ["relative_path"]).first()
        if fault:
            raise RepositoryError("corrupt_data", f"{fault.relative_path}: {fault.fault}")
        home = held.select("hash", "snapshot_id").groupBy("hash").agg(F.min("snapshot_id").alias("snapshot_id"))
        held = held.join(home, ["hash", "snapshot_id"], "left_semi").select(F.col("hash").alias("chunk_hash"), "payload")
        parts = refs.join(held, "chunk_hash", "left")
        work = files.join(parts.select("relative_path", "sequence_number", "raw_length", "payload"), "relative_path", "left")

        def place(path: str, first, temporary: str | None, data: bytes | None) -> None:
            """Put a verified file in its place: `data`, or what `temporary` holds."""
            full = os.path.join(target, path)
            temporary = temporary or f"{full}.{uuid.uuid4().hex}"
            try:
                if data is not None:
                    with open(temporary, "xb") as f:
                        f.write(data)
                        f.flush()
                        os.fsync(f.fileno())
                os.chmod(temporary, int(first.posix_mode))
                os.utime(temporary, ns=(int(first.modified_time_ns),) * 2)
                os.replace(temporary, full)
            except OSError:
                if os.path.lexists(temporary):
                    os.unlink(temporary)
                raise

        def clear(path: str, first) -> None:
            full = os.path.join(target, path)
            if os.path.lexists(full) and first.action != "replace":
                # an earlier attempt of this task may have written it; anything else came after the plan
                if os.path.islink(full) or not os.path.isfile(full) or os.path.getsize(full) != first.logical_size or _file_hash(full) != first.file_hash:
                    raise RepositoryError("conflict", path)

        def small(held: list[tuple[object, bytes]]) -> pd.DataFrame:
            """Verify files that fit in memory together, then write them."""
            for (first, data), digest in zip(held, blake3([data for _, data in held]), strict=True):
                if len(data) != first.logical_size or digest != first.file_hash:
                    raise RepositoryError("corrupt_data", first.relative_path)
                clear(first.relative_path, first)
                place(first.relative_path, first, None, data)
            return pd.DataFrame({"restored": [len(held)]})

        def large(first, rows: Iterator) -> None:
            """Write a file chunk by chunk beside its place, folding its hash piece by piece; it appears only if it is right."""
            clear(first.relative_path, first)
            temporary, marks, held, size = f"{os.path.join(target, first.relative_path)}.{uuid.uuid4().hex}", [], b"", 0
            try:
                with open(temporary, "xb") as f:
                    for row in rows:
                        held += _chunk(row)
                        while len(held) > PIECE:
                            marks += subtrees([held[:PIECE]], [len(marks)], PIECE)
                            f.write(held[:PIECE])
                            size, held = size + PIECE, held[PIECE:]
                    digest = join([*marks, *subtrees([held], [len(marks)], PIECE)]) if marks else blake3([held])[0]
                    f.write(held)
                    size += len(held)
                    f.flush()
                    os.fsync(f.fileno())
                if size != first.logical_size or digest != first.file_hash:
                    raise RepositoryError("corrupt_data", first.relative_path)
                place(first.relative_path, first, temporary, None)
            finally:
                if os.path.lexists(temporary):
                    os.unlink(temporary)

        def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # a partition's rows come by file and number
            rows = (row for frame in frames for row in frame.itertuples(index=False))
            held, bytes_held = [], 0
            for _, own in groupby(rows, key=lambda r: r.relative_path):
                first = next(own)
                if first.logical_size > PIECE:
                    large(first, chain([first], own))
                    yield pd.DataFrame({"restored": [1]})
                    continue
                data = b"".join(_chunk(r) for r in chain([first], own)) if first.logical_size else b""
                held.append((first, data))
                bytes_held += len(data)
                if bytes_held >= TOGETHER or len(held) >= 1000:
                    yield small(held)
                    held, bytes_held = [], 0
            if held:
                yield small(held)

        dealt = work.repartition("relative_path").sortWithinPartitions("relative_path", "sequence_number")
        restored = dealt.mapInPandas(write, "restored bigint").agg(F.coalesce(F.sum("restored"), F.lit(0))).first()[0]
        links = entries.where("entry_type = 'symlink'").select("relative_path", "symlink_target", "action").toLocalIterator()
        n_links = 0
        for link in links:
            full = os.path.join(target, link.relative_path)
            if os.path.lexists(full):
                if link.action != "replace" or os.path.isdir(full) and not os.path.islink(full):
                    raise RepositoryError("conflict", link.relative_path)
                os.unlink(full)
            os.symlink(link.symlink_target, full)
            n_links += 1
        unset = []
        for d in reversed(folders):
            try:
                os.chmod(os.path.join(target, d.relative_path), d.posix_mode)
                os.utime(os.path.join(target, d.relative_path), ns=(d.modified_time_ns,) * 2)
            except OSError as e:  # the content stands; what a directory is like is only reported
                unset.append(f"{d.relative_path}: {e}")
        drop_stage(plan)
        for line in unset:
            warnings.warn(f"directory metadata: {line}", stacklevel=3)
        return {"restored": restored, "skipped": skipped, "directories": len(folders), "symlinks": n_links}

    # what a repository holds

    def diff(self, old: int, new: int) -> DataFrame:
        """(relative_path, change) between two complete snapshots."""
        for i in (old, new):
            self.require_complete(i)
        side = lambda i, c: F.max(F.when(F.col("snapshot_id") == i, F.col(c)))
        both = self.table("entries", [old, new]).withColumn("state", F.coalesce("file_hash", "symlink_target", F.lit("")))
        rows = both.groupBy("relative_path").agg(side(old, "entry_type").alias("t0"), side(new, "entry_type").alias("t1"), side(old, "state").alias("s0"), side(new, "state").alias("s1"))
        change = F.when(F.col("t0").isNull(), "added").when(F.col("t1").isNull(), "removed").when(F.col("t0") != F.col("t1"), "type_changed").when(F.col("s0") != F.col("s1"), "modified")
        return rows.select("relative_path", change.alias("change")).where("change is not null")

    def garbage(self) -> DataFrame:
        """Chunks that no complete snapshot refers to."""
        return self.table("chunks").join(self.table("entry_chunks").select(F.col("chunk_hash").alias("hash")).distinct(), "hash", "left_anti")

    def statistics(self) -> dict:
        """Sizes and savings: deduplication 1 - unique/logical, compression 1 - stored/unique, total 1 - stored/logical."""
        logical = self.table("entry_chunks").agg(F.coalesce(F.sum("raw_length"), F.lit(0))).first()[0]
        unique, stored = self.table("chunks").dropDuplicates(["hash"]).agg(F.coalesce(F.sum("raw_size"), F.lit(0)), F.coalesce(F.sum("compressed_size"), F.lit(0))).first()
        part = lambda a, b: 1 - a / b if b else 0.0
        return {"logical_size": logical, "unique_size": unique, "stored_size": stored, "deduplication": part(unique, logical), "compression": part(stored, unique), "total": part(stored, logical)}


def _chunk(row) -> bytes:
    """The content of a row's chunk; its layout has been checked, but the object may be missing."""
    if row.payload is None:
        raise RepositoryError("corrupt_data", row.relative_path)
    return decompress_frame(bytes(row.payload), int(row.raw_length), MAX_CHUNK)


def _file_hash(path: str) -> str:
    marks = []
    with open(path, "rb") as f:
        held = f.read(PIECE)
        while more := f.read(PIECE):
            marks += subtrees([held], [len(marks)], PIECE)
            held = more
    return join([*marks, *subtrees([held], [len(marks)], PIECE)]) if marks else blake3([held])[0]


@contextmanager
def _cancelling(spark: SparkSession, cancel: Event | None) -> Iterator[None]:
    """Stops the jobs started inside once `cancel` is set, and says so."""
    if cancel is None:
        yield
        return
    sc, tag, done = spark.sparkContext, f"cairn-{uuid.uuid4().hex}", Event()

    def watch() -> None:
        while not done.wait(0.1):
            if cancel.is_set():
                sc.cancelJobsWithTag(tag)

    watcher = Thread(target=watch, daemon=True)
    sc.addJobTag(tag)
    watcher.start()
    try:
        yield
    except Exception as e:
        if cancel.is_set() and not isinstance(e, RepositoryError):
            raise RepositoryError("cancelled", "a running job was stopped") from e
        raise
    finally:
        done.set()
        watcher.join()
        sc.removeJobTag(tag)


def _publish(path: str, content: dict | list) -> None:
    """Write beside, sync, rename, sync the folder."""
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "x") as f:
        json.dump(content, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)
    folder = os.open(os.path.dirname(path), os.O_RDONLY)
    os.fsync(folder)
    os.close(folder)
