import os
import uuid
from pathlib import Path

import pytest

from cairn.plans.repository import Repository, RepositoryError


def tree(root: Path) -> dict:
    out = {}
    for base, dirs, files in os.walk(root):
        for n in dirs + files:
            p = Path(base, n)
            out[str(p.relative_to(root))] = os.readlink(p) if p.is_symlink() else p.read_bytes() if p.is_file() else None
    return out


@pytest.fixture
def source(tmp_path):
    s = tmp_path / "source"
    (s / "sub/deep").mkdir(parents=True)
    (s / "empty").mkdir()
    (s / "a.txt").write_bytes(b"hello world" * 3)
    (s / ".hidden").write_bytes(b"x")
    (s / "sub/none").write_bytes(b"")
    (s / "sub/deep/é b.bin").write_bytes(bytes(range(256)))
    (s / "copy.txt").write_bytes(b"hello world" * 3)
    os.symlink("nowhere", s / "broken")
    os.mkfifo(s / "pipe")
    return s


def test_snapshot_restore_and_dedup(spark, tmp_path, source):
    r = Repository.create(spark, str(tmp_path / "repo"), chunk_size=16)
    one = r.snapshot(str(source))
    assert (one["file_count"], one["directory_count"], one["symlink_count"]) == (5, 4, 1)
    assert [(w.relative_path, w.warning_code) for w in r.table("snapshot_warnings").collect()] == [("pipe", "unsupported_file_type")]
    n_refs = r.table("entry_chunks").count()
    assert one["new_chunk_count"] + one["reused_chunk_count"] == n_refs and one["reused_chunk_count"] >= 3
    two = r.snapshot(str(source))
    assert two["new_chunk_count"] == 0
    (source / "a.txt").write_bytes(b"hello world" * 3 + b"!")
    three = r.snapshot(str(source))
    assert three["new_chunk_count"] == 1
    assert {(x.relative_path, x.change) for x in r.diff(1, 3).collect()} == {("a.txt", "modified")}
    assert all(x.n == 0 for x in r.verify(full=True).collect())
    os.unlink(source / "pipe")
    out = tmp_path / "out"
    assert r.restore(3, str(out))["restored"] == 5
    assert tree(out) == tree(source)
    with pytest.raises(Exception, match="conflict"):
        r.restore(3, str(out))
    assert r.restore(3, str(out), on_conflict="skip")["skipped"] == 5
    r.restore(3, str(tmp_path / "part"), paths=["sub/deep"])
    assert set(tree(tmp_path / "part")) == {"sub", "sub/deep", "sub/deep/é b.bin"}
    r.delete(1)
    assert [m["id"] for m in r.list_snapshots()] == [3, 2]
    r.restore(2, str(tmp_path / "again"))
    assert (tmp_path / "again/a.txt").read_bytes() == b"hello world" * 3
    assert r.statistics()["deduplication"] > 0 and r.garbage().count() == 0


@pytest.mark.parametrize("point", ["after_pending", "after_read", "after_objects", "before_publish"])
def test_failed_snapshots_leave_the_old_one(spark, tmp_path, source, point):
    root = str(tmp_path / "repo")
    Repository.create(spark, root, chunk_size=64).snapshot(str(source))

    def fail(p):
        if p == point:
            raise RuntimeError("injected")

    (source / "new").write_bytes(b"new")
    with pytest.raises(RuntimeError):
        Repository(spark, root, injector=fail).snapshot(str(source))
    r = Repository(spark, root)
    assert [m["status"] for m in r.manifests()] == ["complete", "failed"]
    assert r.table("entries").where("relative_path = 'new'").count() == 0
    assert r.snapshot(str(source))["new_chunk_count"] == 1


def test_progress_and_cancellation(spark, tmp_path, source):
    from threading import Event

    r, seen, stop = Repository.create(spark, str(tmp_path / "repo"), chunk_size=64), [], Event()
    r.snapshot(str(source), progress=lambda e: seen.append(e["step"]))
    assert seen == ["after_pending", "after_scan", "after_read", "after_objects", "after_metadata", "before_publish", "complete"]
    stop.set()
    with pytest.raises(RepositoryError, match="cancelled"):
        r.snapshot(str(source), cancel=stop)
    assert [m["status"] for m in r.manifests()] == ["complete", "cancelled"] and r.table("entries", [2]).count() == 0


def test_conflicts_are_settled_before_writing(spark, tmp_path, source):
    r, out = Repository.create(spark, str(tmp_path / "repo"), chunk_size=64), tmp_path / "out"
    r.snapshot(str(source))
    out.mkdir()
    (out / "a.txt").write_bytes(b"mine")
    (out / "copy.txt").write_bytes(b"mine")
    (out / "sub").write_bytes(b"a file where a directory goes")
    with pytest.raises(RepositoryError, match="conflict"):
        r.restore(1, str(out))
    assert set(tree(out)) == {"a.txt", "copy.txt", "sub"}
    asked = []

    def resolve(path, found):
        asked.append((path, found))
        return "replace" if path == "a.txt" else "skip"

    done = r.restore(1, str(out), on_conflict=resolve)
    assert asked == [("a.txt", "file"), ("copy.txt", "file"), ("sub", "file")]
    assert (done["restored"], done["skipped"]) == (2, 3)
    assert (out / "a.txt").read_bytes() == b"hello world" * 3 and (out / "copy.txt").read_bytes() == b"mine" and (out / "sub").is_file()
    with pytest.raises(RepositoryError, match="cancelled"):
        r.restore(1, str(out), on_conflict=lambda path, found: "cancel")
    assert r.restore(1, str(out), on_conflict="replace")["restored"] == 5
    assert (out / "sub/deep/é b.bin").read_bytes() == bytes(range(256))


def test_guards(spark, tmp_path, source):
    r = Repository.create(spark, str(tmp_path / "repo"))
    with pytest.raises(RepositoryError, match="invalid_argument"):
        r.snapshot(str(tmp_path))
    with r._lock(), pytest.raises(RepositoryError, match="repository_busy"):
        r.snapshot(str(source))
    with pytest.raises(RepositoryError, match="read_only"):
        Repository(spark, str(tmp_path / "repo"), read_only=True).snapshot(str(source))
    with pytest.raises(RepositoryError, match="snapshot_not_found"):
        r.list_entries(1)


def test_large_files_are_read_in_pieces(spark, tmp_path, monkeypatch):
    from cairn.functions.codecs import blake3
    from cairn.plans import repository

    monkeypatch.setattr(repository, "PIECE", 1 << 12)
    src = tmp_path / "s"
    src.mkdir()
    sizes = [0, 1, 1024, 4095, 4096, 4097, 8192, 12_289, 40_000]
    for n in sizes:
        (src / f"f{n}").write_bytes(bytes((i * 7 + i // 251) % 256 for i in range(n)))
    for size in (1024, 2048, 700):  # the last doesn't divide a piece, so files are read whole
        r = Repository.create(spark, str(tmp_path / f"r{size}"), chunk_size=size)
        r.snapshot(str(src))
        found = {e.relative_path: (e.logical_size, e.file_hash) for e in r.table("entries").where("entry_type = 'file'").collect()}
        assert found == {f"f{n}": (n, blake3([(src / f"f{n}").read_bytes()])[0]) for n in sizes}
        assert all(x.n == 0 for x in r.verify(full=True).collect())
        r.restore(1, str(tmp_path / f"o{size}"))
        assert tree(tmp_path / f"o{size}") == tree(src)


def test_unchanged_files_are_not_read_again(spark, tmp_path, source):
    r = Repository.create(spark, str(tmp_path / "repo"), chunk_size=16)
    r.snapshot(str(source))
    before = (source / "a.txt").stat()
    seen = []
    spy = lambda e: e["step"] == "after_read" and seen.append(spark.read.parquet(str(tmp_path / f"repo/staging/read-{e['snapshot']}/cut")).where("sequence_number = -1").count())
    two = r.snapshot(str(source), progress=spy)
    assert seen == [0] and two["new_chunk_count"] == 0 and two["reused_chunk_count"] == r.table("entry_chunks", [1]).count()
    (source / "a.txt").write_bytes(b"HELLO WORLD" * 3)
    os.utime(source / "a.txt", ns=(before.st_atime_ns, before.st_mtime_ns))  # same size and time, but the change time tells
    r.snapshot(str(source), progress=spy)
    r.snapshot(str(source), progress=spy, force_rehash=True)
    assert seen == [0, 1, 5]
    assert {(x.relative_path, x.change) for x in r.diff(1, 3).collect()} == {("a.txt", "modified")} and r.diff(3, 4).isEmpty()
    assert all(x.n == 0 for x in r.verify(full=True).collect())
    r.restore(4, str(tmp_path / "out"))
    assert (tmp_path / "out/a.txt").read_bytes() == b"HELLO WORLD" * 3


def test_recovery_on_open_and_layout_check(spark, tmp_path, source):
    import json
    import shutil

    root = tmp_path / "repo"
    r = Repository.create(spark, str(root), chunk_size=64)
    r.snapshot(str(source))
    r.snapshot(str(source))
    (root / "_snapshots/3.json").write_text(json.dumps({"id": 3, "status": "pending", "created_at_ns": 1, "source_root": "x"}))
    shutil.copytree(root / "entries/snapshot_id=1", root / "entries/snapshot_id=3")
    assert {x.violation: x.n for x in Repository(spark, str(root), read_only=True).verify().collect()}["unfinished snapshot"] == 1
    assert [m["status"] for m in Repository(spark, str(root)).manifests()] == ["complete", "complete", "failed"]
    assert not (root / "entries/snapshot_id=3").exists()

    def stop(point):
        if point == "after_delete_batch":
            raise RuntimeError("injected")

    with pytest.raises(RuntimeError):
        Repository(spark, str(root), injector=stop).delete(1)
    again = Repository(spark, str(root))
    assert [m["id"] for m in again.manifests()] == [2, 3] and all(x.n == 0 for x in again.verify(full=True).collect())
    again.restore(2, str(tmp_path / "out"))
    os.unlink(source / "pipe")
    assert tree(tmp_path / "out") == tree(source)
    info = json.loads((root / "repository_info.json").read_text())
    for field, value in (("zstd_level", 99), ("chunk_size_bytes", 0), ("format_version", 2), ("path_encoding", "latin-1"), ("created_at_ns", "x")):
        (root / "repository_info.json").write_text(json.dumps(info | {field: value}))
        with pytest.raises(RepositoryError, match="invalid_repository"):
            Repository(spark, str(root))
    (root / "repository_info.json").write_text(json.dumps(info))
    shutil.rmtree(root / "objects")
    with pytest.raises(RepositoryError, match="missing"):
        Repository(spark, str(root))


def test_cancelled_restore_and_linked_source(spark, tmp_path, source):
    from threading import Event

    r, stop = Repository.create(spark, str(tmp_path / "repo"), chunk_size=64), Event()
    r.snapshot(str(source))
    stop.set()
    with pytest.raises(RepositoryError, match="cancelled"):
        r.restore(1, str(tmp_path / "out"), cancel=stop)
    os.symlink(tmp_path / "repo/objects", tmp_path / "link")
    with pytest.raises(RepositoryError, match="invalid_argument"):
        r.snapshot(str(tmp_path / "link"))


def test_generated_trees(spark, tmp_path):
    from cairn.sources import datasets

    done = datasets.many_small(spark, str(tmp_path / "a"), 2100)
    assert done["files"] == 2100 == sum(len(f) for _, _, f in os.walk(tmp_path / "a")) and done["bytes"] == sum(x.stat().st_size for x in (tmp_path / "a").rglob("*.*") if x.is_file())
    datasets.many_small(spark, str(tmp_path / "b"), 2100)
    assert tree(tmp_path / "a") == tree(tmp_path / "b")
    done = datasets.large_files(spark, str(tmp_path / "c"), 5 << 20, files=2)
    assert done == {"files": 2, "bytes": 5 << 20} and {x.stat().st_size for x in (tmp_path / "c").iterdir()} == {5 << 19}


def test_root_rule_is_dropped(spark, tmp_path, source):
    from cairn.functions.paths import ignored
    from cairn.sources.tree import IGNORE_FILE, scan

    (source / IGNORE_FILE).write_text("/\nempty/\n")
    found = {x.relative_path for x in scan(spark, str(source)).where("kind = 'entry'").collect()}
    assert "" in found and "empty" not in found and "sub/deep/é b.bin" in found
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("", True), ("empty", True)], "p string, d boolean")
    assert [r.p for r in rows.where(ignored(["/", "empty/"], "p", F.col("d"))).collect()] == ["empty"]


def test_ignore_file_prunes(spark, tmp_path, source):
    from cairn.sources.tree import IGNORE_FILE, scan

    (source / IGNORE_FILE).write_text("# comment\r\nsub/\r\n\r\n*.txt\r\n")
    found = {x.relative_path for x in scan(spark, str(source)).where("kind = 'entry'").collect()}
    assert found == {"", "empty", ".hidden", "broken", IGNORE_FILE}


def test_streams(spark, tmp_path):
    from cairn.streaming.ingest import event_counts, ingest_chunks

    spark.createDataFrame([("a" * 600,), ("b",)], "text string").repartition(2).write.parquet(str(tmp_path / "in"))
    ingest_chunks(spark, str(tmp_path / "in"), "text string", str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).select("hash").distinct().count() == spark.read.parquet(str(tmp_path / "t")).count() == 3
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "ev"))
    q = event_counts(spark, str(tmp_path / "ev"), "ts timestamp, event_type string").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg({"n": "sum"}).first()[0] == events.count()


def test_full_verify_hashes_objects_together(spark, tmp_path, monkeypatch):
    """Hashes are computed for many objects at a time, every damaged one counts, and groups are bounded in bytes."""
    source, root = tmp_path / "many", tmp_path / "repo"
    source.mkdir()
    for k in range(40):
        (source / f"{k}.bin").write_bytes(bytes([k]) * (100 + k))
    r = Repository.create(spark, str(root), chunk_size=128)
    r.snapshot(str(source))
    assert all(x.n == 0 for x in r.verify(full=True).collect())
    from cairn.plans import repository as module

    table = r.table("objects")
    rows = sorted(table.select("hash", "raw_size", "payload").collect(), key=lambda x: x.hash)
    same = [x for x in rows if x.raw_size == 128]
    swapped = {same[0].hash: bytes(same[1].payload), same[2].hash: b"no frame", rows[-1].hash: b""}
    broken = spark.createDataFrame([(x.hash, x.raw_size, swapped.get(x.hash, bytes(x.payload))) for x in rows], "hash string, raw_size bigint, payload binary")
    calls = tmp_path / "calls"
    calls.mkdir()
    real = module.blake3

    def counted(messages):
        (calls / uuid.uuid4().hex).write_text(f"{len(messages)} {sum(map(len, messages))}")
        return real(messages)

    monkeypatch.setattr(module, "blake3", counted)
    monkeypatch.setattr(module, "TOGETHER", 1000)
    broken.coalesce(1).write.mode("overwrite").parquet(str(root / "objects/snapshot_id=1"))
    assert {x.violation: x.n for x in r.verify(full=True).collect()}["damaged object"] == len(swapped)
    made = [tuple(map(int, f.read_text().split())) for f in calls.iterdir()]
    assert sum(n for n, _ in made) == len(rows) - 2 and max(b for _, b in made) < 1000 + 128
    assert len(made) <= sum(b for _, b in made) / 1000 + 2
