"""Queries over a repository on disk: the virtual corpus is written as a tree below the shared folder, snapshotted three
times, and read back, restored, compared, verified and recovered. The SQL says what must come out of the documents table."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import paths as P
from cairn.operators import integrity
from cairn.plans import snapshot_queries as virtual
from cairn.plans.repository import POINTS, Repository, RepositoryError
from cairn.session import shared_dir, ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
_BUILT: dict[tuple[str, str], str] = {}


def _query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = f"WITH {virtual._BASE} {sql}"
        return f

    return add


def _write_tree(files: DataFrame, root: str) -> None:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["relative_path"], frame["content"], strict=True):
                full = os.path.join(root, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "wb") as f:
                    f.write(bytes(content))
            yield pd.DataFrame({"n": [len(frame)]})

    files.select("relative_path", "content").mapInPandas(run, "n bigint").agg(F.sum("n")).collect()


def repository(spark: SparkSession, sf_dir: str) -> Repository:
    """The repository of the three snapshots; made once per application and table."""
    key = spark.sparkContext.applicationId, sf_dir
    base = os.path.join(shared_dir(spark).removeprefix("file://"), "cairn", f"repository-{key[0]}-{len(_BUILT)}")
    if key not in _BUILT:
        ship(spark)
        shutil.rmtree(base, ignore_errors=True)
        source, files = os.path.join(base, "source"), virtual.vfiles(spark, sf_dir)
        made = Repository.create(spark, os.path.join(base, "repository"), chunk_size=virtual.CHUNK)
        state = files.groupBy("relative_path").agg(*(F.max(F.when(F.col("snapshot_id") == s, F.sha2("content", 256))).alias(f"h{s}") for s in (1, 2, 3))).withColumn("h0", F.lit(None).cast("string"))
        for s in (1, 2, 3):
            # only what changed is written, so that the others keep their times and needn't be read again
            changed = state.where(f"h{s} is not null and not (h{s} <=> h{s - 1})").select("relative_path")
            _write_tree(files.where(F.col("snapshot_id") == s).join(changed, "relative_path", "left_semi"), source)
            for r in state.where(f"h{s} is null and h{s - 1} is not null").select("relative_path").toLocalIterator():
                os.unlink(os.path.join(source, r.relative_path))
            for folder, _, _ in os.walk(source, topdown=False):
                if folder != source and not os.listdir(folder):
                    os.rmdir(folder)
            made.snapshot(source)
        _BUILT[key] = base
    return Repository(spark, os.path.join(_BUILT[key], "repository"))


@_query("""
, f AS (SELECT chunk_hash, min(snapshot_id) AS first FROM vchunk GROUP BY 1),
n AS (SELECT first AS id, count(*) AS n FROM f GROUP BY 1),
c AS (SELECT snapshot_id AS id, count(*) AS n FROM vchunk GROUP BY 1)
SELECT snapshot_id AS id, 'complete' AS status, count(*) FILTER (entry_type = 'file') AS file_count, count(*) FILTER (entry_type = 'directory') AS directory_count, sum(logical_size)::BIGINT AS logical_size,
  max(coalesce(n.n, 0))::BIGINT AS new_chunk_count, max(c.n - coalesce(n.n, 0))::BIGINT AS reused_chunk_count
FROM ventry LEFT JOIN n ON n.id = snapshot_id JOIN c ON c.id = snapshot_id GROUP BY 1""")
def repo_snapshots(spark, sf_dir):
    rows = [(m["id"], m["status"], m["file_count"], m["directory_count"], m["logical_size"], m["new_chunk_count"], m["reused_chunk_count"]) for m in repository(spark, sf_dir).list_snapshots()]
    return spark.createDataFrame(rows, "id bigint, status string, file_count bigint, directory_count bigint, logical_size bigint, new_chunk_count bigint, reused_chunk_count bigint")


@_query("SELECT relative_path, parent_path, name, entry_type, logical_size, entry_type = 'file' AS hashed FROM ventry WHERE snapshot_id = 2")
def repo_entries(spark, sf_dir):
    return repository(spark, sf_dir).list_entries(2).select("relative_path", "parent_path", "name", "entry_type", "logical_size", P.is_hash("file_hash").alias("hashed"))


@_query("SELECT relative_path, sequence_number, raw_offset, raw_length FROM vchunk WHERE snapshot_id = 3")
def repo_chunk_references(spark, sf_dir):
    return repository(spark, sf_dir).table("entry_chunks", [3]).select("relative_path", "sequence_number", "raw_offset", "raw_length")


@_query("SELECT relative_path, octet_length(content)::BIGINT AS length, sha256(content) AS sha256 FROM vfile WHERE snapshot_id = 3")
def repo_restored(spark, sf_dir):
    r = repository(spark, sf_dir)
    target = os.path.join(os.path.dirname(r.root), "restored")
    shutil.rmtree(target, ignore_errors=True)
    r.restore(3, target)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{target}")
    return files.select(F.expr(f"substring(path, {len('file:' + target) + 2})").alias("relative_path"), F.col("length"), F.sha2("content", 256).alias("sha256"))


@_query("""
, a AS (SELECT * FROM ventry WHERE snapshot_id = 1), b AS (SELECT * FROM ventry WHERE snapshot_id = 3)
SELECT relative_path, CASE WHEN a.entry_type IS NULL THEN 'added' WHEN b.entry_type IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM a FULL JOIN b USING (relative_path) WHERE a.entry_type IS NULL OR b.entry_type IS NULL OR a.file_hash IS DISTINCT FROM b.file_hash""")
def repo_diff(spark, sf_dir):
    return repository(spark, sf_dir).diff(1, 3)


_VIOLATIONS = ["unfinished snapshot", "entry of a failed snapshot", "warning of a failed snapshot", "file without hash", "reference without chunk", "reference without entry", "entry without snapshot", "unsafe path", "bad chunk", "bad chunk layout", "chunk without object", "damaged object"]


@_query("SELECT violation, 0::BIGINT AS n FROM (VALUES " + ", ".join(f"('{v}')" for v in _VIOLATIONS) + ") t(violation)")
def repo_verify(spark, sf_dir):
    return repository(spark, sf_dir).verify(full=True)


@_query("SELECT violation, CASE violation WHEN 'damaged object' THEN 1 ELSE 0 END::BIGINT AS n FROM (VALUES " + ", ".join(f"('{v}')" for v in _VIOLATIONS) + ") t(violation)")
def repo_verify_damage(spark, sf_dir):
    """As repo_verify, in a copy of the repository where one object holds another one's payload."""
    r = repository(spark, sf_dir)
    copy = os.path.join(os.path.dirname(r.root), "damaged")
    shutil.rmtree(copy, ignore_errors=True)
    shutil.copytree(r.root, copy)
    first = r.table("objects", [1])
    least, other = first.agg(F.min("hash"), F.max("hash")).first()
    wrong = first.where(F.col("hash") == other).select("payload").first().payload
    swapped = first.withColumn("payload", F.when(F.col("hash") == least, F.lit(wrong)).otherwise(F.col("payload")))
    swapped.select("hash", "raw_size", "payload").write.mode("overwrite").parquet(os.path.join(copy, "objects", "snapshot_id=1"))
    return Repository(spark, copy, read_only=True).verify(full=True)


@_query("SELECT point, 'failed' AS status, 0::BIGINT AS rows_left, 3::BIGINT AS complete FROM (VALUES " + ", ".join(f"('{p}')" for p in POINTS[:-1]) + ") t(point)")
def repo_recovery(spark, sf_dir):
    """A snapshot that is interrupted at each point leaves no row, and the three complete ones."""
    r = repository(spark, sf_dir)
    small = os.path.join(os.path.dirname(r.root), "small")
    os.makedirs(small, exist_ok=True)
    out = []
    for point in POINTS[:-1]:
        with open(os.path.join(small, point), "w") as f:
            f.write(point)

        def stop(at: str, point: str = point) -> None:
            if at == point:
                raise RuntimeError("injected")

        try:
            Repository(spark, r.root, injector=stop).snapshot(small)
        except RuntimeError:
            pass
        again = Repository(spark, r.root)
        last = again.manifests()[-1]
        left = sum(again.table(name, [last["id"]]).count() for name in ("entries", "entry_chunks", "chunks", "objects", "snapshot_warnings"))
        out.append((point, last["status"], left, len(again.list_snapshots())))
        again.forget(last["id"])
    return spark.createDataFrame(out, "point string, status string, rows_left bigint, complete bigint")


@_query("SELECT 1::BIGINT AS version, 'tables by snapshot' AS description, 6::BIGINT AS folders")
def repo_layout(spark, sf_dir):
    r = repository(spark, sf_dir)
    folders = sum(os.path.isdir(os.path.join(r.root, x)) and x not in ("staging",) for x in os.listdir(r.root))
    return spark.createDataFrame([(m["version"], m["description"], folders) for m in r.migrations()], "version bigint, description string, folders bigint")


# checks and column functions, over the tables

_TAIL = "substr(relative_path, -5, 1)"


@_query(f"""
, f AS (SELECT relative_path, logical_size + CASE WHEN {_TAIL} = '4' THEN 1 ELSE 0 END AS logical_size FROM ventry WHERE snapshot_id = 2 AND entry_type = 'file'),
r AS (SELECT relative_path, sequence_number + CASE WHEN {_TAIL} = '2' AND sequence_number > 0 THEN 1 ELSE 0 END AS s, raw_offset + CASE WHEN {_TAIL} = '1' AND sequence_number > 0 THEN 1 ELSE 0 END AS o, raw_length + CASE WHEN {_TAIL} = '3' THEN 1 ELSE 0 END AS n, raw_length AS raw, CASE WHEN {_TAIL} = '5' THEN 0 ELSE raw_length END AS stored FROM vchunk WHERE snapshot_id = 2),
w AS (SELECT *, row_number() OVER (PARTITION BY relative_path ORDER BY s) - 1 AS k, coalesce(sum(n) OVER (PARTITION BY relative_path ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r),
g AS (SELECT relative_path, bool_and(s = k) AS seq, bool_and(n = raw AND n > 0 AND n <= {virtual.CHUNK} AND stored > 0 AND stored <= {P.most_stored(virtual.CHUNK)}) AS bounds, bool_and(o = before) AS offs, sum(n) AS total FROM w GROUP BY 1),
x AS (SELECT f.relative_path, CASE WHEN total IS NULL THEN CASE WHEN logical_size <> 0 THEN 'size' END WHEN NOT seq THEN 'sequence' WHEN NOT bounds THEN 'bounds' WHEN NOT offs THEN 'offset' WHEN total <> logical_size THEN 'size' END AS fault FROM f LEFT JOIN g USING (relative_path))
SELECT * FROM x WHERE fault IS NOT NULL""")
def bad_chunk_layouts(spark, sf_dir):
    odd = lambda digit, then: F.when((F.expr(_TAIL) == digit) & then, 1).otherwise(0)
    v, later = virtual.vchunks(spark, sf_dir).where("snapshot_id = 2"), F.col("sequence_number") > 0
    files = virtual.ventries(spark, sf_dir).where("snapshot_id = 2 and entry_type = 'file'").select("relative_path", (F.col("logical_size") + odd("4", F.lit(True))).alias("logical_size"))
    own = F.when(F.expr(_TAIL) == "5", F.concat(F.lit("no"), "chunk_hash")).otherwise(F.col("chunk_hash"))
    refs = v.select("relative_path", (F.col("sequence_number") + odd("2", later)).alias("sequence_number"), (F.col("raw_offset") + odd("1", later)).alias("raw_offset"), (F.col("raw_length") + odd("3", F.lit(True))).alias("raw_length"), own.alias("chunk_hash"))
    one = v.select("chunk_hash", "raw_length").distinct()
    chunks = one.select(F.col("chunk_hash").alias("hash"), F.col("raw_length").alias("raw_size"), F.col("raw_length").alias("stored_size"))
    chunks = chunks.unionByName(chunks.select(F.concat(F.lit("no"), "hash").alias("hash"), "raw_size", F.lit(0).cast("long").alias("stored_size")))
    return integrity.bad_layouts(files, refs, chunks, virtual.CHUNK, ["relative_path"])


@_query("""
, c AS (SELECT chunk_hash AS h, min(raw_length) AS n FROM vchunk GROUP BY 1)
SELECT h AS hash, CASE substr(h, 1, 1) WHEN '0' THEN 'path' WHEN '1' THEN 'conflict' WHEN '2' THEN 'bounds' WHEN '3' THEN 'missing' WHEN '4' THEN 'size' ELSE 'reusable' END AS state FROM c""")
def known_objects(spark, sf_dir):
    c = virtual.vchunks(spark, sf_dir).groupBy(F.col("chunk_hash").alias("hash")).agg(F.min("raw_length").alias("raw_size"))
    at = lambda digit: F.substring("hash", 1, 1) == digit
    known = c.select(
        "hash", F.when(at("0"), "objects/elsewhere").otherwise(P.object_path("hash")).alias("object_path"), "raw_size", (F.col("raw_size") + F.when(at("1"), 1).otherwise(0)).alias("expected_size"),
        F.when(at("2"), 0).otherwise(F.col("raw_size")).alias("stored_size"), F.when(~at("3"), F.col("raw_size") + F.when(at("4"), 1).otherwise(0)).alias("actual_size"),
    )
    return integrity.reusable(known, virtual.CHUNK)


_FILESYSTEMS = ["ext4", "NFS4", "vfat", "fuse.sshfs", "fuse.s3fs", "apfs", "weird", "exFAT", "9p", "overlay", "cifs"]


@_query(f"""SELECT event_id, n AS name, CASE WHEN n IN ('NFS4', 'fuse.sshfs', 'fuse.s3fs', '9p', 'cifs') THEN 'network' WHEN n IN ('vfat', 'exFAT') THEN 'fat' WHEN n = 'weird' THEN 'unknown' ELSE 'local' END AS class,
CASE WHEN n IN ('NFS4', 'fuse.sshfs', 'fuse.s3fs', '9p', 'cifs') THEN 'refuse' WHEN n IN ('vfat', 'exFAT') THEN 'warn' ELSE 'allow' END AS policy FROM (SELECT event_id, {_FILESYSTEMS}[event_id % {len(_FILESYSTEMS)} + 1] AS n FROM events)""")
def filesystem_classes(spark, sf_dir):
    names = F.array(*(F.lit(x) for x in _FILESYSTEMS))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.get(names, (F.col("event_id") % len(_FILESYSTEMS)).cast("int")).alias("name"))
    return rows.withColumn("class", P.filesystem_class("name")).withColumn("policy", P.filesystem_policy("class"))


@_query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'file' WHEN 1 THEN 'directory' WHEN 2 THEN 'symlink' END AS entry_type, CASE doc_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 END AS status_code FROM documents")
def enum_codecs(spark, sf_dir):
    names = F.array(*(F.lit(x) for x in (*P.STATUSES, "unheard of")))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", P.decode_enum(F.col("doc_id") % 5, P.ENTRY_TYPES).alias("entry_type"), P.encode_enum(F.get(names, (F.col("doc_id") % 6).cast("int")), P.STATUSES).alias("status_code"))


@_query("SELECT event_id, CASE WHEN v BETWEEN 0 AND 4294967295 THEN v END AS uint32, CASE WHEN v >= 0 THEN v END AS size FROM (SELECT event_id, (event_id - 200) * 9999991 AS v FROM events)")
def checked_narrowing(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr("(event_id - 200) * 9999991L").alias("v"))
    return v.select("event_id", P.narrowed("v", 0, (1 << 32) - 1).alias("uint32"), P.narrowed("v", 0, (1 << 63) - 1).alias("size"))


@_query("SELECT doc_id, try(decode(encode(text)[1 : doc_id % 60 + 1])) IS NOT NULL AS valid FROM documents")
def utf8_validity(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    cut = F.expr("substring(to_binary(text, 'utf-8'), 1, cast(doc_id % 60 + 1 as int))")
    return d.select("doc_id", P.is_utf8(cut).alias("valid"))


@_query("""
, e AS (SELECT user_id, event_id, ts, date_trunc('minute', ts) AS w FROM events)
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, w ORDER BY ts, event_id) AS k FROM e) WHERE k = 1""")
def rate_limited_events(spark, sf_dir):
    """At most one event of a user in each minute, the first: what a rate-limited observer is told."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("user_id", F.date_trunc("minute", "ts").alias("w")).agg(F.min(F.struct("ts", "event_id")).alias("x")).select("user_id", "x.event_id")


__all__ = ["ORACLE", "QUERIES", "RepositoryError", "repository"]
