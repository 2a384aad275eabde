"""Queries over a virtual repository of three snapshots of the documents table, and the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import paths as P
from cairn.operators import chunking, integrity, trees

CHUNK = 512
IGNORE = ["doc-*1.txt", "de/src?/", "es/src1*/doc-0000*.txt", "*[0].txt", "src9/"]
#: status of the virtual snapshots and of three that never finished
STATUS = [(1, "complete", 100), (2, "complete", 200), (3, "complete", 200), (4, "pending", 300), (5, "failed", 50), (6, "deleting", 60)]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_BASE = f"""
s(sid) AS (VALUES (1::BIGINT), (2), (3)),
vfile AS (
  SELECT sid AS snapshot_id, doc_id, coalesce(lang, 'none') || '/' || coalesce(source, 'none') || '/doc-' || lpad(doc_id::VARCHAR, greatest(6, length(doc_id::VARCHAR))::INTEGER, '0') || '.txt' AS relative_path,
    encode(coalesce(text, '') || CASE WHEN sid >= 2 AND doc_id % 7 = 0 THEN chr(10) || '-- edited' ELSE '' END) AS content
  FROM documents, s WHERE CASE sid WHEN 1 THEN doc_id % 10 <> 0 WHEN 2 THEN true ELSE doc_id % 5 <> 1 END
),
vchunk AS (
  SELECT snapshot_id, relative_path, i AS sequence_number, i * {CHUNK} AS raw_offset, octet_length(content[i * {CHUNK} + 1 : (i + 1) * {CHUNK}])::BIGINT AS raw_length, sha256(content[i * {CHUNK} + 1 : (i + 1) * {CHUNK}]) AS chunk_hash
  FROM (SELECT *, unnest(range(0, (octet_length(content) + {CHUNK - 1}) // {CHUNK})) AS i FROM vfile)
),
dirs AS (
  SELECT DISTINCT snapshot_id, unnest(['', split_part(relative_path, '/', 1), split_part(relative_path, '/', 1) || '/' || split_part(relative_path, '/', 2)]) AS relative_path FROM vfile
),
ventry AS (
  SELECT snapshot_id, relative_path, regexp_extract(relative_path, '^(.*)/[^/]*$', 1) AS parent_path, regexp_extract(relative_path, '[^/]*$') AS name, entry_type, logical_size, file_hash
  FROM (
    SELECT snapshot_id, relative_path, 'file' AS entry_type, octet_length(content)::BIGINT AS logical_size, sha256(content) AS file_hash FROM vfile
    UNION ALL SELECT snapshot_id, relative_path, 'directory', 0, NULL FROM dirs
  )
),
snapshots(id, status, created_at_ns) AS (VALUES {", ".join(f"({i}::BIGINT, '{s}', {t}::BIGINT)" for i, s, t in STATUS)})
"""


def _query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = f"WITH {_BASE} {sql}"
        return f

    return add


def vfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    in_snapshot = F.filter(F.expr("array(1L, 2L, 3L)"), lambda s: ((s == 1) & (F.col("doc_id") % 10 != 0)) | (s == 2) | ((s == 3) & (F.col("doc_id") % 5 != 1)))
    number = F.col("doc_id").cast("string")
    return docs.withColumn("snapshot_id", F.explode(in_snapshot)).select(
        "snapshot_id", "doc_id",
        F.concat(F.coalesce("lang", F.lit("none")), F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/doc-"), F.lpad(number, F.greatest(F.length(number), F.lit(6)), F.lit("0")), F.lit(".txt")).alias("relative_path"),
        F.to_binary(F.concat(F.coalesce("text", F.lit("")), F.when((F.col("snapshot_id") >= 2) & (F.col("doc_id") % 7 == 0), "\n-- edited").otherwise("")), F.lit("utf-8")).alias("content"),
    )


def vchunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(vfiles(spark, sf_dir), CHUNK).select("snapshot_id", "relative_path", "sequence_number", "raw_offset", "raw_length", F.sha2("data", 256).alias("chunk_hash"))


def ventries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.with_directories(vfiles(spark, sf_dir), size=F.octet_length("content"), digest=F.sha2("content", 256))


def snapshots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATUS, "id bigint, status string, created_at_ns bigint")


@_query("SELECT snapshot_id, count(*) FILTER (entry_type = 'file') AS file_count, count(*) FILTER (entry_type = 'directory') AS directory_count, 0::BIGINT AS symlink_count, coalesce(sum(logical_size), 0)::BIGINT AS logical_size FROM ventry JOIN snapshots ON id = snapshot_id AND status = 'complete' GROUP BY 1")
def snapshot_counters(spark, sf_dir):
    one = lambda kind: F.coalesce(F.sum(F.when(F.col("entry_type") == kind, 1)), F.lit(0)).cast("long")
    shown = snapshots(spark).where("status = 'complete'").select(F.col("id").alias("snapshot_id"))
    return ventries(spark, sf_dir).join(F.broadcast(shown), "snapshot_id").groupBy("snapshot_id").agg(one("file").alias("file_count"), one("directory").alias("directory_count"), one("symlink").alias("symlink_count"), F.coalesce(F.sum("logical_size"), F.lit(0)).alias("logical_size"))


@_query("SELECT * FROM vchunk")
def chunk_listing(spark, sf_dir):
    return vchunks(spark, sf_dir)


@_query("SELECT snapshot_id, count(*) FILTER (k = 1)::BIGINT AS new_chunk_count, count(*) FILTER (k > 1)::BIGINT AS reused_chunk_count FROM (SELECT snapshot_id, row_number() OVER (PARTITION BY chunk_hash ORDER BY snapshot_id, relative_path, sequence_number) AS k FROM vchunk) GROUP BY 1")
def dedup_new_reused(spark, sf_dir):
    return chunking.new_and_reused(vchunks(spark, sf_dir))


@_query("SELECT DISTINCT chunk_hash, 'objects/' || substr(chunk_hash, 1, 2) || '/' || chunk_hash || '.zst' AS object_path, ('0x' || substr(chunk_hash, 1, 2))::BIGINT AS shard FROM vchunk")
def object_paths(spark, sf_dir):
    return vchunks(spark, sf_dir).select("chunk_hash").distinct().select("chunk_hash", P.object_path("chunk_hash").alias("object_path"), P.shard_index("chunk_hash").alias("shard"))


@_query("SELECT relative_path, parent_path, name, entry_type, logical_size, file_hash, CASE WHEN relative_path = '' THEN 0 ELSE len(string_split(relative_path, '/')) END::BIGINT AS depth FROM ventry e WHERE snapshot_id = 2 AND EXISTS (SELECT 1 FROM snapshots s WHERE s.id = e.snapshot_id AND s.status = 'complete') ORDER BY relative_path")
def list_entries(spark, sf_dir):
    shown = snapshots(spark).where("status = 'complete'").select(F.col("id").alias("snapshot_id"))
    return ventries(spark, sf_dir).where("snapshot_id = 2").join(F.broadcast(shown), "snapshot_id", "left_semi").select("relative_path", "parent_path", "name", "entry_type", "logical_size", "file_hash", P.path_depth("relative_path").alias("depth")).orderBy("relative_path")


@_query("SELECT name, relative_path, entry_type FROM ventry WHERE snapshot_id = 2 AND parent_path = '' AND relative_path <> '' ORDER BY name, relative_path")
def list_children(spark, sf_dir):
    return ventries(spark, sf_dir).where("snapshot_id = 2 and parent_path = '' and relative_path <> ''").select("name", "relative_path", "entry_type").orderBy("name", "relative_path")


@_query("SELECT * FROM dirs WHERE relative_path <> ''")
def ancestor_closure(spark, sf_dir):
    return trees.ancestor_closure(vfiles(spark, sf_dir))


@_query("SELECT snapshot_id, relative_path, entry_type FROM ventry WHERE relative_path = 'de' OR starts_with(relative_path, 'de/') OR relative_path = 'fr/src3' OR starts_with(relative_path, 'fr/src3/')")
def descendant_closure(spark, sf_dir):
    roots = spark.createDataFrame([(s, r) for s in (1, 2, 3) for r in ("de", "fr/src3")], "snapshot_id bigint, root string")
    return trees.descendants(ventries(spark, sf_dir), roots).select("snapshot_id", "relative_path", "entry_type")


@_query("SELECT snapshot_id, relative_path, entry_type FROM ventry WHERE snapshot_id = 2 AND (relative_path IN ('', 'es', 'fr') OR relative_path = 'es/src2' OR starts_with(relative_path, 'es/src2/') OR relative_path = 'fr/src3' OR starts_with(relative_path, 'fr/src3/'))")
def restore_selection(spark, sf_dir):
    wanted = spark.createDataFrame([(2, "es/src2"), (2, "fr/src3")], "snapshot_id bigint, relative_path string")
    return trees.select_for_restore(ventries(spark, sf_dir), wanted).select("snapshot_id", "relative_path", "entry_type")


@_query("SELECT row_number() OVER (ORDER BY depth, relative_path)::BIGINT AS step, relative_path FROM (SELECT relative_path, CASE WHEN relative_path = '' THEN 0 ELSE len(string_split(relative_path, '/')) END AS depth FROM ventry WHERE snapshot_id = 2 AND entry_type = 'directory')")
def restore_plan_order(spark, sf_dir):
    # positions are counted over directories, a small part of a tree; each depth is ranked apart and the depths are added up
    from pyspark.sql import Window

    d = ventries(spark, sf_dir).where("snapshot_id = 2 and entry_type = 'directory'").select("relative_path", P.path_depth("relative_path").alias("depth"))
    sizes = d.groupBy("depth").agg(F.count("*").alias("n"))
    base = sizes.select("depth", F.coalesce(F.sum("n").over(Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ranked = d.withColumn("k", F.row_number().over(Window.partitionBy("depth").orderBy("relative_path")))
    return ranked.join(F.broadcast(base), "depth").select((F.col("base") + F.col("k")).alias("step"), "relative_path").orderBy("step")


@_query("""
, e2 AS (SELECT * FROM ventry WHERE snapshot_id = 2), x AS (SELECT relative_path, entry_type AS existing_type FROM ventry WHERE snapshot_id = 1 AND entry_type = 'file' UNION ALL SELECT relative_path, CASE WHEN relative_path = 'fr/src3' THEN 'file' ELSE 'directory' END FROM dirs WHERE snapshot_id = 1)
SELECT e2.relative_path, CASE WHEN starts_with(e2.relative_path, 'fr/src3/') THEN 'skip' WHEN x.existing_type IS NULL THEN 'create' WHEN e2.entry_type = 'directory' AND x.existing_type = 'directory' THEN 'merge' ELSE 'skip' END AS action FROM e2 LEFT JOIN x ON x.relative_path = e2.relative_path""")
def restore_actions(spark, sf_dir):
    e = ventries(spark, sf_dir)
    there = e.where("snapshot_id = 1").select("relative_path", F.when(F.col("relative_path") == "fr/src3", "file").otherwise(F.col("entry_type")).alias("existing_type"))
    return trees.restore_actions(e.where("snapshot_id = 2"), there).select("relative_path", "action")


@_query("""
, c AS (SELECT chunk_hash AS hash, min(raw_length) AS raw_size FROM vchunk GROUP BY 1)
SELECT e.snapshot_id, e.relative_path, v.sequence_number, c.hash, c.raw_size, v.raw_offset, v.raw_length FROM vchunk v JOIN c ON c.hash = v.chunk_hash JOIN ventry e ON e.snapshot_id = v.snapshot_id AND e.relative_path = v.relative_path JOIN snapshots s ON s.id = e.snapshot_id AND s.status = 'complete' WHERE e.snapshot_id = 3""")
def entry_chunk_join(spark, sf_dir):
    v = vchunks(spark, sf_dir)
    c = v.groupBy(F.col("chunk_hash").alias("hash")).agg(F.min("raw_length").alias("raw_size"))
    e = ventries(spark, sf_dir).where("snapshot_id = 3").select("snapshot_id", "relative_path")
    shown = F.broadcast(snapshots(spark).where("status = 'complete'").select(F.col("id").alias("snapshot_id")))
    return v.where("snapshot_id = 3").join(e, ["snapshot_id", "relative_path"]).join(c, F.col("hash") == F.col("chunk_hash")).join(shown, "snapshot_id").select("snapshot_id", "relative_path", "sequence_number", "hash", "raw_size", "raw_offset", "raw_length")


@_query("SELECT snapshot_id, relative_path, count(*)::BIGINT AS n_chunks, sum(raw_length)::BIGINT AS total_length, bool_and(sequence_number = k AND raw_offset = coalesce(o, 0) AND raw_length > 0) AS contiguous FROM (SELECT *, row_number() OVER w - 1 AS k, sum(raw_length) OVER (PARTITION BY snapshot_id, relative_path ORDER BY sequence_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM vchunk WINDOW w AS (PARTITION BY snapshot_id, relative_path ORDER BY sequence_number)) GROUP BY 1, 2")
def chunk_contiguity(spark, sf_dir):
    return chunking.contiguity(vchunks(spark, sf_dir), ["snapshot_id", "relative_path"])


def _glob_sql(path: str, is_dir: str) -> str:
    tests = []
    for rule in IGNORE:
        regex, whole, only_dirs = P.glob_regex(rule)
        target = path if whole else f"regexp_extract({path}, '[^/]*$')"
        tests.append(f"(regexp_full_match({target}, '{regex[2:-2]}'){f' AND {is_dir}' if only_dirs else ''})")
    return " OR ".join(tests)


@_query(f"SELECT relative_path, entry_type FROM ventry WHERE snapshot_id = 2 AND ({_glob_sql('relative_path', chr(101) + 'ntry_type = ' + chr(39) + 'directory' + chr(39))})")
def ignore_match(spark, sf_dir):
    return ventries(spark, sf_dir).where("snapshot_id = 2").where(P.ignored(IGNORE, "relative_path", F.col("entry_type") == "directory")).select("relative_path", "entry_type")


@_query(f"""
, hit AS (SELECT relative_path FROM ventry WHERE snapshot_id = 2 AND ({_glob_sql('relative_path', "entry_type = 'directory'")}))
SELECT relative_path, entry_type FROM ventry e WHERE snapshot_id = 2 AND relative_path NOT IN (SELECT relative_path FROM hit)
AND split_part(relative_path, '/', 1) NOT IN (SELECT relative_path FROM hit) AND split_part(relative_path, '/', 1) || '/' || split_part(relative_path, '/', 2) NOT IN (SELECT relative_path FROM hit)""")
def ignore_pruned(spark, sf_dir):
    e = ventries(spark, sf_dir).where("snapshot_id = 2")
    hit = e.where(P.ignored(IGNORE, "relative_path", F.col("entry_type") == "directory"))
    return e.join(trees.descendants(e, hit.select("snapshot_id", F.col("relative_path").alias("root"))), ["snapshot_id", "relative_path"], "left_anti").select("relative_path", "entry_type")


@_query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'skip' WHEN event_id % 3 = 0 THEN 'warn:cloud_placeholder' WHEN event_id % 5 = 0 THEN 'warn:volume_mount_point' WHEN event_id % 7 = 0 THEN 'warn:unsupported_reparse_point'
WHEN event_id % 11 = 0 THEN 'warn:filesystem_boundary' WHEN event_id % 13 = 0 THEN 'capture_link' ELSE 'capture' END AS decision FROM events""")
def scan_decision(spark, sf_dir):
    d = lambda k: F.col("event_id") % k == 0
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", P.scan_decision(d(2), d(3), d(5), d(7), d(11), d(13), skip_hidden=True, one_file_system=True).alias("decision"))


_ODD = "CASE doc_id % 6 WHEN 0 THEN source || '/' || lang WHEN 1 THEN '/' || source WHEN 2 THEN source || '/../' || lang WHEN 3 THEN source || '//' || lang WHEN 4 THEN source || '/./' || lang ELSE '' END"


@_query(f"SELECT doc_id, p AS relative_path, p <> '' AND len(list_filter(string_split(p, '/'), lambda c: c IN ('', '.', '..'))) = 0 AS safe FROM (SELECT doc_id, {_ODD} AS p FROM documents)")
def safe_paths(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(_ODD).alias("relative_path")).withColumn("safe", P.is_safe_path("relative_path"))


@_query("SELECT doc_id, regexp_full_match(h, '[0-9a-f]{64}') AS valid FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN sha256(text) WHEN 1 THEN upper(sha256(text)) WHEN 2 THEN sha256(text) || chr(10) ELSE substr(sha256(text), 2) END AS h FROM documents)")
def hash_format_check(spark, sf_dir):
    h = "CASE doc_id % 4 WHEN 0 THEN sha2(text, 256) WHEN 1 THEN upper(sha2(text, 256)) WHEN 2 THEN concat(sha2(text, 256), '\n') ELSE substr(sha2(text, 256), 2) END"
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", P.is_hash(F.expr(h)).alias("valid"))


@_query("""SELECT 'order' AS child, count(*)::BIGINT AS n FROM orders o WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_custkey % 50 <> 0)
UNION ALL SELECT 'label', count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.doc_id % 9 <> 0)""")
def fk_violations(spark, sf_dir):
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    a = integrity.orphans(t("orders"), ["o_custkey"], t("customer").where("c_custkey % 50 <> 0"), ["c_custkey"], "order")
    b = integrity.orphans(t("labels"), ["doc_id"], t("documents").where("doc_id % 9 <> 0"), ["doc_id"], "label")
    return a.unionByName(b).withColumnRenamed("violation", "child")


_MOVED = "CASE WHEN snapshot_id = 3 AND relative_path LIKE 'de/src1/%' THEN 5 ELSE snapshot_id END"


@_query(f"""
, c AS (SELECT chunk_hash AS hash, min(raw_length) AS raw_size FROM vchunk WHERE snapshot_id <= 2 GROUP BY 1),
e AS (SELECT * REPLACE ({_MOVED} AS snapshot_id) FROM ventry), w AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 5 ELSE 2 END AS snapshot_id FROM documents WHERE doc_id % 11 = 0)
SELECT 'unfinished snapshot' AS violation, count(*)::BIGINT AS n FROM snapshots WHERE status IN ('pending', 'deleting')
UNION ALL SELECT 'entry of a failed snapshot', count(*) FROM e JOIN snapshots s ON s.id = e.snapshot_id WHERE s.status IN ('failed', 'cancelled')
UNION ALL SELECT 'warning of a failed snapshot', count(*) FROM w JOIN snapshots s ON s.id = w.snapshot_id WHERE s.status IN ('failed', 'cancelled')
UNION ALL SELECT 'file without hash', count(*) FROM e JOIN snapshots s ON s.id = e.snapshot_id WHERE s.status = 'complete' AND e.entry_type = 'file' AND (e.file_hash IS NULL OR length(e.file_hash) <> 64)
UNION ALL SELECT 'reference without chunk', count(*) FROM vchunk v WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.hash = v.chunk_hash)
UNION ALL SELECT 'reference without entry', count(*) FROM vchunk v WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.snapshot_id = v.snapshot_id AND e.relative_path = v.relative_path)
UNION ALL SELECT 'entry without snapshot', count(*) FROM e WHERE NOT EXISTS (SELECT 1 FROM snapshots s WHERE s.id = e.snapshot_id)
UNION ALL SELECT 'unsafe path', 0 UNION ALL SELECT 'bad chunk', count(*) FROM c WHERE raw_size <= 0""")
def relationship_check(spark, sf_dir):
    v = vchunks(spark, sf_dir)
    c = v.where("snapshot_id <= 2").groupBy(F.col("chunk_hash").alias("hash")).agg(F.min("raw_length").alias("raw_size"))
    e = ventries(spark, sf_dir).withColumn("snapshot_id", F.expr(_MOVED).cast("long"))
    w = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 11 = 0").select(F.expr("if(doc_id % 3 = 0, 5L, 2L)").alias("snapshot_id"))
    return integrity.relationship_check(snapshots(spark), e, w, v, c)


@_query("SELECT id, status FROM snapshots WHERE status = 'complete' ORDER BY created_at_ns DESC, id DESC")
def visible_snapshots(spark, sf_dir):
    return snapshots(spark).where("status = 'complete'").orderBy(F.desc("created_at_ns"), F.desc("id")).select("id", "status")


@_query("SELECT id, status FROM snapshots WHERE status <> 'complete' ORDER BY id")
def incomplete_snapshots(spark, sf_dir):
    return snapshots(spark).where("status <> 'complete'").select("id", "status").orderBy("id")


@_query("SELECT relative_path FROM ventry WHERE snapshot_id = 1 ORDER BY relative_path LIMIT 100")
def cleanup_batch(spark, sf_dir):
    return ventries(spark, sf_dir).where("snapshot_id = 1").select("relative_path").orderBy("relative_path").limit(100)


@_query("""
, a AS (SELECT chunk_hash AS hash, min(raw_length) + CASE WHEN substr(chunk_hash, 1, 2) = '00' THEN 1 ELSE 0 END AS raw_size FROM vchunk WHERE snapshot_id = 1 GROUP BY chunk_hash), b AS (SELECT chunk_hash AS hash, min(raw_length) AS raw_size FROM vchunk WHERE snapshot_id = 2 GROUP BY 1)
SELECT b.hash, b.raw_size, CASE WHEN a.raw_size <> b.raw_size THEN 'conflict' WHEN a.hash IS NULL THEN 'new' ELSE 'equal' END AS state FROM b LEFT JOIN a ON a.hash = b.hash""")
def upsert_chunks(spark, sf_dir):
    v = vchunks(spark, sf_dir).select("snapshot_id", F.col("chunk_hash").alias("hash"), F.col("raw_length").alias("raw_size"))
    bad = F.when(F.substring("hash", 1, 2) == "00", 1).otherwise(0)
    stored = v.where("snapshot_id = 1").groupBy("hash").agg(F.min("raw_size").alias("raw_size")).withColumn("raw_size", F.col("raw_size") + bad)
    return integrity.upsert_chunks(stored, v.where("snapshot_id = 2"))


@_query("SELECT s.id AS snapshot_id, s.status = 'pending' OR s.status = 'complete' AS state_ok, NOT EXISTS (SELECT 1 FROM ventry e WHERE e.snapshot_id = s.id AND e.entry_type = 'file' AND e.logical_size < 30) AS hashes_ok FROM snapshots s")
def publish_gate(spark, sf_dir):
    # a file of less than 30 bytes stands for one whose hash is missing
    unhashed = ventries(spark, sf_dir).where("entry_type = 'file' and logical_size < 30").select(F.col("snapshot_id").alias("id")).distinct().withColumn("bad", F.lit(True))
    return snapshots(spark).join(unhashed, "id", "left").select(F.col("id").alias("snapshot_id"), F.col("status").isin("pending", "complete").alias("state_ok"), F.col("bad").isNull().alias("hashes_ok"))


@_query("SELECT event_id, (ns - ((ns % 1000000000 + 1000000000) % 1000000000)) // 1000000000 AS seconds, (ns % 1000000000 + 1000000000) % 1000000000 AS nanos, CASE WHEN ns > 0 THEN -1 ELSE ns + 1 END AS checked FROM (SELECT event_id, (event_id - 5000) * 123456789 AS ns FROM events)")
def checked_arithmetic(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr("(event_id - 5000) * 123456789L").alias("ns"))
    seconds, nanos = P.floor_seconds("ns")
    return rows.select("event_id", seconds.alias("seconds"), nanos.alias("nanos"), F.expr("coalesce(try_add(ns, if(ns > 0, 9223372036854775807L, 1L)), -1L)").alias("checked"))


@_query("SELECT relative_path, CASE WHEN a.file_hash IS NULL THEN 'added' WHEN b.file_hash IS NULL THEN 'removed' ELSE 'modified' END AS change FROM (SELECT * FROM ventry WHERE snapshot_id = 1 AND entry_type = 'file') a FULL JOIN (SELECT * FROM ventry WHERE snapshot_id = 3 AND entry_type = 'file') b USING (relative_path) WHERE a.file_hash IS DISTINCT FROM b.file_hash")
def snapshot_diff(spark, sf_dir):
    # one aggregation by path instead of an outer join of two scans
    f = ventries(spark, sf_dir).where("entry_type = 'file' and snapshot_id in (1, 3)")
    side = lambda s: F.max(F.when(F.col("snapshot_id") == s, F.col("file_hash")))
    return f.groupBy("relative_path").agg(side(1).alias("a"), side(3).alias("b")).where("not (a <=> b)").select("relative_path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("modified").alias("change"))


@_query("SELECT DISTINCT chunk_hash FROM vchunk v WHERE NOT EXISTS (SELECT 1 FROM vchunk w WHERE w.snapshot_id = 3 AND w.chunk_hash = v.chunk_hash)")
def gc_candidates(spark, sf_dir):
    return vchunks(spark, sf_dir).groupBy("chunk_hash").agg(F.max("snapshot_id").alias("last")).where("last < 3").select("chunk_hash")


@_query("SELECT count(DISTINCT chunk_hash)::BIGINT AS unique_chunks, sum(raw_length)::BIGINT AS logical_size, (SELECT sum(x)::BIGINT FROM (SELECT min(raw_length) AS x FROM vchunk GROUP BY chunk_hash)) AS unique_size FROM vchunk")
def repo_stats(spark, sf_dir):
    per = vchunks(spark, sf_dir).groupBy("chunk_hash").agg(F.sum("raw_length").alias("all"), F.min("raw_length").alias("one"))
    return per.agg(F.count("*").alias("unique_chunks"), F.sum("all").alias("logical_size"), F.sum("one").alias("unique_size"))


@_query("SELECT uses, count(*)::BIGINT AS chunks FROM (SELECT count(*)::BIGINT AS uses FROM vchunk GROUP BY chunk_hash) GROUP BY 1")
def chunk_reuse_histogram(spark, sf_dir):
    return vchunks(spark, sf_dir).groupBy("chunk_hash").agg(F.count("*").alias("uses")).groupBy("uses").agg(F.count("*").alias("chunks"))


@_query("SELECT file_hash, count(*)::BIGINT AS copies, min(relative_path) AS first_path, sum(logical_size)::BIGINT AS bytes FROM ventry WHERE snapshot_id = 2 AND entry_type = 'file' GROUP BY 1 HAVING count(*) > 1")
def dup_files(spark, sf_dir):
    return ventries(spark, sf_dir).where("snapshot_id = 2 and entry_type = 'file'").groupBy("file_hash").agg(F.count("*").alias("copies"), F.min("relative_path").alias("first_path"), F.sum("logical_size").alias("bytes")).where("copies > 1")


@_query(None)
def blake3_chunks(spark, sf_dir):
    from cairn.functions.codecs import blake3_hex
    from cairn.session import ship

    ship(spark)
    return chunking.chunks(vfiles(spark, sf_dir).where("snapshot_id = 2"), CHUNK).select("relative_path", "sequence_number", blake3_hex("data").alias("chunk_hash"))


@_query(None)
def zstd_roundtrip(spark, sf_dir):
    from cairn.functions.codecs import zstd_compress, zstd_decompress
    from cairn.session import ship

    ship(spark)
    packed = chunking.chunks(vfiles(spark, sf_dir).where("snapshot_id = 2"), CHUNK).withColumn("frame", zstd_compress()("data"))
    return packed.select("relative_path", "sequence_number", (zstd_decompress()("frame", "raw_length") == F.col("data")).alias("exact"))
