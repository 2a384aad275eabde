"""Constraint checks as queries that return what violates them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.paths import is_hash, is_safe_path, most_stored, object_path


def orphans(child: DataFrame, key: list[str], parent: DataFrame, parent_key: list[str], name: str) -> DataFrame:
    """(violation, n): child rows whose non-null key has no parent."""
    right = parent.select(*(F.col(p).alias(k) for k, p in zip(key, parent_key, strict=True))).distinct()
    missing = child.where(" and ".join(f"{k} is not null" for k in key)).join(right, key, "left_anti")
    return missing.agg(F.count("*").alias("n")).select(F.lit(name).alias("violation"), "n")


def _counted(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("violation"), "n")


def relationship_check(snapshots: DataFrame, entries: DataFrame, warnings: DataFrame, refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(violation, n) of every kind, zero included: snapshots (id, status) left pending or deleting, entries and warnings of
    failed or cancelled ones, files of complete ones without a hash, and keys and values that can't be."""
    status = F.broadcast(snapshots.select(F.col("id").alias("snapshot_id"), "status"))  # a row per snapshot
    of = lambda rows, *which: rows.join(status.where(F.col("status").isin(*which)).select("snapshot_id"), "snapshot_id", "left_semi")
    kinds = [
        _counted(snapshots.where(F.col("status").isin("pending", "deleting")), "unfinished snapshot"),
        _counted(of(entries, "failed", "cancelled"), "entry of a failed snapshot"),
        _counted(of(warnings, "failed", "cancelled"), "warning of a failed snapshot"),
        _counted(of(entries, "complete").where((F.col("entry_type") == "file") & ~is_hash("file_hash")), "file without hash"),
        orphans(refs, ["chunk_hash"], chunks, ["hash"], "reference without chunk"),
        orphans(refs, ["snapshot_id", "relative_path"], entries, ["snapshot_id", "relative_path"], "reference without entry"),
        orphans(entries.select("snapshot_id"), ["snapshot_id"], snapshots, ["id"], "entry without snapshot"),
        _counted(entries.where((F.col("relative_path") != "") & ~is_safe_path("relative_path")), "unsafe path"),
        _counted(chunks.where(~is_hash("hash") | (F.col("raw_size") <= 0)), "bad chunk"),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out


def bad_layouts(files: DataFrame, refs: DataFrame, chunks: DataFrame, chunk_size: int, keys: list[str]) -> DataFrame:
    """(keys, fault) of each file whose chunks can't make up the file: their numbers or offsets have gaps, a length is not
    that of its chunk or out of bounds, or the sum isn't the file's size. `refs` have sequence_number, chunk_hash, raw_offset
    and raw_length, `chunks` hash, raw_size and stored_size; a file without chunks is empty.

    A file's rows are narrow, and their sort spills, so a file of any number of chunks can be checked.
    """
    limit, w = most_stored(chunk_size), Window.partitionBy(*keys).orderBy("sequence_number")
    met = refs.join(chunks.select(F.col("hash").alias("chunk_hash"), "raw_size", "stored_size"), "chunk_hash", "left")
    seen = met.withColumn("k", F.row_number().over(w) - 1).withColumn("before", F.coalesce(F.sum("raw_length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sized = F.coalesce((F.col("raw_length") == F.col("raw_size")) & (F.col("stored_size") > 0) & (F.col("stored_size") <= limit), F.lit(False))
    per = seen.groupBy(*keys).agg(
        F.bool_and(F.col("sequence_number") == F.col("k")).alias("counted"), F.bool_and(F.col("raw_offset") == F.col("before")).alias("placed"),
        F.bool_and(sized & (F.col("raw_length") > 0) & (F.col("raw_length") <= chunk_size)).alias("bounded"), F.sum("raw_length").alias("total"),
    )
    fault = (
        F.when(F.col("total").isNull(), F.when(F.col("logical_size") != 0, "size")).when(~F.col("counted"), "sequence").when(~F.col("bounded"), "bounds")
        .when(~F.col("placed"), "offset").when(F.col("total") != F.col("logical_size"), "size")
    )
    return files.select(*keys, "logical_size").join(per, keys, "left").select(*keys, fault.alias("fault")).where("fault is not null")


def reusable(known: DataFrame, chunk_size: int) -> DataFrame:
    """(hash, state) of known objects, rows (hash, object_path, raw_size, expected_size, stored_size, actual_size): the first
    of path, conflict, bounds, missing and size that holds, else reusable."""
    state = (
        F.when(~is_hash("hash") | (F.col("object_path") != object_path("hash")), "path").when(F.col("raw_size") != F.col("expected_size"), "conflict")
        .when((F.col("stored_size") <= 0) | (F.col("stored_size") > most_stored(chunk_size)), "bounds").when(F.col("actual_size").isNull(), "missing")
        .when(F.col("actual_size") != F.col("stored_size"), "size").otherwise("reusable")
    )
    return known.select("hash", state.alias("state"))


def upsert_chunks(stored: DataFrame, offered: DataFrame) -> DataFrame:
    """(hash, raw_size, state): offered chunks are new, equal to the stored one, or in conflict with it."""
    one = offered.groupBy("hash").agg(F.min("raw_size").alias("raw_size"), F.max("raw_size").alias("top"))
    met = one.join(stored.select("hash", F.col("raw_size").alias("stored_size")), "hash", "left")
    state = F.when((F.col("raw_size") != F.col("top")) | (F.col("stored_size") != F.col("raw_size")), "conflict").when(F.col("stored_size").isNull(), "new").otherwise("equal")
    return met.select("hash", "raw_size", state.alias("state"))
