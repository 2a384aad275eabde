"""Directory trees as tables: closures, selections and restore plans, by equi-joins on exploded ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.paths import ancestors, entry_name, parent_path, path_depth


def with_directories(files: DataFrame, *, size: Column, digest: Column) -> DataFrame:
    """Entries of a snapshot: its files and every directory above them, the root '' included."""
    shape = ["snapshot_id", "relative_path"]
    leaves = files.select(*shape, F.lit("file").alias("entry_type"), size.cast("long").alias("logical_size"), digest.alias("file_hash"))
    above = files.select("snapshot_id", F.explode(F.concat(F.array(F.lit("")), ancestors("relative_path"))).alias("relative_path")).distinct()
    folders = above.select(*shape, F.lit("directory").alias("entry_type"), F.lit(0).cast("long").alias("logical_size"), F.lit(None).cast("string").alias("file_hash"))
    return leaves.unionByName(folders).select(*shape, parent_path("relative_path").alias("parent_path"), entry_name("relative_path").alias("name"), "entry_type", "logical_size", "file_hash")


def ancestor_closure(entries: DataFrame) -> DataFrame:
    """Distinct (snapshot_id, relative_path) of all directories above the entries, without the root."""
    return entries.select("snapshot_id", F.explode(ancestors("relative_path")).alias("relative_path")).distinct()


def descendants(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries at or below the (snapshot_id, root) rows: each entry offers itself and its ancestors as join keys."""
    keyed = entries.withColumn("root", F.explode(F.concat(ancestors("relative_path"), F.array("relative_path"))))
    return keyed.join(roots.distinct(), ["snapshot_id", "root"], "left_semi").drop("root").distinct()


def select_for_restore(entries: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested subtrees, the directories above them, and the root."""
    below = descendants(entries, requested.withColumnRenamed("relative_path", "root"))
    above = below.select("snapshot_id", F.explode(F.concat(F.array(F.lit("")), ancestors("relative_path"))).alias("relative_path"))
    wanted = below.select("snapshot_id", "relative_path").unionByName(above).distinct()
    return entries.join(wanted, ["snapshot_id", "relative_path"], "left_semi")


def restore_actions(entries: DataFrame, existing: DataFrame, on_conflict: str = "skip") -> DataFrame:
    """create, merge, replace or skip for each entry; a skipped directory skips all below it.

    `existing` has (relative_path, existing_type) of the destination. A directory on a directory merges.
    """
    met = entries.join(existing, "relative_path", "left")
    own = met.withColumn("action", F.when(F.col("existing_type").isNull(), "create").when((F.col("entry_type") == "directory") & (F.col("existing_type") == "directory"), "merge").otherwise(on_conflict))
    shut = own.where("entry_type = 'directory' and action = 'skip'").select("snapshot_id", F.col("relative_path").alias("above"))
    under = own.select("snapshot_id", "relative_path", F.explode(ancestors("relative_path")).alias("above")).join(shut, ["snapshot_id", "above"], "left_semi").select("snapshot_id", "relative_path").distinct().withColumn("shut", F.lit(True))
    return own.join(under, ["snapshot_id", "relative_path"], "left").withColumn("action", F.when(F.col("shut"), "skip").otherwise(F.col("action"))).drop("shut", "existing_type")


def plan_order(entries: DataFrame, deepest_first: bool = False) -> DataFrame:
    depth = path_depth("relative_path")
    return entries.orderBy(depth.desc() if deepest_first else depth.asc(), "relative_path")
