"""Fixed-size chunks, deduplication and chunk layout checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chunks(files: DataFrame, size: int, content: str = "content") -> DataFrame:
    """The rows of `files` once per chunk, with sequence_number, raw_offset, raw_length and data instead of the content.

    Empty contents have no chunk; contents of an exact multiple of `size` have no empty tail.
    """
    n = F.octet_length(content).cast("long")
    rest = [c for c in files.columns if c != content]
    cut = files.where(n > 0).withColumn("sequence_number", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(octet_length({content}) - 1L) div {size}L"))))
    offset = F.col("sequence_number") * size
    return cut.select(*rest, "sequence_number", offset.alias("raw_offset"), F.least(F.lit(size).cast("long"), n - offset).alias("raw_length"), F.expr(f"substring({content}, cast(sequence_number * {size} + 1 as int), {size})").alias("data"))


def new_and_reused(refs: DataFrame, order: str = "snapshot_id") -> DataFrame:
    """Per snapshot: chunks whose hash no earlier snapshot holds (each hash once), and all other references.

    A hash is owned by the first snapshot that has it, so one aggregation per hash finds the owner and no window is needed.
    """
    owner = refs.groupBy("chunk_hash").agg(F.min(order).alias(order)).groupBy(order).agg(F.count("*").alias("new_chunk_count"))
    total = refs.groupBy(order).agg(F.count("*").alias("n_refs"))
    return total.join(owner, order, "left").select(order, F.coalesce("new_chunk_count", F.lit(0)).cast("long").alias("new_chunk_count"), (F.col("n_refs") - F.coalesce("new_chunk_count", F.lit(0))).alias("reused_chunk_count"))


def contiguity(refs: DataFrame, keys: list[str]) -> DataFrame:
    """Per file: whether sequence numbers count from 0 and each offset is the sum of the lengths before it."""
    w = Window.partitionBy(*keys).orderBy("sequence_number")
    seen = refs.withColumn("want_seq", F.row_number().over(w) - 1).withColumn("want_offset", F.coalesce(F.sum("raw_length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    good = (F.col("want_seq") == F.col("sequence_number")) & (F.col("want_offset") == F.col("raw_offset")) & (F.col("raw_length") > 0)
    return seen.groupBy(*keys).agg(F.count("*").alias("n_chunks"), F.sum("raw_length").alias("total_length"), F.bool_and(good).alias("contiguous"))
