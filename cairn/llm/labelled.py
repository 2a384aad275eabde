"""Folds of labelled documents, and models that are fitted on all of them in parts and then broadcast."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import stage


def remainder(id_col: str, modulus: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)


#: About so many bytes of text in a part that one task trains on; there are as many parts as that takes.
TRAIN_BYTES = 64 << 20
#: Labelled ids that may be broadcast.
IDS = 200_000


def chance(*columns: str) -> Column:
    """A number from 0 to 1 that depends on the columns alone."""
    return (F.xxhash64(*columns).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int) -> DataFrame:
    """(doc_id, text, y): every labelled document outside the held-out fold, staged on disk (drop_stage when done).

    A doc_id that is labelled twice counts once, with its larger label; of rows that repeat a doc_id the largest text counts.
    """
    free = remainder("doc_id", modulus) != held
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & free).groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.col("doc_id").isNotNull() & free)
    if known.count() <= IDS:  # so few that no text need be shuffled to find them
        known = F.broadcast(known)
    return stage(texts.join(known, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y")), "training")


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    return buffer.getvalue()


def unpacked(body: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(bytes(body))))


def parts_of(rows: DataFrame, most_rows: int, most_bytes: int = TRAIN_BYTES) -> int:
    """The number of parts of about `most_rows` rows and `most_bytes` bytes of text, or fewer, that `rows` make."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return max(1, -(-n // most_rows), -(-size // most_bytes))


def fit(rows: DataFrame, trainer: Callable[[Iterator[pa.RecordBatch]], dict[str, np.ndarray]], most_rows: int) -> dict[str, np.ndarray]:
    """The mean of the models that `trainer` makes of parts of `rows`, dealt by a hash of doc_id; every row is in one part.

    A part has about `most_rows` rows and TRAIN_BYTES of text, or fewer, in the order of a hash of doc_id, and is one task's
    work. Rows that fit in one part give that part's model. Models are summed up in a task, so one comes to the driver.
    """
    parts = parts_of(rows, most_rows)
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", F.lit(parts)), F.lit(parts)).alias("part"), chance("doc_id").alias("at"), "doc_id", "text", "y")

    def run(own: pa.Table) -> pa.Table:
        own = own.sort_by([("at", "ascending"), ("doc_id", "ascending")])
        return pa.table({"part": own["part"][:1].cast(pa.int64()), "model": pa.array([packed(trainer(iter(own.to_batches())))], pa.binary())})

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = {}, 0
        for batch in batches:
            for body in batch.column(1):
                for name, x in unpacked(body.as_py()).items():
                    total[name] = total[name] + x if n else x.astype(np.float64)
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([packed({k: (v / n).astype(np.float32) for k, v in total.items()})], pa.binary())], ["model"])

    models = dealt.groupBy("part").applyInArrow(run, "part bigint, model binary")
    body = models.repartition(1).sortWithinPartitions("part").mapInArrow(mean, "model binary").collect()
    return unpacked(body[0].model) if body else trainer(iter(()))


def share(docs: DataFrame, model: dict[str, np.ndarray]) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast(model)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights (last: the constant) of a small logistic regression, by damped Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (p - y) + ridge * w)
        w -= step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return w
