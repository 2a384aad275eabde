"""Document quality: logistic regression on hashed word n-grams, fitted with follow-the-regularised-leader updates.

A document's terms are its words (runs of letters and digits), its runs of other signs, bigrams of both and trigrams
of word shapes; a word that repeats the one before it counts as a repeat sign. Terms are hashed into 2^18 cells, counts
damped by a square root and the row scaled to length one, so a score is one sparse dot product. Labelled rows are dealt to
tasks, and the weights that each task comes to are averaged, so all of them count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.labelled import fit, remainder, share, training_rows
from cairn.llm.textbytes import ALNUM, NOT_SPACE, mix, slices, span_hashes, spans
from cairn.session import drop_stage, ship

CELLS = 1 << 18
#: Labelled rows, about, that one task trains on; of more rows the tasks' weights are averaged.
PART_ROWS = 8000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.1, 3

_CLASS = np.zeros(256, dtype=np.uint8)  # 0 white, 1 word, 2 sign
_CLASS[NOT_SPACE] = 2
_CLASS[ALNUM] = 1
_REPEAT = np.uint64(0x5851F42D4C957F2D)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, shapes and row offsets of the runs of words and of signs, in the order of the text."""
    s1, e1, f1 = spans(data, off, ALNUM)
    s2, e2, f2 = spans(data, off, NOT_SPACE & ~ALNUM)
    start, end = np.concatenate([s1, s2]), np.concatenate([e1, e2])
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    sums = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    upper = sums[end] - sums[start]
    digit = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    size = end - start
    shape = np.where(_CLASS[data[start]] == 2, 1, np.where(digit[end] - digit[start] > 0, 2, np.where(upper == 0, 3, np.where((upper == size) & (size > 1), 4, 5)))).astype(np.uint64)
    return span_hashes(data, start, end), shape, f1 + f2


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, value, row offsets) of every row's sparse vector of length one."""
    word, shape, first = tokens(data, off)
    n, rows = len(word), len(off) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    term = word.copy()
    same = np.zeros(n, dtype=bool)
    same[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    term[same] = _REPEAT
    parts, owner = [term], [row]
    if n > 1:
        pair = row[1:] == row[:-1]
        parts.append(mix(term[:-1] * np.uint64(3) ^ term[1:])[pair])
        owner.append(row[1:][pair])
    if n > 2:
        three = row[2:] == row[:-2]
        s = np.where(same, np.uint64(6), shape)
        parts.append(mix((s[:-2] * np.uint64(64) + s[1:-1] * np.uint64(8) + s[2:]) + np.uint64(1 << 40))[three])
        owner.append(row[2:][three])
    cell = (np.concatenate(parts) >> np.uint64(46)).astype(np.int64)
    key, count = np.unique(np.concatenate(owner) * CELLS + cell, return_counts=True)
    value = np.sqrt(count)
    at = np.searchsorted(key, np.arange(rows + 1) * CELLS)
    norm = np.sqrt(np.add.reduceat(np.concatenate([count, [0]]).astype(float), at[:-1])) if rows else np.zeros(0)
    return key % CELLS, value / np.repeat(norm, np.diff(at)), at


def ftrl(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
    """Weights after EPOCHS passes over the (text, y) rows in the given order; the constant is the last weight."""
    rows = []
    for part, data, off in slices(batches, "text"):
        cell, value, at = features(data, off)
        y = part.column(part.schema.get_field_index("y")).to_numpy()
        rows += [(np.append(cell[at[i] : at[i + 1]], CELLS).astype(np.int32), np.append(value[at[i] : at[i + 1]], 1.0).astype(np.float32), int(y[i])) for i in range(len(y))]
    z, n = np.zeros(CELLS + 1), np.zeros(CELLS + 1)
    order = np.random.Generator(np.random.PCG64(5))

    def weights(i) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            i, x, y = rows[k]
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    return {"w": weights(slice(None)).astype(np.float32)}


def dots(w: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Likelihood of label 1 of each row: the sparse dot product of its terms with the weights."""
    cell, value, at = features(data, off)
    dot = np.add.reduceat(np.concatenate([w[cell] * value, [0.0]]), at[:-1]) * (np.diff(at) > 0) + w[CELLS]
    return 1 / (1 + np.exp(-np.clip(dot, -30, 30)))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value["w"].astype(np.float64)
        for part, data, off in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(dots(w, data, off))], ["doc_id", "score"])

    return run


def _keep(model, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value["w"].astype(np.float64)
        for part, data, off in slices(batches, "text"):
            yield part.filter(pa.array(dots(w, data, off) >= least))

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held: int = 2) -> dict[str, np.ndarray]:
    """Fit on all labelled documents outside the fold `held`. Without such rows every score is 0.5."""
    ship(docs.sparkSession)
    rows = training_rows(docs, labels, label, modulus, held)
    model = fit(rows, ftrl, PART_ROWS)
    drop_stage(rows)
    return model


def score(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, score) for each row: the likelihood of label 1, from the whole text.

    Null and empty texts get the score of the constant alone. Repeated rows are scored one by one, an empty table gives
    no rows, and other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_score(share(docs, model)), "doc_id bigint, score double")


def keep(docs: DataFrame, model: dict[str, np.ndarray], least: float) -> DataFrame:
    """The rows of `docs`, all columns as they are, that score at least `least`; decided in the pass that scores."""
    ship(docs.sparkSession)
    return docs.mapInArrow(_keep(share(docs, model), least), docs.schema)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of `docs`; a row without a doc_id is in no fold (held_out false)."""
    out = score(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
