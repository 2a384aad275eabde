"""Toxicity: two Kneser-Ney bigram models, of toxic and of ordinary text, over shared backoff counts.

In each class a word follows another with its discounted bigram count, and what the discount leaves goes to the word's own
probability in the class: its discounted number of different words before it, and what that leaves goes to one distribution
by the continuation counts of both classes together. Every discount's mass is that of its own class and context, so each
class model sums to one; an expression that neither class has seen much speaks for neither.

A text is judged by its two log-likelihoods per word: over the whole text and over its worst passages of WINDOWS words, as
a few words make a long text toxic. These differences and the length are turned into a probability by a logistic fit on a
quarter of the training texts, chosen by a hash of the text, which the counts don't use. Copies of a text count once in a
class. All labelled rows are counted, in tasks that each have the bigrams of a bucket of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.labelled import logistic, packed, parts_of, remainder, share, training_rows, unpacked
from cairn.llm.textbytes import ALNUM, LOWER, mix, slices, span_hashes, spans
from cairn.session import drop_stage, ship

#: About so many bytes of text have their bigrams in a bucket; words whose bigrams a task holds before it sends them on.
BUCKET_BYTES, HELD_WORDS = 16 << 20, 1 << 20
#: What is taken off each word's number of contexts and each bigram's count; words in a passage.
DISCOUNT, PAIR_DISCOUNT, WINDOWS = 3.0, 12.0, (1, 4, 16)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, bigram hashes (with the word before, or a start sign) and row offsets; A-Z are lower-cased."""
    low = LOWER[data]
    start, end, first = spans(low, off, ALNUM)
    w = span_hashes(low, start, end)
    before = np.concatenate([[np.uint64(1)], w[:-1]]) if len(w) else w
    head = first[:-1][np.diff(first) > 0]
    before[head] = 1
    return w, mix(before * np.uint64(3) ^ w), first


def _find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each x in the sorted keys; len(keys) where it is missing."""
    if not len(keys):
        return np.zeros(len(x), dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, len(keys))


def discounts(n: np.ndarray, place: np.ndarray, size: int, least: float, total: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(discounted shares, shares left) of the two columns of counts `n` that stand at `place`, in each of `size` places.

    What is taken off is `least` in the class that is left more by that, and in the other class so much more that it is left
    the same, which bisection finds. So each class sums to one, and what neither has seen speaks for neither, although one
    class is larger. A place that a class hasn't seen leaves all to both. Where each place's `total` is given, counts up to
    `least`, which are taken off whole, needn't be among `n`.
    """
    per = lambda x, at: np.stack([np.bincount(at, weights=x[:, c], minlength=size) for c in (0, 1)], 1)
    total, more = per(n, place) if total is None else total, np.flatnonzero(n.max(1, initial=0) > least)  # the others are taken off whole
    some, at = n[more], place[more]
    rest = total - per(some, at)
    left = lambda off: np.where(total > 0, (rest + per(np.minimum(some, off[at]), at)) / np.maximum(total, 1), 1.0)
    low = np.full((size, 2), least)
    first = left(low)
    goal, high = first.max(1, keepdims=True), np.full((size, 2), n.max(initial=0) + least)
    for _ in range(40):
        middle = (low + high) / 2
        short = left(middle) < goal
        low, high = np.where(short, middle, low), np.where(short, high, middle)
    off = np.where(first >= goal, least, high)
    share = np.zeros_like(n)
    share[more] = np.maximum(some - off[at], 0) / np.maximum(total, 1)[at]
    return share, left(off)


def estimate(w: np.ndarray, b: np.ndarray, before: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Tables of the two models (column 0 ordinary, 1 toxic), from words, their bigrams and the words before (1: none).

    Bigrams count by the different words before them too, like words: a passage that repeats, or that near copies share,
    then counts once.

    word: sorted words and start sign; uni: their probabilities in each class, and in a last row that of any unseen word;
    left: what a context leaves to uni, 1 for an unseen one; pair, over: bigrams with a discounted count, over the count of
    their context. Bigrams without one have no row, as nothing is lost by that.
    """
    word = np.unique(np.append(w, np.uint64(1)))
    pair, one, at = np.unique(b, return_index=True, return_inverse=True)
    three = mix(np.concatenate([b[:1], b[:-1]]) * (before != 1) * np.uint64(5) ^ b)
    n = np.zeros((len(pair), 2))
    for c in (0, 1):
        mine = np.flatnonzero(y == c)
        n[:, c] = np.bincount(at[mine[np.unique(three[mine], return_index=True)[1]]], minlength=len(pair))
    own, context = _find(word, w)[one], _find(word, before)[one]
    # words by the number of different words before them, in each class and over both
    apart = np.stack([np.bincount(own, weights=n[:, c] > 0, minlength=len(word)) for c in (0, 1)], 1)
    return tables(word, apart, pair, context, n)


def tables(word: np.ndarray, apart: np.ndarray, pair: np.ndarray, context: np.ndarray, n: np.ndarray, total: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """estimate()'s tables from counts: of the different words before each word, and of bigrams `pair` (sorted) by the places
    of their contexts. Bigrams of PAIR_DISCOUNT or less may be left out where the contexts' `total` is given."""
    shared = (np.append(apart.sum(1), 0) + 1) / (apart.sum() + len(word) + 1)
    own_share, spare = discounts(apart, np.zeros(len(word), np.int64), 1, DISCOUNT)
    uni = np.vstack([own_share, [[0, 0]]]) + spare * shared[:, None]
    # what a context leaves to the words alone
    over, left = discounts(n, context, len(word), PAIR_DISCOUNT, total)
    kept = over.sum(1) > 0
    return {"word": word, "uni": uni, "left": np.vstack([left, [[1, 1]]]), "pair": pair[kept], "over": np.vstack([over[kept], [[0, 0]]])}


def telling(model: dict[str, np.ndarray], apart: np.ndarray, of_pairs: np.ndarray) -> dict[str, np.ndarray]:
    """The model without words that tell no more than unseen ones: of few words before them and in none of the bigrams kept
    (`of_pairs`: the places of words that are). Both classes have such a word in the same proportion as an unseen one, so no
    evidence changes, and what is broadcast doesn't grow with every rare word."""
    keep = apart.max(1, initial=0) > DISCOUNT
    keep[of_pairs] = True
    keep[_find(model["word"], np.array([1], dtype=np.uint64))] = True
    every = np.append(keep, True)
    return model | {"word": model["word"][keep], "uni": model["uni"][every], "left": model["left"][every]}


def probabilities(model: dict[str, np.ndarray], w: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
    """words x 2: each word's probability after the one before it, in ordinary and in toxic text."""
    at = _find(model["word"], w)
    before = np.concatenate([at[:1], at[:-1]])
    before[first[:-1][np.diff(first) > 0]] = _find(model["word"], np.array([1], dtype=np.uint64))[0]
    return model["over"][_find(model["pair"], b)] + model["left"][before] * model["uni"][at]


def evidence(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per row: how far the toxic log-likelihood per word exceeds the ordinary one, over the whole text and over the worst
    passage of each length (the whole text where that is shorter); and the log of the length."""
    n = np.diff(first)
    sums = np.concatenate([[0.0], np.cumsum(np.log(p[:, 1]) - np.log(p[:, 0]))])
    whole = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1)
    out = [whole]
    row = np.repeat(np.arange(len(n)), n)
    for width in WINDOWS:
        start = np.arange(len(p))
        fits = start + width <= first[1:][row]
        mean = np.where(fits, (sums[np.minimum(start + width, len(p))] - sums[:-1]) / width, -np.inf)
        worst = whole.copy()
        if len(p):
            full = n > 0
            most = np.maximum.reduceat(mean, first[:-1][full])
            worst[full] = np.where(n[full] >= width, most, whole[full])
        out.append(worst)
    return np.stack([*out, np.log1p(n)], 1)


def _late() -> Column:
    """Whether a text is for the logistic fit."""
    return F.pmod(F.xxhash64("text"), F.lit(4)) == 3


def _bigrams(buckets: int) -> object:
    """Rows (bucket, body) of packed arrays: the two words of a bucket's bigrams, and in each class the number of different
    words before each bigram and 32 bits of a hash of each of these, bigram by bigram."""

    def packs(w: np.ndarray, b: np.ndarray, before: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        three = mix(np.concatenate([b[:1], b[:-1]]) * (before != 1) * np.uint64(5) ^ b)
        one = np.concatenate([m[np.unique(three[m], return_index=True)[1]] for m in (np.flatnonzero(y == c) for c in (0, 1))])
        pair, first, at = np.unique(b[one], return_index=True, return_inverse=True)
        own, context = w[one][first], before[one][first]
        of = (pair % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((at, y[one]))  # by class, then by bigram
        n = [np.bincount(at[y[one] == c], minlength=len(pair)) for c in (0, 1)]
        low, of_three = (three[one[order]] & np.uint64(0xFFFFFFFF)).astype(np.uint32), of[at[order]]
        cut = int(n[0].sum())
        ids, bodies = np.unique(of), []
        for k in ids:
            p = of == k
            each = {f"n{c}": n[c][p].astype(np.uint32) for c in (0, 1)}
            bodies.append(packed({"own": own[p], "context": context[p], **each, "t0": low[:cut][of_three[:cut] == k], "t1": low[cut:][of_three[cut:] == k]}))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bodies, pa.binary())], ["bucket", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part, data, off in slices(batches, "text"):
            w, b, first = words(data, off)
            size = np.diff(first)
            before = np.concatenate([[np.uint64(1)], w[:-1]]) if len(w) else w
            before[first[:-1][size > 0]] = 1
            held.append((w, b, before, np.repeat(part.column(1).to_numpy().astype(np.int64), size)))
            n += len(w)
            if n >= HELD_WORDS:
                yield packs(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield packs(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _count(own: pa.Table) -> pa.Table:
    """Counts of a bucket, rows (kind, key, own, context, v0, v1, v2, v3): of its words (kind 0: in both classes the number of
    different words before them, and their bigrams as contexts), and bigrams with more than PAIR_DISCOUNT (kind 1)."""
    held = [unpacked(x.as_py()) for x in own["body"]]
    word, context = (np.concatenate([h[x] for h in held]) for x in ("own", "context"))
    pair, first, at = np.unique(mix(context * np.uint64(3) ^ word), return_index=True, return_inverse=True)
    word, context = word[first], context[first]
    ends = np.cumsum([0, *(len(h["own"]) for h in held)])
    n = np.zeros((len(pair), 2))
    for c in (0, 1):
        places = [np.repeat(at[ends[k] : ends[k + 1]].astype(np.uint64), h[f"n{c}"]) for k, h in enumerate(held)]
        three = np.unique(np.concatenate(places) << np.uint64(32) | np.concatenate([h[f"t{c}"] for h in held]))
        n[:, c] = np.bincount((three >> np.uint64(32)).astype(np.int64), minlength=len(pair))
    names = np.union1d(word, context)
    per = [np.bincount(np.searchsorted(names, key), weights=x[:, c], minlength=len(names)) for key, x in ((word, n > 0), (context, n)) for c in (0, 1)]
    big = n.max(1) > PAIR_DISCOUNT
    none, zero = np.zeros(len(names), dtype=np.uint64), np.zeros(int(big.sum()))
    keys = [np.concatenate(x).view(np.int64) for x in ((names, pair[big]), (none, word[big]), (none, context[big]))]
    values = [np.concatenate(x) for x in zip(per, [n[big, 0], n[big, 1], zero, zero], strict=True)]
    kind = np.repeat(np.array([0, 1], dtype=np.int32), [len(names), len(zero)])
    return pa.table({"kind": kind, **dict(zip(("key", "own", "context"), keys, strict=True)), **{f"v{k}": v for k, v in enumerate(values)}})


def _model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The two models, from all counts."""
    none = [np.zeros(0, t) for t in (np.int32, np.int64, np.int64, np.int64, float, float, float, float)]
    got = [[b.column(k).to_numpy() for k in range(8)] for b in batches if b.num_rows] or [none]
    kind, key, own, context, *v = (np.concatenate(x) for x in zip(*got, strict=True))
    key, own, context = (np.ascontiguousarray(x).view(np.uint64) for x in (key, own, context))
    v, is_word = np.stack(v, 1), kind == 0
    word = np.unique(np.append(key[is_word], np.uint64(1)))
    counts = np.zeros((len(word), 4))
    counts[_find(word, key[is_word])] = v[is_word]
    order = np.argsort(key[~is_word])
    pair, own, context, n = (x[~is_word][order] for x in (key, own, context, v))
    at, before = _find(word, own), _find(word, context)
    model = telling(tables(word, counts[:, :2], pair, before, n[:, :2], counts[:, 2:]), counts[:, :2], np.concatenate([at, before]))
    yield pa.RecordBatch.from_arrays([pa.array([packed(model)], pa.binary())], ["model"])


def _calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(np.stack(b.column(0).to_numpy(zero_copy_only=False)), b.column(1).to_numpy()) for b in batches if b.num_rows]
    k = 2 + len(WINDOWS)
    x, y = (np.concatenate(z) for z in zip(*got, strict=True)) if got else (np.zeros((0, k)), np.zeros(0))
    mean, sd = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(k), np.ones(k))
    fitted = logistic((x - mean) / sd, y) if len(x) else np.zeros(k + 1)
    yield pa.RecordBatch.from_arrays([pa.array([packed({"mean": mean, "sd": sd, "fit": fitted})], pa.binary())], ["model"])


def _evidence(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in slices(batches, "text"):
            w, b, first = words(data, off)
            x = evidence(probabilities(model.value, w, b, first), first)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), part.column(1).cast(pa.int32())], ["x", "y"])

    return run


def fitted(rows: DataFrame) -> dict[str, np.ndarray]:
    """Both models and the logistic fit, from all (text, y) rows. Only the finished tables come to the driver."""
    own = rows.select("text", "y")
    packs = own.where(~_late()).mapInArrow(_bigrams(parts_of(rows, 1 << 62, BUCKET_BYTES)), "bucket bigint, body binary")
    counts = packs.groupBy("bucket").applyInArrow(_count, "kind int, key bigint, own bigint, context bigint, v0 double, v1 double, v2 double, v3 double")
    summed = counts.groupBy("kind", "key", "own", "context").agg(*(F.sum(f"v{k}").alias(f"v{k}") for k in range(4)))
    body = summed.repartition(1).mapInArrow(_model, "model binary").collect()
    model = unpacked(body[0].model if body else next(_model(iter(()))).column(0)[0].as_py())
    late = own.where(_late()).mapInArrow(_evidence(share(rows, model)), "x array<double>, y int")
    body = late.repartition(1).sortWithinPartitions("y", "x").mapInArrow(_calibrate, "model binary").collect()
    return model | unpacked(body[0].model if body else next(_calibrate(iter(()))).column(0)[0].as_py())


def scores(m: dict[str, np.ndarray], data: np.ndarray, off: np.ndarray) -> np.ndarray:
    w, b, first = words(data, off)
    x = (evidence(probabilities(m, w, b, first), first) - m["mean"]) / m["sd"]
    return 1 / (1 + np.exp(-np.clip(x @ m["fit"][:-1] + m["fit"][-1], -30, 30)))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores(model.value, data, off))], ["doc_id", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, held: int = 1) -> dict[str, np.ndarray]:
    """Fit both models on all labelled documents outside the fold `held`. Without rows every score is 0.5."""
    ship(docs.sparkSession)
    rows = training_rows(docs, labels, label, modulus, held)
    model = fitted(rows)
    drop_stage(rows)
    return model


def score(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, score) for each row, from the whole text.

    Null, empty and wordless texts get the score of a text that says nothing for either class. Repeated rows are scored
    one by one, an empty table gives no rows, and other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_score(share(docs, model)), "doc_id bigint, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of `docs`; a row without a doc_id is in no fold (held_out false)."""
    out = score(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
