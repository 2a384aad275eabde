"""Near-duplicate documents by min-max hashing.

Every hash function yields two signature values, the least and the greatest hash of a document's shingles, so 100
evaluations fill 200 values. Bands of five values from five different functions (40 bands) bring together a pair of
similarity 0.8 with probability 1 - 1e-7. Documents with equal shingle sets are one class from the start. In each
bucket the members are held against the bucket's smallest class, its hub. What then still lies in different components
beside one hub is compared as well, unless an exact bound rules the pair out: the triangle inequality of the Jaccard
distance over the hub, or bitmaps of the two sets, whose common cells bound what the sets can share. A hub's classes are
dealt to blocks of at most SIDE by SIDE for that, so no task gets a whole hub. No member is dropped and no group of copies is
expanded into all its pairs. Links are confirmed on whole sets of shingle hashes (64 bits; classes of equal sets go by two
sums of these and the size).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.graph import components
from cairn.llm.textbytes import LOWER, NOT_SPACE, distinct_per_row, mix, shingles, slices, span_hashes, spans
from cairn.session import drop_stage, ship, stage

FUNCTIONS, ROWS, BANDS = 100, 5, 40
#: Ids that may be broadcast: 8 bytes each, so at most about 8 MB.
BROADCAST_IDS = 1_000_000
#: A set's bitmap, in longs; classes of one hub on each side of a block of comparisons.
WORDS, SIDE = 32, 256

_A = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes per row; words are blank-separated, with A-Z lower-cased."""
    low = LOWER[data]
    start, end, first = spans(low, off, NOT_SPACE)
    values, at = shingles(span_hashes(low, start, end), first, width)
    return distinct_per_row(values, at)


def signature(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """rows x 2*FUNCTIONS: minima, then maxima. Every row must have a shingle."""
    out = np.empty((len(off) - 1, 2 * FUNCTIONS), dtype=np.uint64)
    for j in range(FUNCTIONS):
        h = sets * _A[j]
        out[:, j] = np.minimum.reduceat(h, off[:-1])
        out[:, FUNCTIONS + j] = np.maximum.reduceat(h, off[:-1])
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.empty((len(sig), BANDS), dtype=np.uint64)
    for k in range(BANDS):
        acc = np.full(len(sig), k + 1, dtype=np.uint64)
        for j in range(k * ROWS, (k + 1) * ROWS):
            acc = mix(acc * np.uint64(0x9FB21C651E98DF25) ^ sig[:, j])
        keys[:, k] = acc
    return keys


def set_keys(sets: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    """Two 64-bit sums that name each row's set; 0 for empty ones."""
    sums = [np.add.reduceat(np.concatenate([mix(sets ^ np.uint64(s)), [np.uint64(0)]]), at[:-1]) for s in (11, 23)]
    return [pa.array(np.where(np.diff(at) > 0, s, 0).astype(np.uint64).view(np.int64)) for s in sums]


def _sketch(id_col: str, text_col: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in slices(batches, text_col):
            sets, at = shingle_sets(data, off, width)
            n = np.diff(at)
            full = np.flatnonzero(n)
            bands = np.zeros((int(len(full)), BANDS), dtype=np.uint64)
            if len(full):
                bands = band_keys(signature(sets, np.concatenate([at[:-1][full], [len(sets)]])))
            list_at = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(list_at), pa.array(bands.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(id_col)), pa.array(n.astype(np.int64)), *set_keys(sets, at), lists], ["doc_id", "n_shingles", "k1", "k2", "bands"])

    return run


def _sets(width: int):
    """Each row's set, its keys and size, how many of its shingles share a cell with another, and its cells as WORDS longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in slices(batches, "text"):
            v, at = shingle_sets(data, off, width)
            n, cells = np.diff(at), 64 * WORDS
            key = np.unique(np.repeat(np.arange(len(n)), n) * cells + (v % np.uint64(cells)).astype(np.int64))
            row, cell = key // cells, key % cells
            words = np.zeros(len(n) * WORDS, dtype=np.uint64)
            np.bitwise_or.at(words, row * WORDS + cell // 64, np.uint64(1) << (cell % 64).astype(np.uint64))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(v.view(np.int64)))
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * WORDS), pa.array(words.view(np.int64)))
            lost = n - np.bincount(row, minlength=len(n))
            yield pa.RecordBatch.from_arrays([rows.column(0), *set_keys(v, at), lists, pa.array(n.astype(np.int64)), pa.array(lost.astype(np.int64)), bits], ["doc_id", "k1", "k2", "shingles", "n", "lost", "bits"])

    return run


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shared, united) on whole sets, for each of `pairs`; row by row, so that no batch of sets is held."""
    one = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    two = one.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    shared = two.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("shared"), (F.size("x") + F.size("y")).cast("long").alias("both"))
    return shared.select("a", "b", "shared", (F.col("both") - F.col("shared")).alias("united"))


def stage_of(table: DataFrame, name: str, done: list[DataFrame]) -> DataFrame:
    done.append(stage(table, name))
    return done[-1]


def few(ids: DataFrame) -> DataFrame:
    """The rows, to be broadcast if there are at most BROADCAST_IDS (of some 20 bytes), so that what they are joined with isn't
    dealt by their key."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def _blocks(full: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes beside one hub that no bound rules out and that aren't known to lie in one component.

    Classes outside the hub's largest component (p) meet all others (q). Each side of a hub is cut into parts of about SIDE
    by a hash, and a part of one side meets each part of the other as a group of its own.
    """
    size = full.groupBy("hub").agg(F.count(F.when(F.col("comp") != F.col("main"), 1)).alias("n_p"), F.count("*").alias("n_q"))
    parts = few(size.select("hub", F.expr(f"int(ceil(n_p / {SIDE}))").alias("parts_p"), F.expr(f"int(ceil(n_q / {SIDE}))").alias("parts_q")))
    rows = full.join(parts, "hub").withColumn("part", F.xxhash64("rep"))
    p = rows.where("comp <> main").withColumn("i", F.expr("int(pmod(part, parts_p))")).withColumn("j", F.explode(F.expr("sequence(0, parts_q - 1)"))).alias("p")
    q = rows.withColumn("j", F.expr("int(pmod(part, parts_q))")).withColumn("i", F.explode(F.expr("sequence(0, parts_p - 1)"))).alias("q")
    slack = (100 - percent) / 100 + 1e-9
    # two sets share at most their common cells and what the cells of one of them hide
    most = " + ".join(f"bit_count(p.bits[{k}] & q.bits[{k}])" for k in range(WORDS)) + " + least(p.lost, q.lost)"
    bound = f"p.comp <> q.comp and (q.comp = q.main or p.rep < q.rep) and abs(p.far - q.far) <= {slack} and {100 + percent} * ({most}) >= {percent} * (p.n + q.n)"
    met = p.join(q, F.expr(f"p.hub = q.hub and p.i = q.i and p.j = q.j and {bound}"))
    return met.select(F.least("p.rep", "q.rep").alias("a"), F.greatest("p.rep", "q.rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document; kept marks the smallest doc_id of its component.

    A set holds the distinct `width`-word shingles of the whole text, or the whole sequence where it has fewer words;
    documents link where 100 * shared >= percent * united. Null, empty and blank texts have no shingles and stand alone.
    Equal texts always share a component. Rows that repeat a doc_id give one row and count as one document, with the
    largest of their sets (ties by its hashes). Each row without a doc_id gives a row of its own, without a component and
    kept, and links with nothing. An empty table gives no rows. Other columns of `docs` are ignored. The result is written
    to the shared folder; all that led to it is deleted there.
    """
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    every = stage(base.mapInArrow(_sketch("doc_id", "text", width), "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>"), "minmax")
    done = [every]
    sketch = every.where("doc_id is not null")
    twice = sketch.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    repeated = not twice.isEmpty()
    if repeated:
        one = sketch.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct("n_shingles", "k1", "k2", "bands")).alias("x")).select("doc_id", "x.*")
        sketch = stage(sketch.join(twice, "doc_id", "left_anti").unionByName(one), "single")
        done.append(sketch)
    some = sketch.where("n_shingles > 0")
    classes = some.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    member = stage(some.select("doc_id", "k1", "k2", "n_shingles").join(classes, ["k1", "k2", "n_shingles"]).select("doc_id", "n_shingles", "rep"), "classes")

    # buckets of class representatives
    reps = some.join(member.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi")
    entry = reps.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("rep")).distinct()
    hubs = entry.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).where("hub < top").select("bucket", "hub")
    crowded = stage(entry.join(hubs, "bucket"), "buckets")
    pairs = stage(crowded.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")

    involved = crowded.select(F.col("rep").alias("doc_id")).distinct()
    texts = base.join(few(involved), "doc_id", "left_semi")
    sets = stage(texts.mapInArrow(_sets(width), "doc_id bigint, k1 bigint, k2 bigint, shingles array<bigint>, n bigint, lost bigint, bits array<bigint>"), "sets")
    done += [member, crowded, pairs, sets]
    if repeated:
        own = sketch.select("doc_id", "k1", "k2", F.col("n_shingles").alias("n"))
        sets = stage(sets.join(own, ["doc_id", "k1", "k2", "n"], "left_semi").dropDuplicates(["doc_id"]), "sets")
        done.append(sets)

    scored = stage(_confirm(pairs, sets), "scored")
    near = f"100 * shared >= {int(percent)} * united"
    links = scored.where(near).select("a", "b")
    comp = components(links)

    # classes that met one hub and are still apart
    star = scored.select(F.col("a").alias("hub"), F.col("b").alias("rep"), (1 - F.col("shared") / F.col("united")).alias("far"))
    star = star.unionByName(star.select("hub", F.col("hub").alias("rep"), F.lit(0.0).alias("far")).distinct())
    at = star.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    mixed = at.groupBy("hub").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("n")).where("c0 < c1 and n > 2").select("hub")
    apart = stage(at.join(few(stage_of(mixed, "mixed", done)), "hub"), "apart")
    main = apart.groupBy("hub", "comp").agg(F.count("*").alias("n")).groupBy("hub").agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("main"))
    maps = sets.select(F.col("doc_id").alias("rep"), "n", "lost", "bits")
    full = stage(apart.join(maps, "rep").join(few(stage_of(main, "main", done)), "hub"), "bitmaps")
    rest = _blocks(full, int(percent)).join(pairs, ["a", "b"], "left_anti")
    more = stage(_confirm(rest, sets).where(near).select("a", "b"), "linked")
    done += [scored, comp, apart, full, more]
    if not more.isEmpty():
        comp = components(links.unionByName(more))
        done.append(comp)
    sized = member.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("comp", "rep").alias("component_id"))
    alone = sketch.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    unnamed = every.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    out = sized.unionByName(alone).unionByName(unnamed)
    out = stage(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near")
    for table in done:
        drop_stage(table)
    return out
