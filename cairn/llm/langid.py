"""Language identification with hyperdimensional profiles.

Every letter (case folded) has a random vector of +1 and -1, drawn from a hash of its code point, so no two letters share
one. A trigram is bound as the product of its letters' vectors, each rotated by its place; a text bundles (sums) the
vectors of its trigrams, a language those of all its training texts. A text gets the language whose bundle has the highest
cosine with its own.

Vectors are kept as bits, so binding is an exclusive or; they are made for the trigrams at hand and not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.labelled import remainder
from cairn.llm.textbytes import mix, slices
from cairn.session import ship, stage

DIMENSIONS = 1024
#: Languages compared in one pass over the texts (64 MB of prototypes); more are done in further passes.
BLOCK = 16_384
#: Trigrams whose vectors are held at a time.
HELD = 4096
UNKNOWN = "und"

_CACHE: dict[str, np.ndarray] = {}


def alphabet() -> np.ndarray:
    """Each code point's letter: the code point of its lower case plus one, 0 unless it is a letter."""
    if "alphabet" not in _CACHE:
        table = np.zeros(0x110000, dtype=np.int32)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                table[c] = ord(x.lower()[0]) + 1
        _CACHE["alphabet"] = table
    return _CACHE["alphabet"]


def letter_bits(letters: np.ndarray) -> np.ndarray:
    """letters x DIMENSIONS bits (1 stands for -1); the gap, 0, is a sign like any other."""
    words = DIMENSIONS // 64
    seed = (letters.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return np.unpackbits(mix(mix(seed)).view(np.uint8), axis=1)


def bind(codes: np.ndarray) -> np.ndarray:
    """trigrams x DIMENSIONS/8 packed bits of the trigram vectors."""
    places = np.stack([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF])
    letters, at = np.unique(places, return_inverse=True)
    at = at.reshape(places.shape)
    out = np.zeros((len(codes), DIMENSIONS // 8), dtype=np.uint8)
    bits = letter_bits(letters)
    for k, turn in enumerate((2, 1, 0)):
        out ^= np.packbits(np.roll(bits, turn, axis=1), axis=1)[at[k]]
    return out


def bundle(code: np.ndarray, count: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Sum of count times the vectors (packed bits) of the given trigrams, a few at a time."""
    out = np.zeros(DIMENSIONS)
    for a in range(0, len(code), HELD):
        n = count[a : a + HELD].astype(np.float32)
        out += n.sum(dtype=np.float64) - 2.0 * (n @ np.unpackbits(vectors[code[a : a + HELD]], axis=1).astype(np.float32))
    return out


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, trigram) of every trigram of letters and gaps whose middle is a letter, and each row's number of letters."""
    text = data.tobytes().decode("utf-8", "replace")
    lead = (data & 0xC0) != 0x80
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    rows = len(off) - 1
    at = np.concatenate([[0], np.cumsum(lead)])[off]
    if len(points) != at[-1]:  # bytes that aren't UTF-8: decode row by row
        parts = [np.frombuffer(data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for i in range(rows)]
        points, at = np.concatenate([*parts, np.zeros(0, np.uint32)]).astype(np.uint32), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    # one gap before, between and after the rows
    s = np.zeros(len(points) + rows + 1, dtype=np.int32)
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(at))
    place = np.arange(len(points)) + 1 + row
    s[place] = alphabet()[points]
    owner = np.full(len(s), -1, dtype=np.int32)
    owner[place] = row
    owner[at[1:] + np.arange(rows) + 1] = np.arange(rows)
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] > 0) | (s[:-1] > 0) | (owner[1:] != owner[:-1])
    letters = np.bincount(row[s[place] > 0], minlength=rows)
    s, owner = s[keep].astype(np.int64), owner[keep]
    code = s[:-2] << 42 | s[1:-1] << 21 | s[2:] if len(s) > 2 else np.zeros(0, np.int64)
    mid = s[1:-1] > 0 if len(s) > 2 else np.zeros(0, bool)  # the middle one is a letter of its row
    return owner[1:-1][mid], code[mid], letters


def counted(row: np.ndarray, code: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigrams, place in them, count, row offsets) of the distinct trigrams of each row."""
    own, at = np.unique(code, return_inverse=True)
    key, count = np.unique(row.astype(np.int64) * max(len(own), 1) + at, return_counts=True)
    return own, key % max(len(own), 1), count, np.searchsorted(key, np.arange(rows + 1) * max(len(own), 1))


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial bundles, (lang, place, value); those held are sent on when they come to BLOCK / 16 languages."""
    held: dict[str, np.ndarray] = {}

    def send() -> Iterator[pa.RecordBatch]:
        for lang in sorted(held):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(np.rint(held[lang]).astype(np.int64))], ["lang", "place", "value"])
        held.clear()

    for part, data, off in slices(batches, "text"):
        names, which = np.unique(np.array(part.column(1).to_pylist(), dtype=object).astype(str), return_inverse=True)
        row, code, _ = grams(data, off)
        own, at, count, first = counted(which[row], code, len(names))
        vectors = bind(own)
        for k, lang in enumerate(names.tolist()):
            here = slice(first[k], first[k + 1])
            held[lang] = held.get(lang, 0.0) + bundle(at[here], count[here], vectors)
        if len(held) > BLOCK // 16:
            yield from send()
    yield from send()


def learn(rows: DataFrame) -> list[tuple[list[str], np.ndarray]]:
    """Blocks of languages, by name, with their prototypes (unit rows), from all (text, lang) rows whose lang isn't null.

    Partial bundles are whole numbers, summed before they are brought together, so the sums don't depend on the order.
    A block has at most BLOCK languages; nothing else reaches the driver but the languages' names.
    """
    ship(rows.sparkSession)
    some = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    langs = sorted(r.lang for r in some.select("lang").distinct().collect())
    blocks = []
    for k in range(0, len(langs), BLOCK):
        own = some.where((F.col("lang") >= langs[k]) & (F.col("lang") <= langs[min(k + BLOCK, len(langs)) - 1])) if len(langs) > BLOCK else some
        out = own.mapInArrow(_profiles, "lang string, place int, value bigint").groupBy("lang", "place").agg(F.sum("value").alias("value")).toArrow()
        names = sorted(set(out.column("lang").to_pylist()))
        proto = np.zeros((len(names), DIMENSIONS))
        index = {x: i for i, x in enumerate(names)}
        proto[[index[x] for x in out.column("lang").to_pylist()], out.column("place").to_numpy()] = out.column("value").to_numpy()
        size = np.linalg.norm(proto, axis=1)
        names = [x for x, n in zip(names, size, strict=True) if n > 0]
        if names:
            blocks.append((names, (proto[size > 0] / size[size > 0, None]).astype(np.float32)))
    return blocks


def similar(data: np.ndarray, off: np.ndarray, proto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the nearest prototype, its cosine, number of letters) of each row."""
    row, code, letters = grams(data, off)
    rows = len(off) - 1
    own, at, count, first = counted(row, code, rows)
    vectors = bind(own)
    best, score = np.zeros(rows, dtype=np.int64), np.zeros(rows)
    for i in np.flatnonzero(np.diff(first)):
        v = bundle(at[first[i] : first[i + 1]], count[first[i] : first[i + 1]], vectors)
        cos = proto @ (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)
        best[i] = cos.argmax()
        score[i] = cos[best[i]]
    return best, np.clip(score, 0, 1), letters


def _predict(model, least=None):
    """Adds lang_pred, score and n_letters, or betters them; with `least`, (letters, cosine) pairs, rows below it go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, proto = model.value
        for part, data, off in slices(batches, "text"):
            best, score, letters = similar(data, off, proto)
            lang, had = np.array(names, dtype=object)[best], part.column(part.schema.get_field_index("_score")).to_numpy()
            old = np.array(part.column(part.schema.get_field_index("_lang")).to_pylist(), dtype=object)
            better = (letters > 0) & ((score > had) | (old == UNKNOWN))
            lang, score = np.where(better, lang, old), np.where(better, score, had)
            columns = [*part.columns[:-3], pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(letters.astype(np.int64))]
            out = pa.RecordBatch.from_arrays(columns, part.schema.names)
            if least is not None:
                need = np.select([letters >= n for n, _ in least], [c for _, c in least])
                out = out.filter(pa.array((letters > 0) & (score >= need)))
            yield out

    return run


def _with_language(rows: DataFrame, model: list[tuple[list[str], np.ndarray]], least=None) -> DataFrame:
    """`rows`, which have a text column, with _lang, _score and _letters; one pass per block of languages."""
    ship(rows.sparkSession)
    out = rows.withColumns({"_lang": F.lit(UNKNOWN), "_score": F.lit(0.0), "_letters": F.lit(0).cast("long")})
    for k, block in enumerate(model):
        shared = rows.sparkSession.sparkContext.broadcast(block)
        last = k == len(model) - 1
        out = out.mapInArrow(_predict(shared, least if last else None), out.schema)
        out = out if last else stage(out, "languages")
    return out


def predict(docs: DataFrame, model: list[tuple[list[str], np.ndarray]]) -> DataFrame:
    """(doc_id, lang_pred, score, n_letters) for each row, from the whole text; score is the cosine, at least 0.

    Null texts and texts without a letter give `und` and 0, and so does everything where no language was learned. Of
    equally near languages the first by name wins. Repeated rows and rows without a doc_id are answered one by one; other
    columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if not model:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_letters"))
    return _with_language(rows, model).select("doc_id", F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_letters").alias("n_letters"))


def alike(docs: DataFrame, model: list[tuple[list[str], np.ndarray]], least: tuple[tuple[int, float], ...]) -> DataFrame:
    """The rows of `docs`, all columns as they are, that have a letter and whose cosine is at least that of the first pair
    (letters, cosine) of `least` whose letters they have; decided in the pass that scores, so no text is shuffled. Without
    profiles all rows stay."""
    return _with_language(docs, model, least).select(*docs.columns) if model else docs


def language(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row; learns from the rows outside the held-out fold.

    A row without a doc_id is in no fold (held_out false) and isn't learned from.
    """
    out = predict(docs, learn(docs.where(remainder("doc_id", 4) != 2)))
    return out.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
