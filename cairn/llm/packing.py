"""Token ids packed into fixed-length rows: best-fit decreasing, with a segment tree over free capacities.

Documents are dealt by a hash into shards of about SHARD_BYTES of text each, however large the table is, and each shard
is packed on its own. A document longer than a row is cut into full rows and a rest, so nothing is dropped.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.chunks import Memory, boundaries, encode_rows
from cairn.llm.textbytes import NOT_SPACE, slices
from cairn.session import ship

SHARD_BYTES = 4 << 20
#: How a byte-level vocabulary of this kind cuts texts before merging (a fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict[tuple[str, str], tuple[object, Memory]] = {}


def encoder(ranks: str, pattern: str):
    if (ranks, pattern) not in _ENCODERS:
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[ranks, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}), Memory()
    return _ENCODERS[ranks, pattern]


def encode_texts(ranks: str, pattern: str, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, row offsets). Chunks end where the pattern always ends one: before a word's last leading white space."""
    tool, memory = encoder(ranks, pattern)
    word = NOT_SPACE[data]
    space = data == 0x20
    new = np.zeros(len(data), dtype=bool)
    if len(data) > 1:
        new[1:] = ~word[1:] & word[:-1]  # a run of white space begins
        last = ~word[:-1] & word[1:]  # its last character, before a word
        new[:-1] |= last
        new[1:] |= last & ~space[:-1]
    start, end, first = boundaries(data, off, new)

    def encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        one = tool.encode_ordinary
        lists = [one(c.decode("utf-8", "replace")) for c in chunks]
        at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        return np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(at[-1])), at

    return encode_rows(data, start, end, first, encode, memory)


class Capacities:
    """Open rows by free capacity; a segment tree of counts finds the least capacity that fits in O(log)."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def add(self, capacity: int, row: int, by: int = 1) -> None:
        if by > 0:
            self.rows.setdefault(capacity, []).append(row)
        i = capacity + self.leaves
        while i:
            self.tree[i] += by
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(capacity, row) of the tightest open row with room for `size`, removed; None if there is none."""
        i = size + self.leaves
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        row = self.rows[capacity].pop()
        self.add(capacity, row, -1)
        return capacity, row


def best_fit(sizes: np.ndarray, length: int) -> np.ndarray:
    """Row of each item (1 <= size <= length), largest first, ties by position."""
    rows, open_rows, used = np.zeros(len(sizes), dtype=np.int64), Capacities(length), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = open_rows.take(size) if size < length else None
        capacity, row = found or (length, used)
        used += found is None
        rows[i] = row
        if capacity > size:
            open_rows.add(capacity - size, row)
    return rows


SCHEMA = "shard int, row int, n_tokens int, ids binary, cu_seqlens array<int>, doc_ids array<bigint>, doc_offsets array<int>, position_starts array<int>"


def _pack(ranks: str, pattern: str, length: int, end_id: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        parts, sizes = [], []
        for _, data, off in slices(iter(table.select(["text"]).to_batches()), "text"):
            ids, at = encode_texts(ranks, pattern, data, off)
            out = np.full(len(ids) + len(off) - 1, end_id, dtype=np.int32)  # each document ends with end_id
            out[np.arange(len(ids)) + np.repeat(np.arange(len(off) - 1), np.diff(at))] = ids
            parts.append(out)
            sizes.append(np.diff(at) + 1)
        tokens, size = np.concatenate(parts), np.concatenate(sizes)
        base = np.concatenate([[0], np.cumsum(size)])
        pieces = -(-size // length)
        doc = np.repeat(np.arange(len(size)), pieces)
        offset = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
        width = np.minimum(size[doc] - offset, length)
        row = best_fit(width, length)
        order = np.lexsort((np.arange(len(row)), row))
        n_rows = int(row.max()) + 1
        bound = np.searchsorted(row[order], np.arange(n_rows + 1))
        w, d, o = width[order], doc[order], offset[order]
        place = np.cumsum(w) - w
        place -= place[bound[:-1]][row[order]]
        matrix = np.full((n_rows, length), end_id, dtype=np.int32)
        to = np.repeat(row[order] * length + place - (np.cumsum(w) - w), w) + np.arange(int(w.sum()))
        source = np.repeat(base[d] + o - (np.cumsum(w) - w), w) + np.arange(int(w.sum()))
        matrix.ravel()[to] = tokens[source]
        filled = np.bincount(row, weights=width, minlength=n_rows).astype(np.int32)
        # cumulative lengths: 0, then each segment's end
        ends = np.insert((place + w).astype(np.int32), bound[:-1], 0)
        lists = lambda x, b, t: pa.ListArray.from_arrays(pa.array(b.astype(np.int32)), pa.array(x.astype(t)))
        shard = table.column("shard")[0].as_py()
        doc_id = table.column("doc_id").combine_chunks()
        return pa.table({
            "shard": pa.array([shard] * n_rows, pa.int32()), "row": pa.array(np.arange(n_rows, dtype=np.int32)), "n_tokens": pa.array(filled),
            "ids": pa.Array.from_buffers(pa.binary(), n_rows, [None, pa.py_buffer((np.arange(n_rows + 1) * length * 4).astype(np.int32)), pa.py_buffer(matrix)]),
            "cu_seqlens": lists(ends, bound + np.arange(n_rows + 1), np.int32), "doc_ids": pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), doc_id.take(pa.array(d))),
            "doc_offsets": lists(o, bound, np.int32), "position_starts": lists(place, bound, np.int32),
        })

    return run


def pack(docs: DataFrame, ranks: str, length: int = 2048, end_id: int = 50256, pattern: str = PATTERN) -> DataFrame:
    """One row per packed sequence: (shard, row, n_tokens, ids, cu_seqlens, doc_ids, doc_offsets, position_starts).

    `ids` holds `length` little-endian 32-bit ids, filled up with `end_id` after n_tokens. cu_seqlens has 0 and each segment's
    end; position_starts is where positions start again from 0; doc_ids and doc_offsets say which document's tokens, from
    which of them on, a segment holds. Each document is its tokens and `end_id`, so null and empty texts are one token.
    Repeated rows are packed as often as they stand, and a row without a doc_id has null there. Rows are dealt to shards by
    a hash of the row and of its input partition, so that copies of one row don't meet in one task; the layout is the same
    whenever the same files are read in the same splits. An empty table gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(_pack(ranks, pattern, length, end_id), SCHEMA)


def positions(cu_seqlens: np.ndarray, length: int) -> np.ndarray:
    """Position ids of one packed row: each segment counts from 0, and so does the filling."""
    cu = np.append(cu_seqlens, length)
    return np.arange(length) - np.repeat(cu[:-1], np.diff(cu))


def write_matrices(packed: DataFrame, path: str) -> None:
    """The id matrices with their segment lengths and resets, as Parquet in folders by shard."""
    packed.write.partitionBy("shard").parquet(path)
