"""Encode and decode with the pieces of a SentencePiece model: an Aho-Corasick automaton drives a one-pass Viterbi.

The model file is only read. A text's spaces become the mark U+2581 and one is put before it. At each character the
automaton steps once, and its chain of output links gives every piece that ends there; each relaxes the best score at
the character's end. Characters that no piece covers become byte pieces at a penalty. No piece continues past the start
of a space run, so the best segmentation of a text is that of its space-led words; each different word of a slice is
solved once, and all of them advance together, one character a step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.chunks import Memory, boundaries, encode_rows
from cairn.llm.textbytes import slices
from cairn.session import ship

MARK = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6
#: A character without a piece costs as much as the worst piece and this.
PENALTY = 10.0


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a SentencePiece model file, read from its protocol buffer fields."""

    def varint(b: bytes, i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (b[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if b[i - 1] < 128:
                return value, i

    def fields(b: bytes) -> Iterator[tuple[int, object]]:
        i = 0
        while i < len(b):
            key, i = varint(b, i)
            if key & 7 == 2:
                n, i = varint(b, i)
                yield key >> 3, b[i : i + n]
                i += n
            elif key & 7 == 5:
                yield key >> 3, b[i : i + 4]
                i += 4
            elif key & 7 == 1:
                i += 8
            else:
                value, i = varint(b, i)
                yield key >> 3, value

    pieces = []
    with open(path, "rb") as f:
        for number, body in fields(f.read()):
            if number == 1:
                x = dict(fields(body))
                pieces.append((x[1].decode("utf-8"), float(np.frombuffer(x.get(2, b"\0\0\0\0"), "<f4")[0]), x.get(3, NORMAL)))
    return pieces


class Automaton:
    """Aho-Corasick over the ordinary pieces, in arrays: sorted transitions, failure and output links."""

    def __init__(self, pieces: list[tuple[str, float, int]]) -> None:
        self.byte_id = np.zeros(256, dtype=np.int32)
        children: list[dict[int, int]] = [{}]
        piece, depth = [-1], [0]
        scores = [s for _, s, k in pieces if k == NORMAL]
        self.unknown = (min(scores) if scores else 0.0) - PENALTY
        for i, (text, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_id[int(text[3:5], 16)] = i
            if kind != NORMAL or not text:
                continue
            if MARK in text.lstrip(MARK) or (text[:2] == MARK * 2 and text.strip(MARK)):
                raise ValueError(f"piece {text!r} runs over a word boundary")
            at = 0
            for c in map(ord, text):
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    piece.append(-1)
                    depth.append(depth[at] + 1)
                at = children[at][c]
            piece[at] = i
        n = len(children)
        fail, output = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        queue = list(children[0].values())
        for s in queue:  # grows as it goes: breadth first
            for c, t in children[s].items():
                f = fail[s]
                while f and c not in children[f]:
                    f = fail[f]
                fail[t] = children[f].get(c, 0)
                queue.append(t)
            output[s] = fail[s] if piece[fail[s]] >= 0 else output[fail[s]]
        self.fail, self.output = fail, output
        self.piece, self.depth = np.array(piece, dtype=np.int32), np.array(depth, dtype=np.int32)
        self.score = np.array([pieces[p][1] if p >= 0 else 0.0 for p in piece])
        edges = sorted((s << 21 | c, t) for s, x in enumerate(children) for c, t in x.items())
        self.edge, self.target = np.array([e for e, _ in edges], dtype=np.int64), np.array([t for _, t in edges], dtype=np.int32)
        # states and outputs for what the root reads
        self.root = np.zeros(0x110000, dtype=np.int32)
        for c, t in children[0].items():
            self.root[c] = t

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = self.root[c]
        todo = np.flatnonzero(state)
        s = state[todo].astype(np.int64)
        while len(todo):
            key = s << 21 | c[todo]
            at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            hit = self.edge[at] == key
            out[todo[hit]] = self.target[at[hit]]
            s = self.fail[s[~hit]].astype(np.int64)
            todo = todo[~hit]
            todo, s = todo[s > 0], s[s > 0]
        return out

    def solve(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Best piece ids of each word (-1 - code point where a character falls to bytes), and offsets."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        size = size[order]
        points = np.frombuffer("".join(words[i] for i in order).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        base = np.concatenate([[0], np.cumsum(size)])
        node = base + np.arange(len(base))  # each word has one more node than characters
        best = np.full(int(node[-1]), -np.inf)
        best[node[:-1]] = 0.0
        back, take = np.zeros(len(best), dtype=np.int32), np.zeros(len(best), dtype=np.int32)
        state = np.zeros(len(words), dtype=np.int32)
        live = len(words)
        for k in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -k, "left"))  # words longer than k
            c = points[base[:live] + k]
            state[:live] = now = self.step(state[:live], c)
            to = node[:live] + k + 1
            score, length, piece = best[to - 1] + self.unknown, np.ones(live, np.int32), -1 - c.astype(np.int32)
            at, who = np.where(self.piece[now] >= 0, now, self.output[now]), np.arange(live)
            while True:
                on = at > 0
                if not on.any():
                    break
                at, who = at[on], who[on]
                with_it = best[to[who] - self.depth[at]] + self.score[at]
                better = with_it > score[who]
                w, a = who[better], at[better]
                score[w], length[w], piece[w] = with_it[better], self.depth[a], self.piece[a]
                at = self.output[at]
            best[to], back[to], take[to] = score, length, piece
        # walk back from every word's end, all words together
        at, walk = node[1:] - 1, []
        who = np.arange(len(words))
        rank = np.zeros(len(words), dtype=np.int64)
        while True:
            on = at > node[who]
            at, who = at[on], who[on]
            if not len(at):
                break
            walk.append((who, rank[who], take[at]))
            rank[who] += 1
            at = at - back[at]
        inverse = np.empty(len(words), dtype=np.int64)
        inverse[order] = np.arange(len(words))
        count = rank[inverse]
        off = np.concatenate([[0], np.cumsum(count)])
        ids = np.zeros(int(off[-1]), dtype=np.int32)
        for who, r, piece in walk:
            ids[off[order[who] + 1] - 1 - r] = piece
        return ids, off

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, characters without a piece spelt in bytes, and offsets."""
        ids, off = self.solve(words)
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, off
        spelt = [chr(-1 - int(i)).encode("utf-8", "surrogatepass") for i in ids[odd]]
        width = np.ones(len(ids), dtype=np.int64)
        width[odd] = [len(x) for x in spelt]
        to = np.concatenate([[0], np.cumsum(width)])
        out = np.repeat(ids, width)
        for i, x in zip(to[odd], spelt, strict=True):
            out[i : i + len(x)] = self.byte_id[list(x)]
        return out, to[off]


_LOADED: dict[str, tuple[Automaton, np.ndarray, np.ndarray, Memory]] = {}


def load(path: str) -> tuple[Automaton, np.ndarray, np.ndarray, Memory]:
    """The automaton, the pieces' bytes with offsets, and words already solved, once per process."""
    if path not in _LOADED:
        pieces = read_model(path)
        spelt = [bytes([int(t[3:5], 16)]) if k == BYTE else t.replace(MARK, " ").encode() if k == NORMAL else b"" for t, _, k in pieces]
        _LOADED[path] = (Automaton(pieces), np.frombuffer(b"".join(spelt), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in spelt])]), Memory())
    return _LOADED[path]


def encode_texts(path: str, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, row offsets) of the texts; an empty text has none."""
    automaton, _, _, memory = load(path)
    space = data == 0x20
    new = np.zeros(len(data), dtype=bool)
    new[1:] = space[1:] & ~space[:-1]
    start, end, first = boundaries(data, off, new)
    # the first word of a row gets a space of its own, so it is solved apart from the same word inside
    head = np.zeros(len(start), dtype=bool)
    head[first[:-1][np.diff(first) > 0]] = True
    grown = off + np.concatenate([[0], np.cumsum(np.diff(off) > 0)])
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    wide = np.full(int(grown[-1]), 0x20, dtype=np.uint8)
    shift = (grown[1:] - off[1:])[row]
    wide[np.arange(len(data)) + shift] = data
    owner = np.searchsorted(first, np.arange(len(start)), "right") - 1
    extra = (grown[1:] - off[1:])[owner] if len(start) else start
    ids, at = encode_rows(wide, start + extra - head, end + extra, first, lambda words: automaton.encode([w.decode("utf-8", "replace").replace(" ", MARK) for w in words]), memory)
    return ids, at


def decode_ids(path: str, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of the texts; the space put before each is taken off again."""
    _, raw, off, _ = load(path)
    size = np.diff(off)[ids]
    to = np.concatenate([[0], np.cumsum(size)])
    data = raw[np.repeat(off[:-1][ids] - to[:-1], size) + np.arange(to[-1])]
    rows = to[at]
    keep = np.ones(len(data), dtype=bool)
    keep[rows[:-1][np.diff(rows) > 0]] = False
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[rows]


def _run(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in slices(batches, "text"):
            ids, at = encode_texts(path, data, off)
            text, to = decode_ids(path, ids, at)
            same = np.diff(to) == np.diff(off)
            if len(text) == len(data) and same.all():
                wrong = np.concatenate([[0], np.cumsum(text != data)])
                same = wrong[off[1:]] == wrong[off[:-1]]
            else:
                same = np.array([text[to[i] : to[i + 1]].tobytes() == data[off[i] : off[i + 1]].tobytes() for i in range(len(same))], dtype=bool)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
            decoded = pa.Array.from_buffers(pa.binary(), len(to) - 1, [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(text))])
            yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(np.diff(at)), decoded, pa.array(same)], ["doc_id", "ids", "n_ids", "decoded", "exact"])

    return run


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, n_ids, decoded, exact) per row: the ids of the whole text, the bytes they decode to, and whether
    those are the text's own.

    Null and empty texts have no ids. Of equally good segmentations the one with the longer last piece is taken. Any text
    round-trips, whatever its characters. Repeated rows are encoded one by one; other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_run(model), "doc_id bigint, ids array<int>, n_ids bigint, decoded binary, exact boolean")
