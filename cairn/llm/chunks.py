"""Tokenise each different chunk of text once and lay the ids out for every row."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from cairn.llm.textbytes import span_hashes

#: Chunks that a process remembers between slices: about 15 MB.
REMEMBERED = 400_000


class Memory:
    """Ids of chunks seen more than once in some slice, by hash; full, it starts anew."""

    def __init__(self) -> None:
        self.key, self.at, self.ids = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where it is unknown."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)

    def add(self, key: np.ndarray, ids: np.ndarray, at: np.ndarray, pick: np.ndarray) -> None:
        """Remember the picked ones of new keys."""
        if len(self.key) + len(pick) > REMEMBERED:
            self.__init__()
            pick = pick[:REMEMBERED]
        start, size = np.concatenate([self.at[:-1], len(self.ids) + at[:-1][pick]]), np.concatenate([np.diff(self.at), np.diff(at)[pick]])
        both, pool = np.concatenate([self.key, key[pick]]), np.concatenate([self.ids, ids])
        order = np.argsort(both, kind="stable")
        self.key, size = both[order], size[order]
        self.at = np.concatenate([[0], np.cumsum(size)])
        self.ids = pool[spread(start[order], size)]


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start[0] .. start[0]+size[0]-1, start[1] .. and so on."""
    to = np.concatenate([[0], np.cumsum(size)])
    return np.repeat(start - to[:-1], size) + np.arange(to[-1])


def boundaries(data: np.ndarray, off: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the chunks that begin where `new` holds and at each row's start, and each row's first chunk."""
    new = new.copy()
    new[off[:-1][off[:-1] < off[1:]]] = True
    start = np.flatnonzero(new)
    return start, np.append(start[1:], len(data)), np.searchsorted(start, off)


def encode_rows(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], memory: Memory) -> tuple[np.ndarray, np.ndarray]:
    """(ids, row offsets); `encode` gives (ids, offsets) for a list of different chunks."""
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(len(first), np.int64)
    key, one, which, times = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True, return_counts=True)
    known = memory.find(key)
    new = np.flatnonzero(known < 0)
    raw = data.tobytes()
    ids, at = encode([raw[s:e] for s, e in zip(start[one[new]].tolist(), end[one[new]].tolist(), strict=True)])
    begin, size = memory.at[np.maximum(known, 0)], np.zeros(len(key), np.int64)
    if len(memory.key):
        size = np.where(known >= 0, np.diff(memory.at)[np.maximum(known, 0)], 0)
    begin[new], size[new] = len(memory.ids) + at[:-1], np.diff(at)
    pool = np.concatenate([memory.ids, ids])
    out = pool[spread(begin[which], size[which])]
    memory.add(key[new], ids, at, np.flatnonzero(times[new] > 1))
    return out, np.concatenate([[0], np.cumsum(size[which])])[first]
