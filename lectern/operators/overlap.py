"""Pairs of word sets that overlap: a grid of blocks, each compared in memory.

Two sets that overlap by ``t`` share at least ``k`` of their first |s| - ceil(t |s|) + k words in any common order (or all that they must
share, if that is less).  A task orders the words of its own two blocks by rarity, counts shared prefix words by postings in memory and
compares whole sets where the count suffices, so no pair is ever shuffled: disk holds the blocks alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: SHARED: prefix words that a candidate shares.
SHARED = 4


def prefix_sizes(sizes: np.ndarray, t: float) -> np.ndarray:
    return np.minimum(sizes, sizes - np.ceil(t * sizes - 1e-9).astype(np.int64) + SHARED)


def least_shared(size: int, sizes: np.ndarray, t: float) -> np.ndarray:
    """Prefix words that sets of ``size`` and ``sizes`` words share if they overlap by ``t``."""
    need = np.ceil(t * np.maximum(size, sizes) - 1e-9)
    return np.clip(need, 1, SHARED).astype(np.int64)


def encoded(*columns: pa.ChunkedArray) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """((words, offsets) of each column of sets written as words joined by spaces, number of distinct words); rare words have low numbers.

    Within a set words ascend, so a prefix of it holds its rarest words.
    """
    lists = [pc.split_pattern(c.combine_chunks().cast(pa.large_string()), " ") for c in columns]
    lists = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in lists]
    flat = [x.flatten() for x in lists]
    codes = pa.concat_arrays([f.cast(pa.large_string()) for f in flat]).dictionary_encode()
    numbers, n = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(codes.dictionary)
    order = np.argsort(np.bincount(numbers, minlength=n), kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    numbers, out, at = rank[numbers], [], 0
    for x, f in zip(lists, flat):
        mine, at = numbers[at : at + len(f)], at + len(f)
        offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(x).to_numpy(zero_copy_only=False))]).astype(np.int64)
        rows = np.repeat(np.arange(len(x)), np.diff(offsets))
        out.append((mine[np.lexsort((mine, rows))].astype(np.int32), offsets))
    return out, n


class Postings:
    """Rows by word of the prefixes for ``t`` of a block of sets."""

    def __init__(self, words: np.ndarray, offsets: np.ndarray, n: int, t: float):
        sizes = np.diff(offsets)
        inside = np.arange(len(words)) - np.repeat(offsets[:-1], sizes) < np.repeat(prefix_sizes(sizes, t), sizes)
        rows, kept = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[inside], words[inside]
        order = np.argsort(kept, kind="stable")
        self.rows, self.at = rows[order], np.concatenate([[0], np.cumsum(np.bincount(kept, minlength=n))])

    def met(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, number of ``words`` that each holds)."""
        parts = [self.rows[a:b] for a, b in zip(self.at[words].tolist(), self.at[words + 1].tolist()) if b > a]
        return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.int32), np.empty(0, np.int64))


def apart(a: str, b: str) -> bool:
    """Both sets of dates (joined by bars) hold something, and nothing in common."""
    return bool(a and b) and set(a.split("|")).isdisjoint(b.split("|"))


def best_two(new: pa.Table, old: pa.Table) -> tuple[list[int], list, list[float]]:
    """(row of ``new``, old id, overlap) of the two best old ids of each row: most overlap, then least id.

    new: (words, dates, least); old: (words, dates, ids), with no more than two ids a row.
    """
    if not new.num_rows or not old.num_rows:
        return [], [], []
    ((mine, starts), (theirs, offsets)), n = encoded(new["words"], old["words"])
    sizes, sizes_new = np.diff(offsets), np.diff(starts)
    least, dates_new, dates_old, ids = new["least"].to_pylist(), new["dates"].to_pylist(), old["dates"].to_pylist(), old["ids"].to_pylist()
    postings: dict[float, Postings] = {}
    held, out = np.zeros(n, bool), ([], [], [])
    for i, t in enumerate(least):
        words, size = mine[starts[i] : starts[i + 1]], int(sizes_new[i])
        if t not in postings:
            postings[t] = Postings(theirs, offsets, n, t)
        rows, count = postings[t].met(words[: prefix_sizes(sizes_new[i : i + 1], t)[0]])
        rows = rows[count >= least_shared(size, sizes[rows], t)]
        rows = rows[np.minimum(sizes[rows], size) >= t * np.maximum(sizes[rows], size) - 1e-9]
        if not len(rows):
            continue
        lengths = sizes[rows]
        ends = np.cumsum(lengths)
        held[words] = True
        shared = np.add.reduceat(held[theirs[np.arange(ends[-1]) + np.repeat(offsets[rows] - ends + lengths, lengths)]].astype(np.int64), ends - lengths)
        held[words] = False
        overlap = shared / (lengths + size - shared)
        fine = (overlap >= t) & (shared > 0)
        rows, overlap = rows[fine], overlap[fine]
        found: list[tuple[float, object]] = []
        for value in np.unique(overlap)[::-1].tolist():
            met = [x for r in rows[overlap == value].tolist() if not apart(dates_new[i], dates_old[r]) for x in ids[r]]
            found += [(value, x) for x in sorted(met)[: 2 - len(found)]]
            if len(found) == 2:
                break
        for value, x in found:
            out[0].append(i), out[1].append(x), out[2].append(value)
    return out
