"""Suffix order and common prefixes by external induced sorting.

A string's suffixes are L (larger than the next one) or S; the S suffixes that follow an L one (LMS) order all others:

1. the LMS substrings (up to the next LMS symbol) are sorted by an external merge sort of words of packed symbols, ties by their next words,
   and named by their rank; one that another begins with is the larger one, as its last symbol is of type S there and L in the other;
2. if names repeat, the string of names is sorted by the same procedure, recursively, until a level's names are all
   different; that orders the LMS suffixes, and common prefixes come back in names and are converted to symbols (whole
   substrings by their lengths, the last one by comparison);
3. an induction from the sorted LMS suffixes orders the L suffixes, one from those the S suffixes.

An induction is a run over a priority queue of (first symbol, order of arrival) that carries suffix tuples (position, common
prefix with the tuple before).  The queue is on disk: tuples gather in a buffer of ``BUFFER``, sorted by symbol in parts of
``PART``; a full buffer is merged and written as a run, and what leaves the queue is merged from the runs, each read in blocks of ``BLOCK``.  Runs follow each other in
time, so taking their tuples run by run keeps the order of arrival within a symbol.  Text, types, run lengths and results are mapped
files beyond ``MEMORY`` bytes.  Memory thus holds the buffer, a block of each run and the tuples that leave at once, whatever the shard's size.
The merge sort of substrings holds a sorted block of ``BUFFER``, a sample of all blocks and one part of the merge, which is about a block and
all substrings with the same first word.

Tuples leave for as many symbols at once as are complete: a symbol is when all of its tuples but those of its own runs have
arrived, which their known number tells.  They are handled in bulk with numpy; the common prefix of two pushed suffixes is one more than the
range minimum between their sources, and suffixes whose sources have different symbols share exactly one.
"""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile

import numpy as np

#: Common prefixes are kept up to this; none that matters to a caller may be longer.
CAP = 32_000
#: Bytes of arrays that a sort keeps in memory; what comes after goes to files.
MEMORY = 32 << 20
#: Tuples in a queue's buffer and in a sorted part of it, tuples of a run that are read at once, symbols that are looked at for one step.
BUFFER, PART, BLOCK, AHEAD = 1 << 15, 1 << 12, 1 << 13, 1 << 10
#: What precedes a suffix: nothing, another symbol of type L or S, the same symbol.
NONE, FROM_L, FROM_S, SAME = range(4)


class Scratch:
    """Files of a sort in a folder of the task's own, removed at the end; arrays are in memory up to ``memory`` bytes.

    written: runs of queues; deepest: levels of the recursion.
    """

    def __init__(self, memory: int | None = None, buffer: int | None = None):
        self.root, self.n, self.left = tempfile.mkdtemp(prefix="induced-"), 0, MEMORY if memory is None else memory
        self.buffer, self.written, self.deepest = BUFFER if buffer is None else buffer, 0, 0

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def array(self, n: int, dtype) -> np.ndarray:
        size = n * np.dtype(dtype).itemsize
        if size < 1 << 12 or size <= self.left:
            self.left -= size
            return np.zeros(n, dtype)
        path = self.path()
        out = np.asarray(np.memmap(path, dtype, "w+", shape=(n,)))
        os.unlink(path)  # the mapping keeps the file; it goes when the array does
        return out

    def close(self) -> None:
        shutil.rmtree(self.root, ignore_errors=True)


@contextlib.contextmanager
def scratch(memory: int | None = None, buffer: int | None = None):
    held = Scratch(memory, buffer)
    try:
        yield held
    finally:
        held.close()


def stable_order(keys: np.ndarray) -> np.ndarray:
    """Stable order of numbers from 0 to 2^31 - 1; numpy sorts 16 bits by radix, and whole words faster than it merges places."""
    if keys.dtype.itemsize <= 2 or len(keys) < 512:
        return keys.argsort(kind="stable")
    both = keys.astype(np.int64) << 32
    both |= np.arange(len(keys))
    both.sort()
    both &= (1 << 32) - 1
    return both


class Run:
    """Tuples sorted by key, in memory or in a file that is read in blocks.  next: the least key left."""

    KINDS = (np.dtype(np.int32), np.dtype(np.int32), np.dtype(np.int16))

    def __init__(self, columns: tuple[np.ndarray, ...], path: str | None = None):
        self.path, self.n, self.at, self.next = path, len(columns[0]), 0, int(columns[0][0])
        self.block: tuple[np.ndarray, ...] | None = None
        if path is None:
            self.block, self.at = columns, self.n
            return
        with open(path, "wb") as f:
            for x, kind in zip(columns, self.KINDS):
                f.write(np.ascontiguousarray(x, kind).tobytes())

    def _load(self) -> None:
        n, base, out = min(BLOCK, self.n - self.at), 0, []
        for kind in self.KINDS:
            out.append(np.fromfile(self.path, kind, n, offset=base + self.at * kind.itemsize))
            base += self.n * kind.itemsize
        self.block = tuple(out)
        self.at += n

    def take(self, key: int, into: list[tuple[np.ndarray, ...]]) -> bool:
        """Move all tuples below ``key`` to ``into``; whether any are left."""
        while True:
            if self.block is None:
                if self.at == self.n:
                    if self.path is not None:
                        os.unlink(self.path)
                    return False
                self._load()
            keys, pos, lcp = self.block
            i = int(keys.searchsorted(key))
            if i:
                into.append((keys[:i], pos[:i], lcp[:i]))
            if i < len(keys):
                self.block, self.next = (keys[i:], pos[i:], lcp[i:]), int(keys[i])
                return True
            self.block = None


class Queue:
    """The priority queue of an induction; ``down``: largest symbol first."""

    def __init__(self, sigma: int, files: Scratch, down: bool):
        self.sigma, self.files, self.down = sigma, files, down
        self.arrived = np.zeros(sigma, np.int64)
        self.runs: list[Run] = []  # in files; then come sorted parts of the buffer, then what isn't sorted yet
        self.parts: list[Run] = []
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n = self.fresh = 0

    def push(self, symbols: np.ndarray, pos: np.ndarray, lcp: np.ndarray, heads: np.ndarray) -> None:
        """symbols: ascending; heads: where each symbol's part starts."""
        upto = np.empty(len(heads) + 1, np.int64)
        upto[:-1], upto[-1] = heads, len(symbols)
        self.arrived[symbols[heads]] += upto[1:] - upto[:-1]
        self.held.append((self.sigma - 1 - symbols if self.down else symbols, pos, lcp))
        self.fresh += len(symbols)
        if self.n + self.fresh > self.files.buffer:
            columns = self._sorted([x.block for x in self.parts] + self.held)
            self.runs.append(Run(columns, self.files.path()))
            self.files.written += 1
            self.parts, self.held, self.n, self.fresh = [], [], 0, 0
        elif self.fresh > PART:
            self.parts.append(Run(self._sorted(self.held)))
            self.n, self.held, self.fresh = self.n + self.fresh, [], 0

    @staticmethod
    def _sorted(tuples: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        """(key, pos, lcp) by key in order of arrival."""
        keys, pos, lcp = (np.concatenate(x) for x in zip(*tuples)) if len(tuples) > 1 else tuples[0]
        if len(keys) > 1 and (keys[1:] < keys[:-1]).any():
            order = stable_order(keys)
            return keys[order], pos[order], lcp[order]
        return keys, pos, lcp

    def pop(self, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(pos, lcp) of all tuples up to symbol ``last``, by symbol in order of arrival."""
        key = (self.sigma - last) if self.down else last + 1
        out: list[tuple[np.ndarray, ...]] = []
        if self.runs:
            self.runs = [r for r in self.runs if r.next >= key or r.take(key, out)]
        if self.parts:
            self.parts = [r for r in self.parts if r.next >= key or r.take(key, out)]
            self.n = sum(len(r.block[0]) for r in self.parts)
        if self.held:
            keys, pos, lcp = (np.concatenate(x) for x in zip(*self.held)) if len(self.held) > 1 else self.held[0]
            mine = keys < key
            n = np.count_nonzero(mine)
            if n == len(keys):
                out.append((keys, pos, lcp))
                self.held, self.fresh = [], 0
            elif n:
                out.append((keys[mine], pos[mine], lcp[mine]))
                mine = ~mine
                self.held, self.fresh = [(keys[mine], pos[mine], lcp[mine])], len(keys) - n
            else:
                self.held = [(keys, pos, lcp)]
        if not out:
            return np.zeros(0, np.int32), np.zeros(0, np.int16)
        _, pos, lcp = self._sorted(out)
        return np.array(pos, np.int32), np.array(lcp, np.int16)


def range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of values[lo..hi] (inclusive, lo <= hi) for each pair."""
    table, width = [values], 1
    longest = int((hi - lo).max(initial=0)) + 1
    while width * 2 <= longest:
        last = table[-1]
        table.append(np.minimum(last[:-width], last[width:]))
        width *= 2
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    out = np.empty(len(lo), values.dtype)
    for k, row in enumerate(table):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << k) + 1])
    return out


class Level:
    """A string of symbols 0..sigma-1 whose last symbol is the only 0, with suffix types and runs."""

    def __init__(self, text: np.ndarray, sigma: int, files: Scratch, depth: int = 0):
        n = len(text)
        self.text, self.sigma, self.files, self.n, self.depth = text, sigma, files, n, depth
        files.deepest = max(files.deepest, depth + 1)
        changes = np.flatnonzero(text[1:] != text[:-1])  # the last place of each run
        size = np.diff(np.concatenate(([-1], changes, [n - 1])))
        last = np.repeat(np.append(changes, n - 1), size)
        self.run = files.array(n, np.int16)
        self.run[:] = np.minimum(last - np.arange(n) + 1, CAP)
        up = np.append(text[changes] < text[changes + 1], True)
        is_s = np.repeat(up, size)
        self.kind = files.array(n, np.uint8)  # of what precedes each suffix
        self.kind[1:] = np.where(text[1:] == text[:-1], SAME, np.where(is_s[:-1], FROM_S, FROM_L))
        starts = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
        self.lms = files.array(len(starts), np.int32)
        self.lms[:] = starts
        count = lambda mask: np.bincount(text[mask], minlength=sigma)
        self.n_l = count(~is_s)
        # What a symbol gets from others: its suffixes less those that follow in a run of the symbol itself.
        inner = self.run > 1
        self.runs_l, self.runs_s = count(~is_s & inner), count(is_s & inner)
        self.from_l, self.from_s = self.n_l - self.runs_l, count(is_s) - self.runs_s
        self.from_s[0] = 0  # nothing induces the last suffix

    def _step(self, queue: Queue, c: int) -> int:
        """The last symbol, from ``c`` on in the queue's direction, of a stretch that can leave at once."""
        runs, due = (self.runs_s, self.from_s) if queue.down else (self.runs_l, self.from_l)
        if runs[c]:
            return c
        part = slice(max(0, c - AHEAD + 1), c + 1) if queue.down else slice(c, min(self.sigma, c + AHEAD))
        ready = (queue.arrived[part] == due[part]) & (runs[part] == 0)
        if queue.down:
            ready = ready[::-1]
        n = len(ready) if ready.all() else int(ready.argmin())
        return c - max(n, 1) + 1 if queue.down else c + max(n, 1) - 1

    def _joined(self, pos: np.ndarray, lcp: np.ndarray, more: np.ndarray, more_lcp: np.ndarray, down: bool) -> tuple[np.ndarray, np.ndarray]:
        """Tuples of some symbols and others that follow them within each symbol, with common prefixes where the two kinds meet."""
        if not len(more) or not len(pos):
            if len(more):
                pos, lcp = more, more_lcp
            if len(pos):
                if self.text[pos[0]] != self.text[pos[-1]]:
                    symbols = self.text[pos]
                    lcp[1:][symbols[1:] != symbols[:-1]] = 0
                lcp[0] = 0
            return pos, lcp
        both, shared = np.concatenate((pos, more)), np.concatenate((lcp, more_lcp))
        symbols = self.text[both]
        order = stable_order(self.sigma - 1 - symbols if down else symbols)
        both, shared, symbols, later = both[order], shared[order], symbols[order], order >= len(pos)
        start = np.empty(len(both), bool)
        start[0] = True
        np.not_equal(symbols[1:], symbols[:-1], out=start[1:])
        meet = (later[1:] & ~later[:-1] & ~start[1:]).nonzero()[0] + 1
        shared[meet] = np.minimum(self.run[both[meet - 1]], self.run[both[meet]])
        shared[start] = 0
        return both, shared

    def induce(self, seeds: np.ndarray, seed_lcp: np.ndarray, visit) -> None:
        """Order all suffixes from LMS suffixes in order.  ``visit(pos, lcp)`` gets them from the largest to the least,
        whole symbols at once, each with its common prefix with the one before (0 at a symbol's first)."""
        queue = Queue(self.sigma, self.files, False)
        bounds = np.searchsorted(self.text[seeds], np.arange(self.sigma + 1))
        held = np.concatenate(([0], np.cumsum(self.n_l)))
        l_pos, l_lcp = self.files.array(int(held[-1]), np.int32), self.files.array(int(held[-1]), np.int16)  # the L suffixes, kept for the second run
        c = 0
        while c < self.sigma:
            last = self._step(queue, c)
            pos, lcp = queue.pop(last)
            if len(pos) and self.runs_l[c]:
                pos, lcp = self._runs(pos, lcp, c, False)
            pos, lcp = self._joined(pos, lcp, np.zeros(0, np.int32), np.zeros(0, np.int16), False)
            l_pos[held[c] : held[last + 1]], l_lcp[held[c] : held[last + 1]] = pos, lcp
            a, b = bounds[c], bounds[last + 1]
            if b > a:
                pos, lcp = self._joined(pos, lcp, seeds[a:b], np.array(seed_lcp[a:b]), False)
            self._push(queue, pos, lcp)
            c = last + 1
        queue = Queue(self.sigma, self.files, True)
        c = self.sigma - 1
        while c >= 0:
            last = self._step(queue, c)
            pos, lcp = queue.pop(last)
            if len(pos) and self.runs_s[c]:
                pos, lcp = self._runs(pos, lcp, c, True)
            part = slice(held[last], held[c + 1])
            back, back_lcp = l_pos[part][::-1], np.append(0, l_lcp[part][:0:-1]).astype(np.int16)
            if last == 0:
                pos, lcp = np.append(pos, np.int32(self.n - 1)), np.append(lcp, np.int16(0))
            pos, lcp = self._joined(pos, lcp, back, back_lcp[: len(back)], True)
            visit(pos, lcp)
            self._push(queue, pos, lcp)
            c = last - 1

    def _runs(self, pos: np.ndarray, lcp: np.ndarray, c: int, down: bool) -> tuple[np.ndarray, np.ndarray]:
        """A symbol's tuples completed by those whose sources have the same symbol, round by round."""
        lcp[0] = 0
        all_pos, all_lcp = [pos], [lcp]
        rest: int | None = None  # least common prefix since the last source of the same symbol
        while True:
            pos, lcp = all_pos[-1], all_lcp[-1]
            at = (self.kind[pos] == SAME).nonzero()[0]  # of the same type, too
            if not len(at):
                break
            cut = np.zeros(len(at), np.int64)
            np.add(at[:-1], 1, out=cut[1:])
            least = np.minimum.reduceat(lcp[: at[-1] + 1], cut).astype(np.int64)
            least[0] = 0 if rest is None else min(rest, least[0])
            tail = lcp[at[-1] + 1 :]
            rest = int(tail.min()) if len(tail) else CAP
            all_pos.append(pos[at] - 1)
            all_lcp.append(np.minimum(least + 1, CAP).astype(np.int16))
        return (np.concatenate(all_pos), np.concatenate(all_lcp)) if len(all_pos) > 1 else (all_pos[0], all_lcp[0])

    def _push(self, queue: Queue, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Push what precedes the suffixes and has another symbol and the wanted type."""
        if not len(pos):
            return
        at = (self.kind[pos] == (FROM_S if queue.down else FROM_L)).nonzero()[0]
        if not len(at):
            return
        symbols = self.text[pos[at] - 1]
        order = stable_order(symbols)
        at, symbols = at[order], symbols[order].astype(np.int32)
        new = np.empty(len(at), bool)
        new[0] = True
        np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
        out = np.ones(len(at), np.int16)
        same = (~new).nonzero()[0]
        if len(same):
            out[same] = np.minimum(range_min(lcp, at[same - 1] + 1, at[same]), CAP - 1) + 1
        queue.push(symbols, pos[at] - 1, out, new.nonzero()[0])

    def _words(self, at: np.ndarray, size: np.ndarray, bits: int) -> np.ndarray:
        """The next symbols of strings of ``size`` symbols from ``at`` on, packed; what follows a string's end is larger than any symbol."""
        width = 64 // bits
        out = np.zeros(len(at), np.uint64)
        for j in range(width):
            out <<= np.uint64(bits)
            out |= self.text[np.minimum(at + j, self.n - 1)].astype(np.uint64)
        beyond = np.array([(1 << j * bits) - 1 for j in range(width + 1)], np.uint64)
        out |= beyond[np.clip(width - size, 0, width)]
        return out

    def name(self) -> tuple[np.ndarray, int]:
        """Ranks of the LMS substrings in text order, and their number."""
        n, block = len(self.lms) - 1, max(self.files.buffer, 1)  # without the last suffix
        bits = self.sigma.bit_length()
        out, names = self.files.array(n + 1, np.int32), 0
        words, index = self.files.array(n, np.uint64), self.files.array(n, np.int32)  # sorted blocks
        blocks = [slice(lo, min(lo + block, n)) for lo in range(0, n, block)]
        sample = []
        for part in blocks:
            at = self.lms[part]
            found = self._words(at, self.lms[part.start + 1 : part.stop + 1] - at + 1, bits)
            order = found.argsort()
            words[part], index[part] = found[order], order + part.start
            sample.append(words[part][:: max(1, len(order) // (4 * len(blocks)))])
        if n:
            # Parts of the merge, of about a block each; equal first words meet in one.
            some = np.sort(np.concatenate(sample))
            cuts = np.unique(some[[len(some) * k // len(blocks) for k in range(1, len(blocks))]]) if len(blocks) > 1 else some[:0]
            edges = [np.concatenate(([0], words[x].searchsorted(cuts), [x.stop - x.start])) + x.start for x in blocks]
            for k in range(len(cuts) + 1):
                mine = [slice(e[k], e[k + 1]) for e in edges]
                names += self._rank(np.concatenate([words[x] for x in mine]), np.concatenate([index[x] for x in mine]), bits, names, out)
        return out, names + 1

    def _rank(self, words: np.ndarray, index: np.ndarray, bits: int, names: int, out: np.ndarray) -> int:
        """Name some LMS substrings, with their first words, after ``names`` lesser ones; the number of their names."""
        if not len(words):
            return 0
        order = words.argsort()
        words, index = words[order], index[order]
        new = np.empty(len(words), bool)
        new[0] = True
        np.not_equal(words[1:], words[:-1], out=new[1:])
        size = self.lms[index + 1] - self.lms[index] + 1
        at, done = np.arange(len(words)), 64 // bits
        while True:
            first = new[at]
            open_ = (~first | ~np.append(first[1:], True)) & (size[at] > done)
            group = np.cumsum(first) - 1
            wanted = np.zeros(len(at), bool)
            wanted[group[open_]] = True
            mine = wanted[group]
            if not mine.any():
                break
            at, group = at[mine], group[mine]
            words = self._words(self.lms[index[at]] + done, size[at] - done, bits)
            order = np.lexsort((words, group))
            index[at], size[at], words = index[at[order]], size[at[order]], words[order]
            new[at[1:]] |= words[1:] != words[:-1]
            done += 64 // bits
        rank = np.cumsum(new)
        out[index] = rank + names
        return int(rank[-1])

    def sorted_lms(self) -> tuple[np.ndarray, np.ndarray]:
        """LMS suffixes in order, each with its common prefix with the one before."""
        names, sigma = self.name()
        order, shared = sort_suffixes(names, sigma, self.files, self.depth + 1)
        pos = self.lms[order]
        lcp = np.zeros(len(pos), np.int64)
        if len(pos) > 1:
            x, y = order[:-1], order[1:]
            size = self.lms[np.minimum(x + shared[1:], len(pos) - 1)] - self.lms[x]
            live = np.arange(1, len(pos))
            a, b = self.lms[x] + size, self.lms[y] + size
            lcp[1:] = size
            while len(live):
                go = (a < self.n) & (b < self.n)
                go &= self.text[np.minimum(a, self.n - 1)] == self.text[np.minimum(b, self.n - 1)]
                live, a, b = live[go], a[go] + 1, b[go] + 1
                lcp[live] += 1
        return pos, np.minimum(lcp, CAP).astype(np.int16)


def sort_suffixes(text: np.ndarray, sigma: int, files: Scratch, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes of a string of 0..sigma-1 (its last symbol the only 0) and each one's common prefix with the one before."""
    pos_out, lcp_out = files.array(len(text), np.int32), files.array(len(text), np.int16)
    if sigma == len(text):  # every symbol once
        pos_out[text] = np.arange(len(text))
        return pos_out, lcp_out
    level = Level(text, sigma, files, depth)
    seeds, lcp = level.sorted_lms()
    end = len(text)

    def visit(pos: np.ndarray, lcp: np.ndarray) -> None:
        nonlocal end
        pos_out[end - len(pos) : end] = pos[::-1]
        lcp_out[end - len(pos) + 1 : end] = lcp[:0:-1]
        end -= len(pos)

    level.induce(seeds, lcp, visit)
    return pos_out, lcp_out


class Shard:
    """Pieces laid end to end in a file as they come; only their lengths stay in memory."""

    def __init__(self, files: Scratch):
        self.files, self.path, self.size = files, files.path(), []
        self.out = open(self.path, "wb")

    def add(self, piece: bytes) -> None:
        self.out.write((np.frombuffer(piece, np.uint8).astype(np.uint16) + 2).tobytes() + b"\1\0")  # 1 between pieces
        self.size.append(len(piece))

    def repeated_starts(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, ends): a mark at each place of the laid-out pieces that starts a string of ``least`` bytes, within its piece,
        that starts elsewhere too; where each piece ends there."""
        self.out.write(b"\0\0")
        self.out.close()
        size = np.array(self.size, np.int64)
        ends = np.cumsum(size + 1) - 1
        raw = np.memmap(self.path, np.uint16, "r")
        used = np.flatnonzero(np.bincount(raw, minlength=258))
        dense = np.zeros(258, np.uint16)
        dense[used] = np.arange(len(used))
        text, hit = self.files.array(len(raw), np.uint16), self.files.array(len(raw), np.bool_)
        text[:] = dense[raw]
        del raw
        os.unlink(self.path)
        if len(used) < len(text):
            level = Level(text, len(used), self.files)
            seeds, seed_lcp = level.sorted_lms()

            def visit(pos: np.ndarray, lcp: np.ndarray) -> None:
                at = np.flatnonzero(lcp[1:] >= least) + 1
                hit[pos[at]] = True
                hit[pos[at - 1]] = True

            level.induce(seeds, seed_lcp, visit)
        for a, b in zip(ends - size, ends):  # a common prefix that runs on beyond the piece is none
            hit[max(a, b - least + 1) : b + 1] = False
        return hit, ends
