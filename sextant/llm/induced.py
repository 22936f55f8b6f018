"""Suffix arrays with common prefixes by induced sorting, over disk-backed queues.

The order of all suffixes follows from that of the few that begin a descent after an
ascent: a pass over the letters in order takes every suffix out of a priority queue and
puts in the one before it; a second pass does so from the other end. An entry is a tuple
of a suffix and the length of the prefix that it has in common with the entry put in
before it under the same letter, the least that was seen in between; so common prefixes
need no text. The few are ordered by their own substrings first, and, while these leave
ties, as the suffixes of a shorter text of their names: the recursion.

The queue is monotone (what is put in comes after what was taken out), so it is one file
of arrivals for each range of letters, of which only the current one is in memory. Arrivals
beyond ``budget`` bytes, and arrays larger than that, are kept in files without a name,
which are private to the task, as Spark's own spill files are, and gone with it.
A shorter text of ``base`` names or fewer is sorted in memory, by doubling. What stays in
memory of a larger text are two bytes a letter.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes of arrivals or of one array beyond which a file is used.
BUDGET = 128 << 20
#: Names that are sorted in memory.
BASE = 8 << 20
#: Ranges of letters of a queue at most.
RANGES = 4096
#: Entries of an array on disk handled at once.
STEP = 1 << 20
_NEVER = np.iinfo(np.int64).max


def array(n: int, dtype, budget: int) -> np.ndarray:
    """An array in memory, or in an unnamed file if it is large."""
    if n * np.dtype(dtype).itemsize <= budget:
        return np.empty(n, dtype)
    with tempfile.TemporaryFile() as f:
        f.truncate(n * np.dtype(dtype).itemsize)
        return np.memmap(f, dtype, "r+", shape=(n,))


class Queue:
    """Arrivals (suffix, common prefix) by range; those of a range leave in the order in which they came."""

    def __init__(self, ranges: int, budget: int):
        self.rows: list[list[np.ndarray]] = [[] for _ in range(ranges)]
        self.spilled: list[list[tuple[int, int]]] = [[] for _ in range(ranges)]
        self.held, self.budget, self.file = 0, budget, None

    def put(self, at: np.ndarray, suffix: np.ndarray, common: np.ndarray) -> None:
        """``at``: the range of each arrival."""
        order = np.argsort(at, kind="stable")
        at = at[order]
        entry = np.empty(len(at), [("suffix", np.int64), ("common", np.uint8)])
        entry["suffix"], entry["common"] = suffix[order], common[order]
        cuts = np.flatnonzero(np.diff(at)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
            if b > a:
                self.rows[at[a]].append(entry[a:b].copy())
        self.held += entry.nbytes
        if self.held > self.budget:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for r, parts in enumerate(self.rows):
            if parts:
                self.spilled[r].append((self.file.tell(), sum(map(len, parts))))
                for part in parts:
                    self.file.write(part.tobytes())
                self.rows[r] = []
        self.held = 0

    def take(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        parts, kind = [], np.dtype([("suffix", np.int64), ("common", np.uint8)])
        for at, n in self.spilled[r]:
            self.file.seek(at)
            parts.append(np.frombuffer(self.file.read(n * kind.itemsize), kind))
        parts += self.rows[r]
        self.held -= sum(x.nbytes for x in self.rows[r])
        self.rows[r], self.spilled[r] = [], []
        entry = np.concatenate(parts) if parts else np.zeros(0, kind)
        return entry["suffix"].copy(), entry["common"].copy()


class _Least:
    """Least values of stretches of an array."""

    def __init__(self, values: np.ndarray):
        self.rows, width = [values], 1
        while 2 * width <= len(values):
            self.rows.append(np.minimum(self.rows[-1][:-width], self.rows[-1][width:]))
            width *= 2

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least of a to b inclusive."""
        level = (np.frexp((b - a + 1).astype(np.float64))[1] - 1).astype(np.int64)
        out = np.empty(len(a), self.rows[0].dtype)
        for k in np.unique(level):
            on = np.flatnonzero(level == k)
            out[on] = np.minimum(self.rows[k][a[on]], self.rows[k][b[on] - (1 << k) + 1])
        return out


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, ``cap`` at most."""
    n, out, on = len(text), np.zeros(len(a), np.uint8), np.arange(len(a))
    for d in range(cap):
        x, y = a[on] + d, b[on] + d
        inside = np.maximum(x, y) < n
        same = np.zeros(len(on), bool)
        same[inside] = text[x[inside]] == text[y[inside]]
        on = on[same]
        if not len(on):
            break
        out[on] = d + 1
    return out


class _Pass:
    """One pass: suffixes that are ``wanted``, in the order of ``text``'s letters."""

    def __init__(self, text: np.ndarray, letters: int, flip: bool, wanted: np.ndarray, budget: int, cap: int):
        self.text, self.top, self.flip, self.wanted, self.budget, self.cap = text, letters - 1, flip, wanted, budget, cap
        self.shift = max(0, (letters - 1).bit_length() - RANGES.bit_length() + 1)
        self.queue = Queue(((letters - 1) >> self.shift) + 1, budget)
        self.least = np.full(letters, 255, np.uint8) if cap else None  # of the common prefixes since the last arrival under a letter

    def letter(self, suffix: np.ndarray) -> np.ndarray:
        c = self.text[suffix].astype(np.int64)
        return self.top - c if self.flip else c

    def before(self, suffix: np.ndarray) -> np.ndarray:
        """Which suffixes have a wanted one before them."""
        return (suffix > 0) & self.wanted[np.maximum(suffix - 1, 0)]

    def induce(self, suffix: np.ndarray, common: np.ndarray, on: np.ndarray) -> None:
        """Put in the suffixes before those at ``on``; ``common``: of each with the one taken before it."""
        new = suffix[on] - 1
        c = self.letter(new)
        carried = np.zeros(len(new), np.uint8)
        if self.cap:
            least, order = _Least(common), np.argsort(c, kind="stable")
            cs, at = c[order], on[order]
            head = np.concatenate(([True], cs[1:] != cs[:-1])) if len(cs) else np.zeros(0, bool)
            low = np.where(head, 0, np.concatenate(([0], at[:-1])) + 1)
            value = least.of(low, at)
            value[head] = np.minimum(value[head], self.least[cs[head]])
            carried[order] = value
            np.minimum(self.least, common.min(initial=255), out=self.least)
            tail = np.flatnonzero(np.concatenate((head[1:], [True]))) if len(cs) else np.zeros(0, np.int64)
            last, seen = at[tail], np.full(len(tail), 255, np.uint8)
            more = last < len(suffix) - 1
            seen[more] = least.of(last[more] + 1, np.full(int(more.sum()), len(suffix) - 1))
            self.least[cs[tail]] = seen
        self.queue.put(c >> self.shift, new, carried)

    def run(self, first: np.ndarray, late: np.ndarray, late_common: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Wanted suffixes in order, with the prefix that each has in common with the one before it (0 at a new letter).

        ``first`` are put in before all; ``late``, in order, come after all wanted ones of their letter.
        """
        total = int(np.count_nonzero(self.wanted))
        out, shared, done = array(total, np.int64, self.budget), array(total if self.cap else 0, np.uint8, self.budget), 0
        if len(first):
            self.queue.put(self.letter(first) >> self.shift, first, np.zeros(len(first), np.uint8))
        ranges = len(self.queue.rows)
        counts = np.zeros(ranges, np.int64)
        for i in range(0, len(late), STEP):
            counts += np.bincount(self.letter(late[i : i + STEP]) >> self.shift, minlength=ranges)
        bounds = np.concatenate(([0], np.cumsum(counts)))
        for r in range(ranges):
            a, b = int(bounds[r]), int(bounds[r + 1])
            if self.shift:
                rest = late[a:b]
                own, _ = self.queue.take(r)
                while len(own) or len(rest):
                    c = np.concatenate((self.letter(own), self.letter(rest)))
                    both, is_late = np.concatenate((own, rest)), np.arange(len(c)) >= len(own)
                    order = np.argsort(2 * c + is_late, kind="stable")
                    c, both, is_late = c[order], both[order], is_late[order]
                    can = self.before(both)
                    to = np.where(can, self.letter(np.maximum(both - 1, 0)), _NEVER)
                    bound = np.concatenate(([_NEVER], np.minimum.accumulate(to)[:-1]))
                    ready = (c < bound) | ((c == bound) & ~is_late)
                    n = len(ready) if ready.all() else int(np.argmin(ready))
                    mine = both[:n][~is_late[:n]]
                    out[done : done + len(mine)] = mine
                    done += len(mine)
                    self.induce(both[:n], np.zeros(0, np.uint8), np.flatnonzero(can[:n]))
                    back, _ = self.queue.take(r)
                    own, rest = np.concatenate((both[n:][~is_late[n:]], back)), both[n:][is_late[n:]]
                continue
            fresh = True
            while True:
                own, carried = self.queue.take(r)
                if not len(own):
                    break
                common = np.minimum(carried.astype(np.int64) + 1, self.cap).astype(np.uint8)
                if fresh:
                    common[0], fresh = 0, False
                out[done : done + len(own)] = own
                if self.cap:
                    shared[done : done + len(own)] = common
                done += len(own)
                self.induce(own, common, np.flatnonzero(self.before(own)))
                last = own[-1:]
            if b > a:
                some = np.asarray(late[a:b])
                common = np.zeros(0, np.uint8)
                if self.cap:
                    common = np.array(late_common[a:b])
                    common[0] = 0 if fresh else common_prefix(self.text, last, some[:1], self.cap)[0]
                self.induce(some, common, np.flatnonzero(self.before(some)))
        return out[:done], shared[:done]


def _kinds(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one; the last one is not."""
    n = len(text)
    change = np.flatnonzero(text[:-1] != text[1:])
    out = np.zeros(n, bool)
    up = text[change] < text[change + 1]
    lengths = np.diff(np.concatenate(([-1], change)))
    out[: int(lengths.sum())] = np.repeat(up, lengths)
    return out


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffixes of a text of names in order, by sorting pairs of ranks of twice the length each time."""
    rank, width = names.astype(np.int64), 1
    while True:
        behind = np.full(len(rank), -1, np.int64)
        behind[: max(0, len(rank) - width)] = rank[width:]
        order = np.lexsort((behind, rank))
        new = np.ones(len(rank), np.int64)
        new[1:] = (rank[order][1:] != rank[order][:-1]) | (behind[order][1:] != behind[order][:-1])
        rank = np.empty(len(rank), np.int64)
        rank[order] = np.cumsum(new) - 1
        if not len(rank) or rank[order[-1]] == len(rank) - 1:
            return order
        width *= 2


def _places(marks: np.ndarray, budget: int) -> np.ndarray:
    """Where ``marks`` holds."""
    out, done = array(int(np.count_nonzero(marks)), np.int64, budget), 0
    for i in range(0, len(marks), STEP):
        some = np.flatnonzero(marks[i : i + STEP]) + i
        out[done : done + len(some)] = some
        done += len(some)
    return out


def _by_letter(text: np.ndarray, seeds: np.ndarray, letters: int, budget: int) -> np.ndarray:
    """Seeds by the range of their letter."""
    shift = max(0, (letters - 1).bit_length() - RANGES.bit_length() + 1)
    queue, out, done = Queue(((letters - 1) >> shift) + 1, budget), array(len(seeds), np.int64, budget), 0
    for i in range(0, len(seeds), STEP):
        some = np.asarray(seeds[i : i + STEP])
        queue.put(text[some].astype(np.int64) >> shift, some, np.zeros(len(some), np.uint8))
    for r in range(len(queue.rows)):
        some, _ = queue.take(r)
        out[done : done + len(some)] = some
        done += len(some)
    return out


def _names(text: np.ndarray, seeds: np.ndarray, ordered: np.ndarray, budget: int) -> tuple[np.ndarray, int]:
    """Name of the substring of each seed (its place among the distinct ones), and how many there are."""
    out, name, n = array(len(seeds), np.int64, budget), 0, len(seeds)
    for i in range(0, n, STEP):
        some = np.asarray(ordered[max(0, i - 1) : i + STEP])
        number = np.searchsorted(seeds, some)
        ends = np.where(number + 1 < n, seeds[np.minimum(number + 1, n - 1)], len(text))
        lengths = ends - some + 1
        on = np.flatnonzero((lengths[:-1] == lengths[1:]) & (np.maximum(number[:-1], number[1:]) < n - 1))  # the last one is like no other
        new, d = np.ones(len(some), np.int64), 0
        while len(on):
            on = on[text[some[on] + d] == text[some[on + 1] + d]]
            d += 1
            over = lengths[on] == d
            new[on[over] + 1] = 0
            on = on[~over]
        if i:
            new, number = new[1:], number[1:]
        names = name + np.cumsum(new)
        out[number] = names - 1
        name = int(names[-1])
    return out, name


def _merged(text: np.ndarray, large: np.ndarray, large_common: np.ndarray, falling: np.ndarray, small_common: np.ndarray, letters: int, cap: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Letter by letter the large suffixes, then the small ones in rising order."""
    counts = [np.zeros(letters, np.int64), np.zeros(letters, np.int64)]
    for n, part in zip(counts, (large, falling)):
        for i in range(0, len(part), STEP):
            n += np.bincount(text[part[i : i + STEP]], minlength=letters)
    out, common, done = array(len(text), np.int64, budget), array(len(text), np.uint8, budget), 0
    a, b = 0, len(falling)
    for c in np.flatnonzero(counts[0] + counts[1]).tolist():
        n, m = int(counts[0][c]), int(counts[1][c])
        out[done : done + n] = large[a : a + n]
        common[done : done + n] = large_common[a : a + n]
        if n:
            common[done] = 0
        a, done = a + n, done + n
        if m:
            out[done : done + m] = falling[b - m : b][::-1]
            common[done + 1 : done + m] = small_common[b - m + 1 : b][::-1]
            common[done] = common_prefix(text, out[done - 1 : done], out[done : done + 1], cap)[0] if n else 0
        b, done = b - m, done + m
    return out, common


def suffixes(text: np.ndarray, letters: int, cap: int = 0, budget: int = BUDGET, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a text (numbers below ``letters``) in order and, if ``cap``, each one's common prefix with the one before.

    Common prefixes are counted up to ``cap`` (255 at most; it needs 4,096 letters or fewer).
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    small = _kinds(text)
    first_small = small.copy()
    first_small[1:] &= ~small[:-1]
    first_small[0] = False
    seeds = _places(first_small, budget)
    last = np.array([n - 1], np.int64)

    def both(late: np.ndarray, common: np.ndarray | None, cap: int):
        """The large suffixes and, in falling order, the small ones."""
        large, large_common = _Pass(text, letters, False, ~small, budget, cap).run(last, late, common)
        back = np.concatenate((np.zeros(1, np.uint8), large_common[:0:-1])) if cap else None
        return large, large_common, *_Pass(text, letters, True, small, budget, cap).run(last[:0], large[::-1], back)

    ordered = seeds
    if len(seeds) > 1:
        _, _, falling, _ = both(_by_letter(text, seeds, letters, budget), None, 0)
        ordered, done = array(len(seeds), np.int64, budget), len(seeds)
        for i in range(0, len(falling), STEP):
            some = np.asarray(falling[i : i + STEP])
            some = some[first_small[some]][::-1]
            ordered[done - len(some) : done] = some
            done -= len(some)
        names, count = _names(text, seeds, ordered, budget)
        if count < len(seeds):
            order = _doubled(names) if len(names) <= base else suffixes(names, count, 0, budget, base)[0]
            for i in range(0, len(order), STEP):
                ordered[i : i + STEP] = seeds[order[i : i + STEP]]
    common = None
    if cap:
        common = array(len(ordered), np.uint8, budget)
        common[:1] = 0
        for i in range(1, len(ordered), STEP):
            some = np.asarray(ordered[i - 1 : i + STEP])
            common[i : i + STEP] = common_prefix(text, some[:-1], some[1:], cap)
    large, large_common, falling, small_common = both(ordered, common, cap)
    if cap:
        return _merged(text, large, large_common, falling, small_common, letters, cap, budget)
    rising = falling[::-1]
    key = np.concatenate((text[large].astype(np.int64) * 2, text[rising].astype(np.int64) * 2 + 1))
    return np.concatenate((large, rising))[np.argsort(key, kind="stable")], np.zeros(0, np.uint8)
