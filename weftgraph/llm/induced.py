"""Equal windows of a byte string by external induced sorting with common-prefix values.

Suffixes are sorted to a fixed depth. The seeds are the suffixes at leftmost S-type places;
they are sorted in passes of eight bytes, each over the ties of the pass before, which also
gives the common prefix of neighbours. All other suffixes are induced from them: a scan in
suffix order sends the place before each suffix to the queue of its first byte. What a queue
receives is already in order, so a priority queue keyed by (first byte, rank of the rest) is
one first-in-first-out queue a byte; `Queue` keeps them on disk beyond a bound. An entry
carries its common prefix with its neighbour: one more than the least value that the scan
passed since the same queue was last fed.
"""

from __future__ import annotations

import tempfile

import numpy as np

SENTINEL, BREAK, SHIFT = 0, 1, 2  # text bytes are stored as byte + SHIFT
BATCH = 1 << 18
ENTRY = np.dtype([("at", "<i8"), ("lcp", "u1")])


class Queue:
    """First in, first out; kept entries can be read again. In memory up to `limit` entries, then on disk."""

    def __init__(self, spool, limit: int):
        self.spool, self.limit = spool, limit
        self.parts: list = []  # arrays, or (offset, count) in the spool
        self.held = self.length = self.read = 0

    def push(self, at: np.ndarray, lcp: np.ndarray) -> None:
        part = np.empty(len(at), dtype=ENTRY)
        part["at"], part["lcp"] = at, lcp
        self.parts.append(part)
        self.held += len(part)
        self.length += len(part)
        if self.held > self.limit:
            for k, p in enumerate(self.parts):
                if isinstance(p, np.ndarray):
                    self.spool.seek(0, 2)
                    offset = self.spool.tell()
                    self.spool.write(p.tobytes())
                    self.parts[k] = (offset, len(p))
            self.held = 0

    def _get(self, k: int) -> np.ndarray:
        part = self.parts[k]
        if isinstance(part, np.ndarray):
            return part
        self.spool.seek(part[0])
        return np.frombuffer(self.spool.read(part[1] * ENTRY.itemsize), dtype=ENTRY)

    def unread(self):
        """Entries not read yet, also those that come while reading; small parts together, up to BATCH."""
        while self.read < len(self.parts):
            parts, n = [], 0
            while self.read < len(self.parts) and n < BATCH:
                parts.append(self._get(self.read))
                n += len(parts[-1])
                self.read += 1
            part = np.concatenate(parts) if len(parts) > 1 else parts[0]
            for s in range(0, len(part), BATCH):
                yield part[s : s + BATCH]

    def all(self) -> np.ndarray:
        parts = [self._get(k) for k in range(len(self.parts))]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=ENTRY)


def s_types(t: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than the next one."""
    change = np.flatnonzero(t[1:] != t[:-1])
    rising = t[change] < t[change + 1]
    out = np.empty(len(t), dtype=bool)
    out[: len(t) - 1] = np.repeat(rising, np.diff(np.concatenate(([-1], change))))[: len(t) - 1] if len(change) else False
    out[-1] = True
    return out


def _leading_equal(x: np.ndarray) -> np.ndarray:
    """Equal leading bytes of two words whose exclusive or is x."""
    return sum(((x >> np.uint64(s)) == 0).astype(np.int64) for s in range(56, -8, -8))


def _within_groups(group: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The order by word within groups, which are in order already. Ties are in any order."""
    order = np.argsort(word)
    new = group[1:] != group[:-1]
    if not new.any():
        return order
    rank = np.empty(len(word), dtype=np.int64)
    sorted_ = word[order]
    rank[order] = np.concatenate(([0], np.cumsum(sorted_[1:] != sorted_[:-1])))
    rank[1:] += np.cumsum(new) * len(word)
    return np.argsort(rank)


def sorted_seeds(t: np.ndarray, seeds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds by their first `depth` bytes, and each one's common prefix with the one before, at most depth."""
    padded = np.concatenate((t, np.zeros(depth + 16, dtype=np.uint8)))
    words = np.ndarray((len(padded) - 7,), dtype=">u8", buffer=padded, strides=(1,))  # eight bytes from each place
    order = seeds.copy()
    group = np.zeros(len(seeds), dtype=np.int64)  # where each tie begins
    lcp = np.full(len(seeds), depth, dtype=np.int64)
    lcp[:1] = 0
    active = np.arange(len(seeds))
    for at in range(0, depth, 8):
        if len(active) < 2:
            break
        word = words[order[active] + at].astype(np.uint64)
        by = _within_groups(group[active], word)
        order[active] = order[active[by]]
        word = word[by]
        tied = group[active[1:]] == group[active[:-1]]
        split = np.flatnonzero(tied & (word[1:] != word[:-1])) + 1
        lcp[active[split]] = np.minimum(depth, at + _leading_equal(word[split] ^ word[split - 1]))
        begins = np.concatenate(([True], ~tied))
        begins[split] = True
        first = np.maximum.accumulate(np.where(begins, np.arange(len(active)), 0))
        group[active] = active[first]
        size = np.bincount(first, minlength=len(active))
        active = active[size[first] > 1]
    return order, lcp


def _common(t: np.ndarray, a: int, b: int, depth: int) -> int:
    x, y = t[a : a + depth], t[b : b + depth]
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


class _Scan:
    """Feeds queues from entries in suffix order, and carries common prefixes."""

    def __init__(self, t: np.ndarray, wanted: np.ndarray, queues: list[Queue], depth: int):
        self.t, self.wanted, self.queues, self.depth = t, wanted, queues, depth
        self.low = np.full(256, 255, dtype=np.uint8)  # least prefix passed since a queue was fed
        self.fed = np.zeros(256, dtype=bool)

    def feed(self, at: np.ndarray, lcp: np.ndarray) -> None:
        m = len(at)
        lcp = lcp.astype(np.uint8)
        before = at - 1
        hit = np.flatnonzero((before >= 0) & self.wanted[before])
        least = lcp.min() if m else 255
        chars = self.t[before[hit]]
        order = np.argsort(chars, kind="stable")
        k, c = hit[order], chars[order]
        prefix = np.minimum.accumulate(lcp)
        suffix = np.minimum.accumulate(lcp[::-1])[::-1]
        cuts = np.flatnonzero(np.diff(c)) + 1
        firsts = np.concatenate(([0], cuts)).astype(np.int64) if len(c) else np.zeros(0, np.int64)
        value = np.zeros(len(k), dtype=np.uint8)
        if len(k) > 1:
            value[1:] = _range_min(lcp, k[:-1] + 1, k[1:])
        value[firsts] = np.minimum(self.low[c[firsts]], prefix[k[firsts]])
        new = np.minimum(value.astype(np.int64) + 1, self.depth)
        unfed = ~self.fed[c[firsts]]
        new[firsts[unfed]] = 0
        ends = np.concatenate((cuts, [len(c)])).astype(np.int64) if len(c) else firsts
        low = np.minimum(self.low, least)
        for s, e in zip(firsts.tolist(), ends.tolist()):
            char, last = int(c[s]), int(k[e - 1])
            self.queues[char].push(before[k[s:e]], new[s:e])
            self.fed[char] = True
            low[char] = suffix[last + 1] if last + 1 < m else 255
        self.low = low


def _range_min(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(x[a : b + 1]) for many ranges, none empty unless b < a (then the next value, which the caller overwrites)."""
    size = np.maximum(b - a + 1, 1)
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(a), dtype=x.dtype)
    row = x
    for lv in range(int(level.max()) + 1):
        if lv:
            row = np.minimum(row[: -(1 << lv - 1)], row[1 << lv - 1 :])
        use = np.flatnonzero(level == lv)
        if len(use):
            end = len(row) - 1
            out[use] = np.minimum(row[np.minimum(a[use], end)], row[np.minimum(np.maximum(b[use] - (1 << lv) + 1, 0), end)])
    return out


def equal_windows(t: np.ndarray, depth: int, limit: int = 1 << 20):
    """Runs of suffixes that share their first `depth` bytes, as (places, run starts), one array for each first byte.

    t ends with SENTINEL, which occurs nowhere else; places are in suffix order.
    """
    s_type = s_types(t)
    seeds = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    seeds, seed_lcp = sorted_seeds(t, seeds, depth)
    by_char = np.searchsorted(t[seeds], np.arange(257))
    with tempfile.TemporaryFile() as spool:
        larger = [Queue(spool, limit) for _ in range(256)]
        scan = _Scan(t, ~s_type, larger, depth)
        for c in range(256):
            last = None
            for part in larger[c].unread():
                scan.feed(part["at"], part["lcp"])
                last = int(part["at"][-1])
            own = slice(by_char[c], by_char[c + 1])
            at, lcp = seeds[own], seed_lcp[own].copy()
            if len(at):
                lcp[0] = 0 if last is None else _common(t, last, int(at[0]), depth)
                for s in range(0, len(at), BATCH):
                    scan.feed(at[s : s + BATCH], lcp[s : s + BATCH])
        smaller = [Queue(spool, limit) for _ in range(256)]
        scan = _Scan(t, s_type, smaller, depth)
        for c in range(255, -1, -1):
            last = None
            for part in smaller[c].unread():
                scan.feed(part["at"], part["lcp"])
                last = int(part["at"][-1])
            up = larger[c].all()
            seam = 0
            if len(up):
                down = up["at"][::-1]
                lcp = np.concatenate(([0], up["lcp"][1:][::-1])).astype(np.int64)
                if last is not None:
                    lcp[0] = seam = _common(t, last, int(down[0]), depth)
                for s in range(0, len(down), BATCH):
                    scan.feed(down[s : s + BATCH], lcp[s : s + BATCH])
            low = smaller[c].all()
            places = np.concatenate((up["at"], low["at"][::-1]))
            if len(places) > 1:
                common = np.concatenate((up["lcp"][1:], [seam] * (len(up) > 0 and len(low) > 0), low["lcp"][1:][::-1]))
                yield places, np.concatenate(([0], np.flatnonzero(common < depth) + 1))
            larger[c] = smaller[c] = None
