"""A compressed full-text index of a shard of texts, and matching statistics by backward search.

The index holds the Burrows-Wheeler transform as a wavelet matrix of packed digits of `DIGIT` bits, the symbols' counts,
and the longest-common-prefix intervals' parents; suffixes are sorted by prefix doubling in which only unresolved groups are
sorted again. Many texts are searched in lock step, one lane each: a step extends every lane's match by one character
to the left, and a lane that can't be extended moves to its interval's parent (Ohlebusch, Gog, Kuegel 2010).
"""

from __future__ import annotations

import numpy as np

LANE = 500
DIGIT = 4
_SHIFT, _INSIDE = (64 // DIGIT).bit_length() - 1, 64 // DIGIT - 1
_LOW = np.uint64(sum(1 << k for k in range(0, 64, DIGIT)))
_BELOW = np.array([int(_LOW) & ((1 << (k * DIGIT)) - 1) for k in range(64 // DIGIT)], np.uint64)


def _next_separator(code: np.ndarray) -> np.ndarray:
    """Distance from each position to the next separator (symbol 0) at or after it; the last symbol must be one."""
    at = np.where(code == 0, np.arange(code.size), code.size)
    return np.minimum.accumulate(at[::-1])[::-1] - np.arange(code.size)


def _packed(code: np.ndarray, apart: np.ndarray, h: int, bits: int) -> np.ndarray:
    """The first h symbols of each suffix in one integer, zero from its separator on."""
    padded = np.concatenate([code, np.zeros(h, code.dtype)])
    key = np.zeros(code.size, np.int64)
    for t in range(h):
        key <<= bits
        key |= np.where(apart > t, padded[t : t + code.size], 0)
    return key


class Index:
    """code: dense symbols from 1 on, 0 ends each text; owner: for each position the number of the text's document."""

    def __init__(self, code: np.ndarray, owner: np.ndarray):
        n = code.size
        self.code, self.n, self.bits = code, n, max(1, int(code.max()).bit_length())
        apart = _next_separator(code)
        h = 8 if self.bits <= 7 else 4 if self.bits <= 15 else 2
        key = _packed(code, apart, h, self.bits)
        order = np.argsort(key)  # equal keys are one group, in whatever order
        ended = apart[order] < h
        fresh = np.ones(n, bool)
        fresh[1:] = (np.diff(key[order]) != 0) | ended[1:] | ended[:-1]
        starts = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank = np.empty(n, np.int32)
        rank[order] = starts
        levels = []
        open_ = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        while True:
            levels.append((h, np.append(rank, -1)))
            if not open_.size:
                break
            index = order[open_]
            key2 = rank[index].astype(np.int64) * n + rank[np.minimum(index + h, n - 1)]
            by = np.argsort(key2)
            order[open_] = index = index[by]
            key2 = key2[by]
            fresh = np.ones(open_.size, bool)
            fresh[1:] = key2[1:] != key2[:-1]
            rank[index] = np.maximum.accumulate(np.where(fresh, open_, 0))
            open_ = open_[~(fresh & np.append(fresh[1:], True))]
            h *= 2
        self.sa = order
        self._lcp(levels, apart)
        del levels, rank, key, apart, fresh, starts, open_, ended  # the largest arrays, before the others are made
        self._parents()
        self._wavelet(code[order - 1])
        doc = owner[order]
        change = np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, n)
        self.other = np.append(np.repeat(change, np.diff(change, prepend=0)), n + 1).astype(np.int32)

    def _lcp(self, levels: list[tuple[int, np.ndarray]], apart: np.ndarray) -> None:
        """Common prefixes of neighbours, by halving steps; a place beyond the text's end equals no other."""
        n, same = self.n, np.zeros(self.n - 1, np.int32)
        a, b = self.sa[:-1].astype(np.int32), self.sa[1:].astype(np.int32)
        least = levels[0][0]
        while least > 1:
            least //= 2
            key = _packed(self.code, apart, least, self.bits)
            levels.insert(0, (least, np.append(np.where(apart < least, -1 - np.arange(n), key), -1 - n)))
        while levels:
            h, rank = levels.pop()
            same += np.int32(h) * (rank.take(a + same) == rank.take(b + same))
        self.lcp = np.concatenate([[-1], same, [-1]]).astype(np.int32)

    def _parents(self) -> None:
        """For each border between suffixes the nearest borders with a smaller common prefix."""
        lcp, m = self.lcp, self.lcp.size
        sides = []
        for step in (-1, 1):
            to = np.clip(np.arange(m) + step, 0, m - 1)
            todo = np.arange(1, m - 1)
            while todo.size:
                todo = todo[lcp[to[todo]] >= lcp[todo]]
                to[todo] = to[to[todo]]
            sides.append(to.astype(np.int32))
        self.before, self.after = sides

    def _wavelet(self, bwt: np.ndarray) -> None:
        """Levels of DIGIT bits each: per level the packed digits, and the place of each digit before each word."""
        n, per, digits = self.n, 64 // DIGIT, 1 << DIGIT
        levels = -(-self.bits // DIGIT)
        size = n // per + 1
        symbols = np.arange(1 << self.bits)
        start = np.zeros(symbols.size, np.int64)
        self.words, self.places, self.blocks, self.pattern = [], [], [], []
        now = bwt
        for level in range(levels - 1, -1, -1):
            digit = (now >> (level * DIGIT)) & (digits - 1)
            packed = np.zeros(size, np.uint64)
            wide = np.concatenate([digit, np.zeros(size * per - n, digit.dtype)]).reshape(size, per)
            for k in range(per):
                packed |= wide[:, k].astype(np.uint64) << np.uint64(k * DIGIT)
            counts = np.stack([(wide == d).sum(axis=1, dtype=np.int32) for d in range(digits)])
            counts[0, -1] -= size * per - n
            first = np.concatenate([[0], np.cumsum(counts.sum(axis=1))[:-1]])
            before = np.cumsum(counts, axis=1, dtype=np.int32) - counts + first[:, None].astype(np.int32)
            own = (symbols >> (level * DIGIT)) & (digits - 1)
            self.words.append(packed)
            self.places.append(before.ravel())
            self.blocks.append(own * size)
            self.pattern.append(own.astype(np.uint64) * _LOW)
            start = self._down(len(self.words) - 1, start, symbols)
            now = now[np.argsort(digit.astype(np.int8), kind="stable")]
        counts = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=1 << self.bits))[:-1]])
        self.offset = (counts - start).astype(np.int64)

    def _down(self, level: int, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where the digit of symbol before each place goes: its rank, by a count of equal digits within a word."""
        word = at >> _SHIFT
        x = self.words[level].take(word)
        x ^= self.pattern[level].take(symbol)
        for k in range(DIGIT.bit_length() - 1):
            x |= x >> np.uint64(1 << k)
        np.invert(x, out=x)
        x &= _BELOW.take(at & _INSIDE)
        word += self.blocks[level].take(symbol)
        return self.places[level].take(word) + np.bitwise_count(x)

    def extend(self, symbol: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search step: the intervals of symbol + match."""
        at, both = np.concatenate([left, right]).astype(np.int64), np.concatenate([symbol, symbol])
        for k in range(len(self.words)):
            at = self._down(k, at, both).astype(np.int64)
        at += self.offset.take(both)
        return at[: symbol.size], at[symbol.size :]

    def shared(self, begin: np.ndarray, end: np.ndarray, least: int, probe: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lane, start, end) of the maximal matches of `least` symbols or more that stand in two documents.

        Lanes are stretches [begin, end) of the indexed text. A lane first looks at the `probe` symbols that every
        match ending within the next least - probe symbols must contain, and goes through those only if they are shared.
        """
        n, gap = self.n, least - probe
        low, top = begin.astype(np.int64), end.astype(np.int64)
        lane = np.flatnonzero(top - low >= least)
        low, top = low[lane], top[lane]
        probing, goal = np.ones(lane.size, bool), top - least  # goal: where the probe, or the lane, begins
        e = top - gap
        s, left, right = e.copy(), np.zeros(lane.size, np.int64), np.full(lane.size, n, np.int64)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def tell(at: np.ndarray) -> None:
            told = at[e[at] - s[at] >= least]
            if told.size:
                out.append((lane[told], s[told], e[told]))

        while lane.size:
            l2, r2 = self.extend(self.code.take(s - 1), left, right)
            ok = self.other.take(l2) < r2
            np.copyto(left, l2, where=ok)
            np.copyto(right, r2, where=ok)
            s -= ok
            done = []
            hit = np.flatnonzero(ok & (s == goal))
            if hit.size:
                whole = hit[probing[hit]]  # the probe is shared: go through its symbols from the right
                ended = hit[~probing[hit]]
                tell(ended)
                done.append(ended)
                probing[whole], goal[whole] = False, low[whole]
                e[whole] = s[whole] = top[whole]
                left[whole], right[whole] = 0, n
            failed = np.flatnonzero(~ok)
            if failed.size:
                missed, stuck = failed[probing[failed]], failed[~probing[failed]]
                top[missed] -= gap
                again = missed
                if stuck.size:
                    tell(stuck)
                    a, b = left[stuck], right[stuck]
                    x, y = self.lcp.take(a), self.lcp.take(b)
                    border, depth = np.where(x >= y, a, b), np.maximum(x, y)
                    left[stuck], right[stuck] = self.before.take(border), self.after.take(border)
                    empty = e[stuck] == s[stuck]  # not even the character itself is shared
                    e[stuck] = s[stuck] + np.maximum(depth, 0)
                    brief = depth < probe
                    short, on = stuck[brief], stuck[~brief]
                    top[short] = e[short] - empty[brief]
                    again = np.concatenate([short, missed])
                    done.append(on[e[on] - low[on] < least])
                probing[again], goal[again] = True, top[again] - least
                e[again] = s[again] = top[again] - gap
                left[again], right[again] = 0, n
                done.append(again[top[again] - low[again] < least])
            if any(d.size for d in done):
                keep = np.ones(lane.size, bool)
                keep[np.concatenate(done)] = False
                lane, low, top, probing, goal, e, s, left, right = (x[keep] for x in (lane, low, top, probing, goal, e, s, left, right))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def dense(points: np.ndarray) -> np.ndarray:
    """Code points as dense symbols from 1 on."""
    _, symbol = np.unique(points, return_inverse=True)
    return symbol.astype(np.int32) + 1


def shared_stretches(texts: list[np.ndarray], documents: np.ndarray, least: int, probe: int) -> list[tuple[int, int, int]]:
    """(text number, start, end): merged stretches of texts in matches of `least` or more that stand in two documents too."""
    if len(texts) < 2:
        return []
    sizes = np.array([t.size for t in texts])
    joined = np.concatenate(texts)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    code = np.zeros(int(sizes.sum() + len(texts)), np.int32)
    inside = np.ones(code.size, bool)
    inside[begin + sizes] = False
    code[inside] = dense(joined)
    index = Index(code, np.repeat(documents, sizes + 1))
    cuts = [(i, b + k, min(b + k + LANE + least - 1, b + z)) for i, (b, z) in enumerate(zip(begin.tolist(), sizes.tolist())) if z >= least for k in range(0, max(1, z - least + 1), LANE)]
    if not cuts:
        return []
    number, lo, hi = map(np.array, zip(*cuts))
    lane, start, end = index.shared(lo, hi, least, probe)
    cover = np.zeros(code.size + 1, np.int32)
    np.add.at(cover, start, 1)
    np.add.at(cover, end, -1)
    on = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
    edge = np.flatnonzero(on[1:] != on[:-1])
    first, last = edge[::2], edge[1::2]
    text = np.searchsorted(begin, first, side="right") - 1
    return list(zip(text.tolist(), (first - begin[text]).tolist(), (last - begin[text]).tolist()))
