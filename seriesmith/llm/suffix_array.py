"""Suffix arrays by induced sorting, and permuted longest common prefixes, in numpy.

Suffixes are classified as smaller (S) or larger (L) than the next one. The leftmost-smaller (LMS)
substrings are sorted by inducing, named, and the string of their names is sorted by recursion; from
the sorted LMS suffixes all others are induced in linear time.

Inducing goes through the buckets of first characters in order. A bucket places predecessors into
its own or later buckets only, so successive buckets that place nothing among themselves are taken
together: with the few characters of a text a step is a bucket, with the many names of a
recursion a step is many buckets. A bucket that places into itself (a run of one character)
is taken in rounds. Short strings are induced one by one, as steps have a price of their own.
"""

from __future__ import annotations

import numpy as np

#: Buckets among which the end of a step is looked for.
_AHEAD = 1024
#: Strings of names up to this length are induced one by one.
_SHORT = 32_768


def _types(t: np.ndarray) -> np.ndarray:
    """True for S: the suffix is smaller than the next one. The last character is the sentinel, an S."""
    n = len(t)
    differs = np.flatnonzero(t[1:] != t[:-1])
    nxt = differs[np.searchsorted(differs, np.arange(n - 1))] if len(differs) < n - 1 else np.arange(n - 1)
    out = np.ones(n, bool)
    out[:-1] = t[nxt] < t[nxt + 1]
    return out


def _reach(t: np.ndarray, k: int, of: np.ndarray, least: bool) -> np.ndarray:
    """For each bucket the least (or greatest) bucket into which it places suffixes of the chosen type."""
    pairs = np.flatnonzero(of[:-1])
    b, c = t[pairs + 1].astype(np.int64), t[pairs].astype(np.int64)
    out = np.full(k, k if least else -1, np.int64)
    if k * k <= 1 << 20:
        some = np.flatnonzero(np.bincount(b * k + c, minlength=k * k))
        b, c = some // k, some % k
    (np.minimum if least else np.maximum).at(out, b, c)
    return out


class _Text:
    """A string over the characters 0 .. k - 1, all of which occur; 0 is the sentinel at its end alone."""

    def __init__(self, t: np.ndarray, k: int):
        self.t = t.astype(np.uint8 if k <= 256 else np.uint16 if k <= 65536 else np.int32)
        self.k, self.n = k, len(t)
        self.s = _types(self.t)
        self.every = np.arange(self.n)
        self.low = self.high = None
        self.lms = np.flatnonzero(self.s[1:] & ~self.s[:-1]) + 1
        self.ends = np.cumsum(np.bincount(self.t, minlength=k))
        self.starts = np.concatenate([[0], self.ends])

    def induce(self, lms: np.ndarray) -> np.ndarray:
        """The order of all suffixes from that of the LMS suffixes, or of LMS-prefixes from any order of them."""
        c = self.t[lms]
        order = np.argsort(c, kind="stable")
        count = np.bincount(c, minlength=self.k)
        first = self.ends - count
        sa = np.full(self.n, -1, np.int32)
        seat = (first - (np.cumsum(count) - count))[c[order]] + np.arange(len(lms))
        sa[seat] = lms[order]
        if self.k > 257 and self.n <= _SHORT:
            return self._one_by_one(sa, seat)
        if self.low is None:
            self.low, self.high = _reach(self.t, self.k, ~self.s, True), _reach(self.t, self.k, self.s, False)
        larger = self._larger(sa, first)
        sa[seat[1:]] = -1  # the sentinel keeps its place
        self._smaller(sa, larger)
        return sa

    def _larger(self, sa: np.ndarray, lms_at: np.ndarray) -> np.ndarray:
        at, low, starts, k, b = self.starts[:-1].copy(), self.low, self.starts, self.k, 0
        while b < k:
            if low[b] == b:
                lo, hi = starts[b], at[b]
                while lo < hi:
                    self._place(sa, sa[lo:hi], False, at)
                    lo, hi = hi, at[b]
                self._place(sa, sa[lms_at[b] : self.ends[b]], False, at)
                b += 1
                continue
            apart = np.minimum.accumulate(low[b : b + _AHEAD]) > self.every[b : min(b + _AHEAD, k)]
            e = b + (len(apart) if apart[-1] else int(apart.argmin()))
            self._place(sa, sa[starts[b] : starts[e]], False, at)
            b = e
        return at

    def _smaller(self, sa: np.ndarray, larger: np.ndarray) -> None:
        at, high, starts, b = self.ends.copy(), self.high, self.starts, self.k - 1
        while b >= 0:
            if high[b] == b:
                lo, hi = at[b], self.ends[b]
                while lo < hi:
                    self._place(sa, sa[lo:hi][::-1], True, at)
                    lo, hi = at[b], lo
                self._place(sa, sa[starts[b] : larger[b]][::-1], True, at)
                b -= 1
                continue
            a = max(b - _AHEAD + 1, 0)
            apart = np.maximum.accumulate(high[a : b + 1][::-1]) < self.every[a : b + 1][::-1]
            e = b - (len(apart) if apart[-1] else int(apart.argmin()))
            self._place(sa, sa[starts[e + 1] : self.ends[b]][::-1], True, at)
            b = e

    def _one_by_one(self, start: np.ndarray, seat: np.ndarray) -> np.ndarray:
        # the character and type before each suffix; before the first one there is none to place
        before, larger = [0, *self.t[:-1].tolist()], [False, *(~self.s[:-1]).tolist()]
        smaller = [False, *self.s[:-1].tolist()]
        sa, at = start.tolist(), self.starts.tolist()
        for j in sa:  # grows into places further on
            if j >= 0 and larger[j]:
                c = before[j]
                sa[at[c]] = j - 1
                at[c] += 1
        for k in seat[1:].tolist():
            sa[k] = -1
        at = self.ends.tolist()
        for k in range(self.n - 1, -1, -1):
            j = sa[k]
            if j >= 0 and smaller[j]:
                c = before[j]
                at[c] -= 1
                sa[at[c]] = j - 1
        return np.array(sa, np.int32)

    def _place(self, sa: np.ndarray, found: np.ndarray, smaller: bool, at: np.ndarray) -> None:
        """Predecessors of the chosen type, each to the next free place of its bucket, in the order found."""
        p = found[found > 0]
        p -= 1
        p = p[self.s[p] == smaller]
        m = p.size
        if m < 2:
            if m:
                c = self.t[p[0]]
                at[c] -= smaller
                sa[at[c]] = p[0]
                at[c] += not smaller
            return
        c = self.t[p]
        order = c.argsort(kind="stable")
        c, p = c[order], p[order]
        edge = (c[1:] != c[:-1]).nonzero()[0]
        group, size = np.zeros(edge.size + 1, np.int64), np.empty(edge.size + 1, np.int64)
        group[1:] = edge + 1
        size[:-1], size[-1] = group[1:] - group[:-1], m - group[-1]
        head = c[group]
        if smaller:
            sa[(at[head] - 1 + group).repeat(size) - self.every[:m]] = p
            at[head] -= size
        else:
            sa[(at[head] - group).repeat(size) + self.every[:m]] = p
            at[head] += size

    def names(self, order: np.ndarray) -> tuple[np.ndarray, int]:
        """Names of the LMS substrings in the order of the text, equal ones alike, and how many there are."""
        n, lms = self.n, self.lms
        length = np.zeros(n, np.int32)
        length[lms] = np.diff(np.append(lms, n - 1)) + 1
        x, y = order[:-1], order[1:]
        same = length[x] == length[y]
        live = np.flatnonzero(same)
        size, d = length[x[live]], 0
        while len(live):
            equal = self.t[x[live] + d] == self.t[y[live] + d]
            same[live[~equal]] = False
            d += 1
            on = equal & (size > d)
            live, size = live[on], size[on]
        name = np.zeros(n, np.int32)
        name[order] = np.concatenate([[0], np.cumsum(~same)])
        return name[lms], int(len(order) - np.count_nonzero(same))


def _sorted(t: np.ndarray, k: int) -> np.ndarray:
    text = _Text(t, k)
    lms = text.lms
    if len(lms) > 1:
        sa = text.induce(lms)
        is_lms = np.zeros(text.n, bool)
        is_lms[lms] = True
        order = sa[is_lms[sa]]
        name, different = text.names(order)
        if different < len(lms):
            order = lms[_sorted(name, different)]
        lms = order
    return text.induce(lms)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a byte string in their order; a prefix sorts first."""
    if not len(text):
        return np.zeros(0, np.int32)
    present = np.flatnonzero(np.bincount(text))
    rank = np.zeros(int(present[-1]) + 1, np.int32)
    rank[present] = np.arange(1, len(present) + 1)
    return _sorted(np.append(rank[text], 0), len(present) + 1)[1:]


def eights(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out |= padded[k : k + len(text)].astype(np.uint64) << np.uint64(8 * k)
    return out


def permuted_lcp(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position of a byte string, what its suffix shares with the one before it in order.

    Where the characters before both suffixes are equal too, it is one less than at the position
    before; only the others are compared, eight bytes at a time.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    every = np.arange(n)
    own = (before <= 0) | (every == 0)
    own[~own] = text[every[~own] - 1] != text[before[~own] - 1]
    at = np.flatnonzero(own)
    a, b, out = at, before[at], np.zeros(len(at), np.int64)
    grams = np.concatenate([eights(text), np.zeros(8, np.uint64)])
    live = np.flatnonzero(b >= 0)
    room = n - np.maximum(a, b)
    while len(live):
        done = out[live]
        x = grams[a[live] + done] ^ grams[b[live] + done]
        out[live] += np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3)
        live = live[(x == 0) & (out[live] < room[live])]
    out = np.minimum(out, np.where(b < 0, 0, room))
    return out[np.cumsum(own) - 1] - (every - at[np.cumsum(own) - 1])


def repeated(text: np.ndarray, length: int) -> np.ndarray:
    """True where the ``length`` bytes from a position on also start at another position."""
    sa = suffix_array(text)
    shared = permuted_lcp(text, sa)
    out = shared >= length
    out[sa[:-1]] |= shared[sa[1:]] >= length
    return out
