"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Induced sorting: every suffix is smaller (S) or larger (L) than the next one;
leftmost S suffixes (LMS) are sorted, and all others follow from them in two
sweeps over the first letters. Letters are bytes at first, so a sweep is a few
hundred steps, each of them array operations on a whole bucket; LMS substrings
are sorted by the same two sweeps, then named, and the shortened text of names is
sorted by recursion. Its alphabet is too large for steps by letter: there LMS
substrings are sorted letter by letter, all at once, and the two sweeps step by
suffix. The recursion ends where all names differ.

Texts are joined, each followed by an end mark of its own, smaller than any byte
and equal to no other, so no common prefix runs over a text's end.
"""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15


def of_names(t: np.ndarray) -> np.ndarray:
    """Suffix array of joined texts whose letters are dense numbers instead of bytes."""
    return _sorted_names(t.astype(np.int64))


def join(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts with their end marks, and where each text starts. The last end mark is 0."""
    m = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64) + 1
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.empty(int(sizes.sum()), np.int32)
    for j, (at, t) in enumerate(zip(starts, texts)):
        out[at : at + len(t)] = t
        out[at : at + len(t)] += m
        out[at + len(t)] = m - 1 - j
    return out, starts


def _types(t: np.ndarray) -> np.ndarray:
    """True for S suffixes."""
    n = len(t)
    differs = np.concatenate([t[:-1] != t[1:], [True]])
    nxt = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    smaller = np.concatenate([t[:-1] < t[1:], [True]])
    return smaller[nxt]


def _dealt(by: list[list[np.ndarray]], where: np.ndarray, letters: np.ndarray) -> None:
    """Appends places to their letters' buckets, order kept."""
    if not len(where):
        return
    order = np.argsort(letters, kind="stable")
    where, letters = where[order], letters[order]
    cuts = np.flatnonzero(np.diff(letters)) + 1
    for piece, c in zip(np.split(where, cuts), letters[np.concatenate([[0], cuts])].tolist()):
        by[c].append(piece)


def _induced(t: np.ndarray, low: np.ndarray, is_s: np.ndarray, marks: int, lms: np.ndarray) -> np.ndarray:
    """The suffix array that follows from ``lms``, the LMS places in their order. ``low``: letters as 0 (any end mark) to 256."""
    larger: list[list[np.ndarray]] = [[] for _ in range(257)]
    first: list[list[np.ndarray]] = [[] for _ in range(257)]
    _dealt(first, lms, low[lms])
    ends = np.flatnonzero(low == 0).astype(np.int32)
    ends = ends[np.argsort(t[ends])]
    done_larger: list[np.ndarray] = [np.empty(0, np.int32)] * 257

    def before(p: np.ndarray, s: bool) -> np.ndarray:
        p = p[p > 0] - 1
        return p[is_s[p] == s]

    for c in range(257):
        own: list[np.ndarray] = []
        if c == 0:
            j = before(ends, False)
            _dealt(larger, j, low[j])
            continue
        wave = larger[c]
        while wave:
            p = np.concatenate(wave)
            own.append(p)
            j = before(p, False)
            same = low[j] == c
            wave = [j[same]] if same.any() else []
            _dealt(larger, j[~same], low[j[~same]])
        done_larger[c] = np.concatenate(own) if own else done_larger[c]
        if first[c]:
            j = before(np.concatenate(first[c]), False)
            _dealt(larger, j, low[j])
    smaller: list[list[np.ndarray]] = [[] for _ in range(257)]
    out: list[np.ndarray] = []
    for c in range(256, 0, -1):
        own = []
        wave = smaller[c]
        while wave:
            p = np.concatenate(wave)
            own.append(p)
            j = before(p, True)
            same = low[j] == c
            wave = [j[same]] if same.any() else []
            _dealt(smaller, j[~same], low[j[~same]])
        j = before(done_larger[c][::-1], True)
        _dealt(smaller, j, low[j])
        out.append(np.concatenate(own) if own else np.empty(0, np.int32))
        out.append(done_larger[c][::-1])
    return np.concatenate([*out, ends[::-1]])[::-1]


def prefix_sums(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rolling sums and inverse powers; ``(s[b] - s[a]) * inverse[a]`` hints at t[a:b] modulo 2^64: strings that differ in it differ, the others are compared."""
    n = len(t)
    with np.errstate(over="ignore"):
        power = np.full(n, _ODD, np.uint64)
        power[:1] = 1
        np.multiply.accumulate(power, out=power)
        inverse = np.full(n + 1, pow(_ODD, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        x = t.astype(np.uint64) + np.uint64(1)
        x *= np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        x *= power
        del power
        s = np.zeros(n + 1, np.uint64)
        np.cumsum(x, out=s[1:])
    return s, inverse


def agree(t: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """How many of the ``size`` letters from ``a`` and from ``b`` on agree before the first that does not, letter by letter; about ``most`` letters at once."""
    out, upto, lo = size.astype(np.int64), np.cumsum(size, dtype=np.int64), 0
    while lo < len(out):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - out[lo] + most, "right")))
        n = out[lo:hi].copy()
        which = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(which)) - (upto[lo:hi] - n - (upto[lo] - n[0]))[which]
        off = np.flatnonzero(t[a[lo:hi][which] + step] != t[b[lo:hi][which] + step])
        each, at = np.unique(which[off], return_index=True)
        out[lo + each] = step[off[at]]
        lo = hi
    return out


def suffix_array(t: np.ndarray, marks: int) -> np.ndarray:
    """Of joined texts; ``marks``: how many end marks there are."""
    n = len(t)
    low = np.where(t < marks, 0, t - (marks - 1)).astype(np.uint16)
    is_s = _types(t)
    lms = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int32)
    if len(lms) < 2:
        return _induced(t, low, is_s, marks, lms)
    # LMS substrings in order
    sa = _induced(t, low, is_s, marks, lms)
    at_lms = np.zeros(n, bool)
    at_lms[lms] = True
    ordered = sa[at_lms[sa]]
    end = np.full(n, n, np.int64)
    end[lms[:-1]] = lms[1:] + 1
    s, inverse = prefix_sums(t)
    with np.errstate(over="ignore"):
        mark = (s[end[ordered]] - s[ordered]) * inverse[ordered]
    length = end[ordered] - ordered
    new = np.concatenate([[True], (mark[1:] != mark[:-1]) | (length[1:] != length[:-1])])
    # an equal hash is a hint only
    alike = np.flatnonzero(~new)
    new[alike] = agree(t, ordered[alike - 1], ordered[alike], length[alike]) < length[alike]
    rank = np.empty(n, np.int64)
    rank[ordered] = np.cumsum(new) - 1
    del sa, at_lms, end, s, inverse, mark, length, new, ordered
    return _induced(t, low, is_s, marks, lms[_sorted_names(rank[lms])])


def _sorted_names(r: np.ndarray) -> np.ndarray:
    """Suffix array of a text of names (dense ranks; the last is the smallest and occurs once), by recursion."""
    n = len(r)
    if int(r.max()) + 1 == n:
        out = np.empty(n, np.int64)
        out[r] = np.arange(n)
        return out
    is_s = _types(r)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(lms) > 1:
        lms = lms[_sorted_names(_named(2 * r + is_s, lms))]
    return _swept(r, is_s, lms)


def _named(letters: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Ranks of the LMS substrings, which run to the next LMS place. ``letters`` hold the types too, so none is a prefix of another."""
    m = len(lms)
    size = np.append(np.diff(lms) + 1, 1)
    order, head, places, column = np.arange(m), np.zeros(m, bool), np.arange(m), 0
    head[0] = True
    group = np.zeros(m, np.int64)
    while len(places):
        items = order[places]
        key = letters[lms[items] + column]
        again = np.lexsort((key, group[places]))
        items, key, own = items[again], key[again], group[places][again]
        order[places] = items
        head[places] |= np.concatenate([[True], (own[1:] != own[:-1]) | (key[1:] != key[:-1])])
        group = np.cumsum(head) - 1
        alone = head & np.append(head[1:], True)
        column += 1
        places = places[~alone[places] & (size[order[places]] > column)]
    out = np.empty(m, np.int64)
    out[order] = group
    return out


def _swept(r: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that follows from ``lms``, the LMS places in their order, a suffix a step."""
    n = len(r)
    count = np.bincount(r)
    ends = np.cumsum(count)
    out = [-1] * n
    letters = r.tolist()
    larger, smaller = [*(~is_s).tolist(), False, False], [*is_s.tolist(), False, False]  # the last two: before place 0, and no place yet
    tail = ends.tolist()
    for j in lms[::-1].tolist():
        c = letters[j]
        tail[c] -= 1
        out[tail[c]] = j
    head = (ends - count).tolist()
    for x in out:  # which grows ahead of the loop
        j = x - 1
        if larger[j]:
            c = letters[j]
            at = head[c]
            out[at] = j
            head[c] = at + 1
    tail = ends.tolist()
    for x in reversed(out):
        j = x - 1
        if smaller[j]:
            c = letters[j]
            at = tail[c] = tail[c] - 1
            out[at] = j
    return np.array(out, np.int64)


def common_prefixes(t: np.ndarray, sa: np.ndarray, longest: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Permuted: for each place the place before it in ``sa`` and their common prefix. ``longest``: a bound on prefixes.

    Only places whose left letter differs from their partner's are compared; every
    other one has its left neighbour's prefix less one. A prefix below ``least`` may
    be reported as less than it is.
    """
    n = len(t)
    phi = np.empty(n, np.int32)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    left = np.concatenate([[-1], t[:-1]])
    start = np.concatenate([[True], (phi[1:] <= 0) | (left[1:] != left[phi[1:]])])
    at = np.flatnonzero(start & (phi >= 0))
    s, inverse = prefix_sums(t)

    def equal(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        fits = np.maximum(a, b) + size <= n
        a, b = np.where(fits, a, 0), np.where(fits, b, 0)
        end = np.where(fits, size, 0)
        return fits & ((s[a + end] - s[a]) * inverse[a] == (s[b + end] - s[b]) * inverse[b])

    plcp = np.zeros(n, np.int32)
    with np.errstate(over="ignore"):
        if least:
            at = at[equal(at, phi[at].astype(np.int64), least)]
        other = phi[at].astype(np.int64)
        got = np.full(len(at), least, np.int64)
        step = 1 << max(0, longest.bit_length())
        while step:
            got += np.where(equal(at + got, other + got, step), step, 0)
            step >>= 1
    del s, inverse
    plcp[at] = agree(t, at, other, got)  # unequal hashes are proof, equal ones a hint
    here = np.arange(n, dtype=np.int32)
    last = np.maximum.accumulate(np.where(start, here, np.int32(0)))
    return phi, np.maximum(plcp[last] - (here - last), 0)
