"""Edit similarities of many pairs of strings at once: arrays of code points, a step for each place in the strings.

Pairs are taken in groups of like length, so that a long string costs no other pair room, and few pairs of long strings
are compared one by one, as the kernels do."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

#: Cells (pairs x length) of a group, at most, and the least pairs for each 64 characters that are worth a group.
CELLS, LEAST = 1_000_000, 8


def coded(strings: Sequence[str], width: int, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a row a string, and lengths."""
    length = np.fromiter(map(len, strings), np.int64, len(strings))
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.int32)
    out = np.full((len(strings), width), fill, np.int32)
    out[np.arange(width) < length[:, None]] = flat
    return out, length


def grouped(a: Sequence[str], b: Sequence[str], many: Callable, one: Callable) -> np.ndarray:
    """many(A, la, B, lb) over groups of pairs, or one(x, y) where they are too few."""
    out = np.zeros(len(a))
    longest = np.fromiter((max(len(x), len(y), 1) for x, y in zip(a, b, strict=True)), np.int64, len(a))
    size = np.ceil(np.log2(longest)).astype(int)
    for s in np.unique(size):
        every = np.flatnonzero(size == s)
        width = int(longest[every].max())
        if len(every) * 64 < LEAST * width:
            out[every] = [one(a[i], b[i]) for i in every]
            continue
        for at in range(0, len(every), max(1, CELLS // width)):
            rows = every[at : at + max(1, CELLS // width)]
            (x, lx), (y, ly) = coded([a[i] for i in rows], width, -1), coded([b[i] for i in rows], width, -2)
            out[rows] = many(x, lx, y, ly)
    return out


def osa(x: np.ndarray, lx: np.ndarray, y: np.ndarray, ly: np.ndarray) -> np.ndarray:
    """Distances by insertions, deletions, substitutions and swaps of neighbours, no part edited twice."""
    n, width = x.shape
    older, old = None, np.repeat(np.arange(width + 1, dtype=np.int32)[:, None], n, 1)
    found = old[ly, np.arange(n)].copy()
    for i in range(int(lx.max(initial=0))):
        row = np.empty_like(old)
        row[0] = i + 1
        for j in range(width):
            best = np.minimum(np.minimum(old[j + 1], row[j]) + 1, old[j] + (x[:, i] != y[:, j]))
            if i and j:
                swap = (x[:, i] == y[:, j - 1]) & (x[:, i - 1] == y[:, j])
                best = np.where(swap, np.minimum(best, older[j - 1] + 1), best)
            row[j + 1] = best
        older, old = old, row
        done = lx == i + 1
        found[done] = old[ly[done], np.flatnonzero(done)]
    return found


def matches(x: np.ndarray, lx: np.ndarray, y: np.ndarray, ly: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many characters Jaro's window pairs up, and how many of them stand in another order."""
    n, width = x.shape
    reach = np.maximum(np.maximum(lx, ly) // 2 - 1, 0)[:, None]
    at, rows = np.arange(width), np.arange(n)
    taken, met = np.zeros(x.shape, bool), np.zeros(x.shape, bool)
    for i in range(int(lx.max(initial=0))):
        free = (y == x[:, i : i + 1]) & ~taken & (np.abs(at - i) <= reach)
        j = free.argmax(1)
        hit = free[rows, j]
        taken[rows[hit], j[hit]] = True
        met[:, i] = hit
    m = met.sum(1)
    left, right = np.zeros_like(x), np.zeros_like(x)
    for out, codes, mask in ((left, x, met), (right, y, taken)):
        r, c = np.nonzero(mask)
        out[r, (np.cumsum(mask, 1) - 1)[r, c]] = codes[r, c]
    return m, ((left != right) & (at < m[:, None])).sum(1)


def jaro(x: np.ndarray, lx: np.ndarray, y: np.ndarray, ly: np.ndarray) -> np.ndarray:
    m, moved = matches(x, lx, y, ly)
    some = np.maximum(m, 1)
    return np.where(m > 0, (m / np.maximum(lx, 1) + m / np.maximum(ly, 1) + (m - moved // 2) / some) / 3, 0.0)


def jaro_winkler(x: np.ndarray, lx: np.ndarray, y: np.ndarray, ly: np.ndarray) -> np.ndarray:
    w = jaro(x, lx, y, ly)
    same = np.cumprod(x[:, :4] == y[:, :4], axis=1).sum(1)
    return np.where((w > 0.7) & (lx > 3) & (ly > 3), w + 0.1 * same * (1 - w), w)


def damerau_levenshtein(x: np.ndarray, lx: np.ndarray, y: np.ndarray, ly: np.ndarray) -> np.ndarray:
    longest = np.maximum(lx, ly)
    return np.where(longest > 0, 1.0 - osa(x, lx, y, ly) / np.maximum(longest, 1), 1.0)


def l_jaro_winkler(x: np.ndarray, lx: np.ndarray, y: np.ndarray, ly: np.ndarray) -> np.ndarray:
    """Jaro with half transpositions, raised for a prefix in which one character may be left out on either side or differ."""
    m, moved = matches(x, lx, y, ly)
    some = np.maximum(m, 1)
    w = np.where(m > 0, (m / np.maximum(lx, 1) + m / np.maximum(ly, 1) + (m - moved / 2) / some) / 3, 0.0)
    rows = np.flatnonzero((w > 0.7) & (lx > 3) & (ly > 3))
    x, y, longest = x[rows], y[rows], np.maximum(lx, ly)[rows]
    i, j, end = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.full(len(rows), 4)
    forgiving, going = np.minimum(lx, ly)[rows] > 4, np.ones(len(rows), bool)

    def same(r: np.ndarray, di: int, dj: int) -> np.ndarray:
        p, q = i[r] + di, j[r] + dj
        inside = (p < lx[rows][r]) & (q < ly[rows][r])
        return inside & (x[r, np.where(inside, p, 0)] == y[r, np.where(inside, q, 0)])

    while len(r := np.flatnonzero(going & (i < end) & (j < end))):
        hit = same(r, 0, 0)
        i[r[hit]] += 1
        j[r[hit]] += 1
        r = r[~hit]
        going[r[~forgiving[r]]] = False
        r = r[forgiving[r]]
        forgiving[r] = False
        for di, dj in ((0, 1), (1, 0), (1, 1)):
            hit = same(r, di, dj)
            i[r[hit]] += di + 1
            j[r[hit]] += dj + 1
            end[r[hit]] = np.minimum(end[r[hit]] + 1, longest[r[hit]])
            r = r[~hit]
    w[rows] += 0.1 * np.minimum(i, j) * (1 - w[rows])
    return w


#: Stands for no gram; grams are numbers of 21 bits a character.
NONE = np.iinfo(np.int64).max


def _grams(x: np.ndarray, length: np.ndarray, n: int, apart: int = 0) -> np.ndarray:
    """Runs of n characters, a row a string, or with apart the first and last of runs of n + apart."""
    c = x.astype(np.int64) + 1
    width = max(x.shape[1] - n - apart + 1, 0)
    picked = (0, n + apart - 1) if apart else range(n)
    out = np.zeros((len(x), width), np.int64)
    for k in picked:
        out = (out << 21) | c[:, k : k + width]
    return np.where(np.arange(width) < (length - n - apart + 1)[:, None], out, NONE)


def _distinct(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = np.sort(g, axis=1)
    g[:, 1:][g[:, 1:] == g[:, :-1]] = NONE
    return g, (g != NONE).sum(1)


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    return ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] != NONE)).sum(1)


def _both(x: np.ndarray, lx: np.ndarray) -> np.ndarray:
    return np.concatenate([_grams(x, lx, 2), _grams(x, lx, 3)], axis=1)


def jaccard(x: np.ndarray, lx: np.ndarray, y: np.ndarray, ly: np.ndarray) -> np.ndarray:
    """Of padded strings, as cosine and skipgram."""
    (a, na), (b, nb) = _distinct(_both(x, lx)), _distinct(_both(y, ly))
    shared = _shared(a, b)
    return shared / (na + nb - shared)


def strike_a_match(x: np.ndarray, lx: np.ndarray, y: np.ndarray, ly: np.ndarray) -> np.ndarray:
    (a, na), (b, nb) = _distinct(_grams(x, lx, 2)), _distinct(_grams(y, ly, 2))
    alike = (lx == ly) & ((x == y) | (np.arange(x.shape[1]) >= lx[:, None])).all(1)
    return np.where(na + nb > 0, 2 * _shared(a, b) / np.maximum(na + nb, 1), alike.astype(float))


def cosine(x: np.ndarray, lx: np.ndarray, y: np.ndarray, ly: np.ndarray) -> np.ndarray:
    """Sums of products of counts: a gram's k-th occurrence in one string meets every one in the other."""
    ga, gb = np.sort(_both(x, lx), axis=1), np.sort(_both(y, ly), axis=1)
    (a, na), (b, nb) = _distinct(ga), _distinct(gb)
    dot, own_a, own_b = _shared(a, b), na.copy(), nb.copy()
    repeated = np.flatnonzero(((ga != NONE).sum(1) > na) | ((gb != NONE).sum(1) > nb))
    if len(repeated):
        n, both = len(repeated), np.concatenate([ga[repeated], gb[repeated]], axis=1)
        # Both sides' grams in one order a pair, numbered by pair and gram; counts of each side by that number.
        order = np.argsort(both, axis=1, kind="stable")
        both = np.take_along_axis(both, order, axis=1)
        kept = both != NONE
        row, left, new = np.nonzero(kept)[0], (order < ga.shape[1])[kept], np.ones(both.shape, bool)
        new[:, 1:] = both[:, 1:] != both[:, :-1]
        at = np.cumsum(new[kept]) - 1
        count_a, count_b = np.bincount(at, left), np.bincount(at, ~left)
        of = np.zeros(len(count_a), np.int64)
        of[at] = row
        dot[repeated], own_a[repeated], own_b[repeated] = (np.bincount(of, x, n) for x in (count_a * count_b, count_a * count_a, count_b * count_b))
    return dot / (np.sqrt(own_a) * np.sqrt(own_b))


def skipgram(x: np.ndarray, lx: np.ndarray, y: np.ndarray, ly: np.ndarray) -> np.ndarray:
    """Two-skips of both strings are the first one's."""
    two = _grams(x, lx, 2, 2)
    (a1, n1), (b1, m1) = _distinct(_grams(x, lx, 2)), _distinct(_grams(y, ly, 2))
    (a2, n2), (b2, m2) = (_distinct(np.concatenate([_grams(s, n, 2, 1), two], axis=1)) for s, n in ((x, lx), (y, ly)))
    one, skipped = _shared(a1, b1), _shared(a2, b2)
    return (one + skipped) / (n1 + m1 - one + n2 + m2 - skipped)
