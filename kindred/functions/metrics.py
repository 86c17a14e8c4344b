"""Edit and token similarities: scalar kernels, and Arrow-batched functions around them.

Whole-string edit metrics take a batch at once (see batches). Token metrics look up the Jaro-Winkler scores of token
pairs; those of a batch are computed together before."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from functools import lru_cache
from itertools import permutations
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import batches
from .text import without_accents


def osa_distance(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours, no part edited twice."""
    older, old = [], list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            best = min(old[j + 1] + 1, row[j] + 1, old[j] + (x != y))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                best = min(best, older[j - 1] + 1)
            row.append(best)
        older, old = old, row
    return old[-1]


def damerau_levenshtein(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return 1.0 - osa_distance(a, b) / longest if longest else 1.0


def _matches(a: str, b: str) -> tuple[str, str]:
    """The characters of both strings that Jaro's window pairs up, in their own orders."""
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken: set[int] = set()
    left = []
    for i, x in enumerate(a):
        at = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if b[j] == x and j not in taken), None)
        if at is not None:
            taken.add(at)
            left.append(x)
    return "".join(left), "".join(b[j] for j in sorted(taken))


def _jaro(a: str, b: str, half: bool) -> float:
    x, y = _matches(a, b)
    if not x:
        return 0.0
    moved = sum(p != q for p, q in zip(x, y, strict=True))
    moved = moved / 2 if half else moved // 2
    m = len(x)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro(a: str, b: str) -> float:
    return _jaro(a, b, half=False)


#: Jaro-Winkler scores of token pairs that a worker has met, up to KNOWN of them.
_known: dict[tuple[str, str], float] = {}
KNOWN = 200_000


def jaro_winkler(a: str, b: str) -> float:
    found = _known.get((a, b))
    return _jaro_winkler(a, b) if found is None else found


def met(pairs) -> None:
    """Computes the scores of token pairs that are not known yet, all at once."""
    if len(_known) > KNOWN:
        _known.clear()
    new = [p for p in set(pairs) if p not in _known]
    if new:
        a, b = zip(*new, strict=True)
        _known.update(zip(new, batches.grouped(a, b, batches.jaro_winkler, _jaro_winkler).tolist(), strict=True))


def _jaro_winkler(a: str, b: str) -> float:
    """Jaro, raised for a common prefix of up to four if both strings are longer than three."""
    w = jaro(a, b)
    if w > 0.7 and len(a) > 3 and len(b) > 3:
        same = next((i for i in range(4) if a[i] != b[i]), 4)
        w += 0.1 * same * (1 - w)
    return w


@lru_cache(100_000)
def l_jaro_winkler(a: str, b: str, long_tolerance: bool = False) -> float:
    """Jaro with half transpositions, raised for a prefix in which one character may be left out on either side or differ."""
    w = _jaro(a, b, half=True)
    if not (w > 0.7 and len(a) > 3 and len(b) > 3):
        return w
    longest, end, i, j, forgiving = max(len(a), len(b)), 4, 0, 0, min(len(a), len(b)) > 4
    while i < end and j < end:
        if i < len(a) and j < len(b) and a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        if not forgiving:
            break
        forgiving = False
        for di, dj in ((0, 1), (1, 0), (1, 1)):
            if i + di < len(a) and j + dj < len(b) and a[i + di] == b[j + dj]:
                i, j, end = i + di + 1, j + dj + 1, min(end + 1, longest)
                break
    w += 0.1 * min(i, j) * (1 - w)
    common = len(_matches(a, b)[0])
    if long_tolerance and longest > 4 and common > i + 1 and 2 * common >= longest + i:
        w += (1 - w) * (common - i - 1) / (len(a) + len(b) - 2 * i + 2)
    return w


def _sorted(s: str) -> str:
    return " ".join(sorted(s.split(" ")))


def sorted_winkler(a: str, b: str) -> float:
    return _jaro_winkler(_sorted(a), _sorted(b))


def _orders(s: str) -> list[str]:
    ts = s.split(" ")
    return sorted({" ".join(p) for p in permutations(ts if len(ts) <= 5 else [*ts[:5], "".join(ts[5:])])})


def permuted_winkler(a: str, b: str) -> float:
    """The best order of the tokens of both strings; tokens from the sixth on count as one."""
    left, right = _orders(a), _orders(b)
    return float(batches.grouped([p for p in left for _ in right], right * len(left), batches.jaro_winkler, _jaro_winkler).max())


def _total(values: Iterable[float]) -> float:
    """The plain sum in order, as SQL adds: sum() compensates for what it rounds off, and decides other than SQL where a score is just a threshold."""
    total = 0.0
    for v in values:
        total += v
    return total


def _soft_overlap(x: list[str], y: list[str]) -> float:
    """Jaccard in which each distinct token counts with its best partner's score; tokens add up from the last, as in SQL."""
    x, y = list(dict.fromkeys(x))[::-1], list(dict.fromkeys(y))[::-1]
    shared = (_total(max(jaro_winkler(s, t) for t in y) for s in x) + _total(max(jaro_winkler(s, t) for s in x) for t in y)) / 2
    return shared / (len(x) + len(y) - shared)


def monge_elkan(a: str, b: str) -> float:
    mean = lambda x, y: _total(max(jaro_winkler(s, t) for t in y) for s in x) / len(x)
    x, y = a.split(" "), b.split(" ")
    return (mean(x, y) + mean(y, x)) / 2


def soft_jaccard(a: str, b: str) -> float:
    return _soft_overlap(a.split(" "), b.split(" "))


def _spelled_out(x: list[str], y: list[str], limit: int) -> list[str]:
    """Tokens of x, where a lone point is the shortest token of y under limit characters."""
    out = []
    for t in x:
        if t == ".":
            t = min((u for u in y if len(u) < limit), key=len, default=t)
        out.append(t)
    return out


def _davies_tokens(a: str, b: str) -> tuple[list[str], list[str]]:
    x, y = (without_accents(s.lower()).replace("-", " ").split(" ") for s in (a, b))
    x = _spelled_out(x, y, len(b))
    return x, _spelled_out(y, x, len(a))


def davies(a: str, b: str) -> float:
    x, y = _davies_tokens(a, b)
    return (sorted_winkler(a, b) + _soft_overlap(x, y)) / 2


def _windows(s: str, n: int) -> list[str]:
    return [s[i : i + n] for i in range(len(s) - n + 1)]


def _padded(s: str) -> list[str]:
    s = f" {s} "
    return _windows(s, 2) + _windows(s, 3)


def cosine(a: str, b: str) -> float:
    x, y = Counter(_padded(a)), Counter(_padded(b))
    return sum(n * y[g] for g, n in x.items()) / (sqrt(sum(n * n for n in x.values())) * sqrt(sum(n * n for n in y.values())))


def jaccard(a: str, b: str) -> float:
    x, y = set(_padded(a)), set(_padded(b))
    return len(x & y) / len(x | y)


def strike_a_match(a: str, b: str) -> float:
    x, y = set(_windows(a, 2)), set(_windows(b, 2))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else float(a == b)


def skipgram(a: str, b: str) -> float:
    """As in grams.skipgram: two-skips of the second string are the first one's."""
    skip = lambda s, k: {w[0] + w[-1] for w in _windows(f" {s} ", 2 + k)}
    a1, b1, two = skip(a, 0), skip(b, 0), skip(a, 2)
    a2, b2 = skip(a, 1) | two, skip(b, 1) | two
    return (len(a1 & b1) + len(a2 & b2)) / (len(a1 | b1) + len(a2 | b2))


def _reversed(metric):
    return lambda a, b: metric(a[::-1], b[::-1])


def _pad(s: str) -> str:
    return f" {s} "


def _of_padded(metric):
    return lambda a, b: metric(a[1:-1], b[1:-1])


METRICS = {
    "damerau_levenshtein": damerau_levenshtein,
    "jaro": jaro,
    "jaro_winkler": jaro_winkler,
    "jaro_winkler_r": _reversed(jaro_winkler),
    "sorted_winkler": sorted_winkler,
    "permuted_winkler": permuted_winkler,
    "cosine": cosine,
    "jaccard": jaccard,
    "strike_a_match": strike_a_match,
    "skipgram": skipgram,
    "monge_elkan": monge_elkan,
    "soft_jaccard": soft_jaccard,
    "davies": davies,
    "l_jaro_winkler": l_jaro_winkler,
    "l_jaro_winkler_r": _reversed(l_jaro_winkler),
}


#: Metrics of whole strings: how each string is made ready, the form for a batch, and the kernel.
WHOLE = {
    "damerau_levenshtein": (str, batches.damerau_levenshtein, damerau_levenshtein),
    "jaro": (str, batches.jaro, jaro),
    "jaro_winkler": (str, batches.jaro_winkler, _jaro_winkler),
    "jaro_winkler_r": (lambda s: s[::-1], batches.jaro_winkler, _jaro_winkler),
    "sorted_winkler": (_sorted, batches.jaro_winkler, _jaro_winkler),
    "l_jaro_winkler": (str, batches.l_jaro_winkler, l_jaro_winkler),
    "l_jaro_winkler_r": (lambda s: s[::-1], batches.l_jaro_winkler, l_jaro_winkler),
    "strike_a_match": (str, batches.strike_a_match, strike_a_match),
    # Padded here for the batch, by the kernels for themselves.
    "jaccard": (_pad, batches.jaccard, _of_padded(jaccard)),
    "cosine": (_pad, batches.cosine, _of_padded(cosine)),
    "skipgram": (_pad, batches.skipgram, _of_padded(skipgram)),
}
#: Metrics that compare tokens: the tokens of both strings.
TOKENS = {
    "monge_elkan": lambda a, b: (a.split(" "), b.split(" ")),
    "soft_jaccard": lambda a, b: (a.split(" "), b.split(" ")),
    "davies": _davies_tokens,
}


def batch(name: str, left: list[str], right: list[str]) -> np.ndarray:
    """A metric of many pairs of strings."""
    if name in WHOLE:
        ready, many, one = WHOLE[name]
        return batches.grouped(list(map(ready, left)), list(map(ready, right)), many, one)
    if name in TOKENS:
        met((s, t) for x, y in map(TOKENS[name], left, right) for s in x for t in y)
    return np.fromiter(map(METRICS[name], left, right), float, len(left))


def scores(a: Column, b: Column, names) -> Column:
    """A struct of doubles: the named metrics of two string columns, null if one is null. One Python stage for all."""
    names = list(names)

    def run(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        whole = (left.notna() & right.notna()).to_numpy()
        x, y = left[whole].tolist(), right[whole].tolist()
        out = pd.DataFrame(np.nan, index=range(len(left)), columns=names).astype("Float64")
        for n in names:
            out.loc[whole, n] = batch(n, x, y)
        return out

    run.__annotations__ = {"left": pd.Series, "right": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, ", ".join(f"{n} double" for n in names))(a, b)


def score(a: Column, b: Column, name: str) -> Column:
    return scores(a, b, [name])[name]
