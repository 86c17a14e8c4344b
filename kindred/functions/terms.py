"""The two-level similarity over base, mismatching and special (frequent) terms."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import PROFILES
from ..schema import SPLIT
from . import batches
from .metrics import METRICS, _jaro_winkler, batch, jaro_winkler

Group = tuple[list[str], list[str]]


def split_aligned(a: str, b: str, thres: float) -> tuple[Group, Group]:
    """Base and mismatch: both lists of terms are walked in order; terms with alike ends pair up, else the smaller one is left out."""
    x, y = a.split(), b.split()
    base, mismatch = ([], []), ([], [])
    i = j = 0
    while i < len(x) and j < len(y):
        if jaro_winkler(x[i][::-1], y[j][::-1]) >= thres:
            base[0].append(x[i])
            base[1].append(y[j])
            i, j = i + 1, j + 1
        elif x[i] < y[j]:
            mismatch[0].append(x[i])
            i += 1
        else:
            mismatch[1].append(y[j])
            j += 1
    mismatch[0].extend(x[i:])
    mismatch[1].extend(y[j:])
    return base, mismatch


def split_terms(a: str, b: str, thres: float, frequent: frozenset[str] = frozenset()) -> tuple[Group, Group, Group]:
    """Base, mismatch and special terms. A special term is deleted wherever its letters stand, longer terms first."""
    special = tuple(sorted({*s.split()} & frequent, key=lambda t: (-len(t), t)) for s in (a, b))
    a, b = (re.sub("|".join(map(re.escape, ts)), " ", s).strip() if ts else s for s, ts in zip((a, b), special, strict=True))
    return *split_aligned(a, b, thres), special


def component_scores(groups: tuple[Group, Group, Group], metric: str) -> list[float]:
    """The metric over each group's joined terms; a metric that ends in _r is taken over reversed terms."""
    if metric.endswith("_r"):
        metric = metric[:-2]
        groups = tuple(tuple([t[::-1] for t in side] for side in g) for g in groups)
    own = METRICS[metric]
    return [0.0 if metric == "damerau_levenshtein" and not (x or y) else own(" ".join(x), " ".join(y)) for x, y in groups]


def calibrated_weights(groups: tuple[Group, Group, Group], weights, averaged: bool) -> list[float] | None:
    """Weights of the three groups: an empty group's goes to the others by their numbers of terms. None if all are empty."""
    w, n = list(weights), [len(x) + len(y) for x, y in groups]
    if not sum(n):
        return None
    for k in range(3):
        if not n[k]:
            p, q = (i for i in range(3) if i != k)
            share = n[p] / (n[p] + n[q])
            w[p] += w[k] * share
            w[q] += w[k] * (1 - share)
            w[k] = 0.0
    if averaged:
        w = [x * sum(len(t) for side in g for t in side) / 2 for x, g in zip(w, groups, strict=True)]
    total = sum(w)
    return [x / total for x in w]


def lsimilarity(a: str, b: str, metric: str = "damerau_levenshtein", averaged: bool = False, profile: str = "global", frequent: frozenset[str] = frozenset(), thres: float | None = None, weights=None) -> float:
    split_thres, own = PROFILES[profile][metric]["avg" if averaged else "simple"]
    groups = split_terms(a, b, split_thres if thres is None else thres, frequent)
    w = calibrated_weights(groups, weights or own, averaged)
    return float(a == b) if w is None else sum(x * s for x, s in zip(w, component_scores(groups, metric), strict=True))


def _special(strings: Sequence[str], known: frozenset[str]) -> tuple[list[list[str]], list[list[str]]]:
    """The tokens of each string without its special terms, and those."""
    if not known:
        return [s.split() for s in strings], [[] for _ in strings]
    special = [sorted({*s.split()} & known, key=lambda t: (-len(t), t)) for s in strings]
    return [(re.sub("|".join(map(re.escape, ts)), " ", s) if ts else s).split() for s, ts in zip(strings, special, strict=True)], special


def _padded_ids(tokens: list[list[str]], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    length = np.fromiter(map(len, tokens), np.int64, len(tokens))
    out = np.zeros((len(tokens), max(int(length.max(initial=0)), 1)), np.int64)
    out[np.arange(out.shape[1]) < length[:, None]] = [index[t] for ts in tokens for t in ts]
    return out, length


class Splits:
    """The splits of a batch of pairs: base, mismatching and special terms at each threshold asked for.

    Tokens are numbered in their order, so that numbers compare as they do, and all pairs of strings walk their two lists
    at once, a step of each pair at a time. The likeness of two tokens is computed once a batch."""

    def __init__(self, left: Sequence[str], right: Sequence[str], known: frozenset[str] = frozenset()):
        (self.x, sx), (self.y, sy) = _special(left, known), _special(right, known)
        self.special = sx, sy
        self.vocabulary = sorted({t for ts in (*self.x, *self.y) for t in ts})
        index = {t: i for i, t in enumerate(self.vocabulary)}
        (self.a, self.la), (self.b, self.lb) = _padded_ids(self.x, index), _padded_ids(self.y, index)
        self.likeness: dict[int, float] = {}
        self.groups: dict[float, Groups] = {}

    def _alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Jaro-Winkler from the ends of tokens."""
        size = max(len(self.vocabulary), 1)
        keys, at = np.unique(a * size + b, return_inverse=True)
        keys = keys.tolist()
        new = [k for k in keys if k not in self.likeness]
        if new:
            s, t = ([self.vocabulary[i][::-1] for i in part] for part in ([k // size for k in new], [k % size for k in new]))
            self.likeness.update(zip(new, batches.grouped(s, t, batches.jaro_winkler, _jaro_winkler).tolist(), strict=True))
        return np.array([self.likeness[k] for k in keys])[at]

    def at(self, thres: float) -> Groups:
        """Terms with alike ends pair up, else the smaller one is left out."""
        if thres not in self.groups:
            i, j = np.zeros(len(self.x), np.int64), np.zeros(len(self.x), np.int64)
            base_x, base_y = np.zeros(self.a.shape, bool), np.zeros(self.b.shape, bool)
            while len(rows := np.flatnonzero((i < self.la) & (j < self.lb))):
                s, t = self.a[rows, i[rows]], self.b[rows, j[rows]]
                alike = self._alike(s, t) >= thres
                base_x[rows[alike], i[rows[alike]]] = True
                base_y[rows[alike], j[rows[alike]]] = True
                i[rows] += alike | (s < t)
                j[rows] += alike | (s >= t)
            self.groups[thres] = Groups(self, base_x, base_y)
        return self.groups[thres]


class Groups:
    """Base, mismatching and special terms of each pair of a batch: lists of terms a side, their numbers and characters."""

    def __init__(self, splits: Splits, base_x: np.ndarray, base_y: np.ndarray):
        def parted(tokens: list[list[str]], base: np.ndarray) -> tuple[list[list[str]], list[list[str]]]:
            into = [], []
            for ts, mask in zip(tokens, base.tolist(), strict=True):
                into[0].append([t for t, m in zip(ts, mask, strict=False) if m])
                into[1].append([t for t, m in zip(ts, mask, strict=False) if not m])
            return into

        left, right = parted(splits.x, base_x), parted(splits.y, base_y)
        self.terms = [(left[0], right[0]), (left[1], right[1]), splits.special]
        self.n = np.array([[len(p) + len(q) for p, q in zip(*g, strict=True)] for g in self.terms], np.int64).reshape(3, -1)
        self.chars = np.array([[sum(map(len, p)) + sum(map(len, q)) for p, q in zip(*g, strict=True)] for g in self.terms], np.int64).reshape(3, -1)
        self.joined: dict[bool, list] = {}

    def strings(self, turned: bool) -> list[tuple[list[str], list[str]]]:
        if turned not in self.joined:
            join = (lambda ts: " ".join([t[::-1] for t in ts])) if turned else " ".join
            self.joined[turned] = [(list(map(join, p)), list(map(join, q))) for p, q in self.terms]
        return self.joined[turned]

    def scores(self, metric: str) -> np.ndarray:
        """component_scores of all pairs: a row a group. Equal strings are compared once."""
        own = metric.removesuffix("_r")
        nothing = 0.0 if own == "damerau_levenshtein" else METRICS[own]("", "")
        out = np.full(self.n.shape, nothing)
        for k, (p, q) in enumerate(self.strings(metric.endswith("_r"))):
            rows = np.flatnonzero(self.n[k])
            if len(rows):
                pairs = [(p[i], q[i]) for i in rows.tolist()]
                place = {pair: i for i, pair in enumerate(dict.fromkeys(pairs))}
                found = batch(own, *map(list, zip(*place, strict=True)))
                out[k, rows] = found[[place[pair] for pair in pairs]]
        return out

    def weights(self, weights, averaged: bool) -> np.ndarray:
        """calibrated_weights of all pairs: a row a group; not a number where all groups are empty."""
        w = [np.full(self.n.shape[1], float(x)) for x in weights]
        with np.errstate(divide="ignore", invalid="ignore"):
            for k in range(3):
                p, q = (i for i in range(3) if i != k)
                empty = self.n[k] == 0
                share = self.n[p] / (self.n[p] + self.n[q])
                w[p] = np.where(empty, w[p] + w[k] * share, w[p])
                w[q] = np.where(empty, w[q] + w[k] * (1 - share), w[q])
                w[k] = np.where(empty, 0.0, w[k])
            if averaged:
                w = [x * c / 2 for x, c in zip(w, self.chars, strict=True)]
            total = w[0] + w[1] + w[2]
            return np.stack([x / total for x in w])

    def rows(self) -> list[list[dict]]:
        """term_split's struct of each pair."""
        side = lambda k, i: {"a": self.terms[k][0][i], "b": self.terms[k][1][i], "len": int(self.n[k, i]), "char_len": int(self.chars[k, i])}
        return [[side(k, i) for k in range(3)] for i in range(self.n.shape[1])]


def term_split(a: Column, b: Column, thres: float, frequent=()) -> Column:
    """The split as a struct of base, mismatch and special."""
    known = frozenset(frequent)

    def run(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        groups = Splits(left.fillna("").tolist(), right.fillna("").tolist(), known).at(thres)
        return pd.DataFrame(groups.rows(), columns=["base", "mismatch", "special"])

    run.__annotations__ = {"left": pd.Series, "right": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, SPLIT)(a, b)


def lsim_batch(x: list[str], y: list[str], specs: dict[str, tuple[str, bool, bool]], profile: str = "global", known: frozenset[str] = frozenset()) -> dict[str, np.ndarray]:
    """Term similarities of many pairs by name: specs are (metric, averaged, whole strings reversed)."""
    splits, out = {}, {}
    same = np.array([s == t for s, t in zip(x, y, strict=True)], float)
    for name, (metric, averaged, turned) in specs.items():
        thres, weights = PROFILES[profile][metric]["avg" if averaged else "simple"]
        if turned not in splits:
            splits[turned] = Splits([s[::-1] for s in x], [s[::-1] for s in y], known) if turned else Splits(x, y, known)
        groups = splits[turned].at(thres)
        w, s = groups.weights(weights, averaged), groups.scores(metric)
        out[name] = np.where(groups.n.sum(0) == 0, same, w[0] * s[0] + w[1] * s[1] + w[2] * s[2])
    return out


def lsim_scores(a: Column, b: Column, specs: dict[str, tuple[str, bool, bool]], profile: str = "global", frequent=()) -> Column:
    """A struct of doubles: name -> (metric, averaged, whole strings reversed). Splits are shared between metrics."""
    known, specs = frozenset(frequent), dict(specs)

    def run(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        whole = (left.notna() & right.notna()).to_numpy()
        out = pd.DataFrame(np.nan, index=range(len(left)), columns=list(specs)).astype("Float64")
        if whole.any():
            for name, found in lsim_batch(left[whole].tolist(), right[whole].tolist(), specs, profile, known).items():
                out.loc[whole, name] = found
        return out

    run.__annotations__ = {"left": pd.Series, "right": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, ", ".join(f"{n} double" for n in specs))(a, b)


def components_by_split(a: Column, b: Column, metrics, split_thresholds, frequent=()) -> Column:
    """array<struct<split_thres, metric, scores, n, chars, same>>: what every choice of weights needs, computed once."""
    known, metrics, split_thresholds = frozenset(frequent), list(metrics), list(split_thresholds)

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        x, y = left.fillna("").tolist(), right.fillna("").tolist()
        splits, rows = Splits(x, y, known), [[] for _ in x]
        same = [s == t for s, t in zip(left.tolist(), right.tolist(), strict=True)]
        for thres in split_thresholds:
            groups = splits.at(thres)
            n, chars = groups.n.T.tolist(), groups.chars.T.tolist()
            for m in metrics:
                for i, s in enumerate(groups.scores(m).T.tolist()):
                    rows[i].append({"split_thres": thres, "metric": m, "scores": s, "n": n[i], "chars": chars[i], "same": same[i]})
        return pd.Series(rows)

    run.__annotations__ = {"left": pd.Series, "right": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<struct<split_thres: double, metric: string, scores: array<double>, n: array<int>, chars: array<int>, same: boolean>>")(a, b)


def scores_by_split(a: Column, b: Column, metrics, split_thresholds, weights, frequent=()) -> Column:
    """array<struct<split_thres, metric, scores>>: averaged term similarities, one for each of the sets of weights."""
    known, metrics, split_thresholds, weights = frozenset(frequent), list(metrics), list(split_thresholds), list(weights)

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        x, y = left.fillna("").tolist(), right.fillna("").tolist()
        splits, rows = Splits(x, y, known), [[] for _ in x]
        same = np.array([s == t for s, t in zip(left.tolist(), right.tolist(), strict=True)], float)
        for thres in split_thresholds:
            groups = splits.at(thres)
            none, calibrated = groups.n.sum(0) == 0, [groups.weights(w, True) for w in weights]
            for m in metrics:
                s = groups.scores(m)
                found = np.stack([np.where(none, same, w[0] * s[0] + w[1] * s[1] + w[2] * s[2]) for w in calibrated], axis=1)
                for row, one in zip(rows, found.tolist(), strict=True):
                    row.append({"split_thres": thres, "metric": m, "scores": one})
        return pd.Series(rows)

    run.__annotations__ = {"left": pd.Series, "right": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<struct<split_thres: double, metric: string, scores: array<double>>>")(a, b)


def weighted(scores: Column, n: Column, chars: Column, same: Column, weights: Column, averaged: bool = True) -> Column:
    """calibrated_weights and the weighted sum, as column expressions."""
    w = [weights[i] for i in range(3)]
    for k in range(3):
        p, q = (i for i in range(3) if i != k)
        share = F.try_divide(n[p], n[p] + n[q])
        empty = n[k] == 0
        w[p], w[q], w[k] = F.when(empty, w[p] + w[k] * share).otherwise(w[p]), F.when(empty, w[q] + w[k] * (1 - share)).otherwise(w[q]), F.when(empty, 0.0).otherwise(w[k])
    if averaged:
        w = [x * chars[i] / 2 for i, x in enumerate(w)]
    total = w[0] + w[1] + w[2]
    return F.when(n[0] + n[1] + n[2] == 0, same.cast("double")).otherwise(F.try_divide(w[0] * scores[0] + w[1] * scores[1] + w[2] * scores[2], total))
