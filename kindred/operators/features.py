"""The 85 features of a pair, in vector order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions import metrics, terms, text
from ..schema import label, pair_id
from .evaluate import SORTED_BELOW

GROUPS = ("basic", "sorted", "terms", "ind", "stat")
#: The features of ind.
PARTS = ("base", "mismatch", "special")


def _formed(x: list, y: list, canonical: bool) -> tuple[list, list]:
    """transformed(sorting, canonical, simple_sorting=False) of many pairs; a pair that lacks a string is not sorted."""
    if canonical:
        x, y = ([s if s is None else text.made_canonical(s) for s in side] for side in (x, y))
    x, y = list(x), list(y)
    whole = [i for i, (s, t) in enumerate(zip(x, y, strict=True)) if s is not None and t is not None]
    left, right = [x[i] for i in whole], [y[i] for i in whole]
    glued = [[s.replace(" ", "") for s in side] for side in (left, right)]
    close, plain = (metrics.batch("damerau_levenshtein", *sides).tolist() for sides in (glued, (left, right)))
    for k, i in enumerate(whole):
        if close[k] < SORTED_BELOW:
            x[i], y[i] = text.naturally_sorted(left[k]), text.naturally_sorted(right[k])
        elif close[k] > plain[k]:
            x[i], y[i] = glued[0][k], glued[1][k]
    return x, y


def _scores(a: Column, b: Column, groups, canonical: bool, profile: str, frequent) -> Column:
    """A struct of what Python finds for the chosen groups: their features, and for stat the strings sorted three times as a3 and b3.

    One stage for all: each stage more would keep a Python process more for each core."""
    known, groups = frozenset(frequent), set(groups)
    basic = params.FEATURE_BASIC if "basic" in groups else ()
    ordered = params.FEATURE_SORTED if "sorted" in groups else ()
    similar = params.FEATURE_TERMS if "terms" in groups else ()
    parts = PARTS if "ind" in groups else ()
    names = [f"{g}__{m}" for g, ms in (("basic", basic), ("sorted", ordered), ("terms", similar), ("ind", parts)) for m in ms]
    thres = params.PROFILES[profile]["damerau_levenshtein"]["avg"][0]
    schema = [*(f"{n} double" for n in names), *(("a3 string", "b3 string") if "stat" in groups else ())]

    def run(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        whole = (left.notna() & right.notna()).to_numpy()
        of = lambda side: [s for s, w in zip(side, whole, strict=True) if w]
        x, y = ([None if pd.isna(s) else s for s in side] for side in (left.tolist(), right.tolist()))
        out = pd.DataFrame(np.nan, index=range(len(left)), columns=names).astype("Float64")
        for m in basic:
            out.loc[whole, f"basic__{m}"] = metrics.batch(m, of(x), of(y))
        if ordered:
            p, q = ([text.naturally_sorted(text.made_canonical(s)) for s in of(side)] for side in (x, y))
            for m in ordered:
                out.loc[whole, f"sorted__{m}"] = metrics.batch(m, p, q)
        if {"terms", "ind", "stat"} & groups:
            x, y = _formed(x, y, canonical)
        if similar and whole.any():
            for m, found in terms.lsim_batch(of(x), of(y), {m: (m, True, False) for m in similar}, profile, known).items():
                out.loc[whole, f"terms__{m}"] = found
        if {"ind", "stat"} & groups:
            x, y = _formed(x, y, canonical)
        if parts:
            out[[f"ind__{n}" for n in parts]] = terms.Splits([s or "" for s in x], [s or "" for s in y], known).at(thres).scores("damerau_levenshtein").T
        if "stat" in groups:
            out["a3"], out["b3"] = (pd.Series(side, dtype=object) for side in _formed(x, y, canonical))
        return out

    run.__annotations__ = {"left": pd.Series, "right": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, ", ".join(schema))(a, b)


def build(pairs: DataFrame, groups=GROUPS, canonical=False, profile="global", frequent=(), digits: int | None = 5, keep=()) -> DataFrame:
    """pair_id, label, keep, and the features of the chosen groups, rounded half to even.

    The last three groups see pairs sorted once, twice and three times: sorting is not idempotent, and the
    models were tuned on that. All groups are one Python stage; a group not asked for costs nothing."""
    df = pairs.select(pair_id("s1", "s2").alias("pair_id"), label(F.col("res")).alias("label"), "s1", "s2", *keep)
    df = df.withColumn("g", _scores(F.col("s1"), F.col("s2"), groups, canonical, profile, frequent))
    found = {n: F.col("g")[n] for n in params.feature_names() if n.split("__")[0] in set(groups) - {"stat"}}
    if "stat" in groups:
        known = list(frequent)
        for side, c in ((1, F.col("g")["a3"]), (2, F.col("g")["b3"])):
            df = df.withColumn(f"g_freq{side}", text.frequent_flags(c, known, params.FREQUENT))
            found |= {f"stat__tokens_s{side}": text.n_tokens(c).cast("double"), f"stat__has_freq_s{side}": text.has_frequent(c, known).cast("double")}
            found |= {f"stat__freq{i}_s{side}": F.col(f"g_freq{side}")[i].cast("double") for i in range(params.FREQUENT)}
    shape = (lambda c: F.bround(c, digits)) if digits is not None else (lambda c: c)
    return df.select("pair_id", "label", *keep, *(shape(found[n]).alias(n) for n in params.feature_names() if n in found))


def masked(features: DataFrame, names: list[str], mask: list[bool]) -> tuple[DataFrame, list[str]]:
    """The features that a mask keeps; use it on train and test alike."""
    kept = [n for n, k in zip(names, mask, strict=True) if k]
    return features.select("pair_id", *(c for c in ("row",) if c in features.columns), "label", *kept), kept
