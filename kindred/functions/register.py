"""Names for SQL: a function for each metric and the two term similarities, and a table function for the term split."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..params import PROFILES, TERM_METRICS
from .metrics import METRICS, batch
from .terms import lsim_batch, split_terms

#: The columns of term_split: terms of both strings, comma-joined.
COLUMNS = [f"{g}_{s}" for g in ("base", "mismatch", "special") for s in "ab"]


def _of_batches(compute):
    """A function of two string columns; null if one is null."""

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        whole = (left.notna() & right.notna()).to_numpy()
        out = pd.Series([None] * len(left), dtype="Float64")
        if whole.any():
            out[whole] = compute(left[whole].tolist(), right[whole].tolist())
        return out

    run.__annotations__ = {"left": pd.Series, "right": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")


class TermSplit:
    """term_split(a, b, threshold): a row of base, mismatching and special terms; no row if a string is null."""

    known: frozenset[str] = frozenset()

    def eval(self, a: str | None, b: str | None, thres: float):
        if a is not None and b is not None:
            yield tuple(",".join(side) for group in split_terms(a, b, float(thres), self.known) for side in group)


def register(spark: SparkSession, frequent=(), profile: str = "global") -> list[str]:
    """Registers all names in a session and returns them: each metric, lsim_ and avg_lsim_ of each term metric, and term_split."""
    if profile not in PROFILES:
        raise ValueError(f"no such profile: {profile}")
    known, names = frozenset(frequent), []
    for m in METRICS:
        spark.udf.register(m, _of_batches(lambda x, y, m=m: batch(m, x, y)))
        names.append(m)
    for prefix, averaged in (("lsim_", False), ("avg_lsim_", True)):
        for m in TERM_METRICS:
            spec = {m: (m, averaged, False)}
            spark.udf.register(prefix + m, _of_batches(lambda x, y, spec=spec, m=m: lsim_batch(x, y, spec, profile, known)[m]))
            names.append(prefix + m)
    split = type("TermSplit", (TermSplit,), {"known": known})
    spark.udtf.register("term_split", F.udtf(split, returnType=", ".join(f"{c} string" for c in COLUMNS)))
    return [*names, "term_split"]
