"""Gram similarities as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grams(s: Column, n: int) -> Column:
    """All n-grams of s, repeated ones too."""
    none = F.array().cast("array<string>")
    return F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substring(s, i, F.lit(n)))).otherwise(none)


def padded(s: Column) -> Column:
    return F.concat(F.lit(" "), s, F.lit(" "))


def skipped(s: Column, k: int) -> Column:
    """Distinct pairs of characters of s with k characters between them."""
    return F.array_distinct(F.transform(grams(s, 2 + k), lambda g: F.concat(F.substring(g, 1, 1), F.substring(g, 2 + k, 1))))


def _both(s: Column) -> Column:
    return F.concat(grams(padded(s), 2), grams(padded(s), 3))


def bound(use, **values: Column) -> Column:
    """use(struct of the values): as a lambda's argument they are evaluated once, however often use refers to them."""
    return F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), use)[0]


def jaccard(a: Column, b: Column) -> Column:
    return bound(lambda v: F.size(F.array_intersect(v["x"], v["y"])) / F.size(F.array_union(v["x"], v["y"])), x=_both(a), y=_both(b))


def strike_a_match(a: Column, b: Column) -> Column:
    """Dice over distinct bigrams without padding; equality decides if neither has one."""

    def dice(v: Column) -> Column:
        total = F.size(v["x"]) + F.size(v["y"])
        return F.when(total == 0, (a == b).cast("double")).otherwise(F.try_divide(2.0 * F.size(F.array_intersect(v["x"], v["y"])), total))

    return bound(dice, x=F.array_distinct(grams(a, 2)), y=F.array_distinct(grams(b, 2)))


def cosine(a: Column, b: Column) -> Column:
    """Over counts of grams. Counting is left out where no gram of a string repeats, as in most short ones."""
    count = lambda xs, g: F.size(F.filter(xs, lambda h: h == g)).cast("double")
    dot = lambda gs, xs, ys: F.aggregate(gs, F.lit(0.0), lambda acc, g: acc + count(xs, g) * count(ys, g))
    own = lambda xs, gs: F.when(F.size(xs) == F.size(gs), F.size(xs).cast("double")).otherwise(dot(gs, xs, xs))

    def angle(v: Column) -> Column:
        x, y, dx, dy, shared = v["x"], v["y"], v["dx"], v["dy"], v["shared"]
        plain = (F.size(x) == F.size(dx)) & (F.size(y) == F.size(dy))
        return F.when(plain, F.size(shared).cast("double")).otherwise(dot(shared, x, y)) / (F.sqrt(own(x, dx)) * F.sqrt(own(y, dy)))

    distinct = lambda v: bound(angle, x=v["x"], y=v["y"], dx=F.array_distinct(v["x"]), dy=F.array_distinct(v["y"]), shared=F.array_intersect(v["x"], v["y"]))
    return bound(distinct, x=_both(a), y=_both(b))


def skipgram(a: Column, b: Column, fixed: bool = False) -> Column:
    """Jaccard over bigrams and skip-grams. The second string's two-skips are taken from the first, as the
    thresholds were tuned on that; fixed=True takes its own."""

    def share(v: Column) -> Column:
        shared = F.size(F.array_intersect(v["a1"], v["b1"])) + F.size(F.array_intersect(v["a2"], v["b2"]))
        return shared / (F.size(F.array_union(v["a1"], v["b1"])) + F.size(F.array_union(v["a2"], v["b2"])))

    def sides(v: Column) -> Column:
        x, y, two = v["x"], v["y"], v["two"]
        return bound(share, a1=grams(x, 2), b1=grams(y, 2), a2=F.concat(skipped(x, 1), two), b2=F.concat(skipped(y, 1), skipped(y, 2) if fixed else two))

    return bound(sides, x=padded(a), y=padded(b), two=skipped(padded(a), 2))
