"""SQL expressions for the metrics, on ASCII strings, as DuckDB runs them."""

from __future__ import annotations

from .fixtures import PAIRS_SQL


def grams(x: str, n: int) -> str:
    return f"list_transform(range(1, length({x}) - {n} + 2), lambda i: substring({x}, i, {n}))"


def padded(x: str) -> str:
    return f"(' ' || {x} || ' ')"


def both(x: str) -> str:
    return f"list_concat({grams(padded(x), 2)}, {grams(padded(x), 3)})"


def skipped(x: str, k: int) -> str:
    return f"list_distinct(list_transform({grams(x, 2 + k)}, lambda g: g[1] || g[{2 + k}]))"


def jw(a: str, b: str) -> str:
    return f"CASE WHEN least(length({a}), length({b})) > 3 THEN jaro_winkler_similarity({a}, {b}) ELSE jaro_similarity({a}, {b}) END"


def overlap(x: str, y: str) -> str:
    return f"len(list_intersect({x}, {y}))"


def union(x: str, y: str) -> str:
    return f"len(list_distinct(list_concat({x}, {y})))"


def jaccard(a: str, b: str) -> str:
    x, y = both(a), both(b)
    return f"({overlap(x, y)} / {union(x, y)})"


def dice(a: str, b: str) -> str:
    x, y = f"list_distinct({grams(a, 2)})", f"list_distinct({grams(b, 2)})"
    return f"(2.0 * {overlap(x, y)} / (len({x}) + len({y})))"


def cosine(a: str, b: str) -> str:
    dot = lambda x, y: f"list_sum(list_transform(list_distinct({x}), lambda g: len(list_filter({x}, lambda h: h = g)) * len(list_filter({y}, lambda h: h = g))))"
    return f"({dot(both(a), both(b))} / (sqrt({dot(both(a), both(a))}) * sqrt({dot(both(b), both(b))})))"


def skipgram(a: str, b: str) -> str:
    a1, b1, two = grams(padded(a), 2), grams(padded(b), 2), skipped(padded(a), 2)
    a2, b2 = f"list_concat({skipped(padded(a), 1)}, {two})", f"list_concat({skipped(padded(b), 1)}, {two})"
    return f"(({overlap(a1, b1)} + {overlap(a2, b2)}) / ({union(a1, b1)} + {union(a2, b2)}))"


def tokens(x: str) -> str:
    return f"string_split({x}, ' ')"


def sorted_text(x: str) -> str:
    return f"array_to_string(list_sort({tokens(x)}), ' ')"


def sorted_winkler(a: str, b: str) -> str:
    return jw(sorted_text(a), sorted_text(b))


def permuted_winkler(a: str, b: str) -> str:
    """Of names of two words."""
    turned = lambda x: f"({tokens(x)}[2] || ' ' || {tokens(x)}[1])"
    return f"greatest({jw(a, b)}, {jw(a, turned(b))}, {jw(turned(a), b)}, {jw(turned(a), turned(b))})"


def best_partners(x: str, y: str, turned: bool = False) -> str:
    return f"list_transform({x}, lambda s: list_max(list_transform({y}, lambda t: {jw('t', 's') if turned else jw('s', 't')})))"


def monge_elkan(a: str, b: str) -> str:
    x, y = tokens(a), tokens(b)
    return f"((list_avg({best_partners(x, y)}) + list_avg({best_partners(y, x)})) / 2)"


def soft_jaccard(a: str, b: str) -> str:
    x, y = f"list_distinct({tokens(a)})", f"list_distinct({tokens(b)})"
    shared = f"((list_sum({best_partners(x, y)}) + list_sum({best_partners(y, x, True)})) / 2)"
    return f"({shared} / (len({x}) + len({y}) - {shared}))"


def davies(a: str, b: str) -> str:
    """Of lower-case names without points or hyphens."""
    return f"(({sorted_winkler(a, b)} + {soft_jaccard(a, b)}) / 2)"


METRICS = {
    "jaccard": jaccard,
    "strike_a_match": dice,
    "cosine": cosine,
    "skipgram": skipgram,
    "jaro": lambda a, b: f"jaro_similarity({a}, {b})",
    "jaro_winkler": jw,
    "jaro_winkler_r": lambda a, b: jw(f"reverse({a})", f"reverse({b})"),
    "sorted_winkler": sorted_winkler,
    "permuted_winkler": permuted_winkler,
    "monge_elkan": monge_elkan,
    "soft_jaccard": soft_jaccard,
    "davies": davies,
}

#: Edit distance with swaps: a row of the table a step; insertions by a running minimum.
OSA = f"""WITH RECURSIVE {PAIRS_SQL},
t AS (
  SELECT s1, s2, 0 AS i, range(0, length(s2) + 1) AS older, range(0, length(s2) + 1) AS old FROM p
  UNION ALL
  SELECT s1, s2, i + 1, old, list_transform(range(0, length(s2) + 1), lambda j: list_min(list_transform(range(0, j + 1), lambda k: c[k + 1] - k)) + j)
  FROM (SELECT *, list_transform(range(0, length(s2) + 1), lambda j:
          CASE WHEN j = 0 THEN i + 1
               ELSE least(old[j + 1] + 1, old[j] + (s1[i + 1] <> s2[j])::INT,
                          CASE WHEN i > 0 AND j > 1 AND s1[i + 1] = s2[j - 1] AND s1[i] = s2[j] THEN older[j - 1] + 1 ELSE 999999 END) END) AS c
        FROM t WHERE i < length(s1)))
SELECT s1, s2, round(1 - old[length(s2) + 1] / greatest(length(s1), length(s2)), 6) AS score FROM t WHERE i = length(s1)"""


def metric(name: str) -> str:
    return f"WITH {PAIRS_SQL} SELECT s1, s2, round({METRICS[name]('s1', 's2')}, 6) AS score FROM p"


def decided(thresholds: dict[str, float]) -> str:
    """Rows of method, label, score and threshold for pairs."""
    return " UNION ALL ".join(f"SELECT '{m}' AS method, y, {METRICS[m]('s1', 's2')} AS score, {t} AS thres FROM p" for m, t in thresholds.items())


QUALITY = """tp, fn, fp, tn, round((tp + tn) / (tp + fn + fp + tn), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS "precision",
       round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1"""
COUNTS = """count(*) FILTER (y AND score >= thres) AS tp, count(*) FILTER (y AND score < thres) AS fn,
       count(*) FILTER (NOT y AND score >= thres) AS fp, count(*) FILTER (NOT y AND score < thres) AS tn"""


def confusion(thresholds: dict[str, float], pairs: str = PAIRS_SQL) -> str:
    return f"WITH {pairs}, d AS ({decided(thresholds)}), c AS (SELECT method, {COUNTS} FROM d GROUP BY method) SELECT method, {QUALITY} FROM c WHERE tp > 0"


def sweep(methods, thresholds: list[float], best: bool = False) -> str:
    d = " UNION ALL ".join(f"SELECT '{m}' AS method, y, {METRICS[m]('s1', 's2')} AS score FROM p" for m in methods)
    zero = QUALITY.replace("round(tp / nullif(tp + fp, 0), 6)", "round(coalesce(tp / nullif(tp + fp, 0), 0), 6)").replace("round(2 *", "round(coalesce(2 *").replace("fp + fn, 0), 6) AS f1", "fp + fn, 0), 0), 6) AS f1")
    rows = f"WITH {PAIRS_SQL}, d AS ({d}), t AS (SELECT unnest({thresholds})::DOUBLE AS thres), c AS (SELECT method, thres, {COUNTS} FROM d, t GROUP BY method, thres), r AS (SELECT method, thres, {zero} FROM c)"
    return f"{rows} SELECT * FROM r" + (" QUALIFY row_number() OVER (PARTITION BY method ORDER BY accuracy DESC, thres) = 1" if best else "")


def term_splits(thresholds) -> str:
    """CTEs that end in g: the base and mismatching terms of each pair at each threshold. Terms are met in order, a step a row."""
    alike = jw("reverse(x[i])", "reverse(y[j])")
    taken = lambda side, word, when: f"CASE WHEN {when} THEN list_append({side}, {word}) ELSE {side} END"
    return f"""{PAIRS_SQL}, t AS (
  SELECT s1, s2, thres, {tokens("s1")} AS x, {tokens("s2")} AS y, 1 AS i, 1 AS j, []::VARCHAR[] AS ba, []::VARCHAR[] AS bb, []::VARCHAR[] AS ma, []::VARCHAR[] AS mb
  FROM p, (SELECT unnest({sorted(set(thresholds))})::DOUBLE AS thres)
  UNION ALL
  SELECT s1, s2, thres, x, y, i + (alike OR first)::INT, j + (alike OR NOT first)::INT,
         {taken("ba", "x[i]", "alike")}, {taken("bb", "y[j]", "alike")}, {taken("ma", "x[i]", "NOT alike AND first")}, {taken("mb", "y[j]", "NOT alike AND NOT first")}
  FROM (SELECT *, {alike} >= thres AS alike, x[i] < y[j] AS first FROM t WHERE i <= len(x) AND j <= len(y))),
g AS (SELECT s1, s2, thres, ba, bb, list_concat(ma, x[i:]) AS ma, list_concat(mb, y[j:]) AS mb FROM t WHERE i > len(x) OR j > len(y))"""


def term_split(thres: float) -> str:
    return f"WITH RECURSIVE {term_splits([thres])} SELECT s1, s2, " + ", ".join(f"array_to_string({side}, ',') AS {name}" for side, name in (("ba", "base_a"), ("bb", "base_b"), ("ma", "mismatch_a"), ("mb", "mismatch_b"))) + ", '' AS special_a, '' AS special_b FROM g"


def lsimilarity(settings: dict[str, tuple[str, float, tuple]], averaged: bool) -> str:
    """Term similarity of pairs without frequent terms; settings: column -> metric, split threshold and weights."""
    chars = lambda a, b: f"(length(array_to_string({a}, '')) + length(array_to_string({b}, '')))"
    turned = lambda x: f"array_to_string(list_transform({tokens(x)}, lambda t: reverse(t)), ' ')"
    # A reversed metric reverses each term, not the whole string.
    own = METRICS | {"jaro_winkler_r": lambda a, b: jw(turned(a), turned(b))}
    columns = []
    for name, (metric, thres, (base, mismatch, special)) in settings.items():
        score = lambda a, b, n: f"CASE WHEN {n} = 0 THEN 0 ELSE {own[metric](a, b)} END"  # noqa: E731, B023
        w0 = f"(CASE WHEN n0 = 0 THEN 0 WHEN n1 = 0 THEN {base + mismatch} ELSE {base} END + {special} * n0 / (n0 + n1))" + " * c0" * averaged
        w1 = f"(CASE WHEN n1 = 0 THEN 0 WHEN n0 = 0 THEN {base + mismatch} ELSE {mismatch} END + {special} * n1 / (n0 + n1))" + " * c1" * averaged
        columns.append(f"round(max(CASE WHEN thres = {thres} THEN ({w0} * {score('a0', 'b0', 'n0')} + {w1} * {score('a1', 'b1', 'n1')}) / ({w0} + {w1}) END), 6) AS {name}")
    joined = ", ".join(f"array_to_string({side}, ' ') AS {name}" for side, name in (("ba", "a0"), ("bb", "b0"), ("ma", "a1"), ("mb", "b1")))
    groups = f"h AS (SELECT s1, s2, thres, {joined}, len(ba) + len(bb) AS n0, len(ma) + len(mb) AS n1, {chars('ba', 'bb')} AS c0, {chars('ma', 'mb')} AS c1 FROM g)"
    return f"WITH RECURSIVE {term_splits(t for _, t, _ in settings.values())}, {groups} SELECT s1, s2, {', '.join(columns)} FROM h GROUP BY s1, s2"


def sweep_weights(metrics, split_thresholds, thresholds, weights) -> str:
    """The most accurate setting of each metric over all weights, split thresholds and thresholds."""
    chars = lambda a, b: f"(length(array_to_string({a}, '')) + length(array_to_string({b}, '')))"
    turned = lambda x: f"array_to_string(list_transform({tokens(x)}, lambda t: reverse(t)), ' ')"
    own = METRICS | {"jaro_winkler_r": lambda a, b: jw(turned(a), turned(b))}
    joined = ", ".join(f"array_to_string({side}, ' ') AS {name}" for side, name in (("ba", "a0"), ("bb", "b0"), ("ma", "a1"), ("mb", "b1")))
    both = " UNION ALL ".join(f"SELECT *, '{m}' AS metric, CASE WHEN n0 = 0 THEN 0 ELSE {own[m]('a0', 'b0')} END AS x0, CASE WHEN n1 = 0 THEN 0 ELSE {own[m]('a1', 'b1')} END AS x1 FROM h" for m in metrics)
    grid = ", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE)" for i, (x, y, z) in enumerate(weights))
    w0 = "(CASE WHEN n0 = 0 THEN 0 WHEN n1 = 0 THEN base + mismatch ELSE base END + special * n0 / (n0 + n1)) * c0 / 2"
    w1 = "(CASE WHEN n1 = 0 THEN 0 WHEN n0 = 0 THEN base + mismatch ELSE mismatch END + special * n1 / (n0 + n1)) * c1 / 2"
    zero = QUALITY.replace("round(tp / nullif(tp + fp, 0), 6)", "round(coalesce(tp / nullif(tp + fp, 0), 0), 6)").replace("round(2 *", "round(coalesce(2 *").replace("fp + fn, 0), 6) AS f1", "fp + fn, 0), 0), 6) AS f1")
    return f"""WITH RECURSIVE {term_splits(split_thresholds)},
h AS MATERIALIZED (SELECT q.s1, q.s2, p.y, thres AS split_thres, {joined}, len(ba) + len(bb) AS n0, len(ma) + len(mb) AS n1, {chars("ba", "bb")} AS c0, {chars("ma", "mb")} AS c1 FROM g AS q JOIN p ON p.s1 = q.s1 AND p.s2 = q.s2),
x AS MATERIALIZED ({both}), w(seq, base, mismatch, special) AS (VALUES {grid}),
d AS (SELECT metric, seq, split_thres, y, ({w0} * x0 + {w1} * x1) / ({w0} + {w1}) AS score FROM x, w),
c AS (SELECT metric, seq, split_thres, thres, {COUNTS} FROM d, (SELECT unnest({thresholds})::DOUBLE AS thres) GROUP BY ALL),
r AS (SELECT metric, seq, split_thres, thres, {zero} FROM c)
SELECT metric, r.seq, [base, mismatch, special]::VARCHAR AS weights, * EXCLUDE (metric, seq, base, mismatch, special) FROM r JOIN w ON w.seq = r.seq
QUALIFY row_number() OVER (PARTITION BY metric ORDER BY accuracy DESC, r.seq, split_thres, thres) = 1"""
