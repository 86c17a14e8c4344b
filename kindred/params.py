"""Fixed values of metrics, thresholds, term weights and features.

The tuned values must equal those of the workbench whose results this library reproduces."""

from __future__ import annotations

MODES = ("orig", "sorted", "orig_onlylatin", "sorted_onlylatin", "orig_latin_EU/NA", "sorted_latin_EU/NA", "orig_all", "sorted_all")

#: Metrics 1-15 in the order of their ids, with a threshold a mode.
BASIC = {
    "damerau_levenshtein": (0.55, 0.6, 0.4, 0.55, 0.45, 0.55, 0.55, 0.55),
    "jaro": (0.75, 0.8, 0.7, 0.75, 0.7, 0.75, 0.75, 0.75),
    "jaro_winkler": (0.7, 0.85, 0.7, 0.7, 0.7, 0.7, 0.7, 0.7),
    "jaro_winkler_r": (0.75, 0.75, 0.7, 0.75, 0.7, 0.75, 0.75, 0.75),
    "sorted_winkler": (0.7, 0.85, 0.7, 0.7, 0.7, 0.7, 0.7, 0.7),
    "permuted_winkler": (0.7, 0.7, 0.6, 0.6, 0.4, 0.55, 0.7, 0.7),
    "cosine": (0.4, 0.7, 0.35, 0.45, 0.4, 0.45, 0.4, 0.45),
    "jaccard": (0.25, 0.35, 0.3, 0.3, 0.3, 0.3, 0.3, 0.3),
    "strike_a_match": (0.5, 0.55, 0.4, 0.45, 0.4, 0.5, 0.5, 0.4),
    "skipgram": (0.45, 0.55, 0.4, 0.45, 0.45, 0.55, 0.45, 0.45),
    "monge_elkan": (0.7, 0.85, 0.7, 0.75, 0.7, 0.75, 0.7, 0.75),
    "soft_jaccard": (0.6, 0.7, 0.55, 0.6, 0.55, 0.6, 0.6, 0.6),
    "davies": (0.65, 0.7, 0.6, 0.65, 0.65, 0.65, 0.65, 0.65),
    "l_jaro_winkler": (0.7, 0.85, 0.7, 0.7, 0.7, 0.7, 0.75, 0.75),
    "l_jaro_winkler_r": (0.75, 0.75, 0.75, 0.75, 0.75, 0.75, 0.8, 0.8),
}
#: Metrics over split terms, in the order of ids 16-28 (simple) and 29-41 (averaged).
TERM_METRICS = (
    "damerau_levenshtein", "jaro", "jaro_winkler", "jaro_winkler_r", "cosine", "jaccard", "strike_a_match", "skipgram",
    "monge_elkan", "soft_jaccard", "davies", "l_jaro_winkler", "l_jaro_winkler_r",
)
#: Their thresholds in all modes but two, which differ by metric: sorted_latin_EU/NA and sorted_all.
TERM_THRESHOLDS = {"orig": 0.4, "sorted": 0.35, "orig_onlylatin": 0.35, "sorted_onlylatin": 0.35, "orig_latin_EU/NA": 0.4, "orig_all": 0.55}
SIMPLE_SORTED_LATIN = (0.55, 0.75, 0.7, 0.7, 0.45, 0.35, 0.5, 0.45, 0.7, 0.55, 0.65, 0.7, 0.7)
SIMPLE_SORTED_ALL = SIMPLE_SORTED_LATIN
AVG_SORTED_LATIN = (0.55, 0.75, 0.7, 0.75, 0.45, 0.35, 0.5, 0.45, 0.7, 0.6, 0.65, 0.7, 0.75)
AVG_SORTED_ALL = (0.55, 0.75, 0.7, 0.75, 0.35, 0.3, 0.4, 0.4, 0.7, 0.55, 0.65, 0.75, 0.75)


def thresholds() -> list[tuple[int, str, str, float]]:
    """Id, method, mode and threshold of all 41 methods: term metrics are named lsim_ (simple) and avg_lsim_ (averaged)."""
    rows = [(i, m, mode, t) for i, (m, ts) in enumerate(BASIC.items(), 1) for mode, t in zip(MODES, ts, strict=True)]
    for prefix, start, latin, every in (("lsim_", 16, SIMPLE_SORTED_LATIN, SIMPLE_SORTED_ALL), ("avg_lsim_", 29, AVG_SORTED_LATIN, AVG_SORTED_ALL)):
        for k, m in enumerate(TERM_METRICS):
            own = TERM_THRESHOLDS | {"sorted_latin_EU/NA": latin[k], "sorted_all": every[k]}
            rows += [(start + k, prefix + m, mode, own[mode]) for mode in MODES]
    return rows


#: Split threshold and the weights of base, mismatch and special terms.
LATIN = {
    "damerau_levenshtein": {"simple": (0.6, (0.7, 0.1, 0.2)), "avg": (0.7, (0.4, 0.2, 0.4))},
    "jaro": {"simple": (0.6, (0.7, 0.1, 0.2)), "avg": (0.75, (0.7, 0.1, 0.2))},
    "jaro_winkler": {"simple": (0.8, (0.7, 0.1, 0.2)), "avg": (0.7, (0.6, 0.1, 0.3))},
    "jaro_winkler_r": {"simple": (0.6, (0.7, 0.1, 0.2)), "avg": (0.7, (0.7, 0.1, 0.2))},
    "cosine": {"simple": (0.6, (0.6, 0.2, 0.2)), "avg": (0.7, (0.4, 0.2, 0.4))},
    "jaccard": {"simple": (0.6, (0.6, 0.1, 0.3)), "avg": (0.7, (0.334, 0.333, 0.333))},
    "strike_a_match": {"simple": (0.6, (0.6, 0.1, 0.3)), "avg": (0.7, (0.4, 0.2, 0.4))},
    "skipgram": {"simple": (0.6, (0.6, 0.2, 0.2)), "avg": (0.7, (0.334, 0.333, 0.333))},
    "monge_elkan": {"simple": (0.6, (0.7, 0.2, 0.1)), "avg": (0.7, (0.6, 0.2, 0.2))},
    "soft_jaccard": {"simple": (0.8, (0.6, 0.1, 0.3)), "avg": (0.7, (0.4, 0.2, 0.4))},
    "davies": {"simple": (0.8, (0.7, 0.1, 0.2)), "avg": (0.7, (0.5, 0.2, 0.3))},
    "l_jaro_winkler": {"simple": (0.8, (0.7, 0.1, 0.2)), "avg": (0.7, (0.6, 0.1, 0.3))},
    "l_jaro_winkler_r": {"simple": (0.6, (0.7, 0.1, 0.2)), "avg": (0.75, (0.7, 0.1, 0.2))},
}
#: All data: one set of weights, one simple split threshold, and an averaged one a metric.
GLOBAL_WEIGHTS, GLOBAL_SIMPLE = (0.4, 0.5, 0.1), 0.6
GLOBAL_AVG = dict(zip(TERM_METRICS, (0.7, 0.75, 0.7, 0.75, 0.5, 0.5, 0.6, 0.5, 0.6, 0.6, 0.7, 0.75, 0.75), strict=True))
PROFILES = {
    "latin": LATIN,
    "global": {m: {"simple": (GLOBAL_SIMPLE, GLOBAL_WEIGHTS), "avg": (GLOBAL_AVG[m], GLOBAL_WEIGHTS)} for m in TERM_METRICS},
}

#: The order in which an evaluator scores (and saves) the basic metrics.
EVALUATED = (
    "damerau_levenshtein", "jaccard", "jaro", "jaro_winkler", "jaro_winkler_r", "monge_elkan", "cosine", "strike_a_match",
    "soft_jaccard", "sorted_winkler", "skipgram", "davies", "l_jaro_winkler", "l_jaro_winkler_r",
)

#: What sorted runs decide besides: the term similarity, simple and averaged.
TERM_DECISIONS = ("lsim_damerau_levenshtein", "avg_lsim_damerau_levenshtein")

#: Features: metrics in vector order. Names carry their group, as one display name stands in two groups.
FEATURE_BASIC = (
    "damerau_levenshtein", "jaro", "jaro_winkler", "jaro_winkler_r", "sorted_winkler", "cosine", "jaccard", "strike_a_match",
    "skipgram", "monge_elkan", "soft_jaccard", "davies",
)
FEATURE_SORTED = tuple(m for m in FEATURE_BASIC if m != "sorted_winkler") + ("l_jaro_winkler", "l_jaro_winkler_r")
FEATURE_TERMS = (
    "damerau_levenshtein", "davies", "skipgram", "soft_jaccard", "strike_a_match", "cosine", "jaccard", "monge_elkan",
    "jaro_winkler", "jaro", "jaro_winkler_r", "l_jaro_winkler", "l_jaro_winkler_r",
)
FREQUENT = 20


def feature_names() -> list[str]:
    stats = ["tokens_s1", "tokens_s2", "has_freq_s1", "has_freq_s2", *(f"freq{i}_s{s}" for s in (1, 2) for i in range(FREQUENT))]
    return [f"{g}__{m}" for g, ms in (("basic", FEATURE_BASIC), ("sorted", FEATURE_SORTED), ("terms", FEATURE_TERMS), ("ind", ("base", "mismatch", "special")), ("stat", stats)) for m in ms]


def threshold_mode(sorting: bool, latin: bool = False, encoding: str | None = None) -> str:
    """The mode whose thresholds a run uses; latin wins over an encoding."""
    return ("sorted" if sorting else "orig") + ("_latin_EU/NA" if latin else "_all" if encoding else "")
