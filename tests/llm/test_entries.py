"""Each registered query on small whole tables with odd rows, and the two learnt models against plain loops."""

import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from kindred.llm import language, queries, toxicity
from kindred.llm.common import held_out

from .helpers import ODD, documents, put
from .test_learnt import made

COLUMNS = {
    1: {"doc_id", "size", "source_size", "target", "taken"},
    2: {"query_id", "rank", "vec_id", "score"},
    3: {"doc_id", "n_shingles", "component_id", "kept"},
    4: {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    5: {"doc_id", "held_out", "score", "predicted"},
    6: {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    7: {"doc_id", "held_out", "lang_pred", "score"},
    8: {"doc_id", "start", "n_tokens", "ids_crc32"},
    9: {"query_id", "rank", "vec_id", "distance"},
    10: {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    11: {"lang", "rank", "phrase", "a", "l", "r", "n", "score"},
    12: {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    13: {"lang", "source", "part", "item", "value", "rank"},
}


def test_every_query_on_whole_tables(spark, tmp_path):
    rows, labels = made(60)
    rows = [*rows, *ODD, (900, "password=hunter22xyz released under the MIT license", "aa", "s", 0)]
    r = np.random.default_rng(0)
    vectors = [(i, r.normal(size=16).tolist(), 0) for i in range(150)] + [(300, None, 0), (400, [0.0] * 16, 0)]
    sf = put(
        spark, tmp_path,
        documents=documents(spark, rows),
        labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        embeddings=spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int"),
    )
    found = {int(n[2:].split("_")[0]): q(spark, sf) for n, q in queries.queries().items()}
    assert sorted(found) == list(range(1, 14))
    for n, df in found.items():
        out = df.collect()
        assert COLUMNS[n] <= set(df.columns), n
        if n in (2, 9):
            assert {x.query_id for x in out} == {0, 100} | ({400} if n == 9 else set())
        elif "doc_id" in df.columns:
            assert sorted(str(x.doc_id) for x in out) == sorted(str(x[0]) for x in rows), n
        if n == 6:
            own = next(x for x in out if x.doc_id == 900)
            assert own.base_sha256 == hashlib.sha256(b"assign:0:20").hexdigest() and own.n_assign == 1
        if n in (5, 7):
            assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in out if x.doc_id is not None)


def test_scores_are_those_of_the_formula(spark):
    """A score is the machine's sum over single terms and over all pairs of terms, written out."""
    rows, labels = made(200, seed=4)
    docs = documents(spark, [*rows, *ODD])
    m = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    of, want = toxicity.Buckets(), {}
    for i, t, *_ in [*rows, *ODD]:
        ids = sorted({m.known[b] for w in toxicity.words(t) for b in of[w] if b in m.known})
        z = m.bias + sum(m.w[a] for a in ids) + sum(float(m.v[a] @ m.v[b]) for k, a in enumerate(ids) for b in ids[:k])
        want.setdefault(i, set()).add(round(1 / (1 + np.exp(-z)), 9))
    out = toxicity.score(docs.select("doc_id", "text"), m).collect()
    assert m.known and all(any(abs(x.score - y) < 1e-8 for y in want[x.doc_id]) for x in out)


def test_filters_count_what_they_hold():
    """Corrected counts against exact sets of n-grams: nothing is missed, and false positives are taken off on average."""
    rows, _ = made(200, seed=9)
    grams = {x: np.unique(np.concatenate([language.hashes(language.prepared(t), n) for _, t, own, *_ in rows[:100] if own == x for n in language.SIZES])) for x in ("aa", "bb")}
    f = language.Filters({k: v.view(np.int64) for k, v in grams.items()})
    for _, text, *_ in rows[100:]:
        h = np.concatenate([language.hashes(language.prepared(text), n) for n in language.SIZES])
        exact = np.array([np.isin(h, grams[x]).sum() for x in f.langs])
        found, n = f.counts(language.prepared(text))
        assert n == len(h) and (found >= exact).all() and (found - exact <= 0.02 * n + 2).all()
        assert f.predict(text)[0] == f.langs[int(exact.argmax())]


def test_a_frequent_language_is_drawn_by_its_hash(spark, monkeypatch):
    """The bound on hashes leaves at least the sample, and no more of a language is ranked than about twice of it."""
    monkeypatch.setattr(language, "SAMPLE", 50)
    docs = documents(spark, [(i, f"ka lo mi {i}", "aa" if i % 10 else "bb", "s", 0) for i in range(6000)])
    assert language.train(docs).langs == ["aa", "bb"]
    assert docs.filter(~held_out(F.col("doc_id"))).count() > 4000
