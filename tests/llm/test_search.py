import numpy as np
import pytest

from kindred.llm import hamming, neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, list int, code int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, 2) for i, v in rows], SCHEMA)


def made(n=1500, dims=64, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dims))
    x = (centres[r.integers(0, 12, n)] + 0.4 * r.normal(size=(n, dims))).astype(np.float32)
    x[100:400] = x[100]
    return x


def test_recall_and_ties(spark):
    x = made()
    vectors = neighbours.valid(frame(spark, list(enumerate(x.tolist()))))
    out = neighbours.search(vectors, vectors.filter("vec_id % 100 = 0")).toPandas()
    hit = 0
    for q in range(0, len(x), 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(x)), d))[:10]
        got = out[out.query_id == q].sort_values("rank")
        assert got["rank"].tolist() == list(range(1, 11)) and got.score.to_numpy() == pytest.approx(d[got.vec_id])
        hit += len({*want} & {*got.vec_id})
        if 100 <= q < 400:
            assert got.vec_id.tolist() == want.tolist()
    assert hit >= 0.9 * 10 * 15


def test_outliers_and_clumps_get_k(spark):
    """Vectors and small clumps that have a centroid of their own, far from all others."""
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 8))
    for i in range(0, 600, 100):
        x[i : i + 1 + i // 100] = 1000 * r.normal(size=8)
    vectors = neighbours.valid(frame(spark, list(enumerate(x.tolist()))))
    assert len(neighbours.fit(vectors).c) > 1
    out = neighbours.search(vectors, vectors.filter("vec_id % 100 = 0")).toPandas()
    for q in range(0, len(x), 100):
        got = out[out.query_id == q].sort_values("rank")
        assert got["rank"].tolist() == list(range(1, 11)) and q not in set(got.vec_id) and got.score.is_monotonic_increasing
        assert set(got.vec_id) >= {*range(q + 1, q + 1 + q // 100)} if q < 600 else True


def test_visited_lists_hold_enough():
    c = neighbours.Centroids(np.array([[0.0, 0], [10, 0], [10.5, 0], [0, 20], [40, 0]]))
    assert c.visited(np.zeros(2), 1.12, np.array([1, 5, 30, 30, 30]), 11).tolist() == [0, 1, 2]
    assert c.visited(np.zeros(2), 1.12, np.array([11, 5, 30, 30, 30]), 11).tolist() == [0]
    assert c.visited(np.zeros(2), 1.12, np.array([1, 1, 1, 1, 1]), 11).tolist() == [0, 1, 2, 3, 4]


def test_recall_without_structure(spark):
    """Vectors of no structure at all, and of all in one clump but a few."""
    r = np.random.default_rng(11)
    for x in (r.normal(size=(4000, 32)), np.concatenate([0.01 * r.normal(size=(3800, 16)), r.normal(size=(200, 16))])):
        vectors = neighbours.valid(frame(spark, list(enumerate(x.tolist())))).cache()
        out = neighbours.search(vectors, vectors.filter("vec_id % 100 = 0")).toPandas()
        y = x.astype(np.float32).astype(float)
        hit = 0
        for q in range(0, len(x), 100):
            d = ((y - y[q]) ** 2).sum(1)
            d[q] = np.inf
            hit += len({*np.argsort(d)[:10]} & {*out[out.query_id == q].vec_id})
        assert len(out) == len(x) // 10 and hit >= 0.9 * len(out)


def test_lists_are_balanced():
    r = np.random.default_rng(2)
    x = np.concatenate([0.01 * r.normal(size=(3600, 8)), r.normal(size=(400, 8)), np.ones((500, 8))])
    c = neighbours.lloyd(x, x[r.choice(len(x), 20, replace=False)], 8)
    count = lambda c: np.bincount(neighbours.nearest(x, c), minlength=len(c))
    after = count(neighbours.balanced(x, c))
    assert count(c).max() > 2 * 2 * len(x) / 20 and (np.sort(after)[:-1] <= 2.2 * len(x) / 20).all()  # the copies stay together


def test_odd_vectors(spark):
    rows = [(0, [1, 2]), (0, [1, 2]), (1, None), (2, [0, 0]), (3, [1, None]), (4, [float("nan"), 1]), (5, [float("inf"), 1]), (6, [1, 2, 3]), (None, [3, 3]), (7, [1, 3]), (100, [1, 3]), (8, [])]
    vectors = neighbours.valid(frame(spark, rows))
    assert sorted(r.vec_id for r in vectors.collect()) == [0, 7, 100]
    out = sorted(neighbours.search(vectors, vectors.filter("vec_id % 100 = 0")).collect())
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in out] == [(0, 1, 7, 1.0), (0, 2, 100, 1.0), (100, 1, 7, 0.0), (100, 2, 0, 1.0)]
    empty = neighbours.valid(frame(spark, []))
    assert neighbours.search(empty, empty).collect() == []


@pytest.mark.parametrize("bits", [64, 150, 20])
def test_hamming_is_exact(spark, bits):
    x = made(1200, bits, 3)
    rows = [*enumerate(x.tolist()), (5000, None), (None, [1.0] * bits), (5001, [1.0] * 3), (5002, [None] * bits), (0, x[0].tolist())]
    codes = hamming.codes(frame(spark, rows))
    out = hamming.search(codes, codes.filter("vec_id % 100 = 0"), block=5).toPandas()
    bits = x > 0
    for q in range(0, len(x), 100):
        d = (bits != bits[q]).sum(1)
        d[q] = 1000
        want = np.lexsort((np.arange(len(x)), d))[:10]
        got = out[out.query_id == q].sort_values("rank")
        assert got.vec_id.tolist() == want.tolist() and got.distance.tolist() == d[want].tolist()


def test_hamming_few(spark):
    empty = hamming.codes(frame(spark, []))
    assert hamming.search(empty, empty).collect() == []
    two = hamming.codes(frame(spark, [(0, [1.0] * 64), (1, [-1.0] * 64)]))
    assert [(r.vec_id, r.distance) for r in hamming.search(two, two.filter("vec_id = 0")).collect()] == [(1, 64)]
