"""Approximate nearest neighbours with balanced posting lists.

Centroids are fitted on a bounded sample, lists that hold far more of it than others are split in two again and again,
and the centroids are linked to a graph, which tasks keep in memory and search from
neighbour to neighbour. Every vector goes to the list of its nearest centroid and, near a boundary, to those
of other centroids about as near. Long lists are split by hash into parts of bounded size. A query visits
all lists whose centroid is at most RATIO times as far as its nearest one: many where distances are alike,
few where they differ. Where these lists are the homes of less than HOMED vectors, it visits those within RATIO of the
centroid at which so many are reached. A part of a list meets the queries that visit it, in as many blocks as they
need and no more; distances are exact.

Defined results: vectors that are null, zero, hold null or non-finite components, or differ in length from
the most common length (the smallest of those most common) take no part, nor do rows without an id; rows that
repeat an id count once, with the smallest vector; equal distances rank by id; an empty table, and a single
vector, give an empty result. Further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_broadcast, table, written

#: Vectors that centroids are fitted on, at most: those with the smallest hash of their id.
SAMPLE = 40_000
#: Vectors for each centroid, and centroids, at most; how many times the average a list may hold of the sample.
LIST, CENTROIDS, HEAVY = 250, 8192, 2.0
#: Lists of a vector, at most, and how much further than the nearest their centroids may be.
COPIES, BOUNDARY = 6, 1.06
#: How much further than the nearest a visited list's centroid may be.
RATIO = 1.12
#: Vectors that the lists which a query visits are the homes of, at least (more than k in any case).
HOMED = 1000
#: Rows of a part of a list and queries of a block, on average.
PART, QUERIES = 4000, 4000
#: Links of a centroid, and centroids that a search keeps in view at least.
LINKS, VIEW = 24, 24


def valid(df: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = df.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("v") == (lengths[0]["n"] if lengths else 0)).groupBy("vec_id").agg(F.min("v").alias("embedding"))


class Centroids:
    """Centroids, and links of each to its nearest ones and to some others, so that all can be reached."""

    def __init__(self, c: np.ndarray, seed: int = 5):
        self.c, n = c, len(c)
        squares = (c * c).sum(1)
        # A few hundred centroids are compared with all others at once.
        near = np.concatenate([np.argsort(squares - 2 * part @ c.T, axis=1, kind="stable")[:, : LINKS + 1] for part in np.array_split(c, -(-n // 500))])
        ring = np.random.default_rng(seed).permutation(n)
        after = np.empty(n, int)
        after[ring] = np.roll(ring, -1)
        links: list[set[int]] = [{int(after[i]), *map(int, near[i])} for i in range(n)]
        for i in range(n):
            for j in list(links[i]):
                links[j].add(i)
        self.links = [np.array(sorted(x - {i}), int) for i, x in enumerate(links)]
        self.entry = int(((c - c.mean(0)) ** 2).sum(1).argmin())

    def search(self, x: np.ndarray, ratio: float, view: int = VIEW) -> tuple[np.ndarray, np.ndarray]:
        """Centroids within ratio of the nearest distance, nearest first, and their distances."""
        seen = np.zeros(len(self.c), bool)
        seen[self.entry] = True
        first = float(np.sqrt(((self.c[self.entry] - x) ** 2).sum()))
        front, found, best = [(first, self.entry)], [(first, self.entry)], first
        kept = [-first]
        while front:
            d, i = heapq.heappop(front)
            if d > best * ratio and len(kept) >= view and d > -kept[0]:
                break
            new = self.links[i][~seen[self.links[i]]]
            if not len(new):
                continue
            seen[new] = True
            dist = np.sqrt(((self.c[new] - x) ** 2).sum(1))
            for dj, j in zip(dist.tolist(), new.tolist(), strict=True):
                best = min(best, dj)
                heapq.heappush(front, (dj, j))
                found.append((dj, j))
                if len(kept) < view:
                    heapq.heappush(kept, -dj)
                elif -dj > kept[0]:
                    heapq.heapreplace(kept, -dj)
        near = sorted(x for x in found if x[0] <= best * ratio)
        return np.array([j for _, j in near], int), np.array([d for d, _ in near])

    def visited(self, x: np.ndarray, ratio: float, homed: np.ndarray, least: int) -> np.ndarray:
        """The lists of a query: those within ratio, or as many more as are the homes of `least` vectors (homed: a count a list)."""
        near = self.search(x, ratio)[0]
        if homed[near].sum() >= least:
            return near
        d = np.sqrt(((self.c - x) ** 2).sum(1))
        order = np.argsort(d, kind="stable")
        at = min(int(np.searchsorted(homed[order].cumsum(), least)), len(order) - 1)
        return order[: np.searchsorted(d[order], d[order[at]] * ratio, side="right")]

    def homes(self, x: np.ndarray) -> list[int]:
        """The lists of a vector: the nearest, and, near a boundary, others about as near."""
        return self.search(x, BOUNDARY)[0][:COPIES].tolist()


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The centroid of each vector."""
    return np.concatenate([((c * c).sum(1) - 2 * part @ c.T).argmin(1) for part in np.array_split(x, -(-len(x) // 2000))])


def lloyd(x: np.ndarray, c: np.ndarray, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        own = nearest(x, c)
        count = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c)
    return c


def balanced(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """c, with centroids of more than HEAVY times the average number of vectors replaced by two of their own.

    Equal vectors can't be parted: their list is split by hash only, see PART."""
    own, most = nearest(x, c), HEAVY * len(x) / len(c)
    lists = [(c[i], x[own == i]) for i in range(len(c))]
    out = []
    while lists:
        centre, members = lists.pop()
        halves = None
        if len(members) > max(most, 1):
            far = members[((members - members[0]) ** 2).sum(1).argmax()]
            two = lloyd(members, np.array([members[0], far]), 4)
            side = nearest(members, two)
            if 0 < side.sum() < len(members):
                halves = [(two[i], members[side == i]) for i in (0, 1)]
        if halves:
            lists += halves
        else:
            out.append(centre)
    return np.array(out)


def fit(vectors: DataFrame, seed: int = 3) -> Centroids | None:
    """Centroids by Lloyd's method on at most SAMPLE vectors, which come to the driver."""
    n = vectors.count()
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toPandas().embedding
    if not len(sample):
        return None
    x = np.array(sample.tolist(), float)
    k = int(min(max(1, n // LIST), CENTROIDS, max(1, len(x) // 4)))
    return Centroids(balanced(x, lloyd(x, x[np.random.default_rng(seed).choice(len(x), k, replace=False)], 8)))


def index(vectors: DataFrame, centroids: Centroids) -> DataFrame:
    """list, home, vec_id and embedding: the posting lists. Every vector is in one of them at least, and home is true in one."""
    model = vectors.sparkSession.sparkContext.broadcast(centroids)

    def posted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            homes = [model.value.homes(np.asarray(v, float)) for v in b.embedding]
            at = np.repeat(np.arange(len(b)), [len(h) for h in homes])
            yield pd.DataFrame({"list": [j for h in homes for j in h], "home": [j == h[0] for h in homes for j in h], "vec_id": b.vec_id.to_numpy()[at], "embedding": b.embedding.to_numpy()[at]})

    return vectors.mapInPandas(posted, "list int, home boolean, vec_id long, embedding array<double>")


def _nearest(k: int):
    def run(lists: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """The k nearest of a part of a list for each query of a block: exact distances, ties by id."""
        out = []
        if len(lists) and len(queries):
            order = np.argsort(lists.vec_id.to_numpy(), kind="stable")
            ids = lists.vec_id.to_numpy()[order]
            p = np.array(lists.embedding.tolist(), float)[order]
            squares = (p * p).sum(1)
            for qid, q in zip(queries.query_id.tolist(), queries.embedding, strict=True):
                q = np.asarray(q, float)
                rough = squares - 2 * (p @ q)
                rough[ids == qid] = np.inf
                # Rounding is far below the slack, so nothing that ties with the kth is lost.
                near = np.flatnonzero(rough <= np.partition(rough, k - 1)[k - 1] + 1e-9 * (1 + squares.max() + q @ q)) if len(p) > k else np.flatnonzero(rough < np.inf)
                near = near[rough[near] < np.inf]
                d = np.sqrt(((p[near] - q) ** 2).sum(1))
                best = np.argsort(d, kind="stable")[:k]
                out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[near][best], "score": d[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, ratio: float = RATIO) -> DataFrame:
    """query_id, rank, vec_id and score (distance) of the k nearest vectors found for each query (vec_id, embedding).

    A vector with a query's id is not among its candidates."""
    spark = vectors.sparkSession
    centroids = fit(vectors)
    if centroids is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = written(index(vectors, centroids), "ann-lists")
    # As many rows as centroids.
    parts = written(lists.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.count_if("home").alias("homed")), "ann-parts")
    homed = np.zeros(len(centroids.c), int)
    for r in parts.collect():
        homed[r["list"]] = r["homed"]
    model = spark.sparkContext.broadcast((centroids, homed))

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            near = [model.value[0].visited(np.asarray(v, float), ratio, model.value[1], max(HOMED, k + 1)) for v in b.embedding]
            at = np.repeat(np.arange(len(b)), [len(x) for x in near])
            yield pd.DataFrame({"list": np.concatenate(near) if near else [], "query_id": b.vec_id.to_numpy()[at], "embedding": b.embedding.to_numpy()[at]})

    asked = queries.mapInPandas(visits, "list int, query_id long, embedding array<double>")
    asked = written(asked, "ann-visits")
    # Rows a list again: how many parts it has, and how many blocks of queries visit it.
    sizes = written(asked.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks")).join(parts.drop("homed"), "list"), "ann-sizes")
    sizes = F.broadcast(sizes.withColumnRenamed("list", "of"))
    block = F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")
    asked = asked.join(sizes, F.col("list") == F.col("of")).select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), block.alias("block"), "query_id", "embedding")
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    held = lists.join(sizes, F.col("list") == F.col("of")).select("list", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "embedding")
    key = ["list", "part", "block"]
    found = held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(_nearest(k), "query_id long, vec_id long, score double")
    w = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(valid(table(spark, sf_dir, "embeddings")), "ann-vectors")
    return search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
