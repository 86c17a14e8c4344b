"""Near-duplicates by MinHash signatures and a multi-index Hamming join.

A document's set of five-word shingles gets a signature of chunks * wide values of 16 bits. Two sets of
similarity 0.85 differ in 15 % of the values on average; a signature distance up to `errors` misses such a pair
with a chance of about 1e-4, and more similar ones less. With no more than errors = 2 * chunks - 1 errors
one chunk at least has at most one (pigeonhole): enumerating its place, each chunk gives `wide` keys of the
values left. So all pairs within the distance share a key. A Layout holds these numbers for a threshold.

Documents with equal sets are one class, numbered when the classes are written; its text is that of its smallest row by
id and text hash, so that rows that share an id and differ in text are told apart. In a key's group members are compared with its smallest and its
largest. Where these links leave several components, the groups of one smallest member are taken together,
cut into blocks of BLOCK members, and blocks are met two by two: first by signatures, which leaves the members
with a near partner in another component, then by their full sets. Only links come out, no more than join the
components. No group is ever gathered in one task, and every link is confirmed on full sets.

Defined results: texts without words have an empty set and are linked with nothing; texts of fewer words
than a shingle have one; a very long text is hashed whole, and compared by its whole set; rows that repeat are linked;
rows that share an id and differ in text each belong to the component of their own text; rows without an id belong to
the component of their set, if it has an id; of a group's documents the smallest id stays, and where several rows have
it, that of the smallest text hash; an empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, small, table, written

SHINGLE = 5
#: Members of a block, on average.
BLOCK = 200
#: Ids (8 bytes each) that are broadcast at most, so that not all texts are shuffled where few are asked for.
IDS = 200_000


class Layout(NamedTuple):
    """Two sets are linked if `percent` % of their union is shared; signatures have `chunks` chunks of `wide` values."""

    percent: int
    chunks: int
    wide: int

    @property
    def values(self) -> int:
        return self.chunks * self.wide

    @property
    def errors(self) -> int:
        return 2 * self.chunks - 1


#: A pair at the threshold is missed with a chance of 1.6e-4 (21 of 66 values may differ) and 1.0e-4 (27 of 70).
AT_85, AT_80 = Layout(85, 11, 6), Layout(80, 14, 5)
#: Words whose hashes a task keeps.
CACHE = 300_000
_random = np.random.default_rng(20)
FACTORS = _random.integers(0, 2**63, AT_85.values, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ORDER = _random.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Those that longer signatures have besides.
FACTORS = np.concatenate([FACTORS, _random.integers(0, 2**63, AT_80.values - AT_85.values, dtype=np.uint64) * np.uint64(2) + np.uint64(1)])
SIGNED = "doc_id long, text_hash long, n_shingles long, hi long, lo long, sig binary"


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, of: Hashes) -> np.ndarray:
    """Hashes (64 bits) of the distinct shingles of a whole text, ascending. bytes.lower() and .split() know ASCII alone."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)] if words else [], np.uint64)
    w = np.array(list(map(of.__getitem__, words)), np.uint64)
    n = len(w) - SHINGLE + 1
    h = w[:n] * ORDER[0]
    for j in range(1, SHINGLE):
        h = (h ^ (h >> np.uint64(31))) + w[j : n + j] * ORDER[j]
    h ^= h >> np.uint64(32)
    h *= FACTORS[0]
    return np.unique(h ^ (h >> np.uint64(29)))


def signature(h: np.ndarray, values: int) -> np.ndarray:
    """16 bits of the smallest of a set's hashes under each function."""
    factors = FACTORS[:values]
    least = np.full(values, 2**64 - 1, np.uint64)
    for at in range(0, len(h), 2048):
        np.minimum(least, (h[at : at + 2048, None] * factors).min(0), out=least)
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype("<u2")


def _signed(layout: Layout) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Hashes()
        for b in small(batches):
            sizes, his, los, sigs = [], [], [], []
            for t in b.column("text"):
                h = shingles(t.as_py(), of)
                both = xxhash.xxh3_128_digest(h.tobytes())
                sizes.append(len(h))
                his.append(int.from_bytes(both[:8], "little", signed=True))
                los.append(int.from_bytes(both[8:], "little", signed=True))
                sigs.append(signature(h, layout.values).tobytes() if len(h) else None)
            columns = [b.column("doc_id"), b.column("text_hash"), *(pa.array(x, pa.int64()) for x in (sizes, his, los)), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "hi", "lo", "sig"])

    return run


def _keys_of(sig: np.ndarray, layout: Layout) -> np.ndarray:
    """(rows, chunks * wide): the hash of each chunk without each of its values."""
    chunks = sig.reshape(-1, layout.chunks, layout.wide).astype(np.uint64)
    out = np.empty(chunks.shape, np.uint64)
    for j in range(layout.wide):
        h = np.full(chunks.shape[:2], j, np.uint64) + np.uint64(8) * np.arange(layout.chunks, dtype=np.uint64)
        for i in range(layout.wide):
            if i != j:
                h = (h ^ chunks[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        out[:, :, j] = h
    return out.reshape(len(chunks), -1).view(np.int64)


def _sigs(column: pd.Series, layout: Layout) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(-1, layout.values)


def _keyed(layout: Layout) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                keys = _keys_of(_sigs(b.sig, layout), layout)
                yield pd.DataFrame({"key": keys.reshape(-1), "cid": np.repeat(b.cid.to_numpy(), keys.shape[1])})

    return run


def _near(layout: Layout) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b[(_sigs(b.sig_a, layout) != _sigs(b.sig_b, layout)).sum(1) <= layout.errors][["a", "b"]]

    return run


def _confirmed(layout: Layout) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Hashes()
        for b in batches:
            last, left, keep = None, None, []
            for r in b.itertuples():
                if r.a != last:
                    last, left = r.a, shingles(r.text_a, of)
                right = shingles(r.text_b, of)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= layout.percent * (len(left) + len(right) - both))
            yield b[np.array(keep, bool)][["a", "b"]]

    return run


def _sides(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of a pair of blocks' members: of each block, or twice all if it is one block met with itself."""
    every = np.arange(len(g))
    return (every, every) if g.i.iloc[0] == g.j.iloc[0] else (every[(g.own == g.i).to_numpy()], every[(g.own == g.j).to_numpy()])


def _hopeful(layout: Layout) -> Callable:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        """The members with one of another component within the signature distance."""
        sig, comp = _sigs(g.sig, layout), g.comp.to_numpy()
        left, right = _sides(g)
        hope = np.zeros(len(g), bool)
        for x in left:
            near = right[(comp[right] != comp[x])]
            near = near[(sig[near] != sig[x]).sum(1) <= layout.errors]
            hope[near] = True
            hope[x] |= len(near) > 0
        return g.loc[hope, ["leader", "i", "j", "own", "cid", "comp"]]

    return run


def _joining(layout: Layout) -> Callable:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        """Links that join components, by the full sets of two blocks' members."""
        of = Hashes()
        sets = [shingles(t, of) for t in g.text]
        n = np.array([len(x) for x in sets])
        codes, at = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(g)), n)
        held = np.bincount(at, minlength=len(codes)) > 1  # what one member has alone is shared with none
        number = np.cumsum(held) - 1
        owner, at = owner[held[at]], number[at[held[at]]]
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        left, right = _sides(g)
        both = np.zeros((len(left), len(right)), np.float32)
        row, col = np.full(len(g), -1), np.full(len(g), -1)
        row[left], col[right] = np.arange(len(left)), np.arange(len(right))
        for start in range(0, int(held.sum()), 2048):
            part = slice(np.searchsorted(at, start), np.searchsorted(at, start + 2048))
            x, y = np.zeros((len(left), 2048), np.float32), np.zeros((len(right), 2048), np.float32)
            o, c = owner[part], at[part] - start
            x[row[o][row[o] >= 0], c[row[o] >= 0]] = 1
            y[col[o][col[o] >= 0], c[col[o] >= 0]] = 1
            both += x @ y.T
        shared = both.astype(np.int64)
        alike = 100 * shared >= layout.percent * (n[left][:, None] + n[right] - shared)
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.setdefault(c, c) != c:
                c = root[c]
            return c

        cid, comp, out = g.cid.to_numpy(), g.comp.to_numpy(), []
        for i, j in np.argwhere(alike):
            p, q = int(left[i]), int(right[j])
            u, v = find(int(comp[p])), find(int(comp[q]))
            if u != v:
                root[max(u, v)] = min(u, v)
                out.append((min(cid[p], cid[q]), max(cid[p], cid[q])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def signed(docs: DataFrame, layout: Layout) -> DataFrame:
    """doc_id, text_hash, n_shingles, hi and lo (a fingerprint of the set) and sig of every document."""
    return keyed(docs).mapInArrow(_signed(layout), SIGNED)


def texts_of(docs: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """cid and text of the classes with the given numbers (column id)."""
    of = written(classes.join(nodes, F.col("cid") == F.col("id")).select("cid", F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash")), "dedup-ids")
    found = keyed(docs).join(bounded_broadcast(of, IDS), (F.col("doc_id") == F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")))
    return found.select("cid", "text").dropDuplicates(["cid"])


def join_components(groups: DataFrame, comp: DataFrame, classes: DataFrame, docs: DataFrame, layout: Layout) -> DataFrame:
    """Links (a, b) between different components of comp that share a key's group."""
    member = groups.filter("n > 2").select(F.col("first").alias("leader"), "cid").distinct().join(comp, F.col("cid") == F.col("node"), "left").select("leader", "cid", F.coalesce("comp", "cid").alias("comp"))
    member = written(member, "dedup-members")
    mixed = member.groupBy("leader").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("low < high").select("leader", "blocks")
    own = member.join(mixed, "leader").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).join(classes.select("cid", "sig"), "cid")
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("leader", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid", "comp", "sig")
    hope = written(met.groupBy("leader", "i", "j").applyInPandas(_hopeful(layout), "leader long, i int, j int, own int, cid long, comp long"), "dedup-hope")
    texts = texts_of(docs, hope.select(F.col("cid").alias("id")).distinct(), classes)
    return hope.join(texts, "cid").select("leader", "i", "j", "own", "cid", "comp", "text").groupBy("leader", "i", "j").applyInPandas(_joining(layout), "a long, b long")


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, layout: Layout) -> DataFrame:
    """The pairs (a, b) of classes within the signature distance whose full sets are similar enough."""
    sigs = classes.select("cid", "sig")
    both = pairs.join(sigs.select(F.col("cid").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("cid").alias("b"), F.col("sig").alias("sig_b")), "b")
    near = written(both.select("a", "b", "sig_a", "sig_b").mapInPandas(_near(layout), "a long, b long"), "dedup-near")
    texts = written(texts_of(docs, near.select(F.col("a").alias("id")).union(near.select("b")).distinct(), classes), "dedup-texts")
    with_a = near.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a")
    return written(with_a.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b").mapInPandas(_confirmed(layout), "a long, b long"), "dedup-links")


def components(links: DataFrame) -> DataFrame:
    """node and comp (the smallest node that it reaches), for the nodes of links (a, b).

    Each round takes the smallest label among neighbours, then the label of that label, until none changes."""
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "dedup-edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("comp")), "dedup-labels")
    while True:
        seen = edges.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(seen, "node").select("node", "comp", F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("of_next"))
        new = written(step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("of_next", "next")).alias("next"), "comp"), "dedup-labels")
        changed = new.filter("next < comp").limit(1).count()
        labels = new.select("node", F.col("next").alias("comp"))
        if not changed:
            return labels


def linked(docs: DataFrame, layout: Layout) -> DataFrame:
    """doc_id, text_hash, n_shingles, group (a number, null without words), component_id and kept of every document."""
    rows = written(signed(docs, layout), "dedup-signed")
    first = F.min(F.struct("doc_id", "text_hash")).alias("row")
    classes = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "hi", "lo").agg(first, F.min("sig").alias("sig"))
    # Written once, the numbers stay as they are.
    classes = written(classes.select(F.monotonically_increasing_id().alias("cid"), "n_shingles", "hi", "lo", "row.doc_id", "row.text_hash", "sig"), "dedup-classes")
    keys = classes.select("cid", "sig").mapInPandas(_keyed(layout), "key long, cid long")
    shared = keys.groupBy("key").agg(F.min("cid").alias("first"), F.max("cid").alias("last"), F.count("*").alias("n")).filter("n > 1")
    groups = written(keys.join(shared, "key"), "dedup-groups")
    star = groups.select(F.col("first").alias("a"), F.col("cid").alias("b")).union(groups.select(F.col("cid").alias("a"), F.col("last").alias("b"))).filter("a < b").distinct()
    links = confirm(star, classes, docs, layout)
    comp = components(links)

    links = written(links.union(join_components(groups, comp, classes, docs, layout)).distinct(), "dedup-all-links")
    comp = written(components(links), "dedup-components")
    least = comp.join(classes.select("cid", "doc_id"), F.col("node") == F.col("cid")).groupBy("comp").agg(F.min("doc_id").alias("least"))
    labels = comp.join(least, "comp")
    of_class = classes.join(labels, F.col("cid") == F.col("node"), "left").select(F.struct("n_shingles", "hi", "lo").alias("set"), F.coalesce("comp", "cid").alias("group"), F.coalesce("least", "doc_id").alias("least"))
    out = rows.select("doc_id", "text_hash", "n_shingles", F.struct("n_shingles", "hi", "lo").alias("set")).join(of_class, "set", "left")
    component = F.coalesce("least", "doc_id")
    return out.select("doc_id", "text_hash", "n_shingles", "group", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def link(docs: DataFrame, layout: Layout = AT_85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    return linked(docs, layout).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicated(docs: DataFrame, layout: Layout = AT_85) -> DataFrame:
    """One document of each group, and those without words, with their own columns; of rows that share id and text, one."""
    rows = written(linked(docs, layout), "dedup-linked")
    # Which of its rows a group keeps matters only where rows that share an id differ in text.
    several = rows.filter(F.col("kept") & F.col("group").isNotNull()).groupBy("group").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high")).filter("low < high").select(F.col("group").alias("of"), "low")
    ranked = rows.join(bounded_broadcast(written(several, "dedup-several")), F.col("group") == F.col("of"), "left").withColumn("kept", F.col("kept") & F.coalesce(F.col("text_hash") == F.col("low"), F.lit(True)))
    status = written(ranked.groupBy("doc_id", "text_hash").agg(F.min("kept").alias("kept"), F.count("*").alias("n")).filter("NOT kept OR n > 1"), "dedup-dropped")
    same = lambda d: d.doc_id.eqNullSafe(F.col("__id")) & (F.xxhash64(d.text) == F.col("__hash"))
    of = lambda s: s.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    out = docs.join(bounded_broadcast(of(status.filter("NOT kept")), IDS), same(docs), "left_anti")
    again = status.filter("kept")
    if not again.limit(1).count():
        return out
    again = bounded_broadcast(of(again), IDS)
    return out.join(again, same(out), "left_anti").unionByName(out.join(again, same(out), "left_semi").dropDuplicates(["doc_id", "text"]))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))
