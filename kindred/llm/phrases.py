"""Phrases whose words stand together more often than apart, by language.

Texts are cut into pieces and words. A count of words by language comes first: a phrase occurs no more often than its
rarest word. Then a sketch of counters, indexed by hashes of language and phrase, bounds from above how often each
phrase of two or three words occurs: phrases whose bound reaches LEAST are candidates, among them all that occur so
often. Another pass numbers a task's words and counts its candidates by those numbers, exactly; the counts of equal
phrases, by their words, are summed, and thresholds, cuts and the ranking follow on exact counts as joins and windows.

The texts are read three times, however many candidates there are. Memory is bounded at every size: a task passes on
what it has counted at PENDING and at ROUND phrases, and the bits that mark high counters end at MARKS, beyond which there are
more candidates, never fewer. What tasks pass on grows with the phrases that they met, not with the counters.

Defined results: null texts are empty, a null language counts as `und`; very long texts are counted whole; rows that
repeat count as often as they occur; ties are settled by the smaller cut and by the phrase in UTF-8 order; null doc_ids
don't matter; an empty table, or one without a phrase that often, gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, table, written

#: Occurrences that a candidate needs, words of the longest, per cent of a phrase that drops those inside it, rows a language.
LEAST, LONGEST, INSIDE, FIRST = 10, 3, 50, 2000
#: Counters: those of two rows where there are FILL phrases a counter or fewer, those of one row beyond, of which so few are ever
#: used that hardly two phrases share one.
CELLS, FILL = (1 << 16, 1 << 40), 4
#: Counters that meet in one row of a merge: so many where there are two rows, so many rows where there is one.
BLOCK, BLOCKS = 1 << 16, 1 << 12
#: Bits that mark high counters of one row: the power of two from 32 times their number, between these bounds.
MARKS = (1 << 20, 1 << 29)
#: Occurrences of candidates that a task counts at a time, and blocks of a language's candidates.
ROUND, PARTS = 2_500_000, 1024
#: Words that are numbered at a time, and bits of their numbers, of which LONGEST make up a phrase's.
SPAN, NUMBER = 1_000_000, 21
#: Of no effect: digits of the codes that words had while phrases were found by automata.
DIGITS = [chr(c) for c in range(0x30, 0x70)]
#: Bits for hashes of frequent words: the power of two from 16 times their number, between these bounds.
BITS = (1 << 15, 1 << 27)
#: Occurrences, and counts of a block, that wait to be summed.
PENDING = 3_000_000
#: Characters that are worked on at once, words whose numbers and counts a task keeps, about.
CHARACTERS, HELD = 4_000_000, 500_000
#: A-Z small, tabs blank, bytes that end a piece a line feed.
CLEAN = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b == 9 else 0x0A if chr(b) in ".,;:!?\n\x0b\x0c\r" else b for b in range(256))


def words_of(texts: list[str]) -> pa.Array:
    """The words of texts; line feeds among them stand for ends of pieces."""
    joined = "\n".join(texts).encode().translate(CLEAN).replace(b"\n", b" \n ")
    words = pc.split_pattern(pa.array([joined], pa.large_binary()).cast(pa.large_string()), " ").flatten()
    return words.filter(pc.not_equal(words, ""))


def listed(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    """Language and words of texts of it, up to CHARACTERS at once (one text may be longer)."""
    waiting: dict[str, list[str]] = {}
    size: Counter = Counter()
    for b in small(batches, 200):
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            waiting.setdefault(lang, []).append(text)
            size[lang] += len(text) + 1
            if size[lang] >= CHARACTERS:
                yield lang, words_of(waiting.pop(lang))
                del size[lang]
        if size.total() >= 2 * CHARACTERS:
            for lang, texts in waiting.items():
                yield lang, words_of(texts)
            waiting, size = {}, Counter()
    for lang, texts in waiting.items():
        yield lang, words_of(texts)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[pa.Table]] = {}
    size = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            counts = pa.concat_tables(parts).group_by("phrase").aggregate([("n", "sum")])
            counts = counts.filter(pc.not_equal(counts["phrase"], "\n"))
            for b in counts.to_batches(max_chunksize=50_000):
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(b), "phrase": b["phrase"].cast(pa.string()), "n": b["n_sum"]})
        held.clear()

    for lang, words in _by_language(batches):
        found = words.value_counts()
        held.setdefault(lang, []).append(pa.table({"phrase": found.field("values"), "n": found.field("counts")}))
        size += len(found)
        if size > 4 * HELD:
            yield from flushed()
            size = 0
    yield from flushed()


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str], np.ndarray]]:
    """Language, the distinct ones of SPAN words at most and those that phrases which begin there need besides, and which of them
    stands where."""
    for lang, words in _by_language(batches):
        for at in range(0, len(words), SPAN):
            part = words.slice(at, SPAN + LONGEST - 1).dictionary_encode()
            yield lang, listed(part.dictionary), part.indices.to_numpy()


class Hashes(dict):
    """Numbers of a language's words from 1 on; 0 for what is no word, and for words too rare for a phrase (by a bit for
    each hash, which some rare words share). Words and their 64-bit hashes are found by number."""

    def __init__(self, lang: str, bits: np.ndarray):
        super().__init__()
        self.seed, self.bits, self.words, self.hashes = xxhash.xxh64_intdigest(lang.encode(), 42), bits, [""], np.zeros(1, np.uint64)

    def of(self, words: list[str]) -> np.ndarray:
        """The numbers of distinct words."""
        new = [w for w in words if w not in self]
        h = np.fromiter((xxhash.xxh64_intdigest(w.encode(), self.seed) for w in new), np.uint64, len(new))
        at = h % np.uint64(8 * len(self.bits))
        often = self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0
        often &= np.fromiter((w not in ("", "\n") for w in new), bool, len(new)) & (h != 0)
        self.update(zip(new, np.where(often, len(self.words) + np.cumsum(often) - 1, 0).tolist(), strict=True))
        self.words.extend([w for w, o in zip(new, often.tolist(), strict=True) if o])
        self.hashes = np.concatenate([self.hashes, h[often]])
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Known(dict):
    """Hashes by language."""

    def __init__(self, bits: np.ndarray):
        super().__init__()
        self.bits = bits

    def __missing__(self, lang: str) -> Hashes:
        found = self[lang] = Hashes(lang, self.bits)
        return found

    def full(self) -> bool:
        return len(self) > 64 or sum(map(len, self.values())) > HELD


def hash_of(hashes: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases from those of their words."""
    x = hashes[0]
    for h in hashes[1:]:
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def starts(words: list[str], at: np.ndarray, known: Hashes) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """For each length: where phrases of words that are not rare start, among the first SPAN words, and the numbers of their words."""
    k = known.of(words)[at]
    whole = k != 0
    for n in range(2, LONGEST + 1):
        whole = whole[:-1] & (k[n - 1 :] != 0)
        first = np.flatnonzero(whole[:SPAN])
        yield n, first, [k[first + i] for i in range(n)]


def phrase_hashes(words: list[str], known: Hashes, at: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: where phrases of words that are not rare start, and their 64-bit hashes. The words stand one after the
    other, or as at says."""
    if at is None:
        words, at = np.unique(words, return_inverse=True)
        words = words.tolist()
    for n, first, numbers in starts(words, at, known):
        yield n, first, hash_of([known.hashes[k] for k in numbers])


def cells_of(x: np.ndarray, cells: int) -> tuple[np.ndarray, ...]:
    """The counters of phrases: in both rows the low and the high half of their hashes, in one row the high bits."""
    if cells > 1 << 32:
        return (x >> np.uint64(65 - cells.bit_length()),)
    return x & np.uint64(cells - 1), (x >> np.uint64(32)) & np.uint64(cells - 1)


def block_of(cells: int) -> tuple[int, str]:
    """Counters of a block, and how places in it are written."""
    return (cells // BLOCKS, "<u4") if cells > 1 << 32 else (BLOCK, "<u2")


def spots(cell: np.ndarray, row: int, cells: int, bits: int) -> list[np.ndarray]:
    """The bits, of so many, that mark a counter. A block's lie side by side; a counter of the only row has two of them, so that
    few counters share both."""
    cell = cell.astype(np.int64)
    if cells <= 1 << 32:
        return [cell + row * cells]
    block, place = cell // (cells // BLOCKS), cell % (cells // BLOCKS)
    own = bits // BLOCKS
    return [block * own + place % own, block * own + (place * 0x9E3779B1 >> 16) % own]


def _summed(parts: list[np.ndarray], least: int) -> np.ndarray:
    """Of cells, each eight bits up and with a count below it: the distinct ones in order, with their sums up to least. The list is emptied."""
    both = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    parts.clear()
    both.sort()
    counts = both.astype(np.uint8)
    both >>= np.uint64(8)
    first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
    total = np.add.reduceat(counts, first, dtype=np.int64) if len(both) else first
    return both[first] << np.uint64(8) | np.minimum(total, least).astype(np.uint64)


def _sketched(rare, cells: int, least: int):
    """A task's counters that are not 0: a row a block of them, with their places in the block and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size, (own, written_as) = Known(rare.value), 0, block_of(cells)
        rows: list[list[np.ndarray]] = [[] for _ in cells_of(np.zeros(0, np.uint64), cells)]

        def flushed() -> Iterator[pa.RecordBatch]:
            for k, row in enumerate(rows):
                cell = _summed(row, least)
                n = cell.astype(np.uint8)
                cell >>= np.uint64(8)
                block, first = np.unique(cell // np.uint64(own), return_index=True)
                ends = [*first[1:].tolist(), len(cell)]
                places = (cell % np.uint64(own)).astype(written_as)
                for at in range(0, len(block), 1000):
                    spans = list(zip(first[at : at + 1000].tolist(), ends[at : at + 1000], strict=True))
                    columns = {"row": pa.array([k] * len(spans), pa.int32()), "block": pa.array(block[at : at + 1000].astype(np.int32))}
                    yield pa.RecordBatch.from_pydict(columns | {"places": pa.array([places[i:j].tobytes() for i, j in spans], pa.binary()), "counts": pa.array([n[i:j].tobytes() for i, j in spans], pa.binary())})

        for lang, words, at in _words(batches):
            if known.full():
                known.clear()
            for _, _, x in phrase_hashes(words, known[lang], at):
                size += len(x)
                for row, cell in zip(rows, cells_of(x, cells), strict=True):
                    row.append(cell << np.uint64(8) | np.uint64(1))
            if size > PENDING:
                yield from flushed()
                size = 0
        yield from flushed()

    return run


def _high(cells: int, least: int):
    """The places of each block whose counts reach least, of rows that are sorted by row and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, written_as = block_of(cells)
        key, parts = None, []

        def those() -> pa.RecordBatch:
            both = _summed(parts, least)
            places = (both[both & np.uint64(255) >= least] >> np.uint64(8)).astype(written_as)
            return pa.RecordBatch.from_pydict({"row": pa.array([key[0]], pa.int32()), "block": pa.array([key[1]], pa.int32()), "n": [len(places)], "places": pa.array([places.tobytes()], pa.binary())})

        for b in batches:
            for row, block, places, n in zip(*(b.column(c).to_pylist() for c in ("row", "block", "places", "counts")), strict=True):
                if (row, block) != key:
                    if key:
                        yield those()
                    key, parts = (row, block), []
                parts.append(np.frombuffer(places, written_as).astype(np.uint64) << np.uint64(8) | np.frombuffer(n, np.uint8))
                if len(parts) > 1 and sum(map(len, parts[1:])) > PENDING + len(parts[0]):
                    parts = [_summed(parts, least)]
        if key:
            yield those()

    return run


def _marked(cells: int, bits: int):
    """The bits of each block, and which of them is the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, written_as = block_of(cells)
        many = bits // BLOCKS if cells > 1 << 32 else min(BLOCK, cells)
        for b in batches:
            for row, block, places in zip(*(b.column(c).to_pylist() for c in ("row", "block", "places")), strict=True):
                first, out = block * many + (row * cells if cells <= 1 << 32 else 0), np.zeros(many, bool)
                for at in spots(np.frombuffer(places, written_as).astype(np.int64) + block * own, row, cells, bits):
                    out[at - first] = True
                yield pa.RecordBatch.from_pydict({"first": [first], "bits": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    return run


def numbers_of(keys: np.ndarray, n: int) -> list[np.ndarray]:
    """The numbers of the words that keys of n words stand for."""
    return [keys >> (NUMBER * i) & ((1 << NUMBER) - 1) for i in reversed(range(n))]


def lines_of(keys: np.ndarray, words: list[str]) -> list[str]:
    """The phrases that keys stand for."""
    out = np.empty(len(keys), object)
    for n in range(2, LONGEST + 1):
        at = np.flatnonzero((keys >= 1 << NUMBER * (n - 1)) & (keys < 1 << NUMBER * n if n < LONGEST else True))
        out[at] = list(map(" ".join, zip(*(map(words.__getitem__, k.tolist()) for k in numbers_of(keys[at], n)), strict=True)))
    return out.tolist()


def _candidates(rare, model, cells: int):
    """How often a task met the phrases whose counters are high: a row a block of phrases, by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known, size = model.value, Known(rare.value), 0
        waiting: dict[str, list[np.ndarray]] = {}

        def counted(lang: str, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            own, keys = known[lang], np.concatenate(parts)
            parts.clear()
            keys.sort()
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            counts, keys = np.diff(np.r_[first, len(keys)]).astype("<u4"), keys[first]
            blocks = np.zeros(len(keys), np.int16)
            # The numbers of shorter phrases are 0 in front.
            spans = [0, *(int(np.searchsorted(keys, 1 << NUMBER * n)) for n in range(2, LONGEST)), len(keys)]
            for n, i, j in zip(range(2, LONGEST + 1), spans, spans[1:], strict=False):
                blocks[i:j] = hash_of([own.hashes[k] for k in numbers_of(keys[i:j], n)]) % np.uint64(PARTS)
            order = np.argsort(blocks, kind="stable")
            blocks, keys, counts = blocks[order], keys[order], counts[order]
            found, first = np.unique(blocks, return_index=True)
            first = [*first.tolist(), len(keys)]
            for at in range(0, len(found), 64):
                i, those = first[at], first[at : at + 65]
                lines = lines_of(keys[i : those[-1]], own.words)
                columns = {"lang": [lang] * (len(those) - 1), "block": found[at : at + 64].astype(np.int32), "phrases": ["\n".join(lines[a - i : b - i]) for a, b in pairwise(those)]}
                yield pa.RecordBatch.from_pydict(columns | {"counts": pa.array([counts[a:b].tobytes() for a, b in pairwise(those)], pa.binary())})

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, parts in waiting.items():
                yield from counted(lang, parts)
            waiting.clear()

        for lang, words, places in _words(batches):
            if known.full():
                yield from flushed()
                known.clear()
                size = 0
            own = known[lang]
            for _, _, numbers in starts(words, places, own):
                x = hash_of([own.hashes[k] for k in numbers])
                keep = np.arange(len(x))
                for row, cell in enumerate(cells_of(x, cells)):
                    for at in spots(cell, row, cells, 8 * len(bits)):
                        at = at[keep]
                        keep = keep[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
                if len(keep):
                    key = numbers[0][keep]
                    for k in numbers[1:]:
                        key = key << NUMBER | k[keep]
                    waiting.setdefault(lang, []).append(key)
                    size += len(key)
            if size > ROUND:
                yield from flushed()
                size = 0
        yield from flushed()

    return run


def _united(least: int):
    """The phrases of each block whose counts sum up to least or more, of rows that are sorted by language and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, {}

        def often() -> pa.RecordBatch:
            some = [(p, n) for p, n in total.items() if n >= least]
            return pa.RecordBatch.from_pydict({"lang": pa.array([key[0]] * len(some), pa.string()), "phrase": pa.array([p for p, _ in some], pa.string()), "n": pa.array([n for _, n in some], pa.int64())})

        for b in batches:
            for lang, block, phrases, counts in zip(*(b.column(c).to_pylist() for c in ("lang", "block", "phrases", "counts")), strict=True):
                if (lang, block) != key:
                    if key:
                        yield often()
                    key, total = (lang, block), {}
                for p, n in zip(phrases.split("\n"), np.frombuffer(counts, "<u4").tolist(), strict=True):
                    total[p] = total.get(p, 0) + n
        if key:
            yield often()

    return run


def frequent_words(words: DataFrame, least: int) -> np.ndarray:
    """A bit for each hash of a language and word: set if such a word occurs least times or more. At most BITS[1] of them."""
    often = words.filter(F.col("n") >= least)
    size = BITS[0]
    many = often.count()
    while size < BITS[1] and size < 16 * many:
        size *= 2
    at = often.select((F.xxhash64("lang", "phrase").bitwiseAND(F.lit(size - 1)) + 1).alias("at"))
    found = at.groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for r in found.toLocalIterator():
        out[(r["k"] - 1) * 4096 :][:4096] = np.frombuffer(r["bits"], np.uint8)[: size // 8]
    return out


def heavy_cells(docs: DataFrame, rare, cells: int, least: int) -> np.ndarray:
    """Bits that mark the counters that reach least (see spots). At most MARKS[1] of them."""
    blocks = docs.mapInArrow(_sketched(rare, cells, least), "row int, block int, places binary, counts binary")
    merged = blocks.repartition("row", "block").sortWithinPartitions("row", "block")
    found = written(merged.mapInArrow(_high(cells, least), "row int, block int, n long, places binary"), "phrase-cells")
    bits = 2 * cells
    if cells > 1 << 32:
        many, bits = found.agg(F.sum("n")).first()[0] or 0, MARKS[0]
        while bits < MARKS[1] and bits < 32 * many:
            bits *= 2
    out = np.zeros(bits // 8, np.uint8)
    for r in found.mapInArrow(_marked(cells, bits), "first long, bits binary").toLocalIterator():
        some = np.frombuffer(r["bits"], np.uint8)
        out[r["first"] // 8 :][: len(some)] = some
    return out


def phrase_counts(docs: DataFrame, words: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase and n of all phrases of two to LONGEST words that occur least times or more."""
    spark = docs.sparkSession
    n_words = words.agg(F.sum("n")).first()[0] or 0
    cells = CELLS[n_words * (LONGEST - 1) > CELLS[0] * FILL]
    rare = spark.sparkContext.broadcast(frequent_words(words, least))
    heavy = spark.sparkContext.broadcast(heavy_cells(docs, rare, cells, least))
    blocks = docs.mapInArrow(_candidates(rare, heavy, cells), "lang string, block int, phrases string, counts binary").repartition("lang", "block").sortWithinPartitions("lang", "block")
    out = written(blocks.mapInArrow(_united(least), "lang string, phrase string, n long"), "phrase-counts")
    heavy.unpersist()
    rare.unpersist()
    return out


def collocations(docs: DataFrame, least: int = LEAST, inside: int = INSIDE, first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's phrases of highest score."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = written(docs.mapInArrow(_word_counts, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "word-counts")
    phrases = phrase_counts(docs, words, least).withColumn("ws", F.split("phrase", " "))
    # Each cut's two parts, whose counts are those of words or of phrases that occur as often at least.
    run = lambda a, b: F.array_join(F.slice("ws", a, b), " ")
    cuts = phrases.select("lang", "phrase", F.col("n").alias("a"), "ws", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", run(F.lit(1), F.col("k")).alias("left"), run(F.col("k") + 1, F.size("ws")).alias("right"))
    known = words.unionByName(phrases.select("lang", "phrase", "n"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    exact = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"cast(1000000 as decimal(7, 0)) * {exact('a')} * {exact('a')} div ({exact('l')} * {exact('r')})")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # What lies inside longer phrases that make up most of it.
    longer = phrases.filter(F.size("ws") > 2)
    shorter = F.flatten(F.transform(F.sequence(F.lit(2), F.size("ws") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("ws") - m + 1), lambda i: F.array_join(F.slice("ws", i, m), " "))))
    within = longer.select("lang", F.explode(shorter).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    kept = scored.join(within, ["lang", "phrase"], "left").filter(f"most IS NULL OR 100 * most < {inside} * a")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
    return best.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_mine_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


#: The same over all phrases of all pieces.
OP11_SQL = f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM d),
f AS MATERIALIZED (SELECT lang, phrase, count(*) AS f FROM (
    SELECT lang, unnest(ws) AS phrase FROM p
    UNION ALL SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i : i + 1], ' '))) FROM p
    UNION ALL SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' '))) FROM p) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE NOT contains(phrase, ' ') GROUP BY lang),
c AS MATERIALIZED (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE contains(phrase, ' ') AND f >= {LEAST}),
k AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, len(ws))) AS k FROM c)),
s AS (SELECT k.lang, k.phrase, a, k, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score FROM k
    JOIN f AS x ON x.lang = k.lang AND x.phrase = lp JOIN f AS y ON y.lang = k.lang AND y.phrase = rp
    QUALIFY row_number() OVER (PARTITION BY k.lang, k.phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE len(ws) = 3) GROUP BY ALL),
kept AS (SELECT s.* FROM s LEFT JOIN inside USING (lang, phrase) WHERE most IS NULL OR 100 * most < {INSIDE} * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang)
QUALIFY rank <= {FIRST}"""
