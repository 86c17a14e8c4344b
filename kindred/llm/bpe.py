"""Byte-level BPE encoding and decoding around one global shuffle of distinct words.

Texts are exploded into words (matches of the tokenizer's pattern) with their positions. A task keeps the distinct
words of a block of documents once and deals them out by hash, a row a bucket, so that a word's entries from all
blocks meet in one partition, where it is encoded once. The ids go back to the blocks and are put at the words'
positions. A common word adds one entry a block to its bucket, however often it occurs.
Decoding joins the table of the tokens' bytes, as small as the vocabulary, and puts the bytes of each id in a row.

Defined results: a null text is empty and has no ids; rows that repeat or lack an id are encoded each, so no tie
arises; a text longer than a block makes a block of its own; an empty table gives an empty result. Further columns
of the input are ignored.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, small, table
from .token_files import pieces

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Characters of a block, more only if one document has more: larger blocks repeat fewer words, and take more memory.
BLOCK = 32_000_000
#: Pieces of texts whose words, and words whose ids, a task keeps; words of documents that are put together at once.
PIECES, CACHE, AT_ONCE = 200_000, 500_000, 200_000


def ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoding(path: str = RANKS):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


class Block:
    """Documents, the places of their words, and the distinct words by buckets.

    Word i of bucket b has the place i * buckets + b; frequent words come first in their bucket, so most places are small."""

    SCHEMA = "block long, doc_ids array<long>, lengths array<int>, places array<int>, words array<array<string>>"
    TYPES = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.string())))

    def __init__(self, find: Callable[[str], list[str]], buckets: int):
        self.find, self.buckets = find, buckets
        self.doc_ids, self.lengths, self.parts, self.chars = [], [], [], 0
        self.words: dict[str, int] = {}
        self.pieces: dict[str, bytes] = {}

    def add(self, doc_id: int | None, text: str) -> None:
        cut, known, words = pieces(text), self.pieces, self.words
        if len(known) > PIECES:
            known.clear()
        for p in set(cut).difference(known):
            known[p] = np.array([words.setdefault(w, len(words)) for w in self.find(p)], "<u4").tobytes()
        part = b"".join(map(known.__getitem__, cut))
        self.doc_ids.append(doc_id)
        self.lengths.append(len(part) // 4)
        self.parts.append(part)
        self.chars += len(text)

    def row(self, block: int) -> pa.RecordBatch:
        self.pieces.clear()
        numbers = np.frombuffer(b"".join(self.parts), "<u4")
        self.parts.clear()
        place, lists, words = np.empty(len(self.words), np.int32), [[] for _ in range(self.buckets)], list(self.words)
        for i in np.argsort(-np.bincount(numbers, minlength=len(words)), kind="stable").tolist():
            bucket = xxhash.xxh32_intdigest(words[i]) % self.buckets
            place[i] = len(lists[bucket]) * self.buckets + bucket
            lists[bucket].append(words[i])
        values = [block, self.doc_ids, self.lengths, place[numbers], lists]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, self.TYPES, strict=True)], ["block", "doc_ids", "lengths", "places", "words"])


def _blocked(buckets: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, task, k = regex.compile(public_tokenizers.PATTERN).findall, TaskContext.get().partitionId(), 0
        block = Block(find, buckets)
        for b in small(batches):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                block.add(doc_id, text or "")
                if block.chars >= size:
                    yield block.row((task << 32) + k)
                    k += 1
                    block = Block(find, buckets)
        if block.doc_ids:
            yield block.row((task << 32) + k)

    return run


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """counts and ids of the rows' words: all blocks' entries of a word are in one partition, and encoded once."""
        encode, known = encoding(path).encode_ordinary, {}
        for b in small(batches, 8):
            words = b.column("words")
            flat = words.flatten().to_pylist()
            if len(known) > CACHE:
                known.clear()
            for w in set(flat).difference(known):
                known[w] = np.array(encode(w), "<i4").tobytes()
            ids = list(map(known.__getitem__, flat))
            counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            ends = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))])
            upto = np.concatenate([[0], np.cumsum(counts)])
            lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x)) for at, x in ((ends, counts.astype(np.int32)), (upto[ends], np.frombuffer(b"".join(ids), "<i4")))]
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("bucket"), *lists], ["block", "bucket", "counts", "ids"])

    return run


def _numbers(column: pa.ChunkedArray, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


def _documents(doc_ids: pa.Array, ids: np.ndarray, ends: np.ndarray, vocabulary: str) -> pa.RecordBatch:
    """Rows of documents whose ids, one document after the other, end at `ends`."""
    at = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    packed = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.array(4 * np.concatenate([[0], ends]).astype(np.int32)).buffers()[1], pa.py_buffer(ids.astype("<i4", copy=False))])
    names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(ends), np.int8)), pa.array([vocabulary])).dictionary_decode()
    return pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(at, pa.array(ids)), packed, names], ["doc_id", "ids", "packed", "vocabulary"])


def _reassembled(buckets: int, vocabulary: str):
    def run(blocks: pa.Table, found: pa.Table) -> pa.Table:
        """The documents of one block: the ids of its words at the words' positions."""
        out = [_documents(pa.array([], pa.int64()), np.zeros(0, np.int32), np.zeros(0, np.int64), vocabulary)]
        counts = [_numbers(found.column("counts"), i) for i in range(found.num_rows)]
        size = buckets * max(map(len, counts), default=0)
        n, start, before = np.zeros(size, np.int64), np.zeros(size, np.int64), 0
        for i, bucket in enumerate(found.column("bucket").to_pylist()):
            own = slice(bucket, bucket + buckets * len(counts[i]), buckets)
            n[own] = counts[i]
            start[own] = before + np.cumsum(counts[i]) - counts[i]
            before += int(counts[i].sum())
        ids = np.concatenate([np.zeros(0, np.int32), *(_numbers(found.column("ids"), i) for i in range(found.num_rows))])
        for i in range(blocks.num_rows):
            places, doc_ids = _numbers(blocks.column("places"), i), blocks.column("doc_ids")[i].values
            last = np.cumsum(_numbers(blocks.column("lengths"), i), dtype=np.int64)
            a = 0
            while a < len(last):
                before = int(last[a - 1]) if a else 0
                b = max(a + 1, int(np.searchsorted(last, before + AT_ONCE, side="right")))
                p = places[before : last[b - 1]]
                upto = np.cumsum(n[p])
                total = int(upto[-1]) if len(p) else 0
                part = ids[np.repeat(start[p] - upto + n[p], n[p]) + np.arange(total)]
                ends = np.concatenate([[0], upto])[last[a:b] - before]
                out.append(_documents(doc_ids.slice(a, b - a), part, ends, vocabulary))
                a = b
        return pa.Table.from_batches(out)

    return run


def encode(docs: DataFrame, path: str = RANKS, block: int = BLOCK) -> DataFrame:
    """doc_id, ids (array of int), packed (the ids as little-endian unsigned 32-bit integers) and vocabulary of every document."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"bpe_blocks_{uuid.uuid4().hex}"
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_blocked(buckets, block), Block.SCHEMA)
    # Bucketed by block, the blocks need not move again when their ids come back. The table's name is needed for that alone.
    cut.write.format("parquet").option("compression", "zstd").option("maxRecordsPerFile", 4).bucketBy(buckets, "block").option("path", shared_path(spark, name)).saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    words = blocks.select("block", F.posexplode("words").alias("bucket", "words")).filter(F.size("words") > 0)
    found = words.repartition(buckets, "bucket").mapInArrow(_encoded(path), "block long, bucket int, counts array<int>, ids array<int>")
    known = blocks.select("block", "doc_ids", "lengths", "places").groupBy("block").cogroup(found.groupBy("block"))
    return known.applyInArrow(_reassembled(buckets, os.path.basename(path)), "doc_id long, ids array<int>, packed binary, vocabulary string")


def token_bytes(spark: SparkSession, path: str = RANKS) -> DataFrame:
    """vocabulary, token and bytes: a row a token."""
    rows = [(os.path.basename(path), i, bytearray(b)) for b, i in ranks(path).items()]
    return spark.createDataFrame(rows, "vocabulary string, token int, bytes binary")


def decode(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """encoded with decoded (binary) added: the bytes of its ids. Ids run from 0 to the size of the vocabulary."""
    rows = token_bytes(encoded.sparkSession, path).groupBy("vocabulary").agg(F.sort_array(F.collect_list(F.struct("token", F.col("bytes").cast("string").alias("bytes"))))["bytes"].alias("bytes_of"))
    joined = encoded.join(F.broadcast(rows.withColumnRenamed("vocabulary", "of")), F.col("vocabulary") == F.col("of"))
    # Strings carry any bytes; they are joined as they are.
    decoded = F.array_join(F.transform("ids", lambda i: F.col("bytes_of")[i]), "").cast("binary")
    return joined.select(*encoded.columns, decoded.alias("decoded"))


def digest(decoded: DataFrame, *more: str) -> DataFrame:
    return decoded.select("doc_id", *more, F.size("ids").cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_encode_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(decode(encode(table(spark, sf_dir, "documents"))))
