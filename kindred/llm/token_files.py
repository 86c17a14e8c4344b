"""Token ids in ORC files.

Documents are dealt by ranges of their id and sorted, encoded, and written as ORC: ids take integer
run-length encoding, stripes can be read in parallel, and row indexes and Bloom filters on doc_id let a
reader skip what it does not ask for. Offsets are summed up from what the files hold.

Defined results: a null text is empty and has the end id alone; a null id comes first; rows that share an id
stand in the order of their texts' hashes (rows that tie in these too are equal); a very long text is encoded whole,
as one row; an empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_broadcast, shared_path, small, table, written

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END = 2
#: Pieces whose ids a task keeps.
CACHE = 1_000_000
ORC = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000"}
FILE = "doc_id long, part int, seq long, ids array<int>"


#: White space other than spaces and line feeds (looking for each is faster than one pattern); one of these between two other characters.
ODD_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
CUT = re.compile(r"(?<=\S)[ \n](?=\S)")
#: Byte-level models write each byte as a letter: a printable one as itself, the others as those from U+0100 up, in order.
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_others = iter(range(0x100, 0x200))
BYTE_LETTERS = [chr(b if b in PRINTED else next(_others)) for b in range(256)]
SPACE = BYTE_LETTERS[0x20]


def pieces(text: str) -> list[str]:
    """A text cut where no match of the tokenizers' patterns can reach across.

    A single space between two characters other than white space begins a new match, and a single line feed
    there is a match of its own."""
    if not text:
        return []
    doubled = "  " in text or "\n\n" in text or " \n" in text or "\n " in text
    if not (doubled or text[0] in " \n" or text[-1] in " \n" or "\0" in text or any(c in text for c in ODD_SPACE)):
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
    out, at = [], 0
    for m in CUT.finditer(text):
        i = m.start()
        out.append(text[at:i])
        if text[i] == "\n":
            out.append("\n")
        at = i + (text[i] == "\n")
    out.append(text[at:])
    return out


class Encoder:
    """Ids of texts as the tokenizers library gives them for whole texts, each distinct piece encoded once."""

    def __init__(self, path: str = TOKENIZER):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ids: dict[str, bytes] = {}

    def _learn(self, new: Iterable[str]) -> None:
        """A piece of letters alone, with or without a space before them, is one match, and goes to the model directly."""
        tokenize, of, rest = self.tokenizer.model.tokenize, BYTE_LETTERS.__getitem__, []
        for p in new:
            if (p[1:] if p[0] == " " else p).isalpha():
                ids = [t.id for t in tokenize((SPACE + p[1:] if p[0] == " " else p) if p.isascii() else "".join(map(of, p.encode())))]
                self.ids[p] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                rest.append(p)
        for at in range(0, len(rest), 1000):
            part = rest[at : at + 1000]
            for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.ids[p] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit integers."""
        cut = [pieces(t) for t in texts]
        if len(self.ids) > CACHE:
            self.ids.clear()
        known = self.ids
        new = set(chain.from_iterable(cut)).difference(known)
        # A point or comma behind a Latin letter is a match of its own.
        ended = [p for p in new if len(p) > 1 and p[-1] in ".," and p[-2] <= "\u024f" and p[-2].isalpha()]
        new.difference_update(ended)
        new.update({".", ",", *(p[:-1] for p in ended)}.difference(known))
        self._learn(new)
        for p in ended:
            known[p] = known[p[:-1]] + known[p[-1]]
        of = known.__getitem__
        return [b"".join(map(of, ps)) for ps in cut]


#: A worker process keeps its encoders from task to task.
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own, seq, end = encoder(path), 0, np.array([END], "<u4").tobytes()
        for b in small(batches):
            ids = [x + end for x in own.encode([t or "" for t in b.column("text").to_pylist()])]
            at = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in ids], out=at[1:])
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            n = len(ids)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.arange(seq, seq + n)), pa.ListArray.from_arrays(pa.array(at), values)], ["doc_id", "seq", "ids"])
            seq += n

    return run


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER) -> None:
    """The ids of all documents as ORC files at path, in the order of doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    encoded = ordered.mapInArrow(_encoded(tokenizer), "doc_id long, seq long, ids array<int>")
    encoded.select("doc_id", F.spark_partition_id().alias("part"), "seq", "ids").write.options(**ORC).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The ids of some documents; files, stripes and row groups without them are skipped."""
    return read(spark, path).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("ids")
        at, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        crc = [zlib.crc32(values[i:j].tobytes()) for i, j in zip(at, at[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("seq"), pa.array(np.diff(at).astype(np.int64)), pa.array(np.array(crc, np.int64))], ["doc_id", "part", "seq", "n_tokens", "ids_crc32"])


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""
    rows = written(read(spark, path).mapInArrow(_summed, "doc_id long, part int, seq long, n_tokens long, ids_crc32 long"), "token-sums")
    counts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row a part file: the window over all of them is as small as their list.
    starts = counts.select(F.col("part").alias("of"), (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    own = F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return rows.withColumn("own", own).join(bounded_broadcast(starts), F.col("part") == F.col("of")).select("doc_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    write(table(spark, sf_dir, "documents"), path)
    return offsets(spark, path)
