import hashlib
import random
import zlib

import numpy as np

from kindred.llm import bpe, token_files
from kindred.llm.common import shared_path

from .helpers import ODD, documents


def fuzz(n=400, seed=1):
    r = random.Random(seed)
    alphabet = [*" \n\t  .,'sat1é　\x1c!-\x85ßК中😀", "'s", "<|endoftext|>", "lo", "word "]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 16))) for _ in range(n)]


def test_files_hold_what_the_library_encodes(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.TOKENIZER)
    rows = [(3 * i, x, "en", "s", 0) for i, x in enumerate(fuzz())] + ODD
    path = shared_path(spark, "ids")
    token_files.write(documents(spark, rows).repartition(5), path)
    out = sorted(token_files.offsets(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    texts, at = {}, 0
    for i, x, *_ in rows:
        e = np.array([*t.encode(x or "", add_special_tokens=False).ids, token_files.END], "<u4")
        texts.setdefault(i, []).append((len(e), zlib.crc32(e.tobytes())))
    for r in out:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in texts[r.doc_id]
        at += r.n_tokens
    assert token_files.lookup(spark, path, [30]).count() == 1


def test_bpe_is_exact_and_comes_back(spark):
    e = bpe.encoding()
    rows = [(3 * i, x, "en", "s", 0) for i, x in enumerate(fuzz(seed=2))] + ODD
    out = bpe.digest(bpe.decode(bpe.encode(documents(spark, rows).repartition(3), block=500))).collect()
    want = sorted((-1 if i is None else i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()) for i, x, *_ in rows for ids in [e.encode_ordinary(x or "")])
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in out) == want


def test_blocks_words_and_reassembly():
    """The steps by hand: blocks end behind the document that fills them, entries of a word meet, ids go back to their places."""
    import pyarrow as pa
    import regex

    texts = [*fuzz(60, 3), "", "lo " * 3000, *fuzz(60, 4)]  # the long one is larger than a block
    find, rows, block, known = regex.compile(bpe.public_tokenizers.PATTERN).findall, [], bpe.Block(None, 3), {}
    block.find = find
    for i, t in enumerate(texts):
        block.add(i, t)
        if block.chars >= 200 or i == len(texts) - 1:
            rows.append(block.row(len(rows)).to_pylist()[0])
            block = bpe.Block(find, 3)
    assert max(sum(r["lengths"]) for r in rows) >= 3000 and len(rows) > 4
    for r in rows:
        words = [(r["block"], b, ws) for b, ws in enumerate(r["words"]) if ws]
        for b, ws in enumerate(r["words"]):
            assert len(set(ws)) == len(ws) and all(known.setdefault(w, b) == b for w in ws)  # a word's bucket is the same in all blocks
        batch = pa.table({"block": [x[0] for x in words], "bucket": pa.array([x[1] for x in words], pa.int32()), "words": pa.array([x[2] for x in words], pa.list_(pa.string()))}).to_batches()
        found = pa.Table.from_batches(list(bpe._encoded(bpe.RANKS)(iter(batch))))
        out = bpe._reassembled(3, "v")(pa.Table.from_pylist([r], pa.schema(list(zip(["block", "doc_ids", "lengths", "places", "words"], bpe.Block.TYPES, strict=True)))), found)
        e = bpe.encoding()
        for x in out.to_pylist():
            assert x["ids"] == e.encode_ordinary(texts[x["doc_id"]]) and x["packed"] == np.array(x["ids"], "<u4").tobytes()


def test_no_table_is_left(spark):
    bpe.encode(documents(spark)).collect()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bpe_blocks")]


def test_lookup_skips_row_groups(spark):
    """Bloom filters and row indexes are in the files, and the filter on doc_id reaches the scan."""
    import glob

    from pyarrow import orc

    path = shared_path(spark, "ids")
    docs = [(i, "some words", "en", "s", 0) for i in range(0, 30_000, 3)]
    token_files.write(documents(spark, docs).repartition(4), path)
    found = token_files.lookup(spark, path, [33])
    assert [r.doc_id for r in found.collect()] == [33] and token_files.lookup(spark, path, [34]).collect() == []
    assert "EqualTo(doc_id,33)]" in found._jdf.queryExecution().executedPlan().toString()
    files = [orc.ORCFile(f) for f in glob.glob(f"{path}/*.orc")]
    assert files and all(f.row_index_stride == 1000 and f.compression == "ZSTD" for f in files)


def test_empty(spark):
    assert bpe.digest(bpe.decode(bpe.encode(documents(spark, [])))).collect() == []
    path = shared_path(spark, "ids")
    token_files.write(documents(spark, []), path)
    assert token_files.offsets(spark, path).collect() == []
