"""The pipeline on a small table, against its parts."""

import hashlib

import corpus_pipeline
from kindred.llm import bpe
from kindred.llm.common import table

from .helpers import ODD, documents, put
from .test_learnt import made


def test_stages_and_run(spark, tmp_path):
    rows, labels = made(150)
    twin = (500, rows[0][1], "aa", "t", 0)
    leak = (501, rows[1][1][:200] + " new words here to make it another text password=hunter22xyz", "aa", "t", 0)
    docs = documents(spark, [*rows, twin, leak, *ODD])
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    sf = put(spark, tmp_path / "sf", documents=docs, labels=y)
    now, seen = table(spark, sf, "documents"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert after.columns == docs.columns
        seen.append(after)
        now = after
    toxic, dedup, secret, mixed, ids = seen
    bad = {i for i, _, t in labels if t}
    kept = {r.doc_id for r in toxic.collect()}
    assert len(kept & bad) <= 0.1 * len(bad) and kept >= {i for i, _, t in labels if not t}
    left = [r.doc_id for r in dedup.collect()]
    assert 500 not in left or 0 not in left
    texts = {r.doc_id: r.text for r in secret.collect()}
    assert len(texts) == len(set(left)) and (501 not in texts or ("hunter22xyz" not in texts[501] and "[assign]" in texts[501]))
    e = bpe.encoding()
    want = sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in mixed.collect())
    assert sorted(r.decoded_sha256 for r in ids.collect()) == want
    assert all(r.n_tokens == len(e.encode_ordinary(e.decode([int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)]))) for r in ids.collect() if r.n_tokens < 500)
    assert sorted(map(str, corpus_pipeline.run(spark, sf).select("doc_id", "ids_sha256").collect())) == sorted(map(str, ids.select("doc_id", "ids_sha256").collect()))


def test_empty(spark, tmp_path):
    sf = put(spark, tmp_path / "sf", documents=documents(spark, []), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, sf).collect() == []
