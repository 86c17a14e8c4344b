import hashlib
import re

from kindred.llm import secrets
from kindred.llm.common import shared_path

from .helpers import ODD, documents

KEY = "AKIA" + "ABCDEFGH12345678"
TEXTS = [
    f"password = 'hunter22x' and {KEY} é token=token=abcdef",
    "api_key: short TOKEN=\"0123456789abcdef0123456789abcdef\" passwd:x secret=zzzzzz",
    "ſecret=abcdefgh toKen=abcdefgh",
    "deadbeefdeadbeefdeadbeef" * 2 + " AKIAABC",
    "https://user:pa55word@host/x ghp_" + "a" * 36,
]


def brute(text):
    found = []
    for rank, (kind, pattern, flags, ok) in enumerate((
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
    )):
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "", flags) if ok(m)]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def test_base_spans_and_ledger(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)] + [(50, TEXTS[0], "en", "s", 0)]
    path = shared_path(spark, "ledger")
    found = secrets.scan(documents(spark, rows), path)
    out = {r.doc_id: r for r in secrets.digest(found).collect()}
    for i, t in enumerate(TEXTS):
        own = brute(t)
        assert out[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in own).encode()).hexdigest()
        assert [sum(k == x for k, _, _ in own) for x in secrets.BASE] == [out[i].n_assign, out[i].n_access, out[i].n_hex]
        assert {f"{k}:{s}:{e}" for k, s, e in own} <= set(out[i].spans.split(","))
    assert out[50][1:] == out[0][1:] and "forge:" in out[4].spans and "url:" in out[4].spans
    assert secrets.read_ledger(spark, path).count() == len(TEXTS)
    secrets.scan(documents(spark, [*rows, (60, "new text", "en", "s", 0)]), path).collect()
    assert secrets.read_ledger(spark, path).count() == len(TEXTS) + 1


def test_redaction(spark):
    rows = [(0, TEXTS[0], "en", "s", 0), (1, "clean", "en", "s", 0), (2, None, "en", "s", 0)]
    df = secrets.redact(documents(spark, rows), shared_path(spark, "ledger"))
    out = {r.doc_id: r.text for r in df.collect()}
    assert df.columns == documents(spark).columns
    assert out[1] == "clean" and out[2] is None and KEY not in out[0] and "hunter22x" not in out[0] and "[access]" in out[0]


def test_odd_rows(spark):
    assert secrets.digest(secrets.scan(documents(spark), shared_path(spark, "l"))).count() == len(ODD)
    assert secrets.scan(documents(spark, []), shared_path(spark, "l")).collect() == []
