import hashlib
import re

import pytest

from tidemark.llm import secrets
from tidemark.session import new_path

KINDS = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I, 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 0, 20),
    "hex": (r"[0-9a-f]+", 0, 0, 24),
}


def brute(text):
    out = []
    for order, (kind, (pattern, flags, group, least)) in enumerate(KINDS.items()):
        out += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text or "", flags) if len(m[group]) >= least]
    return sorted(out)


TEXTS = [
    None,
    "",
    "nothing here",
    "password=short token = abcdef",
    "secret=token = abcdefgh API_KEY:'x1x2x3x4' apikey\"=\"zzzzzzz\"",
    "é𝄞 Passwd :  aa.bb-cc+dd/ee== end",
    "AKIA" + "A1" * 8 + " AKIAAKIA" + "Z" * 11 + " AKIA" + "0" * 15,
    "f" * 23 + " " + "a0" * 12 + "g" + "0" * 30,
    "token==abcdef token=:abcdef secret = 'AKIA" + "B" * 20 + "'",
    "𝄞" * 5 + " ".join(f"token={i:06d}" for i in range(3000)),
]


def test_spans_against_a_loop(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "x"), (None, TEXTS[5], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, blob string")
    got = secrets.digests(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(TEXTS[5 if r.doc_id is None else r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert r.spans == text and r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(o == i for _, o, _, _ in want) for i in range(3))


def test_more_kinds_stand_beside_the_base_ones(spark):
    text = "-----BEGIN RSA PRIVATE KEY----- token=abcdefg eyJhbGciOiJI.eyJzdWIiOiIx.sig_-1"
    r = secrets.digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.spans == "pem:0:31,assign:32:45,jwt:46:78" and r.n_assign == 1
    assert r.base_sha256 == hashlib.sha256(b"assign:32:45").hexdigest()


@pytest.mark.parametrize("small", [0, 100_000])
def test_only_unseen_pairs_are_scanned(spark, monkeypatch, small):
    monkeypatch.setattr(secrets, "SMALL", small)
    ledger = new_path(spark, "ledger")
    book = secrets.Ledger(ledger)
    first = spark.createDataFrame([("a", 1, "token=abcdef"), ("b", 1, "token=abcdef"), ("c", 1, "plain")], "path string, version int, text string")
    second = spark.createDataFrame([("a", 2, "token=ghijkl"), ("b", 2, "token=abcdef")], "path string, version int, text string")
    secrets.scan(first, ["path", "version"], ledger=ledger, rules=secrets.BASE)
    assert book.scanned(spark).count() == 2 * len(secrets.BASE)
    got = secrets.scan(first.union(second), ["path", "version"], ledger=ledger, rules=secrets.BASE).collect()
    assert book.scanned(spark).count() == 3 * len(secrets.BASE)
    assert {(r.path, r.version, len(r.found)) for r in got} == {("a", 1, 1), ("b", 1, 1), ("c", 1, 0), ("a", 2, 1), ("b", 2, 1)}
    # A new version of one rule is scanned alone, and only its findings count.
    changed = secrets.Rule("hex", 2, r"[0-9a-f]{6,}", 0, 6)
    rules = (secrets.BASE[0], changed)
    got = secrets.scan(second, ["path"], ledger=ledger, rules=rules).collect()
    assert book.scanned(spark).filter("kind = 'hex' and version = 2").count() == 2
    assert sorted((r.path, [f.kind for f in r.found]) for r in got) == [("a", ["assign"]), ("b", ["assign", "hex"])]


def test_a_run_that_broke_off_is_done_again(spark):
    ledger = new_path(spark, "ledger")
    docs = spark.createDataFrame([("a", "token=abcdef")], "path string, text string")
    blob = docs.select(secrets.address(docs.text).alias("blob"))
    blob.selectExpr("blob", "'assign' kind", "1 version", "0L begin", "12L end").write.parquet(f"{ledger}/findings/broken")
    assert len(secrets.scan(docs, ["path"], ledger=ledger).first().found) == 1


def test_no_rows(spark):
    assert secrets.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
