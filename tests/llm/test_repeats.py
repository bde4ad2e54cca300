import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import repeats
from tidemark.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, row int, spans string, _text int"


def brute(rows, length):
    """Every window in order; a window seen before marks its bytes."""
    seen, out = set(), []
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)):
        data = (rows[i][1] or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                gone[p : p + length] = True
            seen.add(window)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((rows[i][0], len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    """Texts that share passages, with edits, copies, runs of one character and periods."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 6)))
    passages = ["".join(word() for _ in range(rng.randint(3, 40))) for _ in range(8)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.15 and texts:
            texts.append(rng.choice(texts))
        elif kind < 0.35 and texts:
            t = rng.choice(texts) or "x"
            at = rng.randrange(len(t))
            texts.append(t[:at] + "#" + t[at + 1 :])
        elif kind < 0.45:
            texts.append("=" * rng.randint(0, 90) + "ab" * rng.randint(0, 40))
        else:
            texts.append("".join(rng.choice(passages) if rng.random() < 0.4 else word() for _ in range(rng.randint(0, 12))))
    return [(i, t, 0, "", 1) for i, t in enumerate(texts)]


CASES = [
    [],
    [(1, None, 0, "", 0), (2, "", 0, "", 0), (3, "short", 0, "", 0), (None, "short", 0, "", 0)],
    [(2, "x" * 300, 0, "", 0), (1, "x" * 100, 0, "", 0), (1, "x" * 100, 0, "", 0), (None, "x" * 40, 0, "", 0)],
    [(7, "the same words " * 5, 0, "", 0), (7, "the same words " * 5, 0, "", 0), (7, "the same words and others", 0, "", 0)],
]


@pytest.mark.parametrize("rows", CASES)
@pytest.mark.parametrize("length", [20, 100])
def test_cases(spark, rows, length):
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = repeats.without_repeats(df, ("n_bytes", "n_removed", "n_spans", "kept_sha256"), length=length)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, length)


@pytest.mark.parametrize("seed,length,gram,classes,size", [(1, 20, 7, 4096, 1 << 20), (2, 20, 9, 2, 64), (3, 33, 11, 3, 500), (4, 8, 2, 1, 100), (5, 64, 20, 1, 1 << 20)])
def test_shared_passages(spark, monkeypatch, seed, length, gram, classes, size):
    """Also with small limits: grams with many runs go by way of Spark, long texts in parts."""
    monkeypatch.setattr(repeats, "CLASSES", classes)
    monkeypatch.setattr(repeats, "SLICE", size)
    rows = corpus(seed)
    got = repeats.without_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), ("n_bytes", "n_removed", "n_spans", "kept_sha256"), length=length, gram=gram)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, length)


def test_hot_passage_and_batches(spark):
    """A passage in every text, between different ones; a group of copies; small Arrow batches cut groups."""
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(150)
    rows = [(i, noise(rng.randint(0, 60)) + passage + noise(rng.randint(0, 60)) if i % 3 else passage * 2, 0, "", 0) for i in range(200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = repeats.without_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4), ("n_bytes", "n_removed", "n_spans", "kept_sha256")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 100)


def test_kept_bytes_and_spans(spark):
    """Spans and kept bytes go together, and a cut may fall into a character."""
    text = "é" * 30 + "-" + "é" * 30
    row = repeats.without_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string"), length=21).first()
    data, at, kept = text.encode(), 0, b""
    for span in row["spans"]:
        kept, at = kept + data[at : span["begin"]], span["end"]
    assert bytes(row["kept"]) == kept + data[at:] and row["n_removed"] == len(data) - len(row["kept"]) > 0


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_suffix_repeats"](spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 100)
