import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import naming
from tidemark.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, kept string, _row int"


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        first = min(known) if known else None
        left = 1
        for i in ids:
            kept = i == first and left == 1
            left -= kept
            out.append((i, first, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


CASES = [
    [],
    [(1, None, "x", 1), (2, "", None, None), (3, " ", "x", 1), (4, "\t\n", "x", 1), (None, None, "x", 1)],
    [(5, "a" * 100, "", 0), (6, "a" * 101, "", 0), (7, "a" * 100, "", 0), (7, "a" * 100, "", 0), (8, "a" * 64, "", 0), (9, "a" * 32, "", 0)],
    [(None, "only", "", 0), (None, "only", "", 0), (3, "abc abd", "", 0), (2, "abc \n abd", "", 0), (1, "abcabd ", "", 0), (1, "other", "", 0)],
    [(i, "hot" * (1 + i % 3) if i % 3 else f"text {i} " + "é𝄞" * i, "", 0) for i in range(300)],
]


@pytest.mark.parametrize("rows", CASES)
@pytest.mark.parametrize("block", [3, 16, 1024])
def test_groups(spark, rows, block):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(naming.exact_groups(docs, block=block)) == brute(rows)


def test_names_are_the_ranks_of_the_keys(spark):
    rows = [(i % 7, i) for i in range(500)]
    named = naming.named(spark.createDataFrame(rows, "key long, at long").repartition(5), ["key"], ["at"], ["at"])
    assert sorted((r.at, r.name) for r in named.collect()) == sorted((a, k) for k, a in rows)


def test_drop_keeps_columns(spark):
    rows = CASES[3]
    docs = spark.createDataFrame(rows, SCHEMA)
    left = naming.drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in left.collect()) == [(False, 1, "abcabd "), (False, 1, "other"), (False, 2, "abc \n abd"), (True, 0, "only")]


def test_a_copy_in_a_real_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = QUERIES["op1_exact_dedup"](spark, sf)
    assert found(got) == brute(rows)
    assert got.filter(F.col("kept")).count() == docs.select(naming.normalised(F.col("text"))).distinct().count()


def test_hash_bits_never_stand_for_texts(spark, monkeypatch):
    monkeypatch.setattr(naming.F, "xxhash64", lambda *columns: F.lit(1).cast("long"))
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    with pytest.raises(Exception, match="same 128 bits"):
        naming.exact_groups(docs).collect()
    same = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    assert {r.group_size for r in naming.exact_groups(same).collect()} == {2}
