import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language
from tidemark.llm.queries import QUERIES

TEXTS = {"aa": "taka kapa paka tapa ", "bb": "milo limo olim molo ", "cc": "sesure resuse suser "}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, (t + t[: i % 15]) * 3, lang, "x") for i in range(60) for lang, t in TEXTS.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_trigrams_against_a_loop():
    batch = ["Ab, c\n", "", "1 2", "éà", "x"]
    grams, of, letters = language.trigrams(batch)
    want = []
    for i, text in enumerate(batch):
        padded = "\0" + "".join(c if c.isalpha() else "\0" for c in text.lower()) + "\0"
        for k, c in enumerate(padded):
            if c != "\0":
                a, b, d = (ord(x) for x in padded[k - 1 : k + 2])
                want.append((a << 42 | b << 21 | d, i))
    assert list(zip(grams.tolist(), of.tolist())) == want
    assert letters.tolist() == [True, False, False, True, True]


def test_counts_are_corrected_for_chance():
    # All slots of one language are set: its count says nothing, and none of it is left.
    table = np.zeros((1 << 10, 1), np.uint64)
    table[:] = 1
    grams, _, _ = language.trigrams(["taka"])
    for at in language._slots(grams, len(table)):
        table[at] |= np.uint64(2)
    filters = language.Filters(("full", "own"), table, np.array([1.0, 0.01]))
    assert language.scores(["taka"], filters)[0] == ["own"]


def test_more_languages_than_bits_of_a_word():
    table = np.zeros((1 << 10, 2), np.uint64)
    grams, _, _ = language.trigrams(["taka"])
    for at in language._slots(grams, len(table)):
        table[at, 1] = np.uint64(1 << 5)
    names = tuple(f"l{i:02d}" for i in range(70))
    found, score = language.scores(["taka"], language.Filters(names, table, np.zeros(70)))
    assert found == ["l69"] and score[0] == 1


def test_predicts_and_covers_edge_cases(spark, docs):
    extra = [(None, "taka kapa", None, "x"), (901, None, "aa", "x"), (902, "", "aa", "x"), (903, "12 ?!", None, "x"), (904, "milo limo " * 30_000, None, "x"), (904, "milo limo " * 30_000, None, "x")]
    all_docs = docs.union(spark.createDataFrame(extra, docs.schema))
    got = {(r.doc_id, r.lang_pred, r.held_out): r.score for r in language.identify(all_docs).collect()}
    assert {k[1] for k in got if k[0] in (901, 902, 903)} == {"und"}
    assert {k[1] for k in got if k[0] == 904} == {"bb"} and {k[1] for k in got if k[0] is None} == {"aa"}
    assert all(0 <= s <= 1 for s in got.values())
    assert all(k[2] == (zlib.crc32(str("" if k[0] is None else k[0]).encode()) % 4 == 2) for k in got)


def test_no_labels_and_no_rows(spark, docs):
    none = language.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}
    assert language.identify(docs.limit(0)).count() == 0


def test_held_out_accuracy_on_whole_texts(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op9_language_filters"](spark, sf).join(docs, "doc_id").filter("held_out").toPandas()
    assert len(got) > 200 and (got.lang == got.lang_pred).mean() > 0.97
