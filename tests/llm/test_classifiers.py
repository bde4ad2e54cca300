import random
import zlib

import numpy as np
import pytest

from tidemark.llm import hashed, quality, toxicity
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def rows_of(texts, terms=toxicity.terms):
    return hashed.rows_of(texts, terms)


def test_logits_against_all_pairs():
    r = np.random.default_rng(1)
    rows = rows_of(["a bb ccc", "", "bb dddddd a", "x"])
    w, v = r.normal(size=hashed.TERMS), r.normal(size=(3, hashed.TERMS))
    total, _ = toxicity._logits(rows, 0.5, w, v)
    for i in range(len(rows)):
        ids = rows.ids[rows.starts[i] : rows.starts[i + 1]]
        pairs = sum(v[:, a] @ v[:, b] for k, a in enumerate(ids) for b in ids[:k])
        assert total[i] == pytest.approx(0.5 + w[ids].sum() + pairs)


def test_machine_learns_a_pair_that_linear_weights_miss():
    r = random.Random(4)
    texts, labels = [], []
    for _ in range(1500):  # either word alone is harmless
        a, b = r.random() < 0.5, r.random() < 0.5
        words = [f"w{r.randrange(300)}" for _ in range(12)] + ["grob"] * a + ["gruppe"] * b
        r.shuffle(words)
        texts.append(" ".join(words))
        labels.append(int(a and b))
    machine = toxicity.fit(rows_of(texts), np.array(labels), epochs=40)
    scores = machine.scores(rows_of(["grob und gruppe", "grob allein", "gruppe allein", ""]))
    assert scores[0] > 0.9 and (scores[1:] < 0.2).all()


@pytest.mark.parametrize("labels", [[], [1, 1, 1], [0, 0]])
def test_fit_of_few_or_one_class(labels):
    rows = rows_of(["a"] * len(labels))
    score = toxicity.fit(rows, np.array(labels, np.int64)).scores(rows_of(["", "a"]))
    assert ((0 < score) & (score < 1)).all()
    grades = quality.fit(rows, np.array(labels, np.int64), 2).at_least(rows_of(["", "a"], quality.terms))
    assert ((0 < grades) & (grades < 1)).all() and (grades[:, 0] >= grades[:, 1]).all()


def test_thresholds_are_ordered_and_grades_rise():
    r = random.Random(2)
    texts, grades = [], []
    for _ in range(1500):
        g = r.randrange(3)
        texts.append(" ".join(r.choices(["good", "fine", "nice"][: g + 1] if g else ["bad", "poor"], k=3) + [f"w{r.randrange(200)}"]))
        grades.append(g)
    model = quality.fit(rows_of(texts, quality.terms), np.array(grades), 2, epochs=30)
    assert model.thresholds[0] < model.thresholds[1]
    p = model.at_least(rows_of(["bad poor", "good fine", "good fine nice nice"], quality.terms))
    assert p.sum(axis=1)[0] < p.sum(axis=1)[1] < p.sum(axis=1)[2]


def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    got = QUERIES["op4_toxicity_machine"](spark, SF).join(labels, "doc_id", "left").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    test = got[got.held_out & got.toxic.notna()]
    assert test[test.toxic == 0].predicted.mean() < 0.01 and test[test.toxic == 1].predicted.mean() > 0.75


def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = QUERIES["op8_ordinal_quality"](spark, SF).join(quality.ratings(labels), "doc_id", "left").toPandas()
    assert got.expected_grade.between(0, 2).all() and got.tail_probability.between(0, 1).all()
    test = got[got.held_out & got.grade.notna()]
    assert test[test.grade == 2].kept.mean() > 0.99 and test[test.grade == 0].kept.mean() < 0.1
    assert test.groupby("grade").expected_grade.mean().is_monotonic_increasing


def test_edge_rows(spark):
    rows = [(None, None, 1), (1, "", 1), (1, "", 1), (2, "idiot " * 100_000, 1), (3, "fine words", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (2, 1, 1), (None, 1, 1), (3, None, None), (77, 0, 0)], "doc_id long, toxic int, quality int")
    for some in (labels, labels.limit(0)):
        got = toxicity.toxic_scores(docs, some)
        assert sorted((x.doc_id for x in got.collect()), key=str) == sorted((x[0] for x in rows), key=str)
        got = quality.graded(docs, quality.ratings(some))
        assert got.count() == len(rows)
        assert toxicity.toxic_scores(docs.limit(0), some).count() == quality.graded(docs.limit(0), quality.ratings(some)).count() == 0


def test_pair_with_a_common_word_that_is_neutral_alone():
    r = random.Random(6)
    texts, labels = [], []
    for i in range(12_000):  # "gruppe" is in 600 rows, toxic in 16 of them more than by chance
        toxic = i < 16 or i >= 48 and r.random() < 0.03
        words = [f"w{r.randrange(2000)}" for _ in range(12)] + [f"schimpf{r.randrange(6)}"] * (toxic and i >= 48)
        words += ["grob", "gruppe"] if i < 16 else ["grob"] if i < 48 else ["gruppe"] if i < 632 else []
        texts.append(" ".join(words))
        labels.append(int(toxic))
    rows, labels = rows_of(texts), np.array(labels)
    kept = hashed.telling(rows, labels > 0, toxicity.LEAST)
    assert hashed.term_id("grob") in kept and hashed.term_id("gruppe") not in kept
    scores = toxicity.fit(rows, labels).scores(rows_of(["grob und gruppe", "grob allein", "gruppe allein", ""]))
    assert scores[0] > 0.9 and (scores[1:] < 0.2).all()


def steps_of(loss, arrays, gradients, at, size=1e-6):
    """Central differences of ``loss`` at some places of each array against its gradient."""
    for array, gradient in zip(arrays, gradients):
        flat = array.reshape(-1)
        for i in at(flat.size):
            old = flat[i]
            flat[i] = old + size
            up = loss()
            flat[i] = old - size
            down = loss()
            flat[i] = old
            assert (up - down) / (2 * size) == pytest.approx(gradient.reshape(-1)[i], abs=1e-7)


def test_gradients_against_differences():
    r = np.random.default_rng(8)
    words = [f"w{i}" for i in range(20)]
    texts = [" ".join(r.choice(words, 6)) for _ in range(40)]
    at = lambda n: r.choice(n, min(n, 15), replace=False)

    rows = rows_of(texts)
    kept = np.unique(rows.ids)
    rows, y = hashed.only(rows, kept), r.integers(0, 2, 40)
    bias, w, v = np.array([0.3]), r.normal(size=len(kept)), r.normal(size=(3, len(kept)))
    signs = 2 * y - 1
    loss = lambda: np.log1p(np.exp(-signs * toxicity._logits(rows, bias[0], w, v)[0])).mean()
    steps_of(loss, [bias, w, v], toxicity._gradient(rows, y, bias, w, v), at)

    rows = rows_of(texts, quality.terms)
    kept = np.unique(rows.ids)
    rows, y = hashed.only(rows, kept), r.integers(0, 3, 40)
    form, w = np.array([-0.4, 0.2]), r.normal(size=len(kept)) * 0.3

    def likelihood():
        cuts = np.concatenate([[-np.inf], np.cumsum(np.concatenate([form[:1], np.exp(form[1:])])), [np.inf]])
        total = hashed.sums(rows, w[rows.ids] * rows.values)
        return -np.log(hashed.sigmoid(cuts[y + 1] - total) - hashed.sigmoid(cuts[y] - total)).mean()

    steps_of(likelihood, [form, w], quality._gradient(rows, y, form, w), at)


def test_sample_does_not_depend_on_the_layout(spark):
    """Ids in several copies and with several texts, labels of ids that no document has: one text an id, wherever rows lie."""
    rows = [(i, f"word{i} common{i % 7} {'bad' if i % 3 else 'good'}" if c < 3 else f"other{i}") for i in range(200) for c in range(5)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for n in (1, 3, 7):
        terms, y = hashed.sample(docs.repartition(n), labels, "toxic", 100, toxicity.terms)
        assert len(terms) == len(y) == 100
        found.append((terms.starts.tolist(), terms.ids.tolist(), y.tolist()))
        scores = toxicity.toxic_scores(docs.repartition(n), labels, rows=100).select("doc_id", "score").distinct().toPandas()
        found[-1] += (sorted(map(tuple, scores.to_numpy().tolist())),)
    assert found[0] == found[1] == found[2]


def test_columns_of_the_same_name_are_replaced(spark):
    docs = spark.createDataFrame([("a", "x", 5.0)], "text string, score string, Expected_Grade double")
    machine = toxicity.fit(rows_of([]), np.zeros(0, np.int64))
    assert toxicity.with_score(docs, machine).columns == ["text", "Expected_Grade", "score"]
    grades = quality.fit(rows_of([], quality.terms), np.zeros(0, np.int64), 2)
    assert quality.with_grades(docs, grades).columns == ["text", "score", "expected_grade", "tail_probability"]
