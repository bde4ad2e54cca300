"""Quality grades by cumulative-link (ordinal logistic) regression over hashed text.

All grades share one weight for each term; ordered thresholds cut the weighted sum into grades:
P(grade <= j) = sigmoid(threshold_j - sum). That gives the expected grade and, for selection, the probability of a
grade or better. It is fitted on a bounded sample of rated documents; the tasks hash their terms and grade all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, in_batches, steps, texts
from tidemark.llm.hashed import TERMS, Adam, Rows, only, rows_of, sample, sigmoid, sums, telling

#: Rated documents of the fit, at most; passes; documents of a step; documents a term must be in.
SAMPLE, EPOCHS, STEP, LEAST = 12_000, 20, 128, 4
RATE, DECAY = 0.02, 0.005
#: Selected are documents that have this grade or a better one with this probability.
WANTED, SURE = 1, 0.5
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def terms(text: str) -> dict[str, float]:
    """Lower-cased words and runs of signs, once each, and five shares, each as a tenth: signs, capitals, column bars,
    tokens seen before, tokens that were there one or two places before."""
    tokens = _TOKEN.findall(text)
    out = dict.fromkeys([t.lower() for t in tokens], 1.0)
    size = max(len(tokens), 1)
    again = sum(map(eq, tokens, tokens[1:])) + sum(map(eq, tokens, tokens[2:]))
    signs = sum(not t[0].isalnum() for t in tokens)
    for name, count in (("signs", signs), ("capitals", sum(map(str.isupper, tokens))), ("bars", tokens.count("|")), ("seen", len(tokens) - len(out)), ("again", again)):
        out[f"#{name} {10 * count // size}"] = 1.0
    return out


@dataclass
class Grades:
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, rows: Rows) -> np.ndarray:
        """P(grade >= j) of each row, a column for each j from 1."""
        total = sums(rows, self.weights[rows.ids] * rows.values)
        return sigmoid(total[:, None] - self.thresholds[None, :])


def _gradient(rows: Rows, grades: np.ndarray, form: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """Of the mean of -log P(grade), by ``form`` (first threshold, logarithms of the steps to the next ones) and weights."""
    cuts = np.cumsum(np.concatenate([form[:1], np.exp(form[1:])]))
    ends = np.concatenate([[-np.inf], cuts, [np.inf]])
    total = sums(rows, w[rows.ids] * rows.values)
    upper, lower = sigmoid(ends[grades + 1] - total), sigmoid(ends[grades] - total)
    p = np.maximum(upper - lower, 1e-9)
    slope = (1 - upper - lower) / len(grades)
    to_cut = np.zeros(len(form) + 2)
    np.add.at(to_cut, grades + 1, -upper * (1 - upper) / p / len(grades))
    np.add.at(to_cut, grades, lower * (1 - lower) / p / len(grades))
    onward = np.cumsum(to_cut[1:-1][::-1])[::-1]
    g_form = onward * np.concatenate([[1.0], np.exp(form[1:])])
    return [g_form, np.bincount(rows.ids, weights=slope[rows.row] * rows.values, minlength=len(w))]


def fit(rows: Rows, grades: np.ndarray, top: int, epochs: int = EPOCHS, seed: int = 11) -> Grades:
    """Grades 0 to ``top``. Without ratings, or with one grade only, the thresholds are the smoothed shares' alone."""
    n = len(grades)
    shares = np.array([((grades < j).sum() + 0.5) / (n + 1) for j in range(1, top + 1)])
    start = np.maximum.accumulate(np.log(shares / (1 - shares)) + 1e-3 * np.arange(top))
    weights = np.zeros(TERMS)
    if n == 0 or grades.min() == grades.max():
        return Grades(weights.astype(np.float32), start)
    kept = np.unique(np.concatenate([telling(rows, grades >= j, LEAST) for j in range(1, top + 1)]))
    rows = only(rows, kept)
    # The first threshold and the logarithms of the steps to the next ones: so they stay in order.
    form = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    w, random = np.zeros(len(kept)), np.random.default_rng(seed)
    adam = Adam([form, w], RATE, [0.0, DECAY])
    for _ in range(epochs):
        order = random.permutation(n)
        for k in range(0, n, STEP):
            part, y = rows.take(order[k : k + STEP]), grades[order[k : k + STEP]]
            adam.step(_gradient(part, y, form, w))
    weights[kept] = w
    return Grades(weights.astype(np.float32), np.cumsum(np.concatenate([form[:1], np.exp(form[1:])])))


def with_grades(docs: DataFrame, model: Grades, wanted: int = WANTED, text: str = "text") -> DataFrame:
    """``docs`` with expected_grade and tail_probability, that of ``wanted`` or better, in place of columns of these names; null counts as empty."""
    docs = docs.drop("expected_grade", "tail_probability")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TERMS weights, whatever the corpus
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = texts(batch.column(names.index(text)))
            found = [shared.value.at_least(rows_of(values[a:b], terms)) for a, b in steps(map(len, values))]
            found = np.concatenate(found) if found else np.zeros((0, len(shared.value.thresholds)))
            columns = [pa.array(found.sum(axis=1)), pa.array(np.ascontiguousarray(found[:, wanted - 1]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, "expected_grade", "tail_probability"])

    schema = docs.withColumns({"expected_grade": F.lit(0.0), "tail_probability": F.lit(0.0)}).schema
    return in_batches(docs, run, schema)


def graded(docs: DataFrame, ratings: DataFrame, top: int = 2, of: int = 5, out: int = 0, doc_id: str = "doc_id", text: str = "text", grade: str = "grade", rows: int = SAMPLE, wanted: int = WANTED, sure: float = SURE) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability, kept for each row of ``docs``.

    ``ratings``: doc_id and ``grade``, 0 (worst) to ``top``; those of ids whose crc32 mod ``of`` is ``out`` aren't learned from.
    Empty and null texts have the grade of no term. Documents are kept that have grade ``wanted`` or better with
    probability ``sure``.
    """
    fitted = fit(*sample(docs, ratings.filter(~held_out(of, out, doc_id)), grade, rows, terms, doc_id, text), top)
    named = docs.select(F.col(doc_id).alias("doc_id"), held_out(of, out, doc_id).alias("held_out"), F.col(text).alias("text"))
    return with_grades(named, fitted, wanted).withColumn("kept", F.col("tail_probability") >= sure).drop("text")


def ratings(labels: DataFrame) -> DataFrame:
    """Grades from two marks: 0 of low quality, 1 of good quality but toxic, 2 of good quality and not toxic."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality").isNotNull(), F.when(F.col("toxic") == 1, 1).otherwise(2))
    return labels.select("doc_id", grade.alias("grade"))
