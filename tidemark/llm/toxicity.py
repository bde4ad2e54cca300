"""Toxicity scores by a factorization machine over hashed terms.

The score's logit is a bias, a weight for each term, and for each pair of terms the product of their factors, summed
in linear time by (sum of factors)^2 - sum of squares. So an insult next to another insult or to the mention of a group counts for
more than either alone. It is fitted on a bounded sample of labelled documents; the tasks hash their terms and score all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, in_batches, steps, texts
from tidemark.llm.hashed import TERMS, Adam, Rows, only, pairing, rows_of, sample, sigmoid, sums, telling

#: Labelled documents of the fit, at most; factors; passes; documents of a step; documents a term must be in.
SAMPLE, FACTORS, EPOCHS, STEP, LEAST = 12_000, 4, 20, 128, 4
RATE, DECAY_WEIGHTS, DECAY_FACTORS = 0.02, 0.005, 0.05
TOXIC = 0.7
#: Letters of the beginnings of words that are terms besides the words.
STEMS = (4, 5)
_WORD = re.compile(r"\w+")


def terms(text: str) -> dict[str, float]:
    """Lower-cased words and the beginnings of longer ones, which inflected forms share; once each."""
    words = {*_WORD.findall(text.lower())}
    return dict.fromkeys([*words, *{w[:n] + "-" for n in STEMS for w in words if len(w) > n}], 1.0)


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, rows: Rows) -> np.ndarray:
        return sigmoid(_logits(rows, self.bias, self.weights, self.factors)[0])


def _logits(rows: Rows, bias: float, weights: np.ndarray, factors: np.ndarray):
    total = bias + sums(rows, weights[rows.ids] * rows.values)
    parts = []
    for f in factors:
        x = f[rows.ids] * rows.values
        s = sums(rows, x)
        total += 0.5 * (s * s - sums(rows, x * x))
        parts.append((x, s))
    return total, parts


def fit(rows: Rows, labels: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Without rows, or with one class only, all scores are that class's smoothed share."""
    kept = telling(rows, labels > 0, LEAST) if 0 < labels.sum() < len(labels) else np.zeros(0, np.int64)
    machine = _fitted(rows, labels, kept, factors, epochs, seed)
    if len(kept):
        logits = _logits(rows, machine.bias, machine.weights, machine.factors)[0]
        more = pairing(rows, labels > 0, kept, logits, LEAST)
        if len(more):
            machine = _fitted(rows, labels, np.union1d(kept, more), factors, epochs, seed)
    return machine


def _gradient(rows: Rows, labels: np.ndarray, bias: np.ndarray, w: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    """Of the mean logistic loss, by bias, weights and factors."""
    logits, parts = _logits(rows, bias[0], w, v)
    error = (sigmoid(logits) - labels) / len(labels)
    each = error[rows.row] * rows.values
    g_v = [np.bincount(rows.ids, weights=each * (s[rows.row] - x), minlength=len(w)) for x, s in parts]
    return [np.array([error.sum()]), np.bincount(rows.ids, weights=each, minlength=len(w)), np.array(g_v)]


def _fitted(rows: Rows, labels: np.ndarray, kept: np.ndarray, factors: int, epochs: int, seed: int) -> Machine:
    """The machine over the terms ``kept``; all others weigh nothing."""
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    bias = np.array([np.log(share / (1 - share))])
    weights, machine = np.zeros(TERMS), np.zeros((factors, TERMS))
    if 0 < labels.sum() < len(labels):
        rows = only(rows, kept)
        random = np.random.default_rng(seed)
        w, v = np.zeros(len(kept)), random.normal(0, 0.01, (factors, len(kept)))
        adam = Adam([bias, w, v], RATE, [0.0, DECAY_WEIGHTS, DECAY_FACTORS])
        for _ in range(epochs):
            order = random.permutation(len(rows))
            for k in range(0, len(order), STEP):
                part, y = rows.take(order[k : k + STEP]), labels[order[k : k + STEP]]
                adam.step(_gradient(part, y, bias, w, v))
        weights[kept], machine[:, kept] = w, v
    return Machine(float(bias[0]), weights.astype(np.float32), machine.astype(np.float32))


def with_score(docs: DataFrame, machine: Machine, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the score of each text, 0 to 1, in place of a column of that name; null and empty texts have that of no term."""
    docs = docs.drop(score)
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # TERMS weights and factors, whatever the corpus
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = texts(batch.column(names.index(text)))
            found = [shared.value.scores(rows_of(values[a:b], terms)) for a, b in steps(map(len, values))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found) if found else np.zeros(0))], [*names, score])

    schema = docs.withColumn(score, F.lit(0.0)).schema
    return in_batches(docs, run, schema)


def toxic_scores(docs: DataFrame, labels: DataFrame, of: int = 3, out: int = 1, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; learned from labels of ids whose crc32 mod ``of`` isn't ``out``.

    Null and empty texts have the score of no term, null ids count as held out by the crc32 of nothing, repeated rows get
    equal scores, very long texts are counted whole. Without labels all scores are the same; no documents, no rows.
    """
    fitted = fit(*sample(docs, labels.filter(~held_out(of, out, doc_id)), label, rows, terms, doc_id, text))
    scored = with_score(docs.select(F.col(doc_id).alias("doc_id"), held_out(of, out, doc_id).alias("held_out"), F.col(text).alias("text")), fitted)
    return scored.withColumn("predicted", (F.col("score") >= TOXIC).cast("int")).drop("text")
