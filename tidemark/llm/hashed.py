"""Hashed terms of texts in flat arrays, and the bounded sample of labelled texts that classifiers are fitted on."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches, steps, texts

#: Number of hashed terms.
TERMS = 1 << 18


@dataclass
class Rows:
    """Terms of row i: ids[starts[i]:starts[i + 1]], with values."""

    starts: np.ndarray
    ids: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.starts))

    def take(self, rows: np.ndarray) -> Rows:
        n = np.diff(self.starts)[rows]
        at = np.repeat(self.starts[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return Rows(np.concatenate([[0], np.cumsum(n)]), self.ids[at], self.values[at])


def term_id(term: str) -> int:
    return zlib.crc32(term.encode()) & (TERMS - 1)


def rows_of(batch: list[str], terms: Callable[[str], dict[str, float]]) -> Rows:
    """Rows of texts; terms with the same hash add up."""
    starts, ids, values = [0], [], []
    for text in batch:
        found: dict[int, float] = {}
        for term, value in terms(text).items():
            i = term_id(term)
            found[i] = found.get(i, 0.0) + value
        ids += found.keys()
        values += found.values()
        starts.append(len(ids))
    return Rows(np.array(starts), np.array(ids, np.int64), np.array(values, np.float32))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, terms, doc_id: str = "doc_id", text: str = "text") -> tuple[Rows, np.ndarray]:
    """Terms and labels of at most ``rows`` labelled documents, the same ones however the tables lie; terms are hashed by the tasks.

    Labels of ids that no document has aren't counted. Of an id with several labels the largest counts, of an id with
    several texts the one with the least hash; null labels and ids are left out.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("label"))
    there = docs.select(F.col(doc_id).alias("id"))
    chosen = known.join(there, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(rows)  # at most ``rows`` ids and labels go to all tasks
    body = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(F.col(doc_id).alias("id"), F.struct(F.xxhash64(body).alias("hash"), body.alias("text")).alias("one")).join(F.broadcast(chosen), "id")
    found = found.groupBy("id", "label").agg(F.min("one").alias("one")).select("label", F.col("one.text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = texts(batch.column("text"))
            for begin, end in steps(map(len, values)):
                r = rows_of(values[begin:end], terms)
                starts = pa.array(r.starts, pa.int32())
                ids = pa.ListArray.from_arrays(starts, pa.array(r.ids.astype(np.int32)))
                weights = pa.ListArray.from_arrays(starts, pa.array(r.values))
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(begin, end - begin), ids, weights], ["label", "ids", "weights"])

    table = in_batches(found, run, "label int, ids array<int>, weights array<float>").toArrow()
    order = np.arange(table.num_rows)
    lists, weights = (table.column(c).combine_chunks() for c in ("ids", "weights"))
    n = np.array([len(x) for x in lists], np.int64)
    flat = Rows(np.concatenate([[0], np.cumsum(n)]), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), weights.flatten().to_numpy(zero_copy_only=False).astype(np.float32))
    # Tasks may end in any order; the fit must not depend on it.
    mark = np.bincount(flat.row, weights=flat.ids * np.float64(0.6180339887498949) % 1.0, minlength=len(flat)) if len(flat) else np.zeros(0)
    y = table.column("label").to_numpy()
    order = np.lexsort((y, mark, n))
    return flat.take(order), y[order]


class Adam:
    """Steps of Adam over arrays that are changed in place; ``decay`` shrinks them with each step."""

    def __init__(self, arrays: list[np.ndarray], rate: float, decay: list[float]):
        self.arrays, self.rate, self.decay = arrays, rate, decay
        self.first = [np.zeros_like(a) for a in arrays]
        self.second = [np.zeros_like(a) for a in arrays]
        self.count = 0

    def step(self, gradients: list[np.ndarray]) -> None:
        self.count += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.count) / (1 - 0.9**self.count)
        for a, g, m, v, d in zip(self.arrays, gradients, self.first, self.second, self.decay):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= scale * m / (np.sqrt(v) + 1e-8) + self.rate * d * a


def _once(rows: Rows) -> np.ndarray:
    mark = np.bincount(rows.row, weights=rows.ids * np.float64(0.6180339887498949) % 1.0, minlength=len(rows))
    _, first = np.unique(np.column_stack([mark, np.diff(rows.starts)]), axis=0, return_index=True)
    return first


def telling(rows: Rows, positive: np.ndarray, least: int) -> np.ndarray:
    """Hashed ids of the terms that ``least`` rows or more have and whose rows' labels differ from the others' by more than the
    most that the log-likelihood ratio of so many terms reaches by chance. Rows with the same terms count once."""
    first = _once(rows)
    rows, positive = rows.take(first), positive[first]
    count = np.bincount(rows.ids, minlength=TERMS).astype(float)
    hit = np.bincount(rows.ids, weights=positive[rows.row].astype(float), minlength=TERMS)
    tested = np.flatnonzero(count >= least)
    n, k, total, positives = count[tested], hit[tested], float(len(rows)), float(positive.sum())

    def part(observed, expected):
        return np.where(observed > 0, observed * np.log(np.maximum(observed, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    ratio = 2 * (
        part(k, n * positives / total)
        + part(n - k, n * (total - positives) / total)
        + part(positives - k, (total - n) * positives / total)
        + part(total - positives - n + k, (total - n) * (total - positives) / total)
    )
    return tested[ratio > 2 * np.log(max(len(tested), 2))]


def _ratio(observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each column's cells."""
    return 2 * np.where(observed > 0, observed * np.log(np.maximum(observed, 1e-12) / np.maximum(expected, 1e-12)), 0.0).sum(axis=0)


def _shifted(logits: np.ndarray, positives: float) -> np.ndarray:
    """Probabilities after a shift of all logits that makes them add up to ``positives``."""
    low, high = -60.0, 60.0
    for _ in range(30):
        middle = (low + high) / 2
        low, high = (middle, high) if sigmoid(logits + middle).sum() < positives else (low, middle)
    return sigmoid(logits + (low + high) / 2)


def pairing(rows: Rows, positive: np.ndarray, kept: np.ndarray, logits: np.ndarray, least: int) -> np.ndarray:
    """Hashed ids of the further terms that, in ``least`` rows or more together with a term of ``kept``, go with labels that
    neither the two terms' odds by themselves explain nor ``logits``, the scores from ``kept`` alone; by more than the most
    that the ratio of so many pairs reaches by chance."""
    first = _once(rows)
    rows, positive, logits = rows.take(first), positive[first].astype(float), logits[first]
    row = rows.row
    by_term = np.argsort(rows.ids, kind="stable")
    edges = np.searchsorted(rows.ids[by_term], np.column_stack([kept, kept + 1]))
    count = np.bincount(rows.ids, minlength=TERMS)
    hit = np.bincount(rows.ids, weights=positive[row], minlength=TERMS)
    total, positives = len(rows), positive.sum()
    open_, pairs, found = np.ones(TERMS, bool), 0, []
    open_[kept] = False
    for a, b in edges:
        having = np.unique(row[by_term[a:b]])
        part, y = rows.take(having), positive[having]
        n = np.bincount(part.ids, minlength=TERMS)
        terms = np.flatnonzero((n >= least) & open_)
        if not len(terms):
            continue
        pairs += len(terms)
        k = np.bincount(part.ids, weights=y[part.row], minlength=TERMS)[terms]
        n, m, h = n[terms], count[terms], hit[terms]
        # Rows with both terms, with the kept one, with the other, with none; positive ones, then the rest.
        size = np.array([n, len(having) - n, m - n, total - len(having) - m + n], float)
        true = np.array([k, y.sum() - k, h - k, positives - y.sum() - h + k])
        cells = np.concatenate([true, size - true])
        # Labels that follow the kept term alone are a special case of odds that add up: where these fit, no pair differs.
        share = np.repeat([(true[:2].sum(0) / size[:2].sum(0)), (true[2:].sum(0) / np.maximum(size[2:].sum(0), 1))], 2, axis=0)
        some = _ratio(cells, np.concatenate([size * share, size * (1 - share)])) > 2 * np.log(max(len(terms), 2))
        scored = np.bincount(part.ids, weights=_shifted(logits[having], y.sum())[part.row], minlength=TERMS)[terms]
        some &= _ratio(np.array([k, n - k]), np.array([scored, n - scored])) > 2 * np.log(max(len(terms), 2))
        found.append((terms[some], cells[:, some]))
    if not found:
        return np.zeros(0, np.int64)
    terms, cells = np.concatenate([t for t, _ in found]), np.concatenate([c for _, c in found], axis=1)
    # With the counts of any two kept, one number moves all cells; it is sought where the odds ratios are equal.
    sign = np.array([1, -1, -1, 1, -1, 1, 1, -1.0])[:, None]
    low, high = -cells[sign[:, 0] > 0].min(axis=0), cells[sign[:, 0] < 0].min(axis=0)
    for _ in range(50):
        middle = (low + high) / 2
        over = (sign * np.log(np.maximum(cells + sign * middle, 1e-12))).sum(axis=0) > 0
        low, high = np.where(over, low, middle), np.where(over, middle, high)
    return np.unique(terms[_ratio(cells, cells + sign * (low + high) / 2) > 2 * np.log(max(pairs, 2))])


def only(rows: Rows, kept: np.ndarray) -> Rows:
    """Rows with the terms ``kept`` (sorted) alone, numbered from 0."""
    to = np.full(TERMS, -1)
    to[kept] = np.arange(len(kept))
    used = to[rows.ids] >= 0
    n = np.bincount(rows.row[used], minlength=len(rows))
    return Rows(np.concatenate([[0], np.cumsum(n)]), to[rows.ids[used]], rows.values[used])


def sums(rows: Rows, per_term: np.ndarray) -> np.ndarray:
    """Sum over each row's terms."""
    return np.bincount(rows.row, weights=per_term, minlength=len(rows))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))
