"""Benchmark decontamination: test items found in documents up to a budget of edited words.

An item of m words may differ by ``k = floor(rate * m)`` inserted, dropped or replaced words. It is split into k + 1
pieces; whatever the k edits hit, one piece stays as it is. So an automaton of all pieces runs over each
document, and only around its hits Myers' bit-parallel algorithm, with words as symbols, takes the distance.
Words are runs of letters, digits and underscores in lower case: case, punctuation and white space don't matter.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import in_batches, with_rows
from tidemark.plans.series import Axis, running, total
from tidemark.session import stage

#: Share of an item's words that may be edited; items of fewer words than SHORT must occur as they are.
RATE, SHORT = 0.2, 5
#: Characters of items that one pass over the documents looks for; a larger benchmark takes more passes.
BLOCK_CHARS = 2_000_000
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def myers(pattern: list[str], text: list[str], anchored: bool = False) -> Iterator[int]:
    """For each end in ``text``: the least edits to make ``pattern`` of what ends there (anchored: of all up to there)."""
    m = len(pattern)
    where: dict[str, int] = {}
    for i, word in enumerate(pattern):
        where[word] = where.get(word, 0) | 1 << i
    mask, top, score = (1 << m) - 1, 1 << (m - 1), m
    plus, minus = mask, 0
    for word in text:
        same = where.get(word, 0)
        vertical = same | minus
        across = (((same & plus) + plus) ^ plus) | same
        more, less = minus | ~(across | plus) & mask, plus & across
        score += bool(more & top) - bool(less & top)
        more, less = (more << 1 | anchored) & mask, less << 1 & mask
        plus, minus = less | ~(vertical | more) & mask, more & vertical
        yield score


class Items:
    """A block of the benchmark, ready to be looked for."""

    def __init__(self, items: list[tuple], rate: float):
        self.items, pieces = [], defaultdict(list)
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            budget = int(rate * len(words)) if len(words) >= SHORT else 0
            cuts = [len(words) * i // (budget + 1) for i in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces[f" {' '.join(words[a:b])} "].append((len(self.items), a))
            self.items.append((item_id, words, budget))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple]:
        """(item_id, distance, item_words, start_word, end_word) of the best match of each item that is within its budget."""
        words = words_of(text)
        if not words or not self.items:
            return []
        hits = defaultdict(set)
        starts = None
        for end, (length, places) in self.automaton.iter(f" {' '.join(words)} "):
            if starts is None:
                starts, at = [], 0
                for word in words:
                    starts.append(at)
                    at += len(word) + 1
            first = bisect_right(starts, end - length + 1) - 1
            for item, offset in places:
                hits[item].add(first - offset)
        found = []
        for item, places in hits.items():
            item_id, pattern, budget = self.items[item]
            best = None
            for a, b in _merged(sorted(places), len(pattern), budget):
                a, b = max(0, a), min(len(words), b)
                near = min(((d, e) for e, d in enumerate(myers(pattern, words[a:b]), a + 1)), default=None)
                if near and near[0] <= budget and (best is None or near < best):
                    best = near
            if best:
                distance, end = best
                back = words[max(0, end - len(pattern) - budget) : end][::-1]
                length = next(n for n, d in enumerate(myers(pattern[::-1], back, True), 1) if d == distance)
                found.append((item_id, distance, len(pattern), end - length, end))
        return found


def _merged(starts: list[int], length: int, budget: int) -> Iterator[tuple[int, int]]:
    """Windows that hold every match that begins within the budget of one of ``starts``."""
    begin = end = None
    for s in starts:
        a, b = s - budget, s + length + budget
        if end is not None and a <= end:
            end = b
            continue
        if end is not None:
            yield begin, end
        begin, end = a, b
    if end is not None:
        yield begin, end


def blocks(benchmark: DataFrame, item_id: str, text: str, limit: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """The items in blocks of ``limit`` characters behind their first item; the driver holds one block at a time.

    Running sums of characters, taken by Spark, number the blocks, so neither a partition nor the benchmark comes to the driver whole.
    """
    rows = with_rows(benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")))
    placed = running(rows, Axis(keys=(), ts="_row", cell=None), _upto=total(F.coalesce(F.length("text"), F.lit(0))))
    number = F.greatest(F.floor((F.col("_upto") - 1) / limit), F.lit(0)).alias("_block")
    items = stage(placed.select("_row", "item_id", "text", number), "items")
    for (block,) in sorted(items.select("_block").distinct().collect()):  # a number for each block
        held = items.filter(F.col("_block") == block).orderBy("_row").select("item_id", "text")
        yield [(row[0], row[1]) for row in held.collect()]


_READY: dict = {}


def _share(spark, block: list[tuple], rate: float):
    """A function that gives the block's automaton, built once in each Python process."""
    shared, token = spark.sparkContext.broadcast(block), uuid.uuid4().hex

    def ready() -> Items:
        if token not in _READY:
            _READY.clear()
            _READY[token] = Items(shared.value, rate)
        return _READY[token]

    return ready


FOUND = ["distance", "item_words", "start_word", "end_word"]


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, limit: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, item_words, start_word, end_word: for each document and item within its budget its best match.

    Of equally good matches the one that ends first. Null and empty texts and items match nothing; documents and
    items that occur repeatedly give a row each. Clean documents have no row.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item_id).alias("item_id")).schema.fields
    schema = T.StructType([rows.schema["doc_id"], *items, *[T.StructField(n, T.IntegerType()) for n in FOUND]])
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(benchmark, item_id, item_text, limit):
        out = out.unionByName(in_batches(rows, _rows(_share(docs.sparkSession, block, rate), schema), schema))
    return out


def _rows(ready, schema: T.StructType):
    types = [f.type for f in to_arrow_schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = ready()
        for batch in batches:
            at, found = [], []
            for i, value in enumerate(batch.column("text")):
                hits = items.find(value.as_py())
                at += [i] * len(hits)
                found += hits
            if not found:
                continue
            ids = batch.column("doc_id").take(pa.array(at))
            rest = [pa.array(values, kind) for values, kind in zip(zip(*found), types[1:])]
            yield pa.RecordBatch.from_arrays([ids, *rest], schema.names)

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, limit: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in which no item is found, as they were.

    Null and empty texts stay, repeated rows stay or go together, whole texts are searched however long; without items
    all rows stay. Between blocks of items the rows left are written, so a task holds one automaton at a time.
    """
    out = docs
    for place, block in enumerate(blocks(benchmark, item_id, item_text, limit)):
        out = in_batches(stage(out, "clean") if place else out, _clean(_share(docs.sparkSession, block, rate), text), docs.schema)
    return out


def _clean(ready, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = ready()
        for batch in batches:
            yield batch.filter(pa.array([not items.find(x.as_py()) for x in batch.column(text)], pa.bool_()))

    return run
