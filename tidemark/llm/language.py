"""Language identification with language-bitmask n-gram filters.

Each language has a Bloom filter of its frequent letter trigrams. The filters lie side by side: a slot holds one bit
for each language, so the slots of a trigram, combined by AND, give all languages that (seem to) have it at once.
A text's bits are counted for each language; of a count, those that a filter as full as this one gives by
chance are taken off. The language with the largest corrected count is predicted, its share of the trigrams is the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import held_out, in_batches, steps, texts

#: Texts of each language that filters are learned from, about; trigrams of each language; slots; probes of a trigram.
SAMPLE, GRAMS, SLOTS, PROBES = 2000, 16_384, 1 << 18, 3
#: A trigram belongs to a language that has it at this share of its rate in the language that has it most.
SHARE = 0.3
UNKNOWN = "und"


@dataclass(frozen=True)
class Filters:
    """languages, in order; table: slots x words of 64 languages; chance: of a trigram in no language to have its bit."""

    languages: tuple[str, ...]
    table: np.ndarray
    chance: np.ndarray


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def trigrams(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams of lower-cased words with a blank on either side, the text each is of, and whether texts have letters."""
    lowered = [x.lower() for x in batch]
    codes = np.frombuffer("".join(f"\n{x}\n" for x in lowered).encode("utf-32-le", "replace"), np.uint32)
    of = np.repeat(np.arange(len(batch)), [len(x) + 2 for x in lowered])
    letter = _letters()[codes]
    codes = np.where(letter, codes, 0).astype(np.uint64)
    used = letter.copy()
    used[1:] |= letter[:-1]
    used[:-1] |= letter[1:]
    codes, of, letter = codes[used], of[used], letter[used]
    middle = np.flatnonzero(letter)
    shift = np.uint64(21)
    grams = (codes[middle - 1] << shift | codes[middle]) << shift | codes[middle + 1]
    return grams, of[middle], np.bincount(of[middle], minlength=len(batch)) > 0


def _slots(grams: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    x = grams * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    step = (x >> np.uint64(20)) | np.uint64(1)
    for i in range(PROBES):
        yield ((x + np.uint64(i) * step) & np.uint64(slots - 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, values = batch.column("lang").to_pylist(), texts(batch.column("text"))
        for begin, end in steps(map(len, values)):
            known = sorted(set(names[begin:end]))
            lang = np.array([known.index(x) for x in names[begin:end]])
            grams, of, _ = trigrams(values[begin:end])
            for i, name in enumerate(known):
                seen, n = np.unique(grams[lang[of] == i], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def learn(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, grams: int = GRAMS, slots: int = SLOTS) -> Filters:
    """Filters of all languages in ``lang`` (null: not used), from about ``sample`` texts of each, chosen by hash.

    What comes to the driver is at most ``grams`` trigrams of each language. Without labelled rows there are no
    languages, and every text is unknown.
    """
    rows = labelled.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))
    sizes = {x["lang"]: x["count"] for x in rows.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return Filters((), np.zeros((slots, 1), np.uint64), np.zeros(0))
    limit = F.lit(0)
    for name, size in sizes.items():
        limit = F.when(F.col("lang") == name, F.lit(round(min(1.0, sample / size) * 2**20))).otherwise(limit)
    chosen = rows.filter(F.pmod(F.xxhash64("id"), F.lit(2**20)) < limit)
    counts = in_batches(chosen.select("lang", "text"), _count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    of_gram, of_lang = Window.partitionBy("gram"), Window.partitionBy("lang")
    rated = counts.withColumn("rate", F.col("n") / F.sum("n").over(of_lang)).withColumn("most", F.max("rate").over(of_gram))
    ranked = rated.filter(F.col("rate") >= SHARE * F.col("most")).withColumn("rank", F.row_number().over(of_lang.orderBy(F.desc("n"), "gram")))
    best = ranked.filter(F.col("rank") <= grams).select("lang", "gram").toPandas()
    languages = tuple(sorted(sizes))
    filled = np.zeros((slots, -(-len(languages) // 64)), np.uint64)
    for i, name in enumerate(languages):
        own = best.gram[best.lang == name].to_numpy(np.int64).view(np.uint64)
        for at in _slots(own, slots):
            filled[at, i // 64] |= np.uint64(1 << i % 64)
    fill = np.array([(filled[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(languages))])
    return Filters(languages, filled, fill**PROBES)


def scores(batch: list[str], filters: Filters) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    found, best = [], []
    for begin, end in steps(map(len, batch)):
        grams, of, letters = trigrams(batch[begin:end])
        total = np.maximum(np.bincount(of, minlength=end - begin), 1)
        masks = None
        for at in _slots(grams, len(filters.table)):
            masks = filters.table[at] if masks is None else masks & filters.table[at]
        shares = np.zeros((end - begin, max(1, len(filters.languages))))
        for i in range(len(filters.languages)):
            bit = (masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(bool)
            seen = np.bincount(of[bit], minlength=end - begin) / total
            shares[:, i] = np.clip((seen - filters.chance[i]) / max(1 - filters.chance[i], 1e-9), 0, 1)
        first = shares.argmax(axis=1)
        known = letters & bool(filters.languages)
        found += [filters.languages[f] if k else UNKNOWN for f, k in zip(first, known)]
        best.append(np.where(known, shares.max(axis=1), 0.0))
    return found, np.concatenate(best) if best else np.zeros(0)


def with_language(docs: DataFrame, filters: Filters, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score, 0 to 1.

    ``und`` with score 0 for texts that are null or have no letter, and for all if no language was learned. Of equal
    counts the first language in order is taken.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # slots x words, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, values = scores(texts(batch.column(text)), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(values)], [*batch.schema.names, lang_pred, score])

    schema = T.StructType([*docs.schema, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return in_batches(docs, run, schema)


def identify(docs: DataFrame, of: int = 4, out: int = 2, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row; learned from the labelled rows whose id's crc32 mod ``of`` isn't ``out``."""
    filters = learn(docs.filter(~held_out(of, out, doc_id)), doc_id, text, lang)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(of, out, doc_id).alias("held_out"), F.col(text).alias("text"))
    return with_language(rows, filters).drop("text")
