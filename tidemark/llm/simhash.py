"""Near-duplicate detection on SimHash fingerprints, compared bit-sliced.

Candidates: the 64 bits are cut into parts; two fingerprints within the radius agree on all parts but ``radius`` of
them, so each choice of the others is a key and pairs within the radius meet under at least one key. More
parts mean longer keys; the number of distinct fingerprints decides, so that a key has few of them on average.
Keys that have many all the same are cut into cells, and each pair of cells is a block of its own: no block is
larger than two cells, and none is left out.

Within blocks bits are stored vertically: word w of plane j holds bit j of 64 fingerprints. A fingerprint is held
against 64 others at a time by adding the differing planes into carry-save counters; once all 64 exceed the
radius, they are dropped. Linked members get the smallest member of their group, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, in_batches, with_rows
from tidemark.llm.components import stars
from tidemark.session import stage

RADIUS = 4
WORDS = 4
SEED = 42
#: Fingerprints of a cell; keys with more are cut.
CELL = 4096
#: Distinct fingerprints that a key should have on average, at most.
MEAN = 64
#: Blocks are compared together up to so many rows, and so many words of 64 at a time.
ROWS, LANES = 1 << 16, 1 << 14
FULL = np.uint64(2**64 - 1)


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """A bit is set if over half the shingles' hashes have it; no word: 0; fewer than ``words``: one shingle."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(tokens) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), ROWS):
        part = zip(starts[k : k + ROWS], ends[k : k + ROWS])
        hashes = np.array([digest(joined[a:b], seed) for a, b in part], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts), bitorder="little").tobytes(), "little")


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(x.as_py() or b"", words, seed) for x in batch.column(batch.num_columns - 1)]
            fp = pa.array(np.array(values, np.uint64).view(np.int64))
            columns = [*batch.columns[:-1], fp]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "fp"])

    return run


def fingerprints(docs: DataFrame, ids: str, text: str, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """The columns ``ids`` (with types, as in a schema) and ``fp``, the fingerprint's 64 bits as a long."""
    names = [x.split()[0] for x in ids.split(",")]
    rows = docs.select(*names, F.col(text).cast("binary").alias("_text"))
    return in_batches(rows, _fingerprints(words, seed), f"{ids}, fp long")


def keys_for(distinct: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of the keys: all choices of ``parts - radius`` parts out of so many that keys are long enough."""
    parts = radius + 1
    while distinct > MEAN * 2 ** (64 * (parts - radius) / parts) and parts < 4 * radius:
        parts += 1
    edges = [round(64 * k / parts) for k in range(parts + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(choice) for choice in combinations(masks, parts - radius)]


def links(fps: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """a, b with a > b: links (some by way of others) that connect what is within ``radius``; ``fps``: distinct fp."""
    masks = keys_for(fps.count(), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    choices = F.array(*[F.struct(F.lit(i).alias("key"), F.lit(m).cast("long").alias("mask")) for i, m in enumerate(signed)])
    keyed = fps.select("fp", F.explode(choices).alias("k"))
    keyed = keyed.select("fp", F.col("k.key").alias("key"), F.col("fp").bitwiseAND(F.col("k.mask")).alias("value"))
    sizes = keyed.groupBy("key", "value").count().filter(F.col("count") > cell)
    cells = stage(sizes.select("key", "value", F.ceil(F.col("count") / cell).cast("int").alias("cells")), "cells")
    # A key of many cells is rare; Spark broadcasts their table if its files are small, else joins by key.
    cut = keyed.join(cells, ["key", "value"], "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int")
    cut = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    block = ["key", "value", "low", "high"]
    blocks = cut.select("key", "value", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    sorted_blocks = blocks.repartition(*block).sortWithinPartitions(*block, "fp")
    return in_batches(sorted_blocks, _compare(radius), "a long, b long").distinct()


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def linked(rows: np.ndarray) -> pa.RecordBatch:
            new = np.any(rows[1:, :4] != rows[:-1, :4], axis=1)
            starts = np.concatenate([[0], np.flatnonzero(new) + 1])
            a, b = grouped(rows[:, 4].view(np.uint64), starts, radius)
            fp = rows[:, 4]
            a, b = fp[a], fp[b]
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

        for batch in batches:
            held.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            count += batch.num_rows
            if count < ROWS:
                continue
            rows = np.concatenate(held)
            last = np.flatnonzero(np.any(rows[:, :4] != rows[-1, :4], axis=1))
            cut = last[-1] + 1 if len(last) else 0  # the last block may go on
            if cut:
                yield linked(rows[:cut])
            held, count = [rows[cut:]], len(rows) - cut
        if count:
            yield linked(np.concatenate(held))

    return run


def grouped(fps: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Members and the smallest member (by place) each is connected with; blocks begin at ``starts``."""
    size = np.diff(np.append(starts, len(fps)))
    words = -(-size // 64)
    base = np.cumsum(words) - words
    block = np.repeat(np.arange(len(starts)), size)
    within = np.arange(len(fps)) - starts[block]
    slot = base[block] * 64 + within
    padded = np.zeros(words.sum() * 64, np.uint64)
    padded[slot] = fps
    place = np.full(len(padded), -1, np.int64)
    place[slot] = np.arange(len(fps))
    pack = lambda bits: np.packbits(bits.reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel()
    planes = [pack(((padded >> np.uint64(j)) & np.uint64(1)).astype(np.uint8)) for j in range(64)]
    valid = pack((place >= 0).astype(np.uint8))
    # Each member against its own word and the later ones of its block; a block of one has nothing to compare.
    mine = base[block] + within // 64
    todo = np.where(size[block] > 1, base[block] + words[block] - mine, 0)
    ends = np.cumsum(todo)
    label = np.arange(len(fps))
    begin = 0
    while begin < len(fps):
        before = ends[begin - 1] if begin else 0
        end = max(int(np.searchsorted(ends, before + LANES, "right")), begin + 1)
        n = todo[begin:end]
        member = np.repeat(np.arange(begin, end), n)
        word = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + mine[member]
        a, b = _near(fps, planes, valid, member, word, radius)
        _connect(label, a, place[b])
        begin = end
    changed = np.flatnonzero(label != np.arange(len(fps)))
    return changed, label[changed]


def _near(fps, planes, valid, member, word, radius: int):
    """Pairs (member, padded place) within the radius, by carry-save counters of which the last one stays set."""
    bits = (radius + 1).bit_length()
    over, counts = ~valid[word], [np.zeros(len(word), np.uint64) for _ in range(bits)]
    own = fps[member]
    for j in range(64):
        carry = planes[j][word] ^ (np.uint64(0) - ((own >> np.uint64(j)) & np.uint64(1)))
        for i in range(bits):
            counts[i], carry = counts[i] ^ carry, counts[i] & carry
        over |= carry
        # Over once the counter shows radius + 1; it stays so, hence no other value need be looked at.
        reached = np.full(len(word), FULL)
        for i in range(bits):
            reached &= counts[i] if (radius + 1) >> i & 1 else ~counts[i]
        over |= reached
        if j % 8 == 7:
            alive = over != FULL
            if alive.sum() < 0.8 * len(alive):
                member, word, own, over = member[alive], word[alive], own[alive], over[alive]
                counts = [c[alive] for c in counts]
                if not len(word):
                    break
    hits = ~over
    some = np.flatnonzero(hits)
    lane, bit = np.nonzero(np.unpackbits(hits[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return member[some][lane], word[some][lane] * 64 + bit


def _connect(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of a and b; labels are places of group members that lead to the smallest one."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label[:] = further


def _labelled(fps: DataFrame, radius: int, cell: int) -> DataFrame:
    """``fps`` (staged) with ``root``, which the rows of a component share."""
    distinct = stage(fps.select("fp").distinct(), "fingerprints")
    star = stars(links(distinct, radius, cell))
    rooted = distinct.join(star, distinct.fp == star.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return fps.join(rooted, "fp")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id (the smallest doc_id that can be reached).

    Null and empty texts have fingerprint zero and are linked like any other. Rows with a null id are labelled too; a
    component that has no other gets null. Repeated rows get equal results.
    """
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    fps = stage(fingerprints(ids, "doc_id long", "text"), "documents")
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = stage(_labelled(firsts, radius, cell), "roots")
    roots = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = rooted.join(roots, "root").select("fp", "component_id")
    out = fps.join(by_fp, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """One row of each component, that with the smallest id (null last), with all its columns as they were."""
    row = fresh(docs, "_row")
    rows = with_rows(docs, row)
    ids = rows.select(F.col(row).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    fps = stage(fingerprints(ids, "row long, doc_id long", "text"), "documents")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    firsts = fps.groupBy("fp").agg(best.alias("best"))
    roots = _labelled(stage(firsts, "firsts"), radius, cell).groupBy("root").agg(F.min("best").alias("best"))
    return rows.join(roots.select(F.col("best.row").alias(row)), row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
