"""Removal of byte strings that occur earlier, by a depth-limited radix sort of sampled suffixes.

Two windows of ``length`` bytes are to meet if they are equal. Of the ``gram``-byte strings inside a window the one with
the smallest hash (leftmost of equals) is its anchor; equal windows have it at the same place, so only suffixes that begin
at an anchor (about one byte in thirty) are sorted, each for the run of windows it anchors. The sort goes by passes, most
significant digit first, and no further than a window reaches:

1. The digit is the gram. Suffixes alone with theirs leave the sort. Those whose whole run of windows has the same bytes
   as an earlier one are settled: every one of their windows occurs earlier.
2. Of what is left, one suffix for each different run of a gram, the digit is the rest of each window: equal groups at
   that depth are exactly the repeated windows, and all but the first of a group go.

Grams and windows are compared by 64 bits of hash each, a window's together with its gram's. A gram whose runs are too
many for one task's memory has its windows sorted by Spark in place of the task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import in_batches, with_rows
from tidemark.session import stage

LENGTH, GRAM = 100, 36
#: Bytes whose hashes are computed at a time.
SLICE = 1 << 20
#: Different runs of a gram up to which one task sorts their windows.
CLASSES = 4096
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A
    x += b
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def _hashes(data: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """For each length the hashes of all strings of so many bytes: two overlapping ones of a power of two."""
    out, size, level = {}, 1, _mix(data.astype(np.uint64), np.full(len(data), 1, np.uint64))
    for n in sorted(lengths):
        while size * 2 <= n:
            level = _mix(level[: max(len(level) - size, 0)], level[size:])
            size *= 2
        most = max(len(data) - n + 1, 0)
        out[n] = _mix(level[:most], level[n - size :][:most])
    return [out[n] for n in lengths]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest (leftmost of equals) among the ``width`` values from each place on."""
    place, size = np.arange(len(values), dtype=np.int32), 1

    def smaller(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(values[right] < values[left], right, left)

    while size * 2 <= width:
        place, size = smaller(place[: len(place) - size], place[size:]), size * 2
    most = len(values) - width + 1
    return smaller(place[:most], place[width - size :][:most]) if width > size else place[:most]


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Runs of windows of texts ``data[starts:ends]``: text, first window, windows, anchor, gram's hash, run's hash."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, empty, empty
    grams, windows = _hashes(data, gram, length)
    anchor = _least(grams, length - gram + 1).astype(np.int64)
    text = np.repeat(np.arange(len(starts)), ends - starts)[: len(anchor)]
    inside = np.flatnonzero(np.arange(len(anchor)) + length <= ends[text])
    if not len(inside):
        return empty, empty, empty, empty, empty, empty
    text, anchor = text[inside], anchor[inside]
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])]))
    count = np.diff(np.append(new, len(inside)))
    first, anchor, text = inside[new], anchor[new], text[new]
    whole = _mix(windows[first], windows[first + count - 1])
    whole = _mix(whole, (anchor - first).astype(np.uint64) * np.uint64(1 << 20) + count.astype(np.uint64))
    return text, first, count, anchor, grams[anchor].view(np.int64), whole.view(np.int64)


def _slices(values: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of texts side by side, of one long text part by part: data, starts, ends, which text, place in it."""
    held, size = [], 0

    def joined(parts):
        sizes = np.array([len(p) for p, _, _ in parts], np.int64)
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join([p for p, _, _ in parts]), np.uint8)
        return data, ends - sizes, ends, np.array([i for _, i, _ in parts]), np.array([a for _, _, a in parts])

    for i, value in enumerate(values):
        # Windows of a part begin in SLICE bytes of it.
        for at in range(0, max(len(value) - length + 1, 0), SLICE):
            part = value[at : at + SLICE + length - 1]
            if held and size + len(part) > SLICE:
                yield joined(held)
                held, size = [], 0
            held.append((part, i, at))
            size += len(part)
    if held:
        yield joined(held)


_SUFFIX = "key long, settled boolean, whole long, doc_id long, row long, first long, windows long, back int"


def _suffixes(length: int, gram: int):
    names = [x.split()[0] for x in _SUFFIX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, rows = [x.as_py() for x in batch.column("text")], batch.column("row").to_numpy()
            for data, starts, ends, which, place in _slices(values, length):
                text, first, count, anchor, key, whole = anchors(data, starts, ends, length, gram)
                if not len(text):
                    continue
                # What a text repeats of itself is settled here: runs that follow each other become one.
                order = np.lexsort((first, whole, key, text))
                same = np.zeros(len(text), bool)
                a, b = order[1:], order[:-1]
                same[a] = (text[a] == text[b]) & (key[a] == key[b]) & (whole[a] == whole[b])
                follows = same[:-1] & (text[1:] == text[:-1]) & (first[1:] == first[:-1] + count[:-1])
                begin = same & np.concatenate([[True], ~follows])
                begins = np.flatnonzero(begin)
                total = np.bincount(np.cumsum(begin)[same] - 1, weights=count[same], minlength=len(begins)).astype(np.int64)
                take = np.concatenate([np.flatnonzero(~same), begins])
                alone = np.arange(len(take)) < len(take) - len(begins)
                at = place[text[take]] + first[take] - starts[text[take]]
                docs = which[text[take]]
                spread = _mix(rows[docs].astype(np.uint64), at.astype(np.uint64)).view(np.int64)
                columns = [
                    pa.array(np.where(alone, key[take], spread)),
                    pa.array(~alone),
                    pa.array(np.where(alone, whole[take], 0)),
                    batch.column("doc_id").take(pa.array(docs)),
                    pa.array(rows[docs]),
                    pa.array(at),
                    pa.array(np.concatenate([count[take[alone]], total])),
                    pa.array(np.where(alone, anchor[take] - first[take], 0).astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


_FOUND = "open boolean, key long, doc_id long, row long, first long, windows long, back int"


def _by_order(df: DataFrame, *ahead: str) -> DataFrame:
    return df.repartition("key").sortWithinPartitions(*ahead, F.col("doc_id").isNull(), "doc_id", "row", F.col("first") + F.col("back"), "first")


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes of a task: later ones of equal runs are settled, the first ones stay open unless alone with their gram."""
    names = [x.split()[0] for x in _FOUND.split(", ")]
    last_key = last_whole = held = None  # ``held``: the only run so far of the last gram

    def emit(rows: pa.RecordBatch, open_: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(open_), *[rows.column(c) for c in names[1:]]], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        key, whole = batch.column("key").to_numpy(), batch.column("whole").to_numpy()
        given = batch.column("settled").to_numpy(zero_copy_only=False)
        goes_on = last_key == key[0]
        new_key = np.concatenate([[not goes_on], key[1:] != key[:-1]])
        new_run = new_key | np.concatenate([[not (goes_on and last_whole == whole[0])], whole[1:] != whole[:-1]])
        new_run &= ~given
        group = np.cumsum(new_key) - new_key[0]
        runs = np.bincount(group, weights=new_run, minlength=group[-1] + 1)
        if goes_on:  # a gram that goes on has one run held back, or several that are out
            runs[0] += 1 if held is not None else 2
        if held is not None and goes_on and runs[0] > 1:
            yield emit(held, np.array([True]))
        if not goes_on or runs[0] > 1 or group[-1]:
            held = None
        out = np.flatnonzero(~new_run | (runs[group] > 1))
        if len(out):
            yield emit(batch.take(pa.array(out)), new_run[out])
        if runs[-1] == 1 and len(waiting := np.flatnonzero(new_run & (group == group[-1]))):
            held = batch.slice(waiting[0], 1)
        last_key, last_whole = key[-1], None if given[-1] else whole[-1]


def _contexts(length: int):
    """The bytes that each open run of a text spans."""

    names = ["key", "doc_id", "row", "first", "windows", "back"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = pa.RecordBatch.from_struct_array(batch.column("runs").flatten())
            texts = [x.as_py() for x in batch.column("text")]
            of = np.repeat(np.arange(batch.num_rows), batch.column("runs").value_lengths().to_numpy())
            for k in range(0, runs.num_rows, SLICE // 64):
                part = runs.slice(k, SLICE // 64)
                spans = zip(of[k:].tolist(), part.column("first").to_pylist(), part.column("windows").to_pylist())
                pieces = pa.array([texts[i][a : a + n - 1 + length] for i, a, n in spans], pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pieces], [*names, "bytes"])

    return run


def _starts(runs: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of the runs: its run, its place before the anchor, its hash."""
    count = runs.column("windows").to_numpy()
    sizes = count + length - 1
    data = np.frombuffer(b"".join(runs.column("bytes").to_pylist()), np.uint8)
    run = np.repeat(np.arange(len(count)), count)
    within = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    (windows,) = _hashes(data, length)
    return run, runs.column("back").to_numpy()[run] - within, windows[(np.cumsum(sizes) - sizes)[run] + within]


def _runs_of(row: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    """Windows, each run's in order, as runs again."""
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (first[1:] != first[:-1] + 1)]))
    count = np.diff(np.append(new, len(row)))
    return pa.RecordBatch.from_arrays([pa.array(row[new]), pa.array(first[new]), pa.array(count)], ["row", "first", "windows"])


def _second_pass(length: int):
    """Runs sorted by gram, then order: the windows of a gram that have an earlier equal."""

    def later(runs: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        run, place, window = _starts(runs, length)
        key = runs.column("key").to_numpy()[run]
        order = np.lexsort((run, window, place, key))
        a, b = order[1:], order[:-1]
        hit = np.sort(a[(key[a] == key[b]) & (place[a] == place[b]) & (window[a] == window[b])])
        if len(hit):
            back = runs.column("back").to_numpy()[run[hit]] - place[hit]
            yield _runs_of(runs.column("row").to_numpy()[run[hit]], runs.column("first").to_numpy()[run[hit]] + back)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count < CLASSES:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key = rows.column("key").to_numpy()
            cut = int(np.argmax(key == key[-1]))  # the last gram may go on
            if cut:
                yield from later(rows.slice(0, cut))
            held, count = [rows.slice(cut)], len(key) - cut
        if count:
            yield from later(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _windows(length: int):
    """One row for each window of a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, CLASSES):
                runs = batch.slice(k, CLASSES)
                of, place, window = _starts(runs, length)
                some = pa.array(of)
                first = runs.column("first").to_numpy()[of] + runs.column("back").to_numpy()[of] - place
                columns = [runs.column("key").take(some), pa.array(place), pa.array(window.view(np.int64)), runs.column("doc_id").take(some)]
                yield pa.RecordBatch.from_arrays([*columns, runs.column("row").take(some), pa.array(first)], ["key", "place", "window", "doc_id", "row", "first"])

    return run


def repeated(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``row``, ``first``, ``windows``: runs of windows that occur earlier; ``rows``: staged, with row, doc_id, text (bytes).

    Earlier: by doc_id (null last), then row, then place in the text.
    """
    gram = max(1, min(gram, length // 2))
    suffixes = in_batches(rows, _suffixes(length, gram), _SUFFIX)
    found = stage(in_batches(_by_order(suffixes, "key", "settled", "whole"), _first_pass, _FOUND), "runs")
    settled = found.filter("not open").select("row", "first", "windows")

    open_ = found.filter("open").drop("open")
    by_row = open_.groupBy("row").agg(F.collect_list(F.struct("key", "doc_id", "row", "first", "windows", "back")).alias("runs"))
    with_text = by_row.join(rows.select("row", "text"), "row").select("runs", "text")
    context = "key long, doc_id long, row long, first long, windows long, back int, bytes binary"
    bytes_ = stage(in_batches(with_text, _contexts(length), context), "contexts")
    large = bytes_.groupBy("key").count().filter(F.col("count") > CLASSES).select("key")
    result = "row long, first long, windows long"
    small = _by_order(bytes_.join(large, "key", "left_anti"), "key")
    settled = settled.unionByName(in_batches(small, _second_pass(length), result))

    # Grams with more runs: their windows are grouped by Spark, with partial aggregation; the first of a group stays.
    windows = in_batches(bytes_.join(large, "key", "left_semi"), _windows(length), "key long, place long, window long, doc_id long, row long, first long")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "first")
    group = ["key", "place", "window"]
    groups = windows.groupBy(*group).agg(F.min(order).alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = windows.withColumn("own", order).join(groups, group).filter(~F.col("own").eqNullSafe(F.col("least")))
    return settled.unionByName(later.select("row", "first", F.lit(1).cast("long").alias("windows")))


RESULTS = {
    "n_bytes": "long", "n_removed": "long", "n_spans": "long", "spans": "array<struct<begin:long,end:long>>",
    "kept": "binary", "kept_sha256": "string",
}


def _removed(length: int, results: tuple[str, ...], keep: list[str]):
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {r: [] for r in results}
            for i, (text, runs) in enumerate(zip(batch.column("_text"), batch.column("_runs"))):
                data = memoryview(text.as_buffer() or b"") if text.is_valid else memoryview(b"")
                begin = end = np.zeros(0, np.int64)
                if runs.is_valid and len(runs.values):
                    first, windows = (x.to_numpy() for x in runs.values.flatten())
                    order = np.argsort(first)
                    begin, end = first[order], np.maximum.accumulate((first + windows - 1 + length)[order])
                    new = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
                    begin, end = begin[new], end[np.append(new[1:] - 1, len(end) - 1)]
                kept = [data[a:b] for a, b in zip(np.append(0, end).tolist(), np.append(begin, len(data)).tolist())]
                values = {
                    "n_bytes": lambda: len(data), "n_removed": lambda: int((end - begin).sum()), "n_spans": lambda: len(begin),
                    "spans": lambda: [{"begin": a, "end": b} for a, b in zip(begin.tolist(), end.tolist())],
                    "kept": lambda: b"".join(kept), "kept_sha256": lambda: _sha256(kept),
                }
                for r in results:
                    out[r].append(values[r]())
            types = {"kept": pa.binary(), "kept_sha256": pa.string(), "spans": kind}
            made = [pa.array(out[r], types.get(r, pa.int64())) for r in results]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *made], [*keep, *results])

    return run


def _sha256(parts: list) -> str:
    digest = hashlib.sha256()
    for p in parts:
        digest.update(p)
    return digest.hexdigest()


def without_repeats(docs: DataFrame, results: tuple[str, ...] = ("n_bytes", "n_removed", "spans", "kept"), doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id and ``results`` of each row: bytes removed because a string of ``length`` bytes that covers them starts earlier.

    Texts count as UTF-8 bytes, null as empty; matches stay within a row. Earlier is a smaller doc_id (null counts as the
    largest), of rows with one id the one read first, then the smaller place. All strings are judged on the input. Texts
    shorter than ``length`` lose nothing; repeated rows lose all that is long enough but in the first; no rows in, no rows
    out. ``kept`` holds bytes, since a cut may fall into a character.
    """
    spark = docs.sparkSession
    # Shuffles of a finished job aren't read again: what the next passes need is staged.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = with_rows(rows, "row")
    runs = repeated(rows, length, gram).groupBy("row").agg(F.collect_list(F.struct("first", "windows")).alias("_runs"))
    joined = rows.join(runs, "row", "left").select("doc_id", F.col("text").alias("_text"), "_runs")
    fields = [T.StructField(r, T._parse_datatype_string(RESULTS[r])) for r in results]
    return in_batches(joined, _removed(length, results, ["doc_id"]), T.StructType([rows.schema["doc_id"], *fields]))
