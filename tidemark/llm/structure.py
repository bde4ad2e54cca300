"""Repair of conversation structure by a square-root checkpointed dynamic programme.

A repaired conversation has role initials ``(s?(ua)+)?``. Rows are kept, given another role, deleted, or new ones are
put in, at the least cost; of edit sequences that cost the same the ASCII-least is taken. The programme knows four
states: nothing yet, after a system row, after a user row, after an assistant row. For each state and row there is a
least cost to the end of the conversation. These vectors are kept at checkpoints only, one for each block of about the
square root of the longest conversation: a block first gives the least costs from any state before it to any state after
it, from which the vectors at all checkpoints follow, last to first. Then each block's own vectors are computed again,
and its edits are read off walking forward: at each row the least letter that keeps to the least cost.

A conversation with a great part of all rows is thus spread over tasks by its blocks, and what comes together in one
task for it is a row for each block. Only a digest over its repaired rows has to read them in order, batch by batch.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches
from tidemark.session import stage

# What an edit costs, and what the edits are called.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
EDITS = "DKR"
SPACES = " \t\n\x0b\x0c\r"
#: Rows of a block, at least; rows of blocks that are computed side by side.
LEAST, SIDE = 64, 1 << 18
FAR = 1 << 60
#: State after an inserted row; after a kept row of initial s, u, a (-1: not allowed); costs of ending in a state.
AFTER_INSERT = np.array([2, 2, 3, 2])
AFTER_KEEP = {"s": [1, -1, -1, -1], "u": [2, 2, -1, 2], "a": [-1, -1, 3, -1]}
END = np.array([0, 2 * INSERT, INSERT, 0])
#: Rows as the programme sees them: role initial (o: any other), in upper case if truncated; x: to be deleted.
CODES = "suaoSUAOx"


def _steps() -> np.ndarray:
    """Least cost of a row of each code from each state to each state, rows inserted ahead of it included."""
    insert = np.full((4, 4), FAR)
    for s in range(4):
        at, cost = s, 0
        for _ in range(3):
            insert[s, at] = min(insert[s, at], cost)
            at, cost = AFTER_INSERT[at], cost + INSERT
    out = np.full((len(CODES), 4, 4), FAR)
    for k, code in enumerate(CODES):
        for s in range(4):
            row = np.full(4, FAR)
            row[s] = DELETE
            if code != "x":
                more = TRUNCATED if code.isupper() else 0
                row[AFTER_INSERT[s]] = min(row[AFTER_INSERT[s]], REROLE + more)
                kept = AFTER_KEEP.get(code.lower(), [-1] * 4)[s]
                if kept >= 0:
                    row[kept] = min(row[kept], more)
            for before in range(4):
                out[k, before] = np.minimum(out[k, before], insert[before, s] + row)
    return np.minimum(out, FAR)


STEPS = _steps()
KEPT = np.array([AFTER_KEEP.get(c.lower(), [-1] * 4) if c != "x" else [-1] * 4 for c in CODES])
MORE = np.array([TRUNCATED if c.isupper() else 0 for c in CODES])
_CODE = np.zeros(128, np.int64)
_CODE[[ord(c) for c in CODES]] = np.arange(len(CODES))


class Side:
    """Blocks side by side, the longest first: at each place the blocks that reach it are the first ones."""

    def __init__(self, blocks: Sequence[str]):
        sizes = np.array([len(b) for b in blocks], np.int64)
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.longest = int(sizes.max(initial=0))
        self.codes = np.zeros((len(blocks), self.longest), np.int64)
        for i, b in enumerate(self.order):
            self.codes[i, : sizes[b]] = _CODE[np.frombuffer(blocks[b].encode(), np.uint8)]
        self.active = np.searchsorted(-self.sizes, -np.arange(self.longest), "left")

    def costs(self, ends: np.ndarray, keep: bool) -> np.ndarray:
        """Least costs from each state ahead of the blocks (or, ``keep``, of each row) to ``ends``, the costs after them."""
        now = ends[self.order].copy()
        kept = np.zeros((len(now), self.longest + 1, 4), np.int64) if keep else None
        if keep:
            kept[np.arange(len(now)), self.sizes] = now
        for t in range(self.longest - 1, -1, -1):
            n = self.active[t]
            now[:n] = np.minimum((STEPS[self.codes[:n, t]] + now[:n, None, :]).min(axis=2), FAR)
            if keep:
                kept[:n, t] = now[:n]
        if keep:
            return kept
        out = np.empty_like(now)
        out[self.order] = now
        return out

    def between(self) -> np.ndarray:
        """Least costs of each block from each state to each state."""
        unit = np.where(np.eye(4, dtype=bool), 0, FAR)
        n = len(self.order)
        return np.stack([self.costs(np.repeat(unit[j : j + 1], n, axis=0), False) for j in range(4)], axis=2)

    def walk(self, costs: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State after each block and a token for each row: state before, rows inserted, edit; entered in ``entry``."""
        state = entry[self.order].copy()
        tokens = np.zeros(self.codes.shape, np.int64)
        for t in range(self.longest):
            n = self.active[t]
            rows, code, s = np.arange(n), self.codes[:n, t], state[:n].copy()
            here, after = costs[:n, t], costs[:n, t + 1]
            inserted = np.zeros(n, np.int64)
            deleted = here[rows, s] == DELETE + after[rows, s]
            more = ~deleted & (here[rows, s] == INSERT + here[rows, AFTER_INSERT[s]])
            while more.any():
                s[more] = AFTER_INSERT[s[more]]
                inserted += more
                deleted[more] = (here[rows, s] == DELETE + after[rows, s])[more]
                more &= ~deleted & (here[rows, s] == INSERT + here[rows, AFTER_INSERT[s]])
            to = KEPT[code, s]
            kept = ~deleted & (to >= 0) & (here[rows, s] == MORE[code] + after[rows, np.maximum(to, 0)])
            tokens[:n, t] = state[:n] * 9 + inserted * 3 + np.where(deleted, 0, np.where(kept, 1, 2))
            state[:n] = np.where(deleted, s, np.where(kept, to, AFTER_INSERT[s]))
        out, exits = np.empty_like(tokens), np.empty_like(state)
        out[self.order], exits[self.order] = tokens, state
        return exits, out


def _cut(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of blocks that fit side by side."""
    codes = batch.column("codes").to_pylist()
    begin, longest = 0, 0
    for i, c in enumerate(codes):
        longest = max(longest, len(c))
        if i > begin and longest * (i + 1 - begin) > SIDE:
            yield batch.slice(begin, i - begin), codes[begin:i]
            begin, longest = i, len(c)
    if begin < len(codes):
        yield batch.slice(begin), codes[begin:]


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, codes in _cut(batch):
            found = Side(codes).between().reshape(len(codes), 16)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("key", "block", "ends")], _lists(found)], ["key", "block", "ends", "costs"])


def _checkpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's blocks in order: the costs after each, the cost of all, pairs of rows across blocks that are illegal."""
    names = ["key", "block", "after", "last", "single", "cost", "across"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for key, blocks in zip(batch.column("key").to_pylist(), batch.column("blocks").to_pylist()):
            after = END
            across = sum(a["ends"][1] + b["ends"][0] not in ("su", "ua", "au") for a, b in zip(blocks, blocks[1:]))
            rows = []
            for i in range(len(blocks) - 1, -1, -1):
                rows.append((key, blocks[i]["block"], after.tolist(), i == len(blocks) - 1, len(blocks) == 1))
                after = np.minimum((np.array(blocks[i]["costs"]).reshape(4, 4) + after).min(axis=1), FAR)
            for row in rows:
                for column, value in zip(out, (*row, int(after[0]), across)):
                    column.append(value)
        types = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names)


def _ends(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("after").flatten().to_numpy().reshape(batch.num_rows, 4)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after each block for each state before it."""
    for batch in batches:
        for part, codes in _cut(batch):
            side = Side(codes)
            costs = side.costs(_ends(part), True)
            found = np.stack([side.walk(costs, np.full(len(codes), s))[0] for s in range(4)], axis=1)
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("block"), _lists(found)], ["key", "block", "exits"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before each block of a conversation."""
    for batch in batches:
        rows = []
        for key, blocks in zip(batch.column("key").to_pylist(), batch.column("blocks").to_pylist()):
            state = 0
            for b in blocks:
                rows.append((key, b["block"], state))
                state = b["exits"][state]
        keys, block, entry = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(block, pa.int64()), pa.array(entry, pa.int64())], ["key", "block", "entry"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block a character for each row (its token), the edits' letters, and the state it ends in."""
    letters = np.array(["I" * (k % 9 // 3) + EDITS[k % 3] for k in range(36)], object)
    marks = np.array([chr(48 + k) for k in range(36)], object)
    for batch in batches:
        for part, codes in _cut(batch):
            side = Side(codes)
            exits, tokens = side.walk(side.costs(_ends(part), True), part.column("entry").to_numpy())
            last = part.column("last").to_numpy(zero_copy_only=False)
            tail = np.where(last, END[exits] // INSERT, 0)
            rows = [tokens[i, : len(c)] for i, c in enumerate(codes)]
            audit = ["".join(letters[r]) + "I" * int(n) for r, n in zip(rows, tail)]
            columns = [pa.array(["".join(marks[r]) for r in rows]), pa.array(audit), pa.array(tail), pa.array(exits)]
            names = ["key", "block", "first", "rows", "cost", "across"]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *columns], [*names, "tokens", "audit", "tail", "exit"])


# Spark ---------------------------------------------------------------------------------------------------


def _key(conv_id: Column) -> Column:
    """Text that tells conversations apart, null included."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after a fault drawn by crc32 of conv_id:turn, modulo 20.

    0 drops the row, 1 empties its text, 2 removes its sentence marks, 3 repeats it, 4 makes it the user's. A null counts
    as one space, in the drawn number as in role and text.
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    drawn = F.pmod(F.crc32(name.cast("binary")), F.lit(20))
    text = F.coalesce(F.col("text"), space)
    return conversations.withColumn("_fault", drawn).filter("_fault <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("_fault") == 4, "user").otherwise(F.coalesce(F.col("role"), space)).alias("role"),
        F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def placed(rows: DataFrame) -> DataFrame:
    """Staged rows with key, pos (their place in the order of all), same (tells role and text) and what is seen of them.

    Sorted by conversation, turn (null first), then ``same``; the order is cut anywhere, also within a conversation.
    """
    known = rows.select(
        _key(F.col("conv_id")).alias("key"), "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"),
    )
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text"), 256)
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    seen = known.withColumns(
        {
            "same": same,
            "blank": trimmed == "",
            "cut": ~F.right(trimmed, F.lit(1)).isin(".", "!", "?"),
            "initial": F.when(initial.isin("s", "u", "a"), initial).otherwise("o"),
        }
    )
    order = ["key", "turn", "same"]
    return stage(seen.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()), "rows")


def _blocks(rows: DataFrame, shift: int) -> DataFrame:
    """Staged: a row for each block (key, pos >> shift) with the codes of its rows and counts of faults."""
    firsts = rows.filter("not blank").groupBy("key", "same").agg(F.min("pos").alias("_first"), F.count("*").alias("_n"))
    narrow = rows.select("key", "same", "pos", "blank", "cut", "initial")
    joined = narrow.join(firsts.filter("_n > 1").drop("_n"), ["key", "same"], "left")
    repeat = ~F.col("blank") & F.coalesce(F.col("pos") > F.col("_first"), F.lit(False))
    cut = F.col("cut") & ~F.col("blank") & ~repeat
    code = F.when(F.col("blank") | repeat, "x").when(cut, F.upper("initial")).otherwise(F.col("initial"))
    flagged = joined.select("key", F.shiftright("pos", shift).alias("block"), "pos", "initial", code.alias("code"), "blank", repeat.alias("repeat"), cut.alias("cut"))
    in_order = F.array_sort(F.collect_list(F.struct("pos", "code", "initial")))
    blocks = flagged.groupBy("key", "block").agg(
        in_order.alias("_rows"), F.count_if("blank").alias("blank"), F.count_if("repeat").alias("duplicate"), F.count_if("cut").alias("truncated")
    )
    text = lambda field: F.array_join(F.transform("_rows", lambda r: r[field]), "")
    blocks = blocks.withColumns({"codes": text("code"), "initials": text("initial"), "first": F.col("_rows")[0]["pos"], "rows": F.size("_rows").cast("long")})
    legal = F.length(F.regexp_replace("initials", "(?=su|ua|au)", "#")) - F.col("rows")
    ends = F.concat(F.left("initials", F.lit(1)), F.right("initials", F.lit(1)))
    return stage(blocks.withColumns({"inside": F.col("rows") - 1 - legal, "ends": ends}).drop("_rows", "initials"), "blocks")


def edited(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Of ``placed`` rows: blocks with counts, blocks (staged) with their edits, and the shift from pos to block."""
    longest = rows.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    shift = math.ceil(math.log2(max(LEAST, math.isqrt(longest))))
    blocks = _blocks(rows, shift)
    costs = in_batches(blocks.select("key", "block", "codes", "ends"), _matrices, "key string, block long, ends string, costs array<long>")
    # A conversation has about as many blocks as a block has rows, and one more for each cut of the sort.
    chains = costs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "ends", "costs"))).alias("blocks"))
    marks = in_batches(chains, _checkpoints, "key string, block long, after array<long>, last boolean, single boolean, cost long, across long")
    known = stage(blocks.select("key", "block", "codes", "first", "rows").join(marks, ["key", "block"]), "checkpoints")
    several = in_batches(known.filter("not single").select("key", "block", "codes", "after"), _exits, "key string, block long, exits array<long>")
    chains = several.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "exits"))).alias("blocks"))
    entries = in_batches(chains, _entries, "key string, block long, entry long")
    ready = known.join(entries, ["key", "block"], "left").withColumn("entry", F.coalesce("entry", F.lit(0).cast("long")))
    schema = "key string, block long, first long, rows long, cost long, across long, tokens string, audit string, tail long, exit long"
    return blocks, stage(in_batches(ready, _edits, schema), "edits"), shift


def repaired_rows(rows: DataFrame, edits: DataFrame, shift: int) -> DataFrame:
    """key, conv_id, pos, place, role, text, edit of the repaired conversations; order by pos, place within a key."""
    joined = rows.select("key", "conv_id", "pos", "role", "text", F.shiftright("pos", shift).alias("block")).join(edits.select("key", "block", "first", "rows", "tokens", "tail", "exit"), ["key", "block"])
    at = (F.col("pos") - F.col("first")).cast("int")
    token = F.ascii(F.substring("tokens", at + 1, 1)) - 48
    joined = joined.withColumns({"_state": F.floor(token / 9), "_in": F.floor(token % 9 / 3), "_edit": token % 3, "_tail": F.when(at == F.col("rows") - 1, F.col("tail")).otherwise(0)})
    other = lambda role: F.when(role == "user", "assistant").otherwise("user")
    due = F.when(F.col("_state") == 2, "assistant").otherwise("user")
    then = F.when(F.col("_in") % 2 == 1, other(due)).otherwise(due)
    end = F.when(F.col("exit") == 2, "assistant").otherwise("user")
    made = lambda place, role, text, edit: F.struct(F.lit(place).alias("place"), role.alias("role"), text.alias("text"), F.lit(edit).alias("edit"))
    empty = F.lit("")
    choices = [
        (F.col("_in") >= 1, made(0, due, empty, "I")),
        (F.col("_in") >= 2, made(1, other(due), empty, "I")),
        (F.col("_edit") == 1, made(2, F.col("role"), F.col("text"), "K")),
        (F.col("_edit") == 2, made(2, then, F.col("text"), "R")),
        (F.col("_tail") >= 1, made(3, end, empty, "I")),
        (F.col("_tail") >= 2, made(4, other(end), empty, "I")),
    ]
    out = F.filter(F.array(*[F.when(test, row) for test, row in choices]), lambda r: r.isNotNull())
    return joined.select("key", "conv_id", "pos", F.inline(out))


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, place, role, text, edit (I, K, R): the rows of the repaired conversations, in order of pos and place.

    ``conversations``: conv_id, turn, role, text; see ``report`` for nulls, ties and repeated rows.
    """
    rows = placed(conversations)
    _, edits, shift = edited(rows)
    return repaired_rows(rows, edits, shift).drop("key")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's lines, which come in order; the digest goes on from batch to batch."""
    last, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last]), pa.array([digest.hexdigest()])], ["key", "repaired_sha256"])

    for batch in batches:
        done = []
        for key, line in zip(batch.column("key").to_pylist(), batch.column("line").to_pylist()):
            if key != last or digest is None:
                if digest is not None:
                    done.append((last, digest.hexdigest()))
                last, digest = key, hashlib.sha256(line.encode())
            else:
                digest.update(b"\n" + line.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done)], ["key", "repaired_sha256"])
    if digest is not None:
        yield row()


def report(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation.

    ``rows`` are looked at and repaired in place of ``conversations``, of which the ids come. Null roles and texts count as
    one space, a null id is a conversation. Rows are taken by turn, null first; equal turns by a digest of role and text,
    so equal rows stand together and all but the first are duplicates. A conversation without rows has zeros, an empty
    audit and the digest of nothing; no conversations, no rows.
    """
    rows = placed(conversations if rows is None else rows)
    blocks, edits, shift = edited(rows)
    counts = blocks.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "inside")])
    pieces = F.array_sort(F.collect_list(F.struct("block", "audit")))
    audits = edits.groupBy("key").agg(F.max("cost").alias("cost"), F.max("across").alias("across"), F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit"))
    turns = rows.groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    lines = repaired_rows(rows, edits, shift).select("key", "pos", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    # A digest needs its rows one after the other: a task holds a batch of them and a few bytes of state.
    in_order = lines.repartition("key").sortWithinPartitions("key", "pos", "place").select("key", "line")
    digests = in_batches(in_order, _digests, "key string, repaired_sha256 string")
    every = conversations.groupBy(_key(F.col("conv_id")).alias("key")).agg(F.min("conv_id").alias("conv_id"))
    joined = every
    for found in (turns, counts, audits, digests):
        joined = joined.join(found, "key", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.withColumn("illegal", F.col("inside") + F.col("across")).select(
        "conv_id", *[number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
