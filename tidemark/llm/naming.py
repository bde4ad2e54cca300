"""Exact deduplication by deterministic block naming.

A text is cut into blocks of fixed size. All blocks are sorted, and equal blocks get one integer, their rank
among the distinct ones. Then adjacent pairs of integers are sorted and named the same way, level by level, until
one integer is left of each document. Equal names at a level mean equal texts: blocks are told apart by comparing
them, not by a digest, so nothing can collide. Sorting cuts the order into ranges of rows, not of keys: a block that a third of all rows have is
spread over many tasks, and its name carries over from range to range.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fresh, in_batches, with_rows
from tidemark.session import stage

BLOCK = 1024
#: Parts in which the rows of one text get their group.
SALTS = 1024


def normalised(text) -> F.Column:
    """Null as empty; each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def named(rows: DataFrame, keys: list[str], place: list[str], keep: list[str]) -> DataFrame:
    """Replace ``keys`` (not null) by ``name``, the rank of their values among all distinct ones, from 0.

    ``place`` tells rows with equal keys apart, so that cuts of the sorted order may fall between them. Texts are
    ordered by 128 bits of hash, then by themselves: the driver, which draws the cuts from a sample, gets numbers only.
    Names come from comparing the texts; should two that differ share all bits, the job ends rather than mix them.
    """
    long_keys = [k for k in keys if isinstance(rows.schema[k].dataType, T.StringType)]
    bits = {f"_bits_{i}_{k}": F.xxhash64(F.lit(i), F.col(k)) for k in long_keys for i in range(2)}
    ahead = [*bits, *[k for k in keys if k not in long_keys]]
    ranged = rows.withColumns(bits).repartitionByRange(*ahead, *place).sortWithinPartitions(*ahead, *long_keys, *place)
    fields = [rows.schema[c] for c in keep]
    fields += [T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType())]
    schema = T.StructType([*fields, *[T.StructField(f"edge_{k}", rows.schema[k].dataType) for k in keys]])
    numbered = stage(in_batches(ranged, _ranker(keys, keep, list(bits)), schema), "names")

    # A row or two of each task: its first and last key and how many distinct ones it has.
    edge = [f"edge_{k}" for k in keys]
    ends = numbered.filter(F.col(edge[0]).isNotNull()).groupBy("part").agg(
        (F.max("rank") + 1).alias("n"),
        F.min_by(F.struct(*edge), "rank").alias("first"),
        F.max_by(F.struct(*edge), "rank").alias("last"),
    )
    order = Window.orderBy("part")
    shared = F.coalesce((F.lag("last").over(order) == F.col("first")).cast("long"), F.lit(0))
    ends = ends.withColumn("new", F.col("n") - shared)
    offsets = ends.select("part", (F.sum("new").over(order) - F.col("n")).alias("offset"))
    # One row of two numbers for each task of the sort, however many rows there are.
    out = numbered.select(*keep, "part", "rank").join(F.broadcast(offsets), "part")
    return out.select(*keep, (F.col("offset") + F.col("rank")).alias("name"))


def _ranker(keys: list[str], keep: list[str], bits: list[str]):
    """Rank within the sorted rows of one task; its first and last row also carry their keys."""

    def changes(columns: list[pa.Array], last: list | None) -> pa.Array:
        """Whether a row differs from the one before it."""
        first = pa.array([[c[0].as_py() for c in columns] != last], pa.bool_())
        if len(columns[0]) == 1:
            return first
        differs = [pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)) for c in columns]
        rest = differs[0]
        for d in differs[1:]:
            rest = pc.or_(rest, d)
        return pa.concat_arrays([first, rest])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, last_bits, at, held = None, None, -1, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k) for k in keys]
            changed = changes(columns, last)
            if bits:
                hashed = [batch.column(k) for k in bits]
                if pc.any(pc.and_not(changed, changes(hashed, last_bits))).as_py():
                    raise ValueError("two different blocks have the same 128 bits of hash")
                last_bits = [c[-1].as_py() for c in hashed]
            ranks = pc.add(pc.cumulative_sum(pc.cast(changed, pa.int64())), at)
            at = ranks[-1].as_py()
            marks = [False] * batch.num_rows
            marks[0] = last is None
            last = [c[-1].as_py() for c in columns]
            if held is not None:
                yield _marked(*held, part, keys, keep)
            held = (batch, ranks, marks)
        if held is not None:
            held[2][-1] = True
            yield _marked(*held, part, keys, keep)

    return rank


def _marked(batch, ranks, marks, part, keys, keep):
    mask = pa.array(marks, pa.bool_())
    edges = [pc.if_else(mask, batch.column(k), pa.scalar(None, batch.column(k).type)) for k in keys]
    parts = pa.array([part] * batch.num_rows, pa.int32())
    return pa.RecordBatch.from_arrays(
        [*[batch.column(c) for c in keep], parts, ranks, *edges], [*keep, "part", "rank", *[f"edge_{k}" for k in keys]]
    )


def identities(rows: DataFrame, row: str, text: str, block: int = BLOCK) -> DataFrame:
    """``row``, ``level``, ``name``: two rows have the same level and name if their texts (not null) are equal."""
    blocks = F.regexp_extract_all(F.col(text), F.lit("(?s).{1,%d}" % block), F.lit(0))
    blocks = F.when(F.col(text) == "", F.array(F.lit(""))).otherwise(blocks)
    cut = rows.select(F.col(row).alias("row"), blocks.alias("blocks"))
    cut = cut.select("row", F.size("blocks").alias("n"), F.posexplode("blocks").alias("at", "block"))
    names = named(cut, ["block"], ["row", "at"], ["row", "n", "at"])
    longest = names.agg(F.max("n")).first()[0] or 0
    done, level = [], 0
    while True:
        done.append(names.filter("n = 1").select("row", F.lit(level).alias("level"), "name"))
        if longest <= 1:
            break
        # Halves the names of each document; a last name without partner pairs with -1.
        pairs = names.filter("n > 1").groupBy("row", F.expr("at div 2").cast("int").alias("at")).agg(
            F.expr("cast((any_value(n) + 1) div 2 as int)").alias("n"),
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        names = named(pairs, ["left", "right"], ["row", "at"], ["row", "n", "at"])
        longest, level = (longest + 1) // 2, level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are the same after each run of white space became one space; null counts as empty.
    Of equal texts the row with the smallest doc_id is kept (a null id only where the group has no other; of rows
    with the same id and text, one). Empty texts are a group like any other. No rows in, no rows out.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("text"))
    return _grouped(with_rows(rows), block).drop("_row")


def _grouped(rows: DataFrame, block: int) -> DataFrame:
    """``rows``: staged, with _row, doc_id and the normalised text."""
    about = rows.select(F.col("_row").alias("row"), "doc_id", F.sha2("text", 256).alias("text_sha256"))
    ids = stage(about.join(identities(rows, "_row", "text", block), "row"), "identities")
    ids = ids.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    # A group's rows are counted by salt, the counts are put together and go back by salt: no task meets all copies of a text.
    best = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    parts = ids.groupBy("level", "name", "salt").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.min(best).alias("best"))
    groups = parts.groupBy("level", "name").agg(F.sum("n").alias("group_size"), F.min("least").alias("keep_id"), F.min("best").alias("best"))
    groups = groups.select("level", "name", "group_size", "keep_id", F.col("best.row").alias("keep_row"))
    spread = parts.select("level", "name", "salt").join(groups, ["level", "name"])
    return ids.join(spread, ["level", "name", "salt"]).select(
        F.col("row").alias("_row"), "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all their columns as they were."""
    row = fresh(docs, "_row")
    rows = with_rows(docs, row)
    clean = rows.select(F.col(row).alias("_row"), F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("text"))
    kept = _grouped(clean, block).filter("kept").select(F.col("_row").alias(row))
    return rows.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
