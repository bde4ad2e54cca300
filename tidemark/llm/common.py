"""Small helpers the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage

#: Bytes of an Arrow batch, about: texts may be long, and a count of rows alone bounds nothing.
BATCH_BYTES = 4 << 20
#: Characters that one step of an array computation takes at most, unless a single text is longer.
STEP_CHARS = 1 << 20


def with_rows(docs: DataFrame, row: str = "_row") -> DataFrame:
    """``docs`` with a number that tells all rows apart, repeated ones too.

    The numbers are written with the rows: read twice, they are the same, whatever ``docs`` is computed from.
    """
    return stage(docs.withColumn(row, F.monotonically_increasing_id()), "rows")


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def in_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with batches bounded in bytes; the session keeps that bound, since Spark reads it when the plan runs."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(run, schema)


def steps(lengths: Iterable[int], limit: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Cut a sequence of texts into runs ``[begin, end)`` of ``limit`` characters in all, or one text."""
    begin, total, i = 0, 0, -1
    for i, n in enumerate(lengths):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if i >= begin:
        yield begin, i + 1


def texts(column) -> list[str]:
    """The strings of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def held_out(of: int, remainder: int, doc_id: str = "doc_id"):
    """Whether crc32 of the id, as text, leaves ``remainder``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(of)) == remainder


def select(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{n}`") for n in names])
