"""Ordered work on long series without ever giving one task a whole series.

A plain ``Window.partitionBy("symbol").orderBy("ts")`` puts all rows of a symbol into one task. Here a
series is cut along its order into *cells* (for a time axis: equal spans of the clock). Two plans are
built on that:

``running``   prefix values (sums, extremes, last / next known value). Cells are aggregated with map-side
              combine, the prefix is taken over the small cell table, and rows add the carry of their cell
              to the prefix inside the cell.
``Halo``      row frames of bounded reach (moving means, lags, decayed sums). Neighbouring cells form
              blocks, and every block receives a copy of the rows just before (and after) it, so frames
              run inside a block and give the same values as over the whole series.

Both keep the parallelism at (key, cell) or (key, block), whatever share of the rows one key holds.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.time import epoch_micros, epoch_seconds
from tidemark.plans.parts import WHOLE, sketch_parts

_UNBOUNDED_BEFORE = Window.unboundedPreceding
_UNBOUNDED_AFTER = Window.unboundedFollowing


@dataclass(frozen=True)
class Axis:
    """Layout of a series table. Rows without a key or a stamp belong to no series.

    ``keys`` name a series, ``ts`` orders it, ``ties`` order rows of equal ``ts``. ``cell`` is the width of
    a cell in the units of ``ts`` (seconds for timestamps) and ``block`` the number of rows per block.

    A fixed width suits bars, of which a day holds a known number. For ticks and fills, whose density is not
    known, ``cell=None`` cuts each series into parts of equal row counts by a sketch, at the price of one
    more pass over the order column; series up to ``whole`` rows are not cut.
    """

    keys: tuple[str, ...] = ("symbol",)
    ts: str = "ts"
    ties: tuple[str, ...] = ()
    cell: float | None = 86400
    block: int = 2048
    whole: int = WHOLE

    def with_(self, **changes) -> "Axis":
        return replace(self, **changes)

    @property
    def order(self) -> list[str]:
        return [self.ts, *self.ties]

    @property
    def id(self) -> list[str]:
        return [*self.keys, self.ts, *self.ties]

    def placed(self, df: DataFrame, cell: Column | None = None) -> DataFrame:
        """Append ``_cell``, a bigint that grows with the order; rows without a stamp go."""
        value = F.col(self.ts)
        timed = isinstance(df.schema[self.ts].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
        zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
        if timed and zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
            raise ValueError(f"the session time zone must be UTC, not {zone}")
        known = df.filter(value.isNotNull())
        if cell is None and self.cell is None:
            return sketch_parts(known, epoch_micros(value) if timed else value, self.keys, "_cell", self.whole)
        if cell is None:
            cell = F.floor((epoch_seconds(value) if timed else value) / F.lit(self.cell)).cast("bigint")
        # The same test stands on both sides of the join with the cells, so a shuffle below can be shared.
        return known.withColumn("_cell", cell).filter("_cell is not null")

    def order_key(self) -> Column:
        return F.struct(*self.order) if self.ties else F.col(self.ts)


BARS = Axis()


@dataclass(frozen=True)
class Prefix:
    """One running value: ``kind`` is total, highest, lowest, latest or upcoming."""

    kind: str
    value: Column


def total(value) -> Prefix:
    """Sum from the start of the series to this row (nulls count as 0)."""
    return Prefix("total", value if isinstance(value, Column) else F.col(value))


def row_count() -> Prefix:
    """1-based position in the series."""
    return total(F.lit(1).cast("bigint"))


def highest(value) -> Prefix:
    return Prefix("highest", value if isinstance(value, Column) else F.col(value))


def lowest(value) -> Prefix:
    return Prefix("lowest", value if isinstance(value, Column) else F.col(value))


def latest(value) -> Prefix:
    """Last non-null value at or before this row."""
    return Prefix("latest", value if isinstance(value, Column) else F.col(value))


def upcoming(value) -> Prefix:
    """First non-null value at or after this row."""
    return Prefix("upcoming", value if isinstance(value, Column) else F.col(value))


def _cell_aggregate(axis: Axis, prefix: Prefix, source: str) -> Column:
    if prefix.kind == "total":
        return F.sum(source)
    if prefix.kind == "highest":
        return F.max(source)
    if prefix.kind == "lowest":
        return F.min(source)
    known = F.when(F.col(source).isNotNull(), axis.order_key())
    pick = F.max_by if prefix.kind == "latest" else F.min_by
    return pick(F.col(source), known)


def _carry(prefix: Prefix, column: str, keys: list[str]) -> Column:
    over = Window.partitionBy(*keys).orderBy("_cell")
    before, after = over.rowsBetween(_UNBOUNDED_BEFORE, -1), over.rowsBetween(1, _UNBOUNDED_AFTER)
    if prefix.kind == "total":
        return F.sum(column).over(before)
    if prefix.kind == "highest":
        return F.max(column).over(before)
    if prefix.kind == "lowest":
        return F.min(column).over(before)
    if prefix.kind == "latest":
        return F.last(column, ignorenulls=True).over(before)
    return F.first(column, ignorenulls=True).over(after)


def _inside(prefix: Prefix, source: str, carry: str, over: WindowSpec) -> Column:
    before = over.rowsBetween(_UNBOUNDED_BEFORE, 0)
    zero = F.lit(0)
    if prefix.kind == "total":
        return F.coalesce(F.sum(source).over(before), zero) + F.coalesce(F.col(carry), zero)
    if prefix.kind == "highest":
        return F.greatest(F.max(source).over(before), F.col(carry))
    if prefix.kind == "lowest":
        return F.least(F.min(source).over(before), F.col(carry))
    if prefix.kind == "latest":
        return F.coalesce(F.last(source, ignorenulls=True).over(before), F.col(carry))
    return F.coalesce(F.first(source, ignorenulls=True).over(over.rowsBetween(0, _UNBOUNDED_AFTER)), F.col(carry))


def running(df: DataFrame, axis: Axis, cell: Column | None = None, size: str | None = None, **prefixes: Prefix) -> DataFrame:
    """Append one running column per keyword; ``size`` names a column for the row count of the series.

    ``cell`` replaces the axis' cell by another bigint expression that grows with the order.
    """
    keys = list(axis.keys) or ["_all"]
    base = df if axis.keys else df.withColumn("_all", F.lit(0))
    sources = {name: f"_in_{name}" for name in prefixes}
    base = axis.placed(base, cell).withColumns({sources[n]: p.value for n, p in prefixes.items()})
    aggregates = [_cell_aggregate(axis, p, sources[n]).alias(f"_cell_{n}") for n, p in prefixes.items()]
    if size:
        aggregates.append(F.count(F.lit(1)).alias("_cell_rows"))
    cells = base.groupBy(*keys, "_cell").agg(*aggregates)
    carries = [_carry(p, f"_cell_{n}", keys).alias(f"_carry_{n}") for n, p in prefixes.items()]
    if size:
        carries.append(F.sum("_cell_rows").over(Window.partitionBy(*keys)).alias(size))
    cells = cells.select(*keys, "_cell", *carries)
    over = Window.partitionBy(*keys, "_cell").orderBy(*axis.order)
    joined = base.join(cells, [*keys, "_cell"])
    result = {n: _inside(p, sources[n], f"_carry_{n}", over) for n, p in prefixes.items()}
    joined = joined.select(
        *[c for c in df.columns if c not in result], *[c.alias(n) for n, c in result.items()], *([size] if size else [])
    )
    return joined


def surrounded(df: DataFrame, axis: Axis, cols: list[str]) -> DataFrame:
    """Append ``_rn``, the position, and for each column ``_prev_<c>`` and ``_next_<c>``: (at, value) of the known value at or
    before and at or after the row. Positions and known values come from one pass over the cells."""
    keys = list(axis.keys)
    inside = Window.partitionBy(*keys, "_cell").orderBy(*axis.order)
    base = axis.placed(df).withColumn("_place", F.row_number().over(inside).cast("bigint"))
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_place").alias("at"), F.col(c).cast("double").alias("value"))) for c in cols}
    ends = [f(known[c]).alias(f"_{n}_{c}") for c in cols for n, f in (("first", F.min), ("last", F.max))]
    cells = base.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"), *ends)
    over = Window.partitionBy(*keys).orderBy("_cell")
    before, after = over.rowsBetween(_UNBOUNDED_BEFORE, -1), over.rowsBetween(1, _UNBOUNDED_AFTER)
    cells = cells.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))

    def moved(known: str) -> Column:
        return F.when(F.col(known).isNotNull(), F.struct((F.col("_start") + F.col(f"{known}.at")).alias("at"), F.col(f"{known}.value").alias("value")))

    cells = cells.withColumns({f"_{n}_{c}": moved(f"_{n}_{c}") for c in cols for n in ("first", "last")})
    carried = [F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_last_{c}") for c in cols]
    carried += [F.first(f"_first_{c}", ignorenulls=True).over(after).alias(f"_first_{c}") for c in cols]
    joined = base.join(cells.select(*keys, "_cell", "_start", *carried), [*keys, "_cell"]).withColumn("_rn", F.col("_start") + F.col("_place"))
    out = {}
    for c in cols:
        here = F.when(F.col(c).isNotNull(), F.struct(F.col("_rn").alias("at"), F.col(c).cast("double").alias("value")))
        back, ahead = inside.rowsBetween(_UNBOUNDED_BEFORE, 0), inside.rowsBetween(0, _UNBOUNDED_AFTER)
        out[f"_prev_{c}"] = F.coalesce(F.last(here, ignorenulls=True).over(back), F.col(f"_last_{c}"))
        out[f"_next_{c}"] = F.coalesce(F.first(here, ignorenulls=True).over(ahead), F.col(f"_first_{c}"))
    return joined.select(*df.columns, "_rn", *[v.alias(n) for n, v in out.items()])


def numbered(df: DataFrame, axis: Axis, name: str = "rn", size: str | None = None) -> DataFrame:
    """Append the 1-based position of each row in its series (and the length of the series)."""
    return running(df, axis, size=size, **{name: row_count()})


@dataclass(frozen=True)
class Halo:
    """A series table spread into blocks with copied edges.

    ``frame`` carries the rows, ``w`` is the window of a block. Build columns on ``frame`` with ``last(n)``
    and the like, then ``settle`` to drop the copied rows. With ``exact`` blocks ``k`` is the position in
    the block, known to be at most ``longest``.
    """

    frame: DataFrame
    axis: Axis
    w: WindowSpec
    longest: int | None = None

    @staticmethod
    def spread(df: DataFrame, axis: Axis = BARS, back: int = 0, ahead: int = 0, block: int | None = None) -> "Halo":
        """One shuffle of the rows; blocks are whole cells, so their length is only about ``block``."""
        size = max(block or axis.block, back, ahead, 1)
        keys = list(axis.keys)
        base = axis.placed(df)
        over = Window.partitionBy(*keys).orderBy("_cell")
        whole = Window.partitionBy(*keys)
        cells = base.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
        cells = cells.select(
            *keys,
            "_cell",
            "_n",
            F.coalesce(F.sum("_n").over(over.rowsBetween(_UNBOUNDED_BEFORE, -1)), F.lit(0)).alias("_start"),
            F.sum("_n").over(whole).alias("_total"),
            F.max("_n").over(whole).alias("_widest"),
        )
        own = F.floor(F.col("_start") / size)
        # A block needs every cell that ends less than `back` rows before its first row or starts less
        # than `ahead` rows after its last row; copying a few more keeps frames exact.
        last = F.least(F.floor((F.col("_start") + F.col("_n") - 1 + back) / size), F.floor((F.col("_total") - 1) / size))
        first = own
        if ahead:
            first = F.greatest(F.floor((F.col("_start") + 1 - F.col("_widest") - ahead) / size), F.lit(0))
        targets = F.sequence(first, F.greatest(own, last))
        cells = cells.select(
            *keys, "_cell", "_start", own.alias("_own"), F.explode(targets).alias("_block")
        )
        frame = base.join(cells, [*keys, "_cell"]).withColumn("_core", F.col("_own") == F.col("_block"))
        return Halo(frame, axis, Window.partitionBy(*keys, "_block").orderBy(*axis.order))

    @staticmethod
    def exact(df: DataFrame, axis: Axis = BARS, back: int = 0, block: int | None = None) -> "Halo":
        """Blocks of exactly ``block`` rows plus ``back`` copied rows; adds ``_rn`` and ``_k``.

        Costs a second shuffle for the numbering, but bounds the block length, which decayed sums need.
        A table that already carries ``_rn`` and ``_rows`` from ``numbered`` is not numbered again.
        """
        size = max(block or axis.block, 1)
        base = df if {"_rn", "_rows"} <= set(df.columns) else numbered(df, axis, "_rn", size="_rows")
        place = F.col("_rn") - 1
        own = F.floor(place / size)
        end = F.floor(F.least(place + back, F.col("_rows") - 1) / size)
        frame = base.withColumn("_own", own).withColumn("_block", F.explode(F.sequence(own, end)))
        frame = frame.withColumns(
            {
                "_core": F.col("_own") == F.col("_block"),
                "_k": place + 1 - F.greatest(F.col("_block") * size - back, F.lit(0)),
            }
        )
        return Halo(frame, axis, Window.partitionBy(*axis.keys, "_block").orderBy(*axis.order), size + back)

    def last(self, n: int) -> WindowSpec:
        """The last ``n`` rows, this one included."""
        return self.w.rowsBetween(-(n - 1), 0)

    @property
    def so_far(self) -> WindowSpec:
        return self.w.rowsBetween(_UNBOUNDED_BEFORE, 0)

    def position(self) -> Column:
        """1-based position in the whole series (for ``spread`` blocks)."""
        return F.first("_start").over(self.so_far) + F.row_number().over(self.w)

    def settle(self, frame: DataFrame, *drop: str) -> DataFrame:
        """Keep each row once, in its own block, and drop the helper columns."""
        helpers = ["_cell", "_start", "_own", "_block", "_core", "_k", "_rn", "_rows", *drop]
        return frame.filter("_core").drop(*helpers)
