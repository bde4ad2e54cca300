"""Gradient boosting with a softmax over all classes, on binned columns.

A round grows one tree for each class, all of them level by level together. Tasks turn their rows into sums of gradients
and hessians by class, node, column and bin; Spark adds these up in one grouping a level, takes running sums along the
bins, and picks the best cut of every node, so that one row a node reaches the driver. The rows are written once, as a byte
a column, with the margins of the rounds so far; these are renewed every few rounds, and tasks add what came since.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidemark.plans.quantiles import exact_quantiles
from tidemark.session import stage

#: Rounds after which margins are written anew.
RENEW = 8


@dataclass
class Tree:
    """Nodes as a heap: children of i are 2i + 1 (value <= cut) and 2i + 2; column -1 is a leaf."""

    column: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n))

    def node(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``bins``."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(int(np.log2(len(self.column) + 1)) - 1):
            column = self.column[at]
            right = bins[rows, np.maximum(column, 0)] > self.bin[at]
            at = np.where(column >= 0, 2 * at + 1 + right, at)
        return at


@dataclass
class BoostedModel:
    """Trees by round and class, the cuts of each column, and the mean loss after each number of rounds."""

    cols: list[str]
    classes: list[int]
    cuts: list[list[float]]
    step: float
    trees: list[list[Tree]] = field(default_factory=list)
    losses: list[dict[str, float]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """The number of cuts below each value."""
        out = np.zeros(x.shape, np.uint8)
        for j, cuts in enumerate(self.cuts):
            out[:, j] = np.searchsorted(cuts, x[:, j], "left")
        return out

    def margins(self, bins: np.ndarray, since: int = 0) -> np.ndarray:
        out = np.zeros((len(bins), len(self.classes)))
        for trees in self.trees[since:]:
            for k, tree in enumerate(trees):
                out[:, k] += self.step * tree.value[tree.node(bins)]
        return out

    def probabilities(self) -> Column:
        """Class probabilities of a row as an array, by Arrow batches; null where a column has no value."""
        model = self

        @pandas_udf("array<double>")
        def probabilities(x: pd.DataFrame) -> pd.Series:
            values = x.to_numpy(dtype="float64")
            known = ~np.isnan(values).any(axis=1)
            found = softmax(model.margins(model.bins(np.nan_to_num(values))))
            return pd.Series([p if k else None for p, k in zip(found.tolist(), known)])

        return probabilities(F.struct(*[F.col(c).cast("double") for c in self.cols]))

    def score(self, df: DataFrame) -> DataFrame:
        """Append ``y_pred`` (the first of the likeliest classes), ``probs`` and ``confidence``; every row stays."""
        scored = df.withColumn("probs", self.probabilities())
        top = F.array_max("probs")
        classes = F.array(*[F.lit(c) for c in self.classes])
        best = F.get(classes, (F.array_position("probs", top) - 1).cast("int")).cast("int")
        return scored.withColumns({"y_pred": best, "confidence": top}).select(*df.columns, "y_pred", "probs", "confidence")

    def save(self, path: str) -> None:
        """Write the model as a table of one row with its JSON."""
        trees = [[{"column": t.column.tolist(), "bin": t.bin.tolist(), "value": t.value.tolist()} for t in r] for r in self.trees]
        text = json.dumps({**{k: getattr(self, k) for k in ("cols", "classes", "cuts", "step", "losses")}, "trees": trees})
        SparkSession.getActiveSession().createDataFrame([(text,)], "boosted string").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedModel:
        values = json.loads(spark.read.parquet(path).first()["boosted"])
        trees = [[Tree(np.array(t["column"]), np.array(t["bin"]), np.array(t["value"])) for t in r] for r in values.pop("trees")]
        return BoostedModel(trees=trees, **values)


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def column_cuts(df: DataFrame, cols: Sequence[str], bins: int) -> list[list[float]]:
    """Different quantiles of each column: at most ``bins`` - 1 numbers a column come back."""
    shares = [i / bins for i in range(1, bins)]
    rows = exact_quantiles(df.select(F.lit(0).alias("_all"), *cols), list(cols), shares, ["_all"]).select("column", "q").collect()
    found = {r["column"]: sorted({float(v) for v in r["q"] if v is not None}) for r in rows}
    return [found.get(c, []) for c in cols]


def fit(
    df: DataFrame,
    cols: Sequence[str],
    label: str,
    weight: str | None = None,
    validation: Column | None = None,
    rounds: int = 20,
    depth: int = 4,
    step: float = 0.1,
    bins: int = 64,
    l1: float = 0.0,
    l2: float = 1.0,
    least_weight: float = 1e-3,
    least_rows: int = 1,
    patience: int = 10,
) -> BoostedModel:
    """Fit on complete rows; rows where ``validation`` holds are only looked at, and end the rounds when the loss there has
    not fallen for ``patience`` of them (the model keeps the rounds up to the least loss).

    A cut must leave hessians of ``least_weight`` and ``least_rows`` rows on both sides and gain more than nothing;
    gains that agree to nine digits go to the first column, then the lowest cut.
    """
    if not 2 <= bins <= 256:
        raise ValueError("bins must be 2 to 256")
    held = F.coalesce(validation, F.lit(False)) if validation is not None else F.lit(False)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    named = {c: f"_c{j}" for j, c in enumerate(cols)}
    rows = df.select(*[F.col(c).cast("double").alias(named[c]) for c in cols], F.col(label).cast("int").alias("_y"), w.alias("_w"), held.alias("_held"))
    learned = rows.filter("not _held")
    classes = sorted(r["_y"] for r in learned.select("_y").distinct().collect())  # as many as there are classes
    model = BoostedModel(list(cols), classes, column_cuts(learned, list(named.values()), bins), step)
    if not classes:
        return model
    known = rows.filter(F.col("_y").isin(*classes))
    data = stage(known.mapInArrow(_binned(model, len(cols)), "bins binary, y int, w double, held boolean, margin array<double>"), "binned")
    grower = _Grower(model, depth, l1, l2, least_weight, least_rows)
    base, best = 0, 0
    for number in range(rounds + 1):
        grower.start()
        found = grower.level(data, base)
        model.losses.append(grower.loss)
        seen = [x.get("held", np.inf) for x in model.losses]
        best = int(np.argmin(seen)) if np.isfinite(seen).any() else number
        if number == rounds or number - best >= patience or not grower.split(found):
            break
        for _ in range(depth - 1):
            if not grower.split(grower.level(data, base)):
                break
        model.trees.append(grower.trees)
        if len(model.trees) - base >= RENEW and number + 1 < rounds:
            data, base = stage(data.mapInArrow(_renewed(model, base), data.schema), "binned"), len(model.trees)
    del model.trees[best:]
    return model


class _Grower:
    """The trees of a round while they grow."""

    def __init__(self, model: BoostedModel, depth: int, l1: float, l2: float, least_weight: float, least_rows: int):
        self.model, self.depth, self.l1, self.l2 = model, depth, l1, l2
        self.least_weight, self.least_rows = least_weight, least_rows

    def start(self) -> None:
        self.trees = [Tree.empty(self.depth) for _ in self.model.classes]
        self.open = [(k, 0) for k in range(len(self.trees))]
        self.loss: dict[str, float] = {}

    def level(self, data: DataFrame, base: int) -> list:
        """The best cut of each open node; with the first level also the loss."""
        sums = data.mapInArrow(_sums(self.model, base, self.trees, self.open), "class int, node int, col int, bin int, g double, h double, n long")
        sums = sums.groupBy("class", "node", "col", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
        by_column = Window.partitionBy("class", "node", "col").orderBy("bin")
        so_far, whole = by_column.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("class", "node", "col")
        cuts = sums
        for c in ("g", "h", "n"):
            cuts = cuts.withColumns({f"l{c}": F.sum(c).over(so_far), f"t{c}": F.sum(c).over(whole)})

        def share(g: Column, h: Column) -> Column:
            kept = F.greatest(F.abs(g) - self.l1, F.lit(0.0))
            return kept * kept / (h + self.l2)

        lg, lh, ln, tg, th, tn = (F.col(c) for c in ("lg", "lh", "ln", "tg", "th", "tn"))
        gain = (share(lg, lh) + share(tg - lg, th - lh) - share(tg, th)) / 2
        fits = (F.least(lh, th - lh) >= self.least_weight) & (F.least(ln, tn - ln) >= self.least_rows)
        gain = F.when((F.col("class") >= 0) & fits, F.round(gain, 9))
        ranked = F.struct(gain.alias("gain"), (-F.col("col")).alias("c"), (-F.col("bin")).alias("b"))
        # A node's best cut, or its sums if no cut fits; a row a node comes back, and one for each kind of loss.
        best = F.max_by(F.struct("col", "bin", gain.alias("gain"), "lg", "lh", "tg", "th"), ranked)
        found = cuts.groupBy("class", "node").agg(best.alias("best")).collect()
        for r in found:
            if r["class"] < 0 and r["best"]["th"]:
                self.loss["held" if r["node"] else "learned"] = r["best"]["tg"] / r["best"]["th"]
        return [r for r in found if r["class"] >= 0]

    def value(self, g: float, h: float) -> float:
        return -float(np.sign(g)) * max(abs(g) - self.l1, 0.0) / (h + self.l2)

    def split(self, found: list) -> bool:
        """Cut the open nodes where that gains; whether any was."""
        self.open = []
        for r in sorted(found, key=lambda r: (r["class"], r["node"])):
            tree, i, b = self.trees[r["class"]], r["node"], r["best"]
            if i == 0:
                tree.value[0] = self.value(b["tg"], b["th"])
            if b["gain"] is None or b["gain"] <= 0:
                continue
            tree.column[i], tree.bin[i] = b["col"], b["bin"]
            tree.value[2 * i + 1] = self.value(b["lg"], b["lh"])
            tree.value[2 * i + 2] = self.value(b["tg"] - b["lg"], b["th"] - b["lh"])
            self.open += [(r["class"], 2 * i + 1), (r["class"], 2 * i + 2)]
        return bool(self.open)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def _matrix(batch: pa.RecordBatch, columns: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, columns)


def _binned(model: BoostedModel, columns: int):
    place = {c: i for i, c in enumerate(model.classes)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(j).to_numpy(zero_copy_only=False).astype(float) for j in range(columns)])
            w = batch.column("_w").to_numpy(zero_copy_only=False).astype(float)
            known = np.flatnonzero(~np.isnan(x).any(axis=1) & ~np.isnan(w))
            batch, x, w = batch.take(pa.array(known)), x[known], w[known]
            if not len(x):
                continue
            bins = [r.tobytes() for r in model.bins(x)]
            y = [place[v] for v in batch.column("_y").to_pylist()]
            margin = _lists(np.zeros((len(x), len(place))))
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.binary()), pa.array(y, pa.int32()), pa.array(w), batch.column("_held"), margin], ["bins", "y", "w", "held", "margin"])

    return run


def _now(batch: pa.RecordBatch, model: BoostedModel, base: int) -> tuple[np.ndarray, np.ndarray]:
    bins = _matrix(batch, len(model.cols))
    kept = batch.column("margin").flatten().to_numpy().reshape(batch.num_rows, -1)
    return bins, kept + model.margins(bins, base)


def _renewed(model: BoostedModel, base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.set_column(batch.schema.names.index("margin"), "margin", _lists(_now(batch, model, base)[1]))

    return run


def _sums(model: BoostedModel, base: int, trees: list[Tree], open_: list[tuple[int, int]]):
    """Sums of the task's rows by class, node, column and bin; with the roots also (class -1) of the loss."""
    width = max((len(c) for c in model.cuts), default=0) + 1
    classes, columns = len(model.classes), len(model.cols)
    slot = np.full((classes, len(trees[0].column)), -1)
    for i, (k, node) in enumerate(open_):
        slot[k, node] = i
    names = ["class", "node", "col", "bin", "g", "h", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(open_), columns, width))
        loss = np.zeros((2, 3))
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, margin = _now(batch, model, base)
            y, w = batch.column("y").to_numpy(), batch.column("w").to_numpy()
            held = batch.column("held").to_numpy(zero_copy_only=False)
            p = softmax(margin)
            each = -w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))
            for i, part in enumerate((~held, held)):
                loss[i] += each[part].sum(), w[part].sum(), part.sum()
            use = np.flatnonzero(~held)
            for k in range(classes):
                at = slot[k, trees[k].node(bins[use])]
                rows, at = use[at >= 0], at[at >= 0]
                pk = p[rows, k]
                weights = (w[rows] * (pk - (y[rows] == k)), w[rows] * pk * (1 - pk), None)
                for j in range(columns):
                    cell = at * width + bins[rows, j]
                    for s, x in enumerate(weights):
                        total[s, :, j] += np.bincount(cell, x, minlength=len(open_) * width).reshape(len(open_), width)
        i, j, b = np.nonzero(total[2])
        where = np.array(open_, np.int64).reshape(-1, 2)
        ints = [where[i, 0], where[i, 1], j, b]
        values = [total[0][i, j, b], total[1][i, j, b], total[2][i, j, b].astype(np.int64)]
        if any(node == 0 for _, node in open_):
            some = np.flatnonzero(loss[:, 2])
            ints = [np.append(a, x) for a, x in zip(ints, (np.full(len(some), -1), some, np.zeros(len(some)), np.zeros(len(some))))]
            values = [np.append(a, loss[some, c]) for c, a in enumerate(values)]
        arrays = [*[pa.array(x.astype(np.int32)) for x in ints], pa.array(values[0]), pa.array(values[1]), pa.array(values[2].astype(np.int64))]
        yield pa.RecordBatch.from_arrays(arrays, names)

    return run
