"""Vector codes of one byte a part, by Lloyd's rounds over cover trees.

A task cuts its vectors into chunks and builds a cover tree for each part of a chunk: a node's points lie within its
radius of its centre, its children cover them at half that radius, lie more than that apart, and one of them has the
node's own centre. A subtree's points stand next to each other, so that cumulative sums give the sum of any subtree.
The trees are written once; each round reads them. An entry of the codebook that is further from a node's centre than
the nearest one by more than twice the radius is nearest to no point below it (triangle inequality): where one entry is
left, it gets the whole subtree at once, and only ambiguous nodes go down, to exact comparisons at the leaves. A round
sends the driver one count and one sum for each entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches
from tidemark.session import stage

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a chunk; points up to which a node isn't split.
CHUNK, LEAF = 2048, 8
#: Components from here on (after scaling) could make a distance exceed 63 bits.
LARGEST = 1 << 27
_FIELDS = ("order", "points", "begin", "end", "child", "children", "radius")
_TREE = "array<struct<" + ",".join(f"{f}:binary" for f in _FIELDS) + ">>"
_BINARY = pa.struct([(f, pa.binary()) for f in _FIELDS])


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """Nodes level by level: points order[begin:end], the first of them the centre; children child:child + children."""
    n = len(points)
    order = np.arange(n)
    distance = np.sqrt(_squares(points, points[:1]).astype(float))  # to the centre of the point's node
    begin, end = np.array([0]), np.array([n])
    radius = np.array([distance.max()])
    nodes: dict[str, list] = {"begin": [], "end": [], "child": [], "children": [], "radius": []}
    made = 1
    while len(begin):
        split = (radius > 0) & (end - begin > leaf)
        size = np.where(split, end - begin, 0)
        place = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        node = np.repeat(np.arange(len(begin)), size)
        half = radius[node] / 2
        child = np.zeros(len(place), np.int64)  # number among the node's children; 0 has its centre
        to = distance[place].copy()
        far = np.flatnonzero(to > half)
        far = far[np.lexsort((place[far], -to[far], node[far]))]
        number = 0
        while len(far):
            number += 1
            first = np.concatenate([[True], node[far[1:]] != node[far[:-1]]])
            centre = far[first][np.cumsum(first) - 1]
            d = np.sqrt(_squares(points[order[place[far]]], points[order[place[centre]]]).astype(float))
            near = d <= half[far]
            child[far[near]], to[far[near]] = number, d[near]
            far = far[~near]
        # A centre stands first among its child's points: ties in distance go by place, and a child's centre has zero.
        by = np.lexsort((place, to, child, node))
        order[place], distance[place] = order[place[by]], to[by]
        node, child = node[by], child[by]
        new = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (child[1:] != child[:-1])])) if len(node) else np.zeros(0, np.int64)
        count = np.bincount(node[new], minlength=len(begin))
        nodes["begin"].append(begin)
        nodes["end"].append(end)
        nodes["radius"].append(radius)
        nodes["children"].append(count)
        nodes["child"].append(made + np.cumsum(count) - count)
        made += len(new)
        begin, end = place[new], place[np.append(new[1:], len(node)) - 1] + 1 if len(new) else place[new]
        radius = np.maximum.reduceat(distance[place], new) if len(new) else np.zeros(0)
    tree = {k: np.concatenate(v) for k, v in nodes.items()}
    return {"order": order.astype(np.int32), "points": points[order].astype(np.int32), **{k: tree[k].astype(np.int32) for k in ("begin", "end", "child", "children")}, "radius": tree["radius"]}


def assign(tree: dict[str, np.ndarray], entries: np.ndarray, codes: bool = False):
    """Count and sum of the points nearest to each entry (ties to the first), or each point's entry and squared distance."""
    points = tree["points"].astype(np.int64)
    m, n = len(entries), len(points)
    begin, end, child, children, radius = (tree[k] for k in _FIELDS[2:])
    upto = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0)])
    count, total, code = np.zeros(m, np.int64), np.zeros((m, points.shape[1]), np.int64), np.zeros(n, np.int64)
    node, open_ = np.array([0]), np.ones((1, m), bool)

    def give(a: np.ndarray, b: np.ndarray, entry: np.ndarray) -> None:
        """Points a:b go to ``entry``."""
        if codes:
            size = b - a
            code[np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())] = np.repeat(entry, size)
        else:
            np.add.at(count, entry, b - a)
            np.add.at(total, entry, upto[b] - upto[a])

    far = np.iinfo(np.int64).max
    while len(node):
        exact = np.where(open_, _squares(points[begin[node]][:, None], entries[None]), far)
        d = np.sqrt(exact.astype(float))
        # Rounding never drops an entry: the bound is wider than the error of the roots.
        bound = (d.min(axis=1) + 2 * radius[node]) * (1 + 1e-12) + 1e-9
        open_ &= d <= bound[:, None]
        sure = (open_.sum(axis=1) == 1) | (radius[node] == 0)
        give(begin[node[sure]], end[node[sure]], np.where(open_, exact, far)[sure].argmin(axis=1))
        leaf = ~sure & (children[node] == 0)
        if leaf.any():
            size = (end - begin)[node[leaf]]
            at = np.repeat(begin[node[leaf]] - np.cumsum(size) + size, size) + np.arange(size.sum())
            among = np.repeat(open_[leaf], size, axis=0)
            give(at, at + 1, np.where(among, _squares(points[at][:, None], entries[None]), far).argmin(axis=1))
        down = ~sure & ~leaf
        size = children[node[down]]
        open_ = np.repeat(open_[down], size, axis=0)
        node = np.repeat(child[node[down]] - np.cumsum(size) + size, size) + np.arange(size.sum())
    if not codes:
        return count, total
    back = np.empty(n, np.int64)
    back[tree["order"]] = code
    error = np.empty(n, np.int64)
    error[tree["order"]] = _squares(points, entries[code])
    return back, error


def _loaded(value: dict) -> dict[str, np.ndarray]:
    kinds = {"radius": np.float64}
    tree = {f: np.frombuffer(value[f], kinds.get(f, np.int32)) for f in _FIELDS}
    return tree | {"points": tree["points"].reshape(len(tree["order"]), -1)}


def _grow(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def chunk(rows: pa.Table) -> pa.RecordBatch:
            vectors = rows.column("vector").combine_chunks()
            flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            width = flat.shape[1] // parts
            trees = [cover_tree(flat[:, p * width : (p + 1) * width]) for p in range(parts)]
            column = pa.array([[{f: t[f].tobytes() for f in _FIELDS} for t in trees]], pa.list_(_BINARY))
            ids, labels = (pa.array([rows.column(c).to_pylist()], pa.list_(t)) for c, t in (("id", pa.int64()), ("label", pa.string())))
            return pa.RecordBatch.from_arrays([ids, labels, column], ["ids", "labels", "trees"])

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count >= CHUNK:
                rows = pa.Table.from_batches(held).combine_chunks()
                yield chunk(rows.slice(0, CHUNK))
                held, count = rows.slice(CHUNK).to_batches(), count - CHUNK
        if count:
            yield chunk(pa.Table.from_batches(held).combine_chunks())

    return run


def whole_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """id, label (as text), vector of floor(scale * x), where the vector and all its components are known and finite."""
    x = F.col(embedding).cast("array<double>")
    known = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.filter(known).select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), x.alias("_x"))
    limit = F.lit(float(LARGEST))
    number = lambda v: F.when(F.abs(v * scale) < limit, F.floor(v * scale)).otherwise(F.raise_error(F.lit(f"a component of {LARGEST // scale} or more")))
    return rows.select("id", "label", F.transform("_x", number).alias("vector"))


def seeds(rows: DataFrame, entries: int = ENTRIES, parts: int = PARTS) -> list[np.ndarray]:
    """For each part the parts of the first ``entries`` vectors by id (null last, equal ids by vector)."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not first:
        return []
    size = len(first[0]["vector"])
    if size % parts or any(len(r["vector"]) != size for r in first):
        raise ValueError(f"vectors must have equally many components, in {parts} equal parts; the first has {size}")
    table = np.array([r["vector"] for r in first], np.int64)
    return list(table.reshape(len(table), parts, -1).transpose(1, 0, 2))


def grown(rows: DataFrame, size: int, parts: int = PARTS) -> DataFrame:
    """Staged trees, a row for each chunk; ends the job if a vector isn't of ``size`` components."""
    odd = F.raise_error(F.lit(f"a vector that hasn't {size} components"))
    checked = rows.withColumn("vector", F.when(F.size("vector") == size, F.col("vector")).otherwise(odd))
    return stage(in_batches(checked, _grow(parts), f"ids array<long>, labels array<string>, trees {_TREE}"), "trees")


def lloyd(trees: DataFrame, books: Sequence[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after ``rounds``: each entry becomes the floor of the mean of its parts; unused ones stay."""
    books = [np.array(b) for b in books]

    def sums(now: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = [np.zeros(len(b), np.int64) for b in now]
            totals = [np.zeros(b.shape, np.int64) for b in now]
            for batch in batches:
                for chunk in batch.column("trees"):
                    for p, tree in enumerate(chunk):
                        count, total = assign(_loaded(tree.as_py()), now[p])
                        counts[p] += count
                        totals[p] += total
            part, entry, at = (x.ravel() for x in np.indices((len(now), *now[0].shape)))
            rows = [part, entry, at, np.stack(counts)[part, entry], np.stack(totals).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["part", "entry", "at", "n", "total"])

        return run

    for _ in range(rounds if books else 0):
        found = in_batches(trees.select("trees"), sums(books), "part long, entry long, at long, n long, total long")
        # As many rows as the codebooks have numbers.
        for r in found.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).filter("n > 0").collect():
            books[r["part"]][r["entry"], r["at"]] = r["total"] // r["n"]
    return books


def assigned(trees: DataFrame, books: Sequence[np.ndarray]) -> DataFrame:
    """id, label, code (an entry for each part), error (squared distance to the entries) of each vector."""
    books = list(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, chunk in zip(*(batch.column(c) for c in ("ids", "labels", "trees"))):
                found = [assign(_loaded(tree.as_py()), book, True) for tree, book in zip(chunk, books)]
                code, error = np.stack([c for c, _ in found], axis=1), sum(e for _, e in found)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(code) + 1) * len(books), pa.int32()), pa.array(code.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, lists, pa.array(error)], ["id", "label", "code", "error"])

    return in_batches(trees, run, "id long, label string, code array<int>, error long")


def compressed(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (error summed over equal labels), codebooks_sha256.

    Vectors that are null or hold a null, NaN or infinite component are left out; null labels are a label, null ids come
    last among the seeds, repeated rows count each. Fewer vectors than ``entries`` make smaller codebooks, none give no
    rows. Equally near entries: the lower one. All arithmetic is on integers. A vector of another length than the first,
    a length that ``parts`` doesn't divide, or a component of 32,768 or more ends the job.
    """
    rows = stage(whole_vectors(vectors, vec_id, embedding, label, scale), "vectors")
    books = seeds(rows, entries, parts)
    trees = grown(rows, sum(b.shape[1] for b in books), parts)
    books = lloyd(trees, books, rounds)
    numbers = ",".join(str(x) for b in books for x in b.ravel())
    coded = stage(assigned(trees, books), "codes")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        F.col("id").alias("vec_id"),
        F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "").alias("code"),
        "error",
        "label_error",
        F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256"),
    )
