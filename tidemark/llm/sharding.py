"""Shards of nearly equal bytes for groups that must not be torn apart, by Karmarkar-Karp differencing.

Documents with equal texts are a group. Groups above a fixed share of all bytes stand alone (there are fewer of
them than ``1 / share``); the others are bundled by hash into as many bundles. So at most twice that number of
sizes, however large the corpus, is differenced: each size is a partial partition, and the two with the largest
spread are combined in opposite order until one is left.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import with_rows
from tidemark.session import stage

SHARDS, BUNDLES = 8, 4096
#: Rows of a cell within which slots are counted one by one, and the least number of cells of a shard.
CELL_ROWS, CELLS = 100_000, 64


def karmarkar_karp(sizes: list[int], shards: int) -> list[int]:
    """A shard for each size; partial partitions are sums in falling order with the places they hold."""
    heap = []
    for i, size in enumerate(sizes):
        heap.append((-size, i, [size] + [0] * (shards - 1), [[i]] + [[] for _ in range(shards - 1)]))
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, sums, places = heapq.heappop(heap)
        _, _, others, more = heapq.heappop(heap)
        joined = [(a + b, *(sorted((p, q), key=len))) for a, b, p, q in zip(sums, reversed(others), places, reversed(more))]
        joined.sort(key=lambda x: -x[0])
        for _, few, many in joined:
            many.extend(few)
        count += 1
        heapq.heappush(heap, (joined[-1][0] - joined[0][0], count, [x[0] for x in joined], [x[2] for x in joined]))
    out = [0] * len(sizes)
    for shard, members in enumerate(heap[0][3] if heap else []):
        for i in members:
            out[i] = shard
    return out


def _placed(rows: DataFrame, shards: int, bundles: int) -> DataFrame:
    """``rows`` (staged: row, group, size, more) with shard, cell and slot."""
    spark = rows.sparkSession
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    groups = stage(rows.groupBy("group").agg(F.sum("size").alias("bytes")), "groups")
    bundle = F.pmod(F.xxhash64("group"), F.lit(bundles)).cast("int")
    alone = F.col("bytes") * bundles > F.lit(total)
    # Both lists have at most ``bundles`` entries: the groups that stand alone have more than 1 / bundles of all bytes each.
    large = sorted((x["bytes"], bytes(x["group"])) for x in groups.filter(alone).collect())
    small = sorted((x["bytes"], x["bundle"]) for x in groups.filter(~alone).groupBy(bundle.alias("bundle")).agg(F.sum("bytes").alias("bytes")).collect())
    shard_of = karmarkar_karp([b for b, _ in large + small], shards)
    groups_to = [(bytearray(g), s) for (_, g), s in zip(large, shard_of)]
    bundles_to = [(b, s) for (_, b), s in zip(small, shard_of[len(large) :])]
    by_group = spark.createDataFrame(groups_to, "group binary, alone int")
    by_bundle = spark.createDataFrame(bundles_to, "bundle int, bundled int")
    out = rows.withColumn("bundle", bundle).join(F.broadcast(by_group), "group", "left").join(F.broadcast(by_bundle), "bundle", "left")
    out = out.withColumn("shard", F.coalesce("alone", "bundled")).drop("bundle", "alone", "bundled")
    # Slots: rows before the cell in its shard, and rows before in the cell.
    cells = max(CELLS, -(-count // CELL_ROWS))
    out = stage(out.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)).cast("int")), "shards")
    counts = out.groupBy("shard", "cell").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("cell")) - F.col("count")
    out = out.join(counts.select("shard", "cell", before.alias("before")), ["shard", "cell"])
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("row"))
    return out.withColumn("slot", F.col("before") + within - 1).drop("before", "cell", "group")


def _measured(docs: DataFrame, row: str, text: str, more: dict) -> DataFrame:
    binary = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(
        F.col(row).alias("row"),
        F.unhex(F.sha2(binary, 256)).alias("group"),
        (F.octet_length(binary).cast("long") + 1).alias("size"),
        F.crc32(binary).alias("text_crc32"),
        *[F.col(k).alias(v) for k, v in more.items()],
    )


def shard_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, bundles: int = BUNDLES) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law (bytes), shard, slot, grown_shard (null).

    Size is the text's bytes and one; a null text has none and is in one group with empty texts. Rows with equal
    texts, repeated rows among them, share a shard; slots run from 0 without gaps in each shard.
    """
    narrow = _measured(docs.withColumn("_place", F.monotonically_increasing_id()), "_place", text, {doc_id: "doc_id"})
    placed = _placed(stage(narrow, "sizes"), shards, bundles)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, text: str = "text", shards: int = SHARDS, bundles: int = BUNDLES) -> None:
    """Write all rows below ``path``/shard=N with their slot; files of a shard hold ranges of slots in order."""
    rows = with_rows(docs, "_place")
    placed = _placed(stage(_measured(rows, "_place", text, {}), "sizes"), shards, bundles)
    joined = rows.join(placed.select(F.col("row").alias("_place"), "shard", "slot"), "_place").drop("_place")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
