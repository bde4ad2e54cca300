import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tidemark.llm import sharding
from tidemark.llm.queries import QUERIES
from tidemark.session import new_path


def spread(sizes, shards, to):
    sums = [0] * shards
    for s, k in zip(sizes, to):
        sums[k] += s
    return max(sums) - min(sums)


def test_differencing_by_hand_and_against_the_best():
    # 8,7,6,5,4 in two: 8-7, 6-5, then 4-1, then 3-1 leaves 2.
    assert spread([8, 7, 6, 5, 4], 2, sharding.karmarkar_karp([8, 7, 6, 5, 4], 2)) == 2
    r = random.Random(1)
    for _ in range(30):
        sizes = [r.randint(1, 50) for _ in range(7)]
        best = min(spread(sizes, 3, to) for to in itertools.product(range(3), repeat=7))
        assert spread(sizes, 3, sharding.karmarkar_karp(sizes, 3)) <= best + max(sizes)
    many = [r.randint(1, 10_000) for _ in range(2000)]
    assert spread(many, 8, sharding.karmarkar_karp(many, 8)) <= 8
    assert sharding.karmarkar_karp([], 8) == [] and len(set(sharding.karmarkar_karp([5] * 8, 8))) == 8


def holds(rows, got, shards=8):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert {(r.law, r.grown_shard) for r in got} <= {("bytes", None)}
    slots, groups = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        groups[r.size, r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(g) == 1 for g in groups.values())
    sums = Counter()
    for r in got:
        sums[r.shard] += r.size
    return [sums[k] for k in range(shards)]


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    sums = holds(rows, QUERIES["op5_karmarkar_karp"](spark, sf).collect())
    sizes = Counter()
    for _, t in rows:
        sizes[t] += len(t.encode()) + 1
    assert max(sums) - min(sums) <= max(sizes.values())


@pytest.mark.parametrize("bundles", [4, 64, 4096])
def test_hot_group_nulls_and_repeats(spark, bundles):
    rows = [(i, "hot text") for i in range(400)] + [(i, "a" * (i % 37)) for i in range(600)] + [(None, None), (7, None), (7, ""), (7, "")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, shard int").repartition(4)
    sums = holds(rows, sharding.shard_bytes(docs, bundles=bundles).collect())
    if bundles == 4096:
        hot = 400 * 9
        assert max(sums) == max(hot, max(sums)) and max(sums) <= hot + 1


def test_no_rows(spark):
    assert sharding.shard_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_written_shards(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 9)) for i in range(200)], "doc_id long, text string")
    path = new_path(spark, "shards")
    sharding.write_shards(docs, path, shards=3)
    back = spark.read.parquet(path)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((r.doc_id, r.text) for r in docs.collect())
    assert {r.shard for r in back.collect()} == {0, 1, 2}
