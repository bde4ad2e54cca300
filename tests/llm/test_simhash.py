import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tidemark.llm import components, simhash
from tidemark.llm.queries import QUERIES


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, near):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def brute(rows, radius=4):
    fps = [plain_fingerprint(t) for _, t in rows]
    distinct = sorted(set(fps))
    root = roots(distinct, lambda a, b: (a ^ b).bit_count() <= radius)
    ids = defaultdict(list)
    for (i, _), fp in zip(rows, fps):
        if i is not None:
            ids[root[fp]].append(i)
    return sorted(((i, f"{fp:016x}", min(ids[root[fp]], default=None)) for (i, _), fp in zip(rows, fps)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("text", ["", " \t\n", "One", "A b C", "a b c d", "É Ü x Y z ß " * 30, "a\x1cb c\x85d e f g", "tick tock " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert found(QUERIES["op10_simhash_near_dedup"](spark, sf)) == brute(rows)


@pytest.mark.parametrize("cell", [2, 7, 4096])
def test_ties_nulls_and_hot_keys(spark, cell):
    words = "the quick brown fox jumps over the lazy dog while one small bird sings in a very old tree near our house".split()
    rows = [(None, None), (3, ""), (2, " "), (9, "x"), (9, "x"), (None, "alone here"), (1, " ".join(words))]
    rows += [(100 + i, " ".join(words * 6 + [f"w{i}"])) for i in range(60)] + [(50, "X")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fp string").repartition(4)
    assert found(simhash.near_groups(docs, cell=cell)) == brute(rows)
    left = simhash.drop_near_copies(docs, cell=cell)
    assert left.columns == docs.columns
    kept = [r.doc_id for r in left.collect()]
    assert len(kept) == len({c for *_, c in brute([r for r in rows if r[0] is not None])}) + 1  # and the one without id


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert found(simhash.near_groups(docs)) == [] and simhash.drop_near_copies(docs).count() == 0


def test_links_connect_what_is_near(spark):
    random = np.random.default_rng(5)
    centres = random.integers(0, 2**63, 12).astype(np.uint64)
    fps = centres[random.integers(0, 12, 400)]
    for _ in range(4):
        fps = fps ^ (np.uint64(1) << random.integers(0, 64, 400).astype(np.uint64))
    fps = sorted({int(x) for x in fps})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    star = components.stars(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), cell=50))
    got = {x: x for x in signed} | {r.node: r.root for r in star.collect()}
    want = roots(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    assert len({(got[x], want[x]) for x in signed}) == len(set(got.values())) == len(set(want.values()))


def test_keys_are_long_enough_and_cover_all_choices():
    for n, count in ((10, 5), (200_000, 5), (15_000_000, 15), (5 * 10**10, 70)):
        masks = simhash.keys_for(n)
        assert len(masks) == count
        for bits in ([0, 1, 2, 3], [0, 20, 40, 63], [5, 30, 31, 62]):
            changed = sum(1 << b for b in bits)
            assert any(m & changed == 0 for m in masks)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 400)], "a long, b long")
    got = {r.node: r.root for r in components.stars(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {500: 400}
