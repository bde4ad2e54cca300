import random

import pytest

from tidemark.llm import decontaminate as dec
from tidemark.llm.queries import QUERIES


def least(pattern, text):
    """Least edits between the pattern and any part of the text, and the first end that reaches it."""
    row = list(range(len(pattern) + 1))
    best = []
    for j, word in enumerate(text, 1):
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != word)))
        row = new
        best.append((row[-1], j))
    return min(best, default=(len(pattern), 0))


def test_myers_against_dynamic_programming():
    r = random.Random(1)
    for _ in range(400):
        pattern = [r.choice("abc") for _ in range(r.randint(1, 80))]
        text = [r.choice("abc") for _ in range(r.randint(0, 120))]
        got = min(((d, e) for e, d in enumerate(dec.myers(pattern, text), 1)), default=(len(pattern), 0))
        assert got == least(pattern, text)


def edited(r, words, edits):
    words = list(words)
    for _ in range(edits):
        i = r.randrange(len(words))
        kind = r.choice("idr")
        if kind == "d" and len(words) > 1:
            del words[i]
        elif kind == "i":
            words.insert(i, f"new{r.randrange(99)}")
        else:
            words[i] = f"other{r.randrange(99)}"
    return words


def brute(rows, items, rate=0.2):
    out = []
    for doc_id, text in rows:
        words = dec.words_of(text)
        for item_id, item in items:
            pattern = dec.words_of(item)
            if pattern and words:
                budget = int(rate * len(pattern)) if len(pattern) >= dec.SHORT else 0
                distance, end = least(pattern, words)
                if distance <= budget:
                    out.append((doc_id, item_id, distance, len(pattern), end))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [60, 2_000_000])
def test_matches_against_all_pairs(spark, limit):
    r = random.Random(7)
    vocabulary = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(5, 40)))) for i in range(12)] + [(50, None), (51, ""), (52, "two words"), (53, "!?"), (3, "Again, again; and AGAIN we go")]
    rows = [(None, None), (1, ""), (2, "two\nWORDS"), (2, "two\nWORDS"), (3, "two other words")]
    for i in range(120):
        words = r.choices(vocabulary, k=r.randint(0, 60))
        for _ in range(r.randint(0, 2)):
            pattern = dec.words_of(r.choice(items)[1]) or ["x"]
            words += edited(r, pattern, r.randint(0, len(pattern) // 3)) + r.choices(vocabulary, k=4)
        rows.append((100 + i, r.choice([" ", ", "]).join(words).upper()))
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, distance int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dec.matches(docs, bench, limit=limit)
    assert sorted(((x.doc_id, x.item_id, x.distance, x.item_words, x.end_word) for x in got.collect()), key=str) == brute(rows, items)
    for x in got.collect():
        words = dec.words_of(dict(rows)[x.doc_id])[x.start_word : x.end_word]
        pattern = next(p for p in (dec.words_of(t) for i, t in items if i == x.item_id) if len(p) == x.item_words)
        assert least(pattern, words)[0] == x.distance
    hit = {x[0] for x in brute(rows, items)}
    clean = dec.drop_contaminated(docs, bench, limit=limit)
    assert clean.columns == docs.columns
    assert sorted((x.doc_id for x in clean.collect()), key=str) == sorted((i for i, _ in rows if i not in hit), key=str)


def test_no_rows_and_no_items(spark):
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert dec.matches(docs, bench.limit(0)).count() == dec.matches(docs.limit(0), bench).count() == 0
    assert dec.drop_contaminated(docs, bench.limit(0)).count() == 1 and dec.matches(docs, bench).count() == 1


def test_query_finds_what_contains_an_item(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    plain = lambda t: f" {' '.join(dec.words_of(t))} "
    want = {(d.doc_id, i.item_id) for d in docs for i in items if plain(i.text) in plain(d.text)}
    got = {(x.doc_id, x.item_id): x.distance for x in QUERIES["op3_decontaminate"](spark, sf).collect()}
    assert want and want <= {k for k, d in got.items() if d == 0}
    assert all(0 <= d for d in got.values()) and len(got) < len(docs) / 5


def test_blocks_hold_all_items_and_a_bounded_text(spark):
    items = [(i % 9, "w" * (i % 7 * 5)) for i in range(60)] + [(None, None), (3, "x" * 400), (3, "x" * 400)]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(5)
    got = list(dec.blocks(bench, "item_id", "text", 100))
    assert sorted((x for block in got for x in block), key=str) == sorted(items, key=str)
    assert all(sum(len(t or "") for _, t in block[1:]) <= 100 for block in got) and len(got) > 10
    assert list(dec.blocks(bench.limit(0), "item_id", "text", 100)) == []


def test_a_very_long_text_is_searched_to_its_end(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, "filler words " * 200_000 + item), (2, "filler words " * 200_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(x.doc_id, x.item_id, x.distance, x.start_word) for x in dec.matches(docs, bench).collect()] == [(1, 7, 0, 400_000)]
    assert [x.doc_id for x in dec.drop_contaminated(docs, bench).collect()] == [2]
