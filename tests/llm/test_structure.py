import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from tidemark.llm import structure
from tidemark.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, key string, pos int"
GOES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
EMPTY = hashlib.sha256(b"").hexdigest()


def hurt(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(name.encode()) % 20
        if fault == 1:
            text = ""
        elif fault == 2:
            text = re.sub("[.!?]", "", text)
        elif fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def mend(rows):
    """The cheapest edits by trying all, least audit first; rows: (role, text, must go, truncated)."""

    @cache
    def best(i, state):
        options = []
        if i == len(rows) and state in (0, 3):
            options.append((0, "", ()))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            cost, audit, lines = best(i + 1, state)
            options.append((2 + cost, "D" + audit, lines))
            choices = [] if gone else [("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")]
            for letter, price, new in choices:
                if (after := GOES.get((state, new[:1]))) is not None:
                    cost, audit, lines = best(i + 1, after)
                    options.append((cost + price + 5 * cut, letter + audit, (f"{new}:{text}", *lines)))
        for new in ("user", "assistant"):
            after = GOES.get((state, new[0]))
            # Inserting twice and being where one was never pays.
            if after is not None and (state != 3 or i < len(rows)):
                cost, audit, lines = inserted(i, after, 1)
                options.append((5 + cost, "I" + audit, (f"{new}:", *lines)))
        return min(options, key=lambda o: o[:2])

    @cache
    def inserted(i, state, depth):
        """Best from here after ``depth`` rows put in, at most two in a row."""
        options = []
        if i == len(rows) and state in (0, 3):
            options.append((0, "", ()))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            cost, audit, lines = best(i + 1, state)
            options.append((2 + cost, "D" + audit, lines))
            for letter, price, new in [] if gone else [("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")]:
                if (after := GOES.get((state, new[:1]))) is not None:
                    cost, audit, lines = best(i + 1, after)
                    options.append((cost + price + 5 * cut, letter + audit, (f"{new}:{text}", *lines)))
        if depth < 2:
            new = "assistant" if state == 2 else "user"
            cost, audit, lines = inserted(i, GOES[state, new[0]], depth + 1)
            options.append((5 + cost, "I" + audit, (f"{new}:", *lines)))
        return min(options, key=lambda o: o[:2], default=(10**9, "", ()))

    return best(0, 0)


def brute(every, rows):
    out = []
    for conv in {r[0] for r in every}:
        same = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).hexdigest()
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, same(r)))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, kinds = set(), []
        for _, _, role, text in mine:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            kinds.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, lines = mend(tuple((r[2], r[3], k in ("blank", "duplicate"), k == "truncated") for r, k in zip(mine, kinds)))
        out.append((conv, gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    names = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def talks(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(0, 14)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "agent"])
            if rng.random() < 0.7:
                role = ("user", "assistant")[turn % 2]
            text = rng.choice(["Yes.", "no", "What? ", "\t\n", "", None, "Long! \x0b", f"{turn}.", f"é{rng.random()}."])
            rows.append((rng.choice([conv] * 9 + [None]), rng.choice([turn * 2] * 5 + [None, turn]), role, text, "k", 1))
    return rows


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, "", 0), (None, None, "user", "a.", "", 0)], [(3, 0, "system", "s.", "", 0)] * 3])
def test_small(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x, *_ in rows]
    assert found(structure.report(df)) == brute(rows, plain)
    assert found(structure.report(df, structure.damaged(df))) == brute(rows, hurt(rows))


@pytest.mark.parametrize("seed,least", [(1, 64), (2, 2), (3, 4)])
def test_against_brute_force(spark, monkeypatch, seed, least):
    monkeypatch.setattr(structure, "LEAST", least)
    monkeypatch.setattr(structure.math, "isqrt", lambda n: 1)
    rows = talks(seed, 60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(structure.report(df, structure.damaged(df))) == brute(rows, hurt(rows))


def test_hot_conversation(spark, monkeypatch):
    """One conversation of many rows, in many blocks and across the cuts of the sort."""
    rng = random.Random(5)
    monkeypatch.setattr(structure, "LEAST", 2)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Yes.", f"{t}.", "cut", f"{t}"]), "", 0) for t in range(400)]
    rows += [(8, t, ("user", "assistant")[t % 2], f"{t}.", "", 0) for t in range(6)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = found(structure.report(df))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rows, [r[:4] for r in rows])


def test_long_text_and_rows(spark):
    """Repaired rows are legal and keep their texts, very long ones too."""
    long = "word " * 400_000 + "end."
    rows = [(1, 0, "assistant", long), (1, 1, "user", "Hello."), (1, 2, "tool", "there"), (2, 0, "system", "s.")]
    got = structure.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "pos", "place").collect()
    first = [(r["role"], r["text"], r["edit"]) for r in got if r["conv_id"] == 1]
    assert "".join(r[0][0] for r in first) in ("ua", "uaua") and (long in [t for _, t, _ in first] or len(first) == 2)
    assert not [r for r in got if r["conv_id"] == 2]


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op11_checkpointed_repair"](spark, sf)) == brute(rows, hurt(rows))


def test_damage(spark):
    rows = talks(11, 30)
    got = structure.damaged(spark.createDataFrame(rows, SCHEMA)).select("conv_id", "turn", "role", "text")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, hurt(rows)))
    assert got.filter(F.col("text").isNull()).isEmpty()
