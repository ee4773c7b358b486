import hashlib
import random
import zlib
from collections import Counter

import duckdb
import pytest

from sluice.llm import prefix_trie as P

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuild(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(own)] for c, own in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + own[h:]
    return out


def brute(convs):
    """Every prefix as a tuple of turns."""
    members = {}
    for c, own in convs.items():
        for d in range(len(own) + 1):
            members.setdefault(tuple(own[:d]), []).append(c)
    kids = Counter(x[:-1] for x in members if x)
    leaves, saved = Counter(), Counter()
    for x, own in members.items():
        for d in range(len(x) + 1):
            leaves[x[:d]] += x not in kids
            saved[x[:d]] += (len(own) - 1) * len(x[-1][1].encode()) if x else 0
    return Counter((min(own), len(x), min(members[x[:-1]]) if x else None, len(own), kids[x], leaves[x], saved[x], hashlib.sha256(",".join(str(c) for c in sorted(own) if len(convs[c]) == len(x)).encode()).hexdigest()) for x, own in members.items())


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)


def run(spark, rows, bits=64):
    turns, convs = P.share_heads(frame(spark, rows))
    return Counter(tuple(r[c] for c in COLUMNS) for r in P.prefix_trie(turns, convs, ["own", "depth"], bits).collect())


def made(rng, convs, most):
    return [(c, t if rng.random() < 0.9 else rng.choice([None, 1]), rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None, "long text " * 3])) for c in convs for t in range(rng.randint(1, most))]


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = made(rng, [*range(60), -1, -2, -5, -7, 103, 1007], 12) + made(rng, [13], 90)
    rows += [(None, 0, "user", "x"), (0, 0, "user", "a"), (0, 0, "user", "a")]
    assert run(spark, rows) == brute(rebuild(rows))


@pytest.mark.parametrize("bits", [1, 4])
def test_collisions_are_split(spark, bits):
    rng = random.Random(2)
    rows = made(rng, range(40), 7)
    assert run(spark, rows, bits) == brute(rebuild(rows))


def test_long_conversations_span_partitions(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_DEPTHS", 16)
    monkeypatch.setattr(P, "CHUNK_BYTES", 8)
    rng = random.Random(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(c, t, "user", rng.choice("ab")) for c in range(0, 400, 5) for t in range(3)] + [(c, t, "user", f"t{t % 7}") for c in (7, 1000, 1001) for t in range(700)]
        assert run(spark, rows) == brute(rebuild(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_groups_of_equal_conversations(spark):
    rows = [(c, t, "user", "same") for c in range(0, 1500, 5) for t in range(3)] + [(c, 0, "system", "x") for c in range(1, 300, 5)]
    assert run(spark, rows) == brute(rebuild(rows))


def test_empty_and_turnless(spark):
    assert run(spark, []) == Counter()
    turnless = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(turnless, 0, "user", "gone")]
    assert run(spark, rows) == brute(rebuild(rows)) and len(brute(rebuild(rows))) == 1


def test_extra_columns_with_clashing_names(spark):
    rows = made(random.Random(4), range(12), 6)
    df = frame(spark, rows)
    for name in ("depth", "own", "print", "_part", "path", "k"):
        df = df.selectExpr("*", f"'x' AS {name}")
    turns, convs = P.share_heads(df)
    assert Counter(tuple(r[c] for c in COLUMNS) for r in P.prefix_trie(turns, convs, ["own", "depth"]).collect()) == brute(rebuild(rows))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '/root/testdata/{sf}/conversations.parquet'")
    want = con.sql(P.OP13_SQL)
    got = P.op13_prefix_trie(spark, f"/root/testdata/{sf}")
    assert sorted(got.columns) == sorted(want.columns) == sorted(COLUMNS)
    assert Counter(tuple(r[c] for c in want.columns) for r in got.collect()) == Counter(want.fetchall())
