import binascii
import hashlib
import random
import re

import pytest
from pyspark.sql import types as T

from opsmetrics.llm import prefixtrie as X
from opsmetrics.llm.registry import ORACLE, QUERIES

ROWS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    def mark(role, text):
        return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()

    held = {}
    for c, turn, role, text in rows:
        if c is not None:
            held.setdefault(c, []).append((turn is not None, turn or 0, role or "", mark(role or "", text or ""), text or ""))
    return {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in held.items()}


def rebuilt(held):
    out = {}
    for c, own in held.items():
        h = binascii.crc32(str(c).encode()) % 4
        out[c] = held.get(c - c % 20, [])[:h] + own[h:]
    return out


def brute(held):
    members, ends = {}, {}
    for c, turns in held.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    rows = []
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(z) == len(q) + 1 and z[: len(q)] == q for z in below)]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        rows.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(children), len(leaves), saved,
                     hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()))
    return sorted(rows, key=str)


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.fixture
def table_of(spark):
    return lambda rows, parts=5: spark.createDataFrame(rows, ROWS).repartition(parts)


def some(seed, convs=45, deepest=9):
    rnd = random.Random(seed)
    rows = []
    for c in range(convs):
        if c == 20:
            continue  # a head that is absent
        for turn in range(rnd.randint(1, deepest)):
            rows.append((c, turn, rnd.choice(["user", "assistant"]) if turn > 1 else "user", rnd.choice(["a", "b b", "", "c\tc c", None]) if turn else "same"))
    return rows


def test_rebuilt_against_brute_force(spark, table_of, folder):
    rows = some(1) + [(3, None, "system", "first"), (7, 1, "user", "tie"), (7, 1, "user", "tie"), (7, 1, "aide", "tie"), (8, 2, None, None), (None, 1, "user", "no id"), (None, None, None, None)]
    path = folder(conversations=table_of(rows).selectExpr("*", "1 AS depth", "'x' AS name", "2 AS words"))
    got = QUERIES["op12_prefix_trie"](spark, path)
    assert got.columns == COLUMNS
    assert result(got) == brute(rebuilt(ordered(rows)))


def test_turnless_conversations_are_members_of_the_root(spark, table_of, folder):
    short = next(c for c in range(21, 40) if binascii.crc32(str(c).encode()) % 4 >= 2)
    rows = [(short, 0, "user", "alone")]
    got = result(QUERIES["op12_prefix_trie"](spark, folder(conversations=table_of(rows))))
    assert got == [(short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())]


def test_as_they_are_with_one_long_and_many_equal(table_of):
    rnd = random.Random(4)
    long = [(1, t, "user", rnd.choice("xyz")) for t in range(150)]
    near = [(2, t, r, x) for _, t, r, x in long[:97]] + [(2, 97, "user", "other words here")] + [(2, t, "user", "w") for t in range(98, 131)]
    rows = long + near + [(c, t, "user", x) for c in range(10, 200) for t, x in enumerate(("hello there", "yes"))]
    held = ordered(rows)
    assert result(X.prefix_trie(table_of(rows))) == brute(held)


def test_a_conversation_over_many_partitions(spark, table_of):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        rows = [(5, t, "user", str(t % 3)) for t in range(400)] + [(c, 0, "user", "0") for c in range(6, 30)]
        turns, sizes = X.numbered(table_of(rows))
        assert sorted((r.conv, r["at"]) for r in turns.collect()) == sorted([(5, t) for t in range(400)] + [(c, 0) for c in range(6, 30)])
        assert {r.conv: r.turns for r in sizes.collect()} == {5: 400} | {c: 1 for c in range(6, 30)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_many_members_of_one_node(spark):
    ends = spark.range(60_000).selectExpr("2L AS depth", "unhex(md5(cast(id % 2 as string))) AS name", "id AS conv").repartition(9)
    got = {bytes(r.name): r.ends_sha256 for r in X.member_digests(ends).collect()}
    for k in (0, 1):
        wanted = hashlib.sha256(",".join(map(str, range(k, 60_000, 2))).encode()).hexdigest()
        assert got[hashlib.md5(str(k).encode()).digest()] == wanted


def test_empty_and_sql(spark, table_of, folder):
    import duckdb

    path = folder(conversations=table_of([], 1))
    assert QUERIES["op12_prefix_trie"](spark, path).count() == 0
    rows = some(9, 70)
    path = folder(conversations=table_of(rows))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS FROM '{path}/conversations.parquet/*.parquet'")
    theirs = duck.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE['op12_prefix_trie']})").fetchall()
    assert result(QUERIES["op12_prefix_trie"](spark, path)) == sorted(theirs, key=str) == brute(rebuilt(ordered(rows)))
