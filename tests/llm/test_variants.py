import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from opsmetrics.llm import variants as V
from opsmetrics.llm.registry import ORACLE, QUERIES

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return Counter({w: k for w, k in n.items() if len(w) >= 6})


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(n):
    form, rows = {}, {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
        rows[w] = len(others)
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], rows[w], n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_neighbours_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice("aabé"[: rnd.choice((2, 4))]) for _ in range(rnd.randint(6, 8))): rnd.choice((5, 5, 6, 25, 30, 126, 700, 5000)) for _ in range(120)}
    words |= {"aaaaaa": 9, "aaaaaaa": 9, "aaaaaaaa": 200, "lonely": 7, "ÿÿÿÿÿÿ": 5, "zebras": 25, "zebra$"[:5] + "xs": 5}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(4)
    assert result(V.variants(df)) == brute(Counter(words))


def test_roots_of_long_chains(spark):
    chain = ["aaaaaa" + "b" * k for k in range(9)]
    df = spark.createDataFrame([(w, 5 ** (k + 1)) for k, w in enumerate(chain)], "word string, n bigint")
    assert {r.word: r.root for r in V.variants(df).collect()} == {w: chain[-1] for w in chain}


def test_runs_and_digests():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("aZé×ÿ¿ŀ 1中😀'") for _ in range(rnd.randint(0, 30))) for _ in range(800)] + ["", "é", "", "x" * 500]
    data, start, end, size, row = V.runs(pa.array(texts, pa.large_string()))
    got = [(k, data[x:y].tobytes().decode()) for k, x, y in zip(row.tolist(), start.tolist(), end.tolist())]
    assert got == [(k, w.translate(SMALL)) for k, t in enumerate(texts) for w in re.findall("[A-Za-zÀ-ÿ]+", t)]
    assert size.tolist() == [len(w) for _, w in got]
    seed = np.array([zlib.crc32(f"{k}:".encode()) for k, _ in got], dtype=np.uint32)
    assert V.crcs(seed, data, start, end).tolist() == [zlib.crc32(f"{k}:{w}".encode()) for k, w in got]


def texts(seed, count=300):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(5, 8))) for _ in range(25)]
    rows = []
    for i in range(count):
        words = []
        for _ in range(rnd.randint(0, 60)):
            w = rnd.choice(base[: rnd.choice((3, 25))])
            if rnd.random() < 0.1:
                k = rnd.randrange(len(w))
                w = w[:k] + rnd.choice("abÀ") + w[k + rnd.randint(0, 1) :]
            words.append(w.upper() if rnd.random() < 0.2 else w)
        rows.append((i, " ".join(words)))
    return rows


def test_query_against_brute_force_and_sql(spark, docs, folder):
    import duckdb

    rows = texts(1) + [(None, "nullid nullid nullid nullid nullid Nullid"), (3, None), (4, ""), (7, "repeated " * 6), (7, "repeated " * 6), (8, "y" * 3000 + "," + "longer" * 400)]
    path = folder(documents=docs(rows, 6).selectExpr("*", "1 AS word", "'x' AS n"))
    wanted = brute(Counter({w: k for w, k in counted(rows).items() if k >= 5}))
    assert any(r[1] for r in wanted) and len(wanted) > 50
    assert result(QUERIES["op13_spelling_variants"](spark, path)) == wanted
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS FROM '{path}/documents.parquet/*.parquet'")
    theirs = duck.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE['op13_spelling_variants']})").fetchall()
    assert sorted(theirs, key=str) == wanted


def test_tables_handed_on_early_give_the_same(spark, docs, monkeypatch):
    rows = texts(5, 80)
    df = docs(rows)
    monkeypatch.setattr(V, "HELD", 5)
    monkeypatch.setattr(V, "slices", lambda batches, f=V.slices: f(batches, limit=200))
    assert {r.word: r.n for r in V.word_counts(df).collect()} == dict(counted(rows))


def test_empty(spark, docs, folder):
    got = QUERIES["op13_spelling_variants"](spark, folder(documents=docs([], 1)))
    assert got.columns == COLUMNS and got.count() == 0
