import random
import re

import numpy as np
import pytest

from opsmetrics.llm import common, jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(texts, width, percent):
    ids = list(texts)
    sets = {i: shingles(t, width) for i, t in texts.items()}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(rng, n, near):
    vocab = [f"w{k}" for k in range(3000)]
    texts = {}
    base = [rng.choice(vocab) for _ in range(120)]
    for i in range(n):
        if i < near:  # copies of one text with few edits each
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.2:
                w = w[rng.randrange(6) :]
        elif i % 3 == 0 and i > near + 3:
            w = texts[rng.randrange(near, i)].split()
            for _ in range(rng.choice([0, 1, 2])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
        else:
            w = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 12, 20, 40, 90, 200, 600]))]
        texts[i] = " ".join(w)
    return texts


@pytest.mark.parametrize("width,percent,near", [(3, 90, 150), (5, 80, 120), (2, 50, 60)])
def test_groups_equal_brute_force(docs, width, percent, near):
    texts = corpus(random.Random(width), 330, near)
    want = brute(texts, width, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs(texts), width, percent).collect()}
    assert got == want


def test_nulls_copies_and_case(spark, docs, folder):
    long = "a b c d e " * 4000
    rows = [(5, "A b  c D"), (3, "a B c\td"), (9, None), (8, ""), (7, " \n"), (None, "a b c d"), (5, "other text here now"), (2, "one"), (4, "ONE"),
            (11, long), (12, long + "a"), (3, "a B c\td")]
    got = jaccard.op5_ngram_jaccard_join(spark, folder(documents=docs(rows))).collect()
    found = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got)
    assert found == sorted([("5", 2, 3), ("3", 2, 3), ("3", 2, 3), ("9", 0, 9), ("8", 0, 8), ("7", 0, 7), ("None", 2, 3), ("5", 2, 5), ("2", 1, 2), ("4", 1, 2),
                            ("11", 5, 11), ("12", 5, 11)])
    assert jaccard.similar_groups(docs([])).count() == 0


def test_signatures_of_similar_sets_meet():
    rng = np.random.default_rng(1)
    for percent in (50, 80, 90):
        for n in (1, 4, 5, 9, 10, 19, 20, 37, 80, 200, 700):
            for _ in range(15):
                a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
                budget = jaccard.difference(n, n, percent)
                take = int(rng.integers(0, budget + 1))
                gone = rng.choice(len(a), size=min(len(a) - 1, take - take // 2), replace=False) if take else []
                b = np.unique(np.concatenate([np.delete(a, gone), rng.integers(0, 1 << 64, take // 2, dtype=np.uint64)]))
                common = len(np.intersect1d(a, b))
                if 100 * common >= percent * (len(a) + len(b) - common):
                    assert len(np.intersect1d(jaccard.signatures(a, percent), jaccard.signatures(b, percent))), (percent, n)


def test_bands_cover_partners():
    for percent in (50, 80, 90, 99):
        edges = jaccard.bands(percent, 100_000)
        for n in list(range(1, 3000)) + [50_000, 77_777]:
            at = np.searchsorted(edges, [n, n * 100 // percent], "right")
            assert at[1] - at[0] <= 1


@pytest.mark.parametrize("percent,n_x,n_y,common,pivot_x,pivot_common", [(90, 100, 95, 93, 7, 60), (80, 100, 90, 87, 13, 12), (50, 40, 22, 21, 19, 0), (90, 95, 100, 93, 2, 60)])
def test_pairs_of_unequal_sizes_meet_around_a_pivot(spark, percent, n_x, n_y, common, pivot_x, pivot_common):
    pool = np.random.default_rng(4).integers(0, 1 << 64, 400, dtype=np.uint64).tolist()
    both, of_x, of_y = pool[:common], pool[100 : 100 + n_x - common], pool[200 : 200 + n_y - common]
    given = {1: of_x[:pivot_x] + both[:pivot_common], 2: both + of_x, 3: both + of_y}
    assert 100 * common >= percent * (n_x + n_y - common)
    frame = lambda sets: spark.createDataFrame(
        [(k, np.sort(np.array(v, np.uint64)).view(np.int64).tolist()) for k, v in sets.items()], "node bigint, elements array<bigint>")
    sets = frame(given)
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "p bigint, x bigint")
    stars = jaccard._against_pivot(jaccard._both_sets(pairs, sets), percent)
    roots = spark.createDataFrame([], "node bigint, root bigint")
    assert [tuple(r) for r in jaccard._around_pivots(stars, roots, sets, percent).collect()] == [(2, 3)]


def test_each_pair_shares_a_part():
    """Whatever the sizes and distances of a similar pair, both are near the pivot or both are far from it."""
    for percent in (50, 67, 80, 90, 99):
        h = lambda n: jaccard.difference(n, n * 100 // percent, percent)
        limit = lambda n: 4 * h(-(-n * percent // 100)) - h(n)
        for n in range(1, 300):
            for other in range(-(-n * percent // 100), n + 1):
                most = jaccard.difference(n, other, percent)
                for a, b in ((n, other), (other, n)):
                    d = 4 * h(a) + 1  # the least distance that is not near; the partner's is smaller by ``most`` or less
                    assert d > limit(a) and d - most > limit(b)


def test_similar_sets_share_enough_leading_elements():
    rng = np.random.default_rng(8)
    for percent in (50, 80, 90):
        for n in (1, 2, 5, 9, 10, 11, 19, 40, 99, 300):
            for _ in range(20):
                a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
                gone = int(rng.integers(0, n * (100 - percent) // 100 + 1))
                new = int(rng.integers(0, n * (100 - percent) // percent + 1))
                b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 64, new, dtype=np.uint64)]))
                common = len(np.intersect1d(a, b))
                if not common or 100 * common < percent * (len(a) + len(b) - common):
                    continue
                met = len(np.intersect1d(jaccard.leaders(a, percent), jaccard.leaders(b, percent)))
                for s in (a, b):
                    assert met >= jaccard.shared_leaders(-(-len(s) * percent // 100), percent), (percent, n)


@pytest.mark.parametrize("together", [1, 50, 1 << 18])
def test_hopeful_sets_are_counted_alike_however_many_are_held(spark, docs, monkeypatch, together):
    monkeypatch.setattr(jaccard, "TOGETHER", together)
    texts = corpus(random.Random(5), 120, 40)
    frame = docs(texts).repartition(3)
    sets = {}
    for t in texts.values():
        for s in [jaccard.set_of(jaccard.Words(jaccard.pa.array([t], jaccard.pa.large_string()), jaccard.NOT_SPACE).hash, 3)]:
            if len(s):
                sets[jaccard.set_key(s)] = s
    times = {}
    for s in sets.values():
        for e in jaccard.leaders(s, 90).tolist():
            times[e] = times.get(e, 0) + 1
    want = {k for k, s in sets.items() if sum(times[e] > 1 for e in jaccard.leaders(s, 90).tolist()) >= jaccard.shared_leaders(-(-len(s) * 90 // 100), 90)}
    got = {r.node for r in jaccard._hopeful(frame, jaccard._numbered(frame, 3), 3, 90).collect()}
    assert got >= want and not {k for k in got - want if all(times[e] == 1 for e in sets[k].tolist())}
    if together > 1000:
        assert len(got) < len(sets)


def test_far_sets_are_held_once_for_all_pivots(spark, monkeypatch):
    """Two similar sets far from each of five pivots: their prefixes do not grow with the number of pivots."""
    pool = np.random.default_rng(9).integers(0, 1 << 64, 2000, dtype=np.uint64)
    given = {k: pool[300 * k : 300 * k + 100] for k in range(1, 6)} | {11: pool[:100], 12: pool[4:104]}
    sets = spark.createDataFrame([(k, np.sort(v).view(np.int64).tolist()) for k, v in given.items()], "node bigint, elements array<bigint>")
    pairs = spark.createDataFrame([(p, x) for p in range(1, 6) for x in (11, 12)], "p bigint, x bigint")
    held = []
    plain = jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, label: held.append(plain(df, label)) or held[-1])
    found = jaccard._around_pivots(jaccard._against_pivot(jaccard._both_sets(pairs, sets), 80), spark.createDataFrame([], "node bigint, root bigint"), sets, 80)
    assert {tuple(r) for r in found.collect()} == {(11, 12)}
    prefix = next(df for df in held if "pos" in df.columns)
    assert prefix.where("x = 11").count() == 100 - 80 + 1


def test_stored_tables_leave_no_shuffle_files(spark):
    import time

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {disk.getAllFiles().apply(k).getName() for k in range(disk.getAllFiles().size())}
    before, setting = names(), spark.conf.get(common.CLEANUP)
    got = common.stored(spark.range(1000).repartition(7, "id"), "test")
    until = time.time() + 20
    while {n for n in names() - before if n.startswith("shuffle_")} and time.time() < until:
        time.sleep(0.2)
    assert not {n for n in names() - before if n.startswith("shuffle_")}
    assert got.count() == 1000 and spark.conf.get(common.CLEANUP) == setting
