import numpy as np

from opsmetrics.llm import neardup

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    good = {}
    for i, v, label in rows:
        if v is not None and label is not None and None not in v and np.isfinite(v).all() and np.any(v):
            good[i] = (np.array(v, np.float32).astype(float), label)
    root = {i: i for i, _, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = dict.fromkeys(root, 0)
    ids = list(good)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            (x, p), (y, q) = good[a], good[b]
            if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[a] += 1
                links[b] += 1
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return {i: (links[i], find(i), i == find(i)) for i in root}


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    rows, n = [], 0
    for _ in range(40):  # clusters of near vectors, some large, some chained
        centre = rng.normal(size=24)
        for _ in range(int(rng.choice([1, 2, 3, 5, 60]))):
            centre = centre if rng.random() < 0.8 else centre + rng.normal(size=24) * 0.12
            rows.append((n, (centre + rng.normal(size=24) * rng.choice([0.01, 0.08])).astype(np.float32).tolist(), int(rng.integers(0, 3))))
            n += 1
    for _ in range(400):
        rows.append((n, rng.normal(size=24).astype(np.float32).tolist(), int(rng.integers(0, 3))))
        n += 1
    same = rows[5][1]
    rows += [(n + k, same, rows[5][2]) for k in range(30)]
    n += 30
    rows += [(n, None, 1), (n + 1, [0.0] * 24, 1), (n + 2, [float("nan")] + [1.0] * 23, 1), (n + 3, [None] + [1.0] * 23, 1), (n + 4, [1.0] * 24, None), (n + 5, [float("inf")] * 24, 1),
             (n + 6, [], 1), (n + 7, [1.0, 2.0], 1), (n + 8, [1.0, 2.0], 1)]
    want = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()}
    assert set(got) == set(want)
    true_links = sum(v[0] for v in want.values())
    assert sum(v[0] for v in got.values()) >= 0.98 * true_links and all(got[k][0] <= want[k][0] for k in want)
    assert sum(got[k] == want[k] for k in want) >= 0.98 * len(want)


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def found(spark, rows, **more):
    frame = spark.createDataFrame(rows, VECTORS).repartition(5)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(frame, **more).collect()}


def test_one_bridge_between_dense_clusters_is_kept(spark):
    """Per label two clusters of 100 and one link between them, by two vectors whose nearest lie in their own cluster."""
    rng, rows = np.random.default_rng(3), []
    for label in range(6):
        plane, rest = np.split(np.linalg.qr(rng.normal(size=(24, 24)))[0], [2], axis=1)
        for angle, away in [(0, 7)] * 100 + [(0, 0), (11.19, 0)] + [(11.19, 7)] * 100:
            aside = rest @ rng.normal(size=22)
            v = plane @ [np.cos(np.radians(angle)), np.sin(np.radians(angle))] + np.tan(np.radians(away)) * aside / np.linalg.norm(aside)
            rows.append((len(rows), v.astype(np.float32).tolist(), label))
    got = found(spark, rows)
    assert got == brute(rows) and len({c for _, c, _ in got.values()}) == 6


def test_links_across_blocks_equal_brute_force(spark):
    rng, rows = np.random.default_rng(6), []
    for _ in range(60):
        centre = rng.normal(size=16)
        for _ in range(int(rng.choice([1, 2, 3, 9]))):
            centre = centre + rng.normal(size=16) * 0.1
            rows.append((len(rows), centre.astype(np.float32).tolist(), len(rows) % 2))
    rows += [(len(rows) + k, rows[3][1], rows[3][2]) for k in range(4)]
    want = brute(rows)
    assert sum(v[0] for v in want.values()) > 50
    assert found(spark, rows, block=7) == found(spark, rows) == want
