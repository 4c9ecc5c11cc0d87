import random

from opsmetrics.llm import decontaminate
from opsmetrics.llm.common import hash_words

ITEMS = "item_id bigint, text string"


def edits(pattern, text):
    """Least edit distance of ``pattern`` to any stretch of ``text``."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row = row, [i]
        for j, t in enumerate(text, 1):
            row.append(min(last[j - 1] + (p != t), last[j] + 1, row[j - 1] + 1))
    return min(row)


def test_myers_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(300):
        pattern = [rng.randrange(5) for _ in range(rng.randint(1, 90))]
        text = [rng.randrange(5) for _ in range(rng.randint(0, 60))]
        bits = {}
        for j, w in enumerate(pattern):
            bits[w] = bits.get(w, 0) | 1 << j
        assert decontaminate.myers(bits, len(pattern), text)[0] == edits(pattern, text)


def test_found_items_equal_brute_force(spark, docs):
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(60)]
    items = {k: [rng.choice(vocab) for _ in range(rng.randint(8, 40))] for k in range(12)}
    texts = {}
    for i in range(80):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if i % 2:
            copy = list(items[rng.randrange(12)])
            for _ in range(rng.randint(0, 7)):
                at = rng.randrange(len(copy))
                rng.choice([lambda: copy.pop(at) if len(copy) > 1 else None, lambda: copy.insert(at, "zz"), lambda: copy.__setitem__(at, "yy")])()
            at = rng.randint(0, len(w))
            w = w[:at] + copy + w[at:]
        texts[i] = w
    bench = spark.createDataFrame([(k, " ".join(w).upper()) for k, w in items.items()] + [(90, None), (91, ""), (92, "too short")], ITEMS)
    given = docs({i: ", ".join(w) for i, w in texts.items()} | {500: None, 501: ""})
    got = {r.doc_id: {m.item_id for m in r.matches} for r in decontaminate.contaminated(given, bench).collect()}
    for i, w in texts.items():
        assert got[i] == {k for k, item in items.items() if edits(item, w) <= len(item) * decontaminate.PERCENT // 100}, i
    assert got[500] == got[501] == set() and sum(map(len, got.values())) > 20
    assert decontaminate.contaminated(docs([]), bench).count() == 0
    assert decontaminate.contaminated(given, bench.limit(0)).where("size(matches) > 0").count() == 0


def test_blocks_give_the_same(spark, docs, folder, monkeypatch):
    bench = spark.createDataFrame([(k, " ".join(f"a{k}x{j}" for j in range(12))) for k in range(5)], ITEMS)
    given = docs({1: "b " + " ".join(f"a3x{j}" for j in range(12)), 2: "b c d"})
    want = decontaminate.op6_benchmark_decontamination(spark, folder(documents=given, benchmark=bench)).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    got = decontaminate.op6_benchmark_decontamination(spark, folder(documents=given, benchmark=bench)).collect()
    assert sorted(got) == sorted(want) and {r.doc_id: r.item_ids for r in got} == {1: "3", 2: ""}
    assert len(hash_words(["a", "b"])) == 2


def test_short_items_are_found_unchanged_only(spark, docs):
    bench = spark.createDataFrame([(1, "Who wrote it?"), (2, "one"), (3, "a b c d e f g"), (4, " ?!"), (5, None), (6, "b c d")], ITEMS)
    texts = {1: "He asked: who WROTE it, one day", 2: "who wrote that", 3: "x a b c d e f g b c d", 4: "a b c e f g", 5: "ones", 6: None}
    got = {r.doc_id: [tuple(m) for m in r.matches] for r in decontaminate.contaminated(docs(texts), bench).collect()}
    assert got == {1: [(1, 2, 5, 0), (2, 5, 6, 0)], 2: [], 3: [(3, 1, 8, 0), (6, 2, 5, 0)], 4: [], 5: [], 6: []}
