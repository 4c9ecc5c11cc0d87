import itertools
import random

import numpy as np

from opsmetrics.llm import toxicity

LABELS = "doc_id bigint, quality int, toxic int"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    field = toxicity.Field(np.zeros(0, np.uint64), rng.normal(size=16), -0.3, rng.normal(size=(2, 2)), rng.normal(size=2))
    sizes = [3, 1, 5, 7]
    buckets = rng.integers(0, 16, sum(sizes))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    got = toxicity.marginals(field.matrices(buckets[:, None], starts))
    for a, n in zip(starts, sizes):
        weight = {}
        for states in itertools.product((0, 1), repeat=n):
            w = field.first[states[0]] + sum(field.step[i, j] for i, j in zip(states, states[1:]))
            weight[states] = np.exp(w + sum(field.bias + field.weight[buckets[a + k]] for k, s in enumerate(states) if s))
        total = sum(weight.values())
        want = [sum(w for s, w in weight.items() if s[k]) / total for k in range(n)]
        assert np.allclose(got[a : a + n], want)


def test_long_chain_equals_plain_recursion():
    rng = np.random.default_rng(1)
    field = toxicity.Field(np.zeros(0, np.uint64), rng.normal(size=64), -1.0, rng.normal(size=(2, 2)), np.zeros(2))
    buckets = rng.integers(0, 64, 1000)
    m = field.matrices(buckets[:, None], np.array([0, 400]))
    f, want = np.array([0.5, 0.5]), []
    for x in m:
        f = f @ x
        f /= f.sum()
        want.append(f)
    assert np.allclose(toxicity.messages(m)[0], want)


def test_learns_held_out_documents(spark, docs, folder):
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(400)]
    texts, labels = {}, []
    for i in range(600):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 60))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(["Idiot", "moron", "SCUM"])
        texts[i] = " ".join(w)
        labels.append((i, 1, int(bad)))
    texts |= {1000: None, 1001: "", 1002: "!!!", 1003: "é moron"}
    labels.append((1000, None, None))
    sf = folder(documents=docs(texts), labels=spark.createDataFrame(labels, LABELS))
    got = {r.doc_id: r for r in toxicity.op8_toxicity(spark, sf).collect()}
    right = [got[i].predicted == t for i, _, t in labels if got[i].held_out and t is not None]
    assert len(got) == len(texts) and sum(r.held_out for r in got.values()) > 150 and np.mean(right) > 0.98
    assert [got[k].score for k in (1000, 1001, 1002)] == [0, 0, 0] and got[1003].spans == "2:7"
    empty = folder(documents=docs([]), labels=spark.createDataFrame([], LABELS))
    assert toxicity.op8_toxicity(spark, empty).count() == 0
