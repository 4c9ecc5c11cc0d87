import random

import numpy as np
import pyarrow as pa

from opsmetrics.llm import quality
from opsmetrics.llm.common import NOT_SPACE, Words

LABELS = "doc_id bigint, quality int, toxic int"


def test_linear_time_score_equals_pairwise_sum():
    rng = np.random.default_rng(3)
    size = (1 << quality.BITS) + len(quality.STATISTICS) * quality.BUCKETS
    machine = quality.Machine(0.1, rng.normal(size=size), rng.normal(size=(size, quality.FACTORS)))
    words = Words(pa.array(["a b a c\nd d", "", "x!! | y", "é a"], pa.large_string()), NOT_SPACE, lower=False)
    got = machine.score(words)
    for k, (f, x) in enumerate(quality.features(words)):
        z = machine.base + (machine.weight[f] * x).sum()
        z += sum(machine.factor[f[i]] @ machine.factor[f[j]] * x[i] * x[j] for i in range(len(f)) for j in range(i))
        assert np.isclose(got[k], 1 / (1 + np.exp(-np.clip(z, -30, 30))))


def test_learns_held_out_documents(spark, docs, folder):
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(800)]
    texts, labels = {}, []
    for i in range(900):
        w = [rng.choice(vocab) for _ in range(rng.randint(8, 80))]
        bad = rng.random() < 0.2
        if bad:
            kind = rng.randrange(3)
            w = [x + "$$$" for x in w] if kind == 0 else [x.upper() + "!!" for x in w] if kind == 1 else [w[0]] * len(w)
        texts[i] = " ".join(w)
        labels.append((i, int(not bad), 0))
    texts |= {2000: None, 2001: "", 2002: "x" * 50_000}
    sf = folder(documents=docs(texts), labels=spark.createDataFrame(labels, LABELS))
    got = {r.doc_id: r for r in quality.op10_quality_classifier(spark, sf).collect()}
    held = [i for i, _, _ in labels if got[i].held_out]
    assert len(got) == len(texts) and len(held) > 120
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.97
    assert got[2000].score == got[2001].score and all(0 <= r.score <= 1 for r in got.values())
    none = folder(documents=docs({1: "a"}), labels=spark.createDataFrame([], LABELS))
    assert quality.op10_quality_classifier(spark, none).first().predicted == 1
