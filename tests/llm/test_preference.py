import random

from opsmetrics.llm import preference

TURNS = "conv_id bigint, turn bigint, role string, text string"


def brute(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    show = lambda turns: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)

    def mask(turns):
        at, out = 0, []
        for r, t in turns:
            start = at + len(r) + 5
            if r == "assistant":
                out.append(f"{start}:{start + len(t) + 7}")
            at = start + len(t) + 8
        return ",".join(out)

    return n, show(a[:n]), show(a[n:]), show(b[n:]), mask(a[n:]), mask(b[n:])


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for c in range(60):
        for k in range(rng.randint(1, 6)):
            rows.append((c, k, rng.choice(["user", "assistant", "system", None]), rng.choice(["a", "bé", "", None, "long " * 3])))
    rows += [(70, 0, "user", "x" * 50_000), (70, 1, "assistant", "y"), (70, 1, "assistant", "y"), (80, None, "user", "q")]
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    convs = {}
    for c, k, r, t in sorted(rows, key=lambda x: (x[0], -1 if x[1] is None else x[1], x[2] or "", x[3] or "")):
        convs.setdefault(c, []).append((r or "", t or ""))
    last = {c: max((k for k, (r, _) in enumerate(t) if r == "assistant"), default=None) for c, t in convs.items()}
    got = {r.conv_id: tuple(r)[1:] for r in preference.op2_preference_format(spark, str(tmp_path)).collect()}
    for c, turns in convs.items():
        other, rejected = c ^ 1, list(turns)
        if last[c] is not None:
            if last.get(other) is not None:
                rejected[last[c]] = ("assistant", convs[other][last[other]][1])
            else:
                del rejected[last[c]]
        assert got[c] == brute(turns, rejected), c
    assert len(got) == len(convs)


def test_pairs_of_any_kind(spark):
    pairs = spark.createDataFrame(
        [(1, [(0, "user", "a")], None), (2, None, None), (None, [(0, "user", "a")], [(0, "user", "a")])],
        "id int, chosen array<struct<turn:bigint,role:string,text:string>>, rejected array<struct<turn:bigint,role:string,text:string>>, prompt string".replace(", prompt string", ""))
    got = {r.id: r for r in preference.preference_pairs(pairs, "id").collect()}
    assert got[1].n_common == 0 and got[1].rejected == "" and got[2].prompt == "" and got[None].n_common == 1 and got[None].chosen == ""
    plan = preference.preference_pairs(pairs, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert preference.preference_pairs(pairs.limit(0), "id").count() == 0
