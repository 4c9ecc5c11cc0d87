import random
import re

from opsmetrics.llm import licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_base_places_equal_plain_search(spark, docs, folder):
    rng = random.Random(5)
    bits = ["cc", "by", "CC BY", "general", "public", "license", "General Public License", "all rights reserved", "All", "rights", "the",
            "Licensed under", "é", "日本", "x9", "this work is", "version 3", "cc by by"]
    texts = {k: rng.choice([" ", ", ", "-"]).join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for k in range(200)}
    texts |= {900: None, 901: "", 902: "cc by " * 20_000, 903: "---"}
    got = {r.doc_id: r for r in licences.op7_licence_scan(spark, folder(documents=docs(texts))).collect()}
    for k, t in texts.items():
        w = words(t)
        at = sorted((i, label) for p, label in licences.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        r = got[k]
        assert (r.n_words, r.n_base) == (len(w), len(at)), k
        assert (r.first_word, r.last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_matching_statistics_equal_brute_force():
    found = licences.Automaton({"a": ["p q r s t u v"], "b": ["r s t x p q r s"]}, {"q r": "qr"})
    rng = random.Random(2)
    seqs = [seq for seq, _ in [*found.templates, *found.phrases]]
    for _ in range(200):
        w = [rng.choice("pqrstuvx") for _ in range(rng.randint(1, 25))]
        places, matches = [], []
        found.stream([found.ids[x] for x in w], 0, places, matches)
        assert sorted(places) == [(i, 0) for i in range(len(w) - 1) if w[i : i + 2] == ["q", "r"]]
        want = set()
        for k, seq in enumerate(seqs[:2]):
            for i in range(len(w)):
                longest = max(n for n in range(len(w) - i + 1) for s in seqs if n == 0 or any(s[a : a + n] == w[i : i + n] for a in range(len(s))))
                left = i > 0 and any(s[a : a + longest + 1] == w[i - 1 : i + longest] for s in seqs for a in range(len(s)))
                if longest >= licences.MIN_MATCH and not left:
                    want |= {(k, i, a, longest) for a in range(len(seq) - longest + 1) if seq[a : a + longest] == w[i : i + longest]}
        assert set(matches) == want


def test_templates_with_an_edit_are_covered(docs):
    mit = licences.TEMPLATES["mit"][2].replace("hereby granted", "now granted")
    apache = licences.TEMPLATES["apache-2.0"][0]
    texts = {1: f"intro words here {mit} trailing words", 2: f"before {apache}. after", 3: "the of and to be", 4: None}
    got = {r.doc_id: [(c.label, c.first, c.end) for c in r.covered] for r in licences.scan(docs(texts)).collect()}
    assert [x[0] for x in got[1]] == ["mit"] and got[1][0][1] == 6 and ("apache-2.0", 1, 9) in got[2]
    assert got[3] == [] and got[4] == [] and licences.scan(docs([])).count() == 0


def test_short_templates_are_found_where_the_text_follows_a_longer_one(spark, docs, folder):
    notice, header = licences.TEMPLATES["apache-2.0"]
    gpl2, gpl3, lgpl = licences.TEMPLATES["gpl-2.0"][0], licences.TEMPLATES["gpl-3.0"][1], licences.TEMPLATES["lgpl"][0]
    texts = {
        1: f"{notice}. The rest is other text", 2: " ".join(header.split()[:40]), 3: f"see {header} end", 4: f"a {notice} (the other) b {notice} c {notice}. The",
        5: f"{gpl3} x", 6: f"{gpl2} x", 7: lgpl, 8: "terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of it"}
    got = {r.doc_id: (r.labels, r.score) for r in licences.op7_licence_scan(spark, folder(documents=docs(texts))).collect()}
    assert got == {1: ("apache-2.0", 1.0), 2: ("apache-2.0", 1.0), 3: ("apache-2.0", 1.0), 4: ("apache-2.0", 1.0), 5: ("gpl,gpl-3.0", 1.0), 6: ("gpl,gpl-2.0", 1.0),
                   7: ("gpl,lgpl", 1.0), 8: ("gpl", 1.0)}
    spans = {r.doc_id: [(c.first, c.end) for c in r.covered] for r in licences.scan(docs(texts)).collect()}
    assert spans[4] == [(1, 9), (12, 20), (21, 29)]


def test_runs_equal_brute_force_per_template():
    found = licences.Automaton({"a": ["p q r s t u v", "q r s t"], "b": ["r s t x p q r s t"]}, {"q r": "qr"})
    rng = random.Random(7)
    for _ in range(200):
        w = [rng.choice("pqrstuvx") for _ in range(rng.randint(1, 25))] + ["p", "q", "r", "s", "t", "x"] * rng.randint(0, 1)
        matches, want = [], set()
        found.runs([found.ids[x] for x in w], 0, matches)
        for k, (seq, _) in enumerate(found.templates):
            for i in range(len(w)):
                for a in range(len(seq)):
                    n = next((n for n in range(min(len(w) - i, len(seq) - a)) if w[i + n] != seq[a + n]), min(len(w) - i, len(seq) - a))
                    if n >= licences.MIN_MATCH and (i == 0 or a == 0 or w[i - 1] != seq[a - 1]):
                        want.add((k, i, a, n))
        assert set(matches) == want and len(matches) == len(want)


def test_an_earlier_copy_with_edits_is_found_beside_a_later_whole_one():
    found = licences.Automaton({"a": ["a b c d e f g h i j k l m n o p"]}, {})
    text = "a b c d e f g z i j k l m n o p z z z z z z z z z a b c d e f g h i j k l m n o p".split()
    matches = []
    found.runs([found.ids.get(x, len(found.ids)) for x in text], 0, matches)
    assert [(first, end) for first, end, _, _ in found.chains(matches)] == [(0, 16), (25, 41)]
