import random
import zlib

import public_tokenizers
import sentencepiece

from opsmetrics.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def unigram():
    """The library's own search over the same pieces and scores: the model file with its kind set to unigram."""
    data = open(PATH, "rb").read()
    at = data.index(b"\x18\x02\x20\x80\xfa\x01")  # trainer: kind 2 (merges), then the vocabulary's size
    return sentencepiece.SentencePieceProcessor(model_proto=data[:at] + b"\x18\x01" + data[at + 2 :])


def plain(model, text):
    """The best path over the whole normalised text, without words."""
    text = (" " + text).replace(" ", pieces.MARK) if text else ""
    own = {p: (k, s) for p, k, s in model.table}
    best = [(0.0, -1, [])]
    for end in range(1, len(text) + 1):
        found = None
        for start in range(max(0, end - model.longest), end):
            part = text[start:end]
            if part in own:
                edge = (best[start][0] + own[part][1], start, [own[part][0]])
            elif end - start == 1:
                edge = (best[start][0] + model.unknown, start, [model.bytes + x for x in part.encode()])
            else:
                continue
            if found is None or edge[0] > found[0]:
                found = edge
        best.append(found)
    out, at = [], len(text)
    while at > 0:
        out, at = best[at][2] + out, best[at][1]
    return out


def test_ids_equal_the_library(spark, docs):
    rng = random.Random(8)
    bits = ["the", "information", "Été", "日本語", "\n", "  ", "   ", "xqzzy", "🙂", "123", "a.b,c!", "ñandú", "\t", "▁", "thorreou"]
    texts = {k: "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 25))) for k in range(120)}
    texts |= {500: None, 501: "", 502: " ", 503: "word " * 3000, 504: "x" * 600}
    model, own = unigram(), pieces.load(PATH)
    compared = 0
    for frequent in (30, 10_000):
        got = {r.doc_id: r.ids for r in pieces.encode(docs(texts), PATH, frequent).collect()}
        for k, t in texts.items():
            t = t or ""
            assert got[k] == plain(own, t), (k, t)
            if min((own.pieces[i][1] for i in got[k]), default=0) > -1e8 and not any(3 <= i < 259 for i in got[k]):
                # an unknown character or a run of spaces scores -1e9, where the library's 32-bit sums round the rest away
                assert got[k] == model.encode(t), (k, t)
                compared += 1
            if t and "▁" not in t:
                assert own.decode(got[k]) == t
    assert compared > 5
    assert pieces.encode(docs([]), PATH).count() == 0


def test_query(spark, docs, folder):
    rows = [(1, "hello  world\n"), (1, "hello  world\n"), (None, "a b"), (2, None)]
    got = pieces.op1_sentencepiece(spark, folder(documents=docs(rows))).collect()
    assert len(got) == 4 and all(r.round_trip for r in got) and sorted(r.n_tokens for r in got)[0] == 0


def test_merges_equal_the_unpatched_library(spark, docs, folder):
    rng = random.Random(3)
    bits = ["the", "international information", "Été", "日本語", "\n", "  ", "   ", "xqzzy", "🙂", "123", "a.b,c!", "ñandú", "\t", "▁", "thorreou", "<s>", "unbelievably"]
    texts = {k: "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 25))) for k in range(120)}
    texts |= {500: None, 501: "", 502: " ", 503: "word " * 3000, 504: "x" * 600, 505: " " * 77 + "a", 506: "international information"}
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = {k: library.encode(t or "") for k, t in texts.items()}
    for frequent in (30, 10_000):
        got = {r.doc_id: r.ids for r in pieces.encode(docs(texts), PATH, frequent, merges=True).collect()}
        assert got == want
    assert [library.id_to_piece(i) for i in want[506]] == ["▁international", "▁information"]
    rows = {r.doc_id: r for r in pieces.op1_sentencepiece(spark, folder(documents=docs(texts))).collect()}
    for k, ids in want.items():
        assert rows[k].n_tokens == len(ids) and rows[k].ids_crc32 == zlib.crc32(",".join(map(str, ids)).encode()), k


def test_equal_rows_are_encoded_once(spark, docs):
    """Many rows equal in id and text hold rare words: each gets its ids, and the work does not grow with their square."""
    text = " ".join(f"q{k}zx{k * 7919 % 1000}w" for k in range(100))
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(7, text)] * 300 + [(8, text), (None, text), (None, text)]
    got = pieces.encode(docs(rows), PATH, 0, merges=True).collect()
    assert len(got) == len(rows) and all(r.ids == library.encode(text) for r in got)


def test_no_document_is_shuffled(spark, docs):
    """Rare words are encoded where they are met: only words are dealt, and the plan over documents has neither exchange, join nor sort."""
    plan = pieces.encoded_documents(docs({1: "xqzzy thorreou", 2: None}), PATH)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and not any(x in plan for x in ("hashpartitioning", "Join", "Sort", "Aggregate"))


def test_long_words_and_many(spark, docs):
    """Rare words by both folds: a long one in time and memory in proportion to its length, and more than are merged together."""
    rng = random.Random(11)
    long = "".join(rng.choice("abcdefghijkABCD0123+/") for _ in range(100_000))
    many = " ".join(f"q{k}zx{rng.randrange(10 ** 6)}w" for k in range(pieces.AT_ONCE + 500))
    texts, own = {1: long, 2: many, 3: long[:3000]}, pieces.load(PATH)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = {r.doc_id: r for r in pieces.encode(docs(texts), PATH, 0, merges=True, decoded="back").collect()}
    assert all(got[k].ids == library.encode(t) and got[k].back == t for k, t in texts.items())
    got = {r.doc_id: r.ids for r in pieces.encode(docs(texts), PATH, 0).collect()}
    assert got[3] == plain(own, texts[3]) and all(own.decode(got[k]) == t for k, t in texts.items())


def test_decode_many(spark):
    rows = spark.createDataFrame([(1, [300, 400]), (2, None), (3, []), (4, [3 + 0xE2, 3 + 0x96, 3 + 0x81, 3 + 0xFF])], "doc_id bigint, ids array<int>")
    own = pieces.load(PATH)
    want = {1: "".join(own.pieces[k][0] for k in (300, 400)).replace(pieces.MARK, " ").removeprefix(" "), 2: None, 3: "", 4: "\ufffd"}
    assert own.bytes == 3 and {r.doc_id: r.text for r in pieces.decode(rows, PATH).collect()} == want


def test_words_merged_together(spark):
    """Words of all lengths, with equal scores side by side, without pieces, and one whose first letter is no piece but part of one."""
    rng, own = random.Random(5), pieces.Model(PATH)
    letters = [p for p, _, _ in own.table if len(p) == 1]
    words = ["".join(rng.choice(letters[:60]) for _ in range(rng.randint(1, 90))) for _ in range(3000)]
    words += [p for p, _, _ in own.table[::5]] + ["aaaaaaa", "日🙂本", "a", "é", pieces.MARK, pieces.MARK * 9, "the" * 21 + "x"]
    part = next(p for p, _, _ in own.table if p.isalpha() and len(p) == 4)
    for changed in (False, True):
        if changed:  # as if the first letter of a piece were none
            own.table = [x for x in own.table if x[0] != part[0]]
            own.parts = pieces._Parts(own)
        got = pieces.Merger(own).merged([*words, part], "<u4")
        assert [list(memoryview(x).cast("I")) for x in got] == [pieces.merged(w, own.parts) for w in [*words, part]]
