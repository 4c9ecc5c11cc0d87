import base64
import hashlib
import random
import struct

import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken

from opsmetrics.llm import bytebpe as B
from opsmetrics.llm.pretokens import Parts

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(vocabulary, texts):
    ids, bounds = vocabulary.encode(pa.array(texts, pa.large_string()))
    return [ids[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:])]


ALPHABET = list("abestrvdmlXYZ''''   \n\t\r  012.,!?-_  　äßéñÀ×÷中文字あいअआकाé́‍😀🏽🇩🇪٣½Ⅷ²ǅʰ\u0085\u001c᠎") + ["'ll", "'ve", "'re", "'s", " 's", "''s", "'t", "'d'm"]


def test_parts_equal_the_expression(library):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    parts = Parts(pa.array(texts, pa.large_string()))
    cut = [parts.distinct[k] for k in parts.of.tolist()]
    pieces = tiktoken.Encoding("bytes", pat_str=P.PATTERN, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    assert "".join(cut) == "".join(texts)
    for k, text in enumerate(texts):
        own = cut[parts.lo[k] : parts.hi[k]]
        assert "".join(own) == text
        # the library's own expression, one part at a time: a part is cut no further, and two neighbours are cut between
        assert sum(map(len, map(pieces.encode_ordinary, own))) == len(text.encode())
    import regex

    plain = [t for t in texts if regex.fullmatch(r"[\n\r\t\x20-\x7e¡-ɏ]*", t)]
    expected = [regex.findall(P.PATTERN, t) for t in plain]
    for text, wanted in zip(plain, expected):
        alone = Parts(pa.array([text], pa.large_string()))
        assert [alone.distinct[k] for k in alone.of.tolist()] == wanted


def test_ids_equal_the_library(library):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(4000)]
    texts += ["", " ", "\n\n  x", "hello world", "Straße und Übermut", "a" * 999, "ab" * 500, " " * 300 + "x"]
    vocabulary = B.Vocabulary(PATH)
    assert ids_of(vocabulary, texts) == [library.encode_ordinary(t) for t in texts]


def test_long_parts(library):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("abcdeinrst") for _ in range(200_000)), "x" * 100_001, "é" * 50_000]
    assert ids_of(B.Vocabulary(PATH), texts) == [library.encode_ordinary(t) for t in texts]


def test_a_lower_rank_made_by_a_merge_goes_first(tmp_path):
    """In these ranks a merge makes a pair of a lower rank, which takes the next pair's left part away."""
    tokens = [bytes([b]) for b in range(256)] + [b"aba", b"ab", b"bab", b"abab", b"ba"]
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(k).encode() for k, t in enumerate(tokens)))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 30))) for _ in range(2000)] + ["abababababab"]
    assert ids_of(B.Vocabulary(str(path)), texts) == [library.encode_ordinary(t) for t in texts]


def test_queue_against_sorting():
    rnd = random.Random(1)
    queue, held = B.Ranks(70_000), {}
    for step in range(20_000):
        if rnd.random() < 0.6 or not held:
            rank = rnd.randrange(70_000)
            queue.push(rank, step)
            held.setdefault(rank, []).append(step)
        else:
            rank = queue.first()
            assert rank == min(held)
            assert queue.take(rank) == sorted(held.pop(rank))
    assert queue.first() == (min(held) if held else -1)


def test_query_and_edges(spark, docs, folder, library):
    rows = [(1, "hello wörld, it's 3 o'clock"), (2, None), (3, ""), (3, "copy"), (3, "copy"), (None, "no id"), (4, "z" * 50_000 + " end" * 3000)]
    path = folder(documents=docs(rows).selectExpr("*", "7 AS n_tokens", "'old' AS ids_sha256"))
    from opsmetrics.llm.registry import QUERIES

    got = QUERIES["op11_byte_bpe"](spark, path)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    wanted = []
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        wanted.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(wanted, key=str)


def test_ids_and_round_trip(spark, docs, library):
    rows = {1: "some text, some'll do", 2: None, 3: "", 4: "日本語 text"}
    clash = docs(rows).selectExpr("*", "'x' AS ids", "1 AS decoded")
    coded = B.encode(clash, PATH)
    assert coded.columns.count("ids") == 1 and "decoded" in coded.columns
    assert {r.doc_id: r.ids for r in coded.collect()} == {i: library.encode_ordinary(t or "") for i, t in rows.items()}
    back = B.decode(coded, PATH)
    assert {r.doc_id: bytes(r.decoded).decode() for r in back.collect()} == {i: t or "" for i, t in rows.items()}
    assert B.encode(docs([]), PATH).count() == 0
    with pytest.raises(ValueError):
        B.encode(clash, PATH, column="ids")
