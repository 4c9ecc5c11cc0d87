import binascii
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from opsmetrics.llm import tokenfiles

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(1)
    bits = ["hello", "world,", " ", "  ", "\n", "\n\n", "\t", " the", "Été", "日本語", "<|endoftext|>", "don't", "x" * 30, " ", "12345", "!!", " \n ", "a\n b", "\x1c"]
    return {k: "".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 30))) for k in range(250)} | {900: None, 901: "", 902: "word " * 20_000, 903: " ", 904: " a", 905: "a "}


def test_files_equal_plain_encoding(spark, docs, folder):
    given = texts()
    got = {r.doc_id: r for r in tokenfiles.op3_token_files(spark, folder(documents=docs(given))).collect()}
    plain, start = Tokenizer.from_file(PATH), 0
    assert len(got) == len(given)
    for k in sorted(given):
        ids = plain.encode(given[k] or "", add_special_tokens=False).ids + [2]
        r = got[k]
        assert (r.start, r.n_tokens, r.ids_crc32, r.keyed) == (start, len(ids), binascii.crc32(np.array(ids, "<u4").tobytes()), True), k
        start += len(ids)


def test_index_finds_all_keys_and_no_others(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "BUCKET_KEYS", 40)
    rows = [(k * 7 - 300, f"text {k}") for k in range(200)] + [(5, "x"), (5, "y"), (None, "null id")]
    path = str(tmp_path / "files")
    ranges = tokenfiles.write(docs(rows), PATH, path)
    buckets = tokenfiles.build_index(ranges, path)
    assert buckets > 3 and ranges.count() == 203
    found = tokenfiles.lookup(docs([(k, "") for k in range(-400, 1400)] + [(None, "")]), path, buckets)
    ids = {r.doc_id: r.ids for r in tokenfiles.read(found, path).collect()}
    plain = Tokenizer.from_file(PATH)
    assert set(ids) == {k for k, _ in rows if k is not None}
    assert all(ids[k] == plain.encode(t).ids + [2] for k, t in rows[:200]) and ids[5] == plain.encode("x").ids + [2]
    index = spark.read.parquet(f"{path}/index").collect()
    assert all(len(r.prints) == r.n == len(r.offset) for r in index) and sum(r.n for r in index) == 201


@pytest.mark.parametrize("n", [1, 2, 5, 100, 5000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.random.default_rng(n).choice(1 << 40, n, replace=False) - (1 << 39)
    assert sorted(tokenfiles.displace(keys)[1]) == list(range(n))


def test_empty_table(spark, docs, folder):
    assert tokenfiles.op3_token_files(spark, folder(documents=docs([]))).count() == 0


def test_query_reads_where_the_index_says(spark, docs, folder, monkeypatch):
    sf = folder(documents=docs([(1, "one text"), (1, "two texts"), (2, "another"), (3, "a third one"), (None, "null id"), (None, "x")]))
    keyed = lambda: {(r.doc_id, r.keyed): r.ids_crc32 for r in tokenfiles.op3_token_files(spark, sf).collect() if r.keyed}
    whole, look = keyed(), tokenfiles.lookup
    assert set(whole) == {(1, True), (2, True), (3, True)} and tokenfiles.op3_token_files(spark, sf).count() == 6
    monkeypatch.setattr(tokenfiles, "lookup", lambda *a: look(*a).withColumn("n_tokens", F.lit(1).cast("bigint")))
    assert all(keyed()[k] != whole[k] for k in whole)
    monkeypatch.setattr(tokenfiles, "lookup", lambda *a: look(*a).where("doc_id <> 2"))
    with pytest.raises(Exception, match="does not hold key 2"):
        keyed()
