import hashlib
import random

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spectraloom.llm import bpe
from spectraloom.llm.token_counts import flat_streams, label_documents, read_files, scan


def library():
    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def random_text(rng, n):
    letters = rng.choice(["ab the inéΣßſ'sll1#<|endoftext|> \x1c\n", "abthenigé", "aab", "ɑ中文字 é́ᄀ가Å"])
    return "".join(rng.choice(letters) for _ in range(n))


def test_encoding_equals_library():
    t, rng = library(), random.Random(1)
    for leaf in (2, 7, 128):
        m = bpe.Bpe(bpe.default_path(), leaf=leaf)
        for k in range(150):
            s = random_text(rng, rng.randint(0, 400 if leaf < 128 else 3000))
            s = s.replace("the", "<|endoftext|>") if k % 5 == 0 else s
            want = t.encode(s, add_special_tokens=False).ids
            got = np.frombuffer(m.encode(s.encode()), "<u4").tolist()
            assert got == want, (leaf, s)
            assert m.decode(got) == t.decode(want, skip_special_tokens=False)


def test_pieces_join_to_the_whole(texts):
    rng = random.Random(2)
    rows = [random_text(rng, 900), "a" * 3000, "theinan" * 400 + " x", None, "", "short", "é" * 700, "<|endoftext|>" * 60, "a" * 3000]
    want = {i: library().encode(t or "", add_special_tokens=False).ids for i, t in enumerate(rows)}
    for piece in (37, 256):
        got = bpe.encode(texts(*rows, n_tokens="clash"), long_chars=300, piece_chars=piece).collect()
        assert {r.doc_id: list(r.ids) for r in got} == want and {r.n_tokens for r in got} == {len(w) for w in want.values()}
        assert all(r.decoded == library().decode(want[r.doc_id], skip_special_tokens=False) for r in got)


def test_long_blank_texts_keep_their_rows(texts):
    rows = [" " * 301, "\n\u00a0 " * 200, " " * 301, "a" + " " * 400, " "]
    want = {i: library().encode(t, add_special_tokens=False).ids for i, t in enumerate(rows)}
    got = bpe.encode(texts(*rows), long_chars=300, piece_chars=37).collect()
    assert {r.doc_id: list(r.ids) for r in got} == want and len(got) == len(rows)
    digests = bpe.encode(texts(*rows), keep=["doc_id"], digest=True, long_chars=300).collect()
    assert {(r.n_tokens, r.ids_sha256) for r in digests if r.doc_id < 3} == {(0, hashlib.sha256(b"").hexdigest())}


def test_digests_and_repeated_rows(texts):
    got = bpe.encode(texts("Hello world", "Hello world", None), keep=["doc_id"], digest=True).orderBy("doc_id").collect()
    ids = library().encode("Hello world", add_special_tokens=False).ids
    assert got[0].ids_sha256 == got[1].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert got[2].n_tokens == 0 and got[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.encode(texts("x").limit(0)).count() == 0


def test_decode(spark):
    df = spark.createDataFrame([([3306, 1002],), (None,), ([10**6],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(df).collect()] == ["hello</w> world</w>", "", ""]


def test_token_counts(texts, docs):
    rng = random.Random(3)
    rows = ["", None, "", "<|endoftext|> inside", *[random_text(rng, rng.randint(0, 200)) for _ in range(60)], ""]
    df = texts(*rows).unionByName(docs.limit(20).select("doc_id", "text", "lang", "source", "n_chars").selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "n_chars"))
    plain = bpe.Bpe(bpe.default_path(), special=False)
    want = {r.doc_id: len(plain.encode((r.text or "").encode())) // 4 for r in df.collect()}
    for block in (1, 3, 64, 1 << 18):
        streams = flat_streams(df, block_tokens=block).cache()
        got = label_documents(scan(streams), streams).collect()
        assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(want)


def test_flat_files(spark, tmp_path):
    ids = [5, 6, 49407, 49407, 7, 49407, 8, 9]
    (tmp_path / "a.bin").write_bytes(np.array(ids, "<u2").tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    for block in (2, 4, 100):
        got = scan(read_files(spark, f"file://{tmp_path}/*.bin", block)).orderBy("doc").collect()
        assert [(r.start, r.n_tokens) for r in got] == [(0, 2), (3, 0), (4, 1), (6, 2)]


def test_token_counts_of_odd_rows(spark):
    """Counts are the tokenizers library's; nulls, repeated rows, clashing columns and an empty table have defined results."""
    rows = [(1, "Some words, twice."), (1, "Some words, twice."), (2, None), (None, "x"), (3, ""), (4, "naïve café 123 " * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("stream", F.lit("clash")).withColumn("n_tokens", F.lit(-1))
    streams = flat_streams(df, block_tokens=64)
    got = label_documents(scan(streams), streams).collect()
    want = [(i, len(library().encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted(want, key=str)
    empty = flat_streams(df.limit(0))
    assert label_documents(scan(empty), empty).count() == 0


def test_token_files_are_read_in_ranges(spark, tmp_path):
    (tmp_path / "a b.bin").write_bytes(np.arange(5000, dtype="<u2").tobytes())
    got = read_files(spark, f"file://{tmp_path}/*.bin", 512).orderBy("block").collect()
    assert [len(r.data) for r in got] == [512] * 19 + [272] and b"".join(r.data for r in got) == np.arange(5000, dtype="<u2").tobytes()
