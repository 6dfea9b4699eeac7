"""The pipeline's stages against plain versions on the smallest data."""

import collections

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from spectraloom.llm import bpe, jaccard, language
from tests.llm.test_jaccard import brute as components
from tests.llm.test_quality_language import brute as quality

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, docs):
    assert [n for n, _ in P.STAGES] == ["quality_rules", "language_id", "near_duplicates", "mix_sources", "bpe_encode"]
    stage = dict(P.STAGES)
    one = stage["quality_rules"](spark, docs, SMALL).cache()
    assert sorted(r.doc_id for r in one.collect()) == sorted(r.doc_id for r in docs.collect() if quality(r.text)[-1])
    two = stage["language_id"](spark, one, SMALL).cache()
    assert two.count() > 0.95 * one.count() and two.columns == list(P.COLUMNS)
    three = stage["near_duplicates"](spark, two, SMALL).cache()
    groups = components([(r.doc_id, r.text) for r in two.collect()], 80, 5)
    assert sorted(r.doc_id for r in three.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)
    four = stage["mix_sources"](spark, three, SMALL).cache()
    copies = collections.Counter(r.doc_id for r in four.collect())
    assert set(copies) <= {r.doc_id for r in three.collect()} and max(copies.values()) <= 3
    five = stage["bpe_encode"](spark, four, SMALL).collect()
    t = Tokenizer.from_file(bpe.default_path())
    text = {r.doc_id: r.text for r in four.collect()}
    assert len(five) == four.count() and all(r.n_tokens == len(t.encode(text[r.doc_id], add_special_tokens=False).ids) for r in five)


def test_stages_on_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "some words " * 3, "en", None, 1), (2, "", "en", "s", 0)]
    words = np.random.default_rng(1)
    rows += [(i, " ".join(words.choice(["the", "and", "of", "that", "was", "with", "for", "this", "are", "one"], 40)), "en", "s", 0) for i in range(10, 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for data in (df, df.limit(0)):
        out = data
        for _, stage in P.STAGES:
            out = stage(spark, out, SMALL)
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() >= 0
    assert language.MIN_SCORE < 1 and jaccard.PERCENT == 90


def test_near_duplicates_link_at_five_words_and_80_percent(spark):
    vocab, rng = [f"w{i}" for i in range(400)], np.random.default_rng(4)
    rows = []
    for g in range(12):
        base = list(rng.choice(vocab, 200))
        for edits in (0, 2, 3, 4, 5, 9):
            w = list(base)
            for i in np.linspace(20, 180, edits).astype(int) if edits else []:
                w[i] = f"new{g}_{edits}_{i}"
            rows.append((len(rows), " ".join(w)))

    def shingles(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            n = len(sets[i] & sets[j])
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((up[i], up[j]))
                up = [a if u == b else u for u in up]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in dict(P.STAGES)["near_duplicates"](spark, df, SMALL).collect())
    assert got == sorted(set(up)) and 12 < len(got) < len(rows)
    assert len({c for _, c in components(rows).values()}) > len(got)


def test_texts_of_one_id_are_told_apart(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (5, b), (7, b), (None, c), (None, c), (8, c + " end"), (9, " "), (9, " "), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("_hash", F.lit("clash"))
    got = dict(P.STAGES)["near_duplicates"](spark, df, SMALL).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(5, a), (5, b), (8, c + " end"), (9, " "), (9, " "), (None, None)], key=str)
