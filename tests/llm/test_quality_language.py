import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from spectraloom.llm import common, language, quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = lambda n: Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))

    def cover(n):
        g, out = grams(n), set()
        for i in range(len(words) - n + 1):
            if g[tuple(words[i : i + n])] > 1:
                out.update(range(i, i + n))
        return out

    lines, dup, dup_chars = set(), 0, 0
    for line in (text or "").split("\n"):
        if w := re.findall(r"[^\x20\x09-\x0D]+", line):
            if line in lines:
                dup, dup_chars = dup + 1, dup_chars + sum(map(len, w))
            lines.add(line)
    chars, symbols = sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(words) < 10 or 100 * len(cover(5)) > 20 * len(words)
    good = dup_chars <= quality.LINE_LIMIT * max(chars, 1) and symbols <= quality.SYMBOL_LIMIT * len(words)
    good = good and all(sum(len(words[i]) for i in cover(n)) / max(chars, 1) <= limit for n, limit in quality.GRAM_LIMITS)
    return len(words), chars, symbols, dup, len(cover(5)), failed, not failed and good


def test_quality(texts, docs):
    odd = [None, "", " \n\t", "a", "a b c\na b c\n\na b c", "x y z w v " * 6, "é ß\x0b中\x0c# $", "one two three four five six seven eight nine ten", "same line here\r\nsame line here\r\n" * 9, "a\x85b c d e f g h i j k l m n"]
    df = texts(*odd, kept="clash").unionByName(docs.withColumn("kept", F.lit("x")).withColumn("doc_id", F.col("doc_id") + 1000))
    want = {r.doc_id: brute(r.text) for r in df.collect()}
    got = quality.quality(df).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got} == want
    assert quality.quality(df.limit(0)).count() == 0


def test_quality_of_long_and_repeated_rows(spark):
    long = " ".join(f"w{i % 70_000}" for i in range(150_000))
    rows = [(1, long), (1, long), (2, "a b c d e " * 40_000), (None, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_words": F.lit("clash"), "off": F.lit(1)})
    got = quality.quality(df).collect()
    assert [r.n_words for r in got if r.doc_id == 1] == [150_000] * 2 and {r.off for r in got} == {1}
    by = {r.doc_id: r for r in got}
    assert by[2].n_repeat_words == 200_000 and not by[2].kept and by[None].base_failed
    assert by[1].n_repeat_words == brute(long)[4]


def parse(text, ref):
    i = n = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in ref:
            j += 1
        i, n = max(i + 1, j - 1), n + 1
    return n


def _edges(m):
    """Keys and values of all transitions but the first of each state."""
    at, c = np.nonzero(m.dense >= 0)
    state = np.flatnonzero(m.row >= 0)[at]
    return state.astype(np.uint64) << np.uint64(16) | c.astype(np.uint64), m.dense[at, c]


def test_phrases_by_brute_force():
    """Blocks and languages together give the sequential parse of whole texts, and the prediction made from it."""
    rng = np.random.default_rng(1)
    make = lambda letters, n: "".join(rng.choice(list(letters), n))
    samples = {"a": [make("abcde ", 1400)], "b": [make("cdefg ", 300), make("cdefg ", 200)], "c": ["abc" * 300]}
    m = language.Model(samples, sample_codes=1450)
    rows = ["", "abc", make("abcdefgh .", 700), "中文" * 400, make("xyz", 50), samples["a"][0][100:1300] * 3, samples["b"][0] + samples["a"][0], "abc" * 500 + make("abcde", 900), "abc" * 2000, "x" * 257, None]
    seq, off, letters = language.codes([r or "" for r in rows], m.table)
    got, text = m.phrases(seq, off), lambda codes: "".join(chr(100 + c) for c in codes)
    want = np.array([[parse(text(seq[off[i] : off[i + 1]]), "".join(text(language.codes([t], m.table)[0]) + chr(100) for t in samples[lang])) for i in range(len(rows))] for lang in m.langs])
    assert (got == want).all() and len({len(s) for s in samples["a"]}) == 1
    plain = language.Model(samples, sample_codes=1450)
    plain.dense, plain.others = None, common.Table(*_edges(plain))
    assert (plain.phrases(seq, off) == want).all()
    langs, scores = m.predict(rows)
    for i in range(len(rows)):
        missing = [sum(m.first[k, c] == m.roots[k] for c in seq[off[i] : off[i + 1]]) for k in range(3)]
        cost = [(n - x) * b + x * m.literal for n, x, b in zip(want[:, i], missing, m.bits, strict=True)]
        assert langs[i] == (m.langs[int(np.argmin(cost))] if letters[i] else "und") and 0 <= scores[i] <= 1


def test_suffix_automaton_knows_all_substrings():
    text = np.array([1, 2, 1, 2, 3, 1, 2], np.uint8)
    go = language.suffix_automaton(text)
    subs = {tuple(text[i:j]) for i in range(7) for j in range(i + 1, 8)}
    import itertools

    for n in (1, 2, 3, 4):
        for t in itertools.product((1, 2, 3), repeat=n):
            s = 0
            for c in t:
                s = go[s].get(c, -1) if s >= 0 else -1
            assert (s >= 0) == (t in subs)


def test_language_odd_rows(spark):
    """Many languages, scripts of many letters, copies, long texts, clashing columns, nulls and empty tables."""
    rng = np.random.default_rng(2)
    letters = {f"l{k:03}": [chr(0x4E00 + 40 * k + i) for i in range(40)] for k in range(230)}
    make = lambda lang, n: "".join(rng.choice(letters[lang], n))
    rows = [(make(lang, 60), lang) for lang in letters] + [("copied words", "copy")] * 500 + [(None, "none"), ("text without", None)]
    train = spark.createDataFrame(rows, "text string, lang string")
    asked = [make("l007", 300_000), make("l229", 50), "copied words", "copied words", None, "", " 12 "]
    df = spark.createDataFrame([(1, t, "clash", 2.0) for t in asked], "doc_id long, text string, lang_pred string, score double")
    got = language.identify(df.withColumn("bits", F.lit("clash")), train).collect()
    assert [r.lang_pred for r in got] == ["l007", "l229", "copy", "copy", "und", "und", "und"] and got[0].bits == "clash"
    assert language.identify(df.limit(0), train).count() == 0
    assert {r.lang_pred for r in language.identify(df, train.limit(0)).collect()} == {"und"}


def test_language_held_out(spark, texts):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = language.identify(docs.where(held), docs.where(~held)).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    odd = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(texts(None, "", "12 .", "the and of this"), docs).collect()}
    assert odd[0] == odd[1] == odd[2] == ("und", 0.0) and odd[3][0] != "und"
    assert {r.lang_pred for r in language.identify(texts("some words"), docs.limit(0)).collect()} == {"und"}


def test_copies_do_not_crowd_out_a_language(spark):
    copies = spark.range(40000).selectExpr("'the one text that is copied' as text", "'xx' as lang")
    few = spark.range(50).selectExpr("concat('another text of number ', id) as text", "'xx' as lang")
    other = spark.range(500).selectExpr("concat('some words here ', id) as text", "'yy' as lang")
    got = language.samples(copies.unionByName(few).unionByName(other), "text", "lang")
    assert len(got["xx"]) == 51 and len(got["yy"]) == language.SAMPLE_DOCS
