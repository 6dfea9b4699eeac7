import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.llm import chat, toxicity

SAID = "</s>[INST] ok [/INST]"
SCHEMA = "conv_id long, turn long, role string, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_escape_round_trip():
    rng = random.Random(1)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "s>", "INST]", "a", "\n", "é"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROLS)


def test_read_back(spark):
    rng = random.Random(2)
    rows = [(-7, 0, "user", SAID), (-7, 1, "assistant", SAID), (1, 0, "user", None), (1, 1, None, "x"), (2, None, "assistant", "no turn"), (2, 3, "assistant", "late"), (2, 3, "assistant", "late"), (None, 0, "user", "lost")]
    for c in range(100, 180):
        rows += [(c, t, ("system", "user", "assistant")[t % 3], rng.choice(["hi", "hello <s>", "same \\ text", ""]) * rng.randint(0, 3)) for t in range(rng.randint(1, 6))]
    rows += [(c, 0, "user", "common first turn") for c in range(300, 340)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("pack", F.lit("clash")).repartition(3)
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    for size in (1, 200, 1 << 16):
        got = {r.conv_id: r for r in chat.read_back(chat.pack(df, size)).collect()}
        assert set(got) == set(by)
        for c, turns in by.items():
            turns.sort()
            loss = "".join(x for _, r, x in turns if r == "assistant")
            r = got[c]
            assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for _, a, b in turns)), len(loss), sha(loss))
            assert r.formatted_chars == sum(len(chat.format_turn(a, b)[0]) for _, a, b in turns)
    packs = chat.pack(df.where("conv_id >= 300"), 1 << 16, 1).collect()
    assert len(packs) == 1 and len(packs[0].nodes) == 1 and len(packs[0].leaves) == 40
    assert chat.pack(df.limit(0)).count() == 0


def test_tree_attention(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "q"), (2, 1, "assistant", "b")]
    p, = chat.pack(spark.createDataFrame(rows, SCHEMA), partitions=1).collect()
    root, *leaves = p.nodes
    assert len(leaves) == 2 and root.position == 0 and not root.attend
    assert all(n.position == root.end and [(i.start, i.end) for i in n.attend] == [(root.start, root.end)] for n in leaves)
    assert all(p.text[n.loss_start : n.loss_end] in ("a", "b") for n in leaves)


def test_long_conversations_have_few_intervals(spark):
    """Many turns, and branches late in them: intervals merge, and everything is read back."""
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t} </s>") for t in range(20_000)]
    rows += [(2, t, r, x) for _, t, r, x in rows[:15_000]] + [(2, 15_000, "user", "other end")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("clash")).withColumn("turns", F.lit(0))
    packs = chat.pack(df, 1 << 30, 1)
    p, = packs.collect()
    assert len(p.nodes) == 20_001 and max(len(n.attend) for n in p.nodes) <= 2 and sum(len(n.attend) for n in p.nodes) < 30_000
    got = {r.conv_id: r.n_turns for r in chat.read_back(packs).collect()}
    assert got == {1: 20_000, 2: 15_001}


def test_tokens_of_packs(spark):
    """Each turn's ids stand once; positions and intervals give every conversation as it is encoded alone."""
    from spectraloom.llm.bpe import bpe, default_path

    rows = [(c, t, r, f"some words {t if t < 2 else c} of turn") for c in range(5) for t, r in enumerate(("user", "assistant", "user", "assistant"))]
    packs = chat.pack(spark.createDataFrame(rows, SCHEMA), partitions=1)
    p, = packs.collect()
    got, = chat.tokens(packs).collect()
    model = bpe(default_path(), False)
    assert len(got.nodes) == 2 + 5 * 2 and len(got.ids) == len(got.positions)
    for leaf in p.leaves:
        n = got.nodes[leaf.node]
        spans = [(i.start, i.end) for i in n.attend] + [(n.start, n.end)]
        own = [r for r in rows if r[0] == leaf.conv_id]
        want = [i for _, _, r, x in own for i in np.frombuffer(model.encode(chat.format_turn(r, x)[0].encode()), "<u4").tolist()]
        assert [i for a, b in spans for i in got.ids[a:b]] == want
        assert [i for a, b in spans for i in got.positions[a:b]] == list(range(len(want)))


def plain_terms(text):
    """Terms and their tf by their definition."""
    words = re.findall(r"[a-z\u0080-\U0010ffff]+", (text or "").lower())
    return collections.Counter([*words, *(w[:4] + "~" for w in words if len(w) >= 6)])


def test_scores_by_brute_force(spark):
    """The whole operator against cosines of all examples, with more examples than a block holds."""
    rng = np.random.default_rng(3)
    vocab = [f"{a}{b}" for a in ("ab", "éclat", "straße", "x", "longerword") for b in "abcdefghijkl"]
    make = lambda bad, n: " ".join([*rng.choice(vocab, n), *(["vilest"] * int(rng.integers(1, 4)) if bad else [])])
    rows = [(make(i % 5 == 0, int(rng.integers(0, 25))), int(i % 5 == 0)) for i in range(400)]
    rows += rows[:30] + [(None, 0), ("", 0), (rows[0][0], 0), ("ignored", None)]
    train = spark.createDataFrame(rows, "text string, toxic int")
    asked = [make(i % 4 == 0, int(rng.integers(1, 40))) for i in range(60)] + [rows[0][0], rows[0][0], None, "", "zzz 12", "ÉCLATA éclata STRASSE" * 2000]
    df = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("name", F.lit("clash"))
    got = toxicity.score(df, train, evidence=True).orderBy("doc_id").collect()

    known = [r for r in rows if r[1] is not None]
    n, toxic = len(known), sum(t for _, t in known)
    have, bad = collections.Counter(), collections.Counter()
    for t, y in known:
        have.update(plain_terms(t).keys())
        bad.update({w: y for w in plain_terms(t)})
    rate = toxic / n
    weight = {w: (math.log((n + 1) / (have[w] + 1)) + 1) * math.sqrt(abs(bad[w] - have[w] * rate) / math.sqrt(have[w] * rate * (1 - rate) + 1)) for w in have}

    def vector(text):
        v = {w: (1 + math.log(f)) * weight[w] for w, f in plain_terms(text).items() if weight.get(w, 0) > 0}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    by = collections.defaultdict(list)
    for t, y in known:
        by[t].append(y)
    examples = [(vector(t), min(len(y), 8), sum(y) / len(y)) for t, y in by.items()]
    for r, text in zip(got, asked, strict=True):
        v = vector(text)
        near = sorted(((sum(v[w] * u.get(w, 0) for w in v), c, s) for u, c, s in examples), reverse=True)
        near = [x for x in near if x[0] > 0]
        assert [e.cosine for e in r.evidence] == pytest.approx([c for c, _, _ in near[: toxicity.K]], abs=1e-6)
        if v and (len(near) <= toxicity.K or near[toxicity.K - 1][0] - near[toxicity.K][0] > 1e-6):  # no tie at the last place
            votes = [(c / (1 - min(x, 1) + toxicity.SPREAD), c, s) for x, c, s in near[: toxicity.K]]
            prior = toxicity.PRIOR * np.mean([c for _, c, _ in votes])
            assert r.score == pytest.approx((sum(a * s for a, _, s in votes) + prior * rate) / (sum(a for a, _, _ in votes) + prior), abs=1e-5)
        if not v:
            assert r.score == pytest.approx(rate) and not r.evidence
        assert r.predicted == int(r.score >= toxicity.THRESHOLD)
    assert got[60].score == got[61].score and toxicity.score(df.limit(0), train).count() == 0


@pytest.mark.parametrize("matrix", [0, 40, 300])
def test_blocks_are_skipped(matrix, monkeypatch):
    """Whatever the number of terms in the matrix, the nearest are the same."""
    monkeypatch.setattr(toxicity, "DENSE", matrix)
    rng = np.random.default_rng(5)
    h = np.sort(rng.integers(1, 1 << 60, 300).astype(np.uint64))
    entries = [np.concatenate(x) for x in zip(*((np.full(12, i), np.sort(rng.choice(h[i // 200 * 30 :], 12, False)), rng.integers(1, 5, 12)) for i in range(1000)), strict=True)]
    ix = toxicity.Index(np.arange(1000), np.ones(1000), np.zeros(1000), tuple(entries), h, 1 + rng.random(300), 0.0)
    dense = np.zeros((1024, 300))
    dense[:, : len(ix.dense)] = ix.dense.T
    dense[ix.at, np.repeat(np.repeat(np.arange(300), np.diff(ix.of)), np.diff(ix.start))] = ix.w
    for _ in range(100):
        doc, term, q = ix.unit(np.zeros(8, np.int64), np.sort(rng.choice(h, 8, False)), rng.integers(1, 4, 8), 1)
        cos = dense[:, term] @ q
        ids, got = ix.nearest(term, q, ix.common(doc, term, q, 1)[0])
        assert got == pytest.approx(np.sort(cos)[::-1][: len(got)]) and cos[ids] == pytest.approx(got) and len(got) == min(toxicity.K, (cos > 0).sum())


def test_sample_is_bounded_and_takes_both_kinds(spark):
    rows = [(f"clean words number {i} {i * 7}", 0) for i in range(900)] + [(f"vilest thing {chr(97 + i % 26)} {chr(97 + i // 26)}", 1) for i in range(60)]
    ix = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"), most=100)
    assert len(ix.names) <= 100 and (ix.share > 0).sum() == 50 and ix.stands[ix.share == 0].sum() == pytest.approx(900)
    assert toxicity.score(spark.createDataFrame([("vilest other",)], "text string"), spark.createDataFrame(rows, "text string, toxic int")).first().predicted == 1


def test_toxicity_held_out(spark, texts):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = docs.join(labels, "doc_id").withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    got = toxicity.score(rows.where("held"), rows.where("not held").select("text", "toxic")).select("toxic", "score", "predicted").collect()
    tp = sum(r.toxic == 1 and r.predicted == 1 for r in got)
    assert tp / sum(r.toxic for r in got) > 0.9 and sum(r.toxic == 0 and r.predicted for r in got) / len(got) < 0.01
    assert len({r.score for r in got}) > 0.8 * len(got)
    odd = toxicity.score(texts(None, "", "idiot trash moron scum idiot"), rows.select("text", "toxic"), evidence=True).orderBy("doc_id").collect()
    assert odd[0].score == odd[1].score < 0.3 < odd[2].score and len(odd[2].evidence) == toxicity.K
    none = toxicity.score(texts("a", None), rows.select("text", "toxic").limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}
