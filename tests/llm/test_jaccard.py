import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.llm import jaccard


def brute(rows, percent=90, words=3):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if len(sets[j]) * percent > len(sets[i]) * 100:
                break
            n = len(sets[i] & sets[j])
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                p, q = sorted((find(i), find(j)))
                up[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("hot", "words", "percent"), [(jaccard.HOT, 3, 90), (7, 3, 90), (7, 5, 80)])
def test_components_by_brute_force(spark, hot, words, percent):
    """Lists longer than `hot` lie in several groups; the links are the same."""
    n_words = words
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows = []
    for _ in range(5):
        base = words(rng.randint(20, 150))
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows) * 7 % 2003, " ".join(w[: len(w) - (rng.random() < 0.3) * rng.randint(0, len(w) // 12)])))
    shared = " ".join(words(55))
    rows += [(5000 + k, shared + " " + " ".join(words(rng.randint(0, 12)))) for k in range(80)]
    chain = words(60)
    for k in range(12):  # drifts: neighbours link, ends do not
        rows.append((7000 + k, " ".join(chain)))
        chain = chain[1:] + words(1)
    rows += [(9000, None), (9001, ""), (9002, "a b"), (9003, "A b"), (9004, "a"), (9005, "a b c"), (9006, " ")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_shingles int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, words=n_words, percent=percent, hot=hot).collect()}
    assert got == brute(rows, percent, n_words)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "lone words here"), (4, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 1, None), (4, 0, 4)], key=str)
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_prefixes_share_enough():
    rng = np.random.default_rng(1)
    for _ in range(2000):
        n = int(rng.integers(1, 80))
        pool = rng.permutation(200)
        x = set(pool[:n].tolist())
        y = set(pool[int(rng.integers(0, max(1, n // 10 + 1))) : n].tolist()) | set(pool[n : n + int(rng.integers(0, n // 10 + 2))].tolist())
        if y and 100 * len(x & y) >= 90 * len(x | y):
            px, py = (set(sorted(s)[: int(jaccard.prefix_size(len(s), 90))]) for s in (x, y))
            assert len(px & py) >= jaccard.must_share(len(x), len(y), 90)


def test_paired_skips_no_pair():
    rng = np.random.default_rng(3)
    for percent in (80, 90):
        n = rng.integers(5, 60, 500)
        pos = rng.integers(0, jaccard.prefix_size(n, percent))
        key, comp, lists, node = rng.integers(0, 2, 500), rng.integers(0, 40, 500), rng.integers(1, 20, 500), rng.permutation(500)
        for side in (np.full(500, -1), rng.integers(0, 2, 500)):
            got = set()
            for x, y, need in jaccard.paired(key, side, n, pos, comp, node, lists, percent, flush=100):
                got |= set(zip(x.tolist(), y.tolist(), need.tolist(), strict=True))
            want = set()
            for i in range(500):
                for j in range(i):
                    if key[i] == key[j] and comp[i] != comp[j] and (side[i] < 0 or side[i] != side[j]) and max(n[i], n[j]) * percent <= min(n[i], n[j]) * 100:
                        need = int(jaccard.must_share(n[i], n[j], percent))
                        first = min(jaccard.SHARED, need)
                        early = all(jaccard.prefix_size(n[k], percent) - pos[k] > need - first for k in (i, j))
                        if early and min(lists[i], lists[j]) >= need and min(n[i] - pos[i], n[j] - pos[j]) >= jaccard.needed(n[i] + n[j], percent) - min(pos[i], pos[j]):
                            want.add((min(node[i], node[j]), max(node[i], node[j]), first))
            assert got == want and want


def test_clashing_columns_and_long_texts(spark):
    text = " ".join(f"w{i}" for i in range(200_000))
    df = spark.createDataFrame([(1, text), (2, text + " more"), (3, "else where here")], "doc_id long, text string")
    for name in ("id", "node", "n", "th", "class", "component_id"):
        df = df.withColumn(name, F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == {1: (199_998, 1), 2: (199_999, 1), 3: (1, 3)}
