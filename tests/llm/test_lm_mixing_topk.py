import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spectraloom.llm import common, lm, mixing, topk


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


@pytest.mark.parametrize("head", [1 << 19, 50])
def test_base_scores(docs, texts, head):
    df = docs.select("doc_id", "text").unionByName(texts(None, "", "never seen wordlets", "The the THE").selectExpr("doc_id + 5000 as doc_id", "text"))
    df = df.withColumn("held_out", F.col("doc_id") % 7 == 2)
    train = df.where("not held_out")
    count = collections.Counter(t for r in train.collect() for t in tokens(r.text))
    n, v = sum(count.values()), len(count)
    got = lm.score(df, train, head=head).collect()
    text = {r.doc_id: r.text for r in df.collect()}
    assert len(got) == len(text)
    for r in got:
        want = sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens(text[r.doc_id]))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens(text[r.doc_id])), sum(count[t] > 0 for t in tokens(text[r.doc_id])), n)
        assert r.base_score == pytest.approx(want) and r.score < 0
    assert lm.score(df.limit(0), train).count() == 0
    assert {r.n_known for r in lm.score(df.limit(3), train.limit(0)).collect()} == {0}


def block(rows):
    raw = [r.encode() for r in rows]
    return common.Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64), lower=True)


def test_stream():
    s, off = lm.stream(block(["A bc", "", "  x\n"]))
    assert bytes(s) == b"a bc\n\nx\n" and off.tolist() == [0, 5, 6, 8]
    keys = [int(k).to_bytes(7, "big") for k in lm.contexts(s, off)]
    assert keys[:2] + keys[5:] == [b"\n\0\0\0\0\0a", b"a\n\0\0\0\0 ", b"\n\0\0\0\0\0\n", b"\n\0\0\0\0\0x", b"x\n\0\0\0\0\n"]


def plain_model(rows, depth=lm.DEPTH):
    """(total symbols, counts by context tuple, retained contexts, probability function) of a suffix tree by its definition."""
    counts = collections.defaultdict(collections.Counter)
    for row in rows:
        symbols, _ = lm.stream(block([row]))
        past = [lm.END, *symbols.tolist()]
        for i in range(1, len(past)):
            for d in range(min(depth, i) + 1):
                counts[tuple(past[i - d : i])][past[i]] += 1
    total = sum(counts[()].values())
    retained = set()

    def prob(context, symbol):
        if not context:
            return (counts[()][symbol] + 1 / 256) / (total + 1)
        below = prob(context[1:], symbol)
        if context not in retained:
            return below
        c = counts[context]
        return (c[symbol] + len(c) * below) / (sum(c.values()) + len(c))

    for context in sorted(counts, key=len):
        c = counts[context]
        n = sum(c.values())
        if context and n >= lm.LEAST and sum(x * math.log(x / n / prob(context[1:], s)) for s, x in c.items()) >= lm.CUT * math.log(total):
            retained.add(context)
    return total, counts, retained, prob


def plain_score(prob, text, depth=lm.DEPTH):
    symbols, _ = lm.stream(block([text]))
    past = [lm.END, *symbols.tolist()]
    return sum(math.log10(prob(tuple(past[max(0, i - depth) : i]), past[i])) for i in range(1, len(past)))


@pytest.mark.parametrize(("parts", "most", "size"), [("1", 1 << 20, 1 << 12), ("4", 300, 1 << 15), ("64", 0, 512)])
def test_scores_by_definition(spark, texts, parts, most, size):
    """Any number of hash ranges and any part of the tree beyond the broadcast give the scores of a tree made in one process."""
    rng = np.random.default_rng(2)
    rows = ["".join(rng.choice(list("abc d"), 300)) for _ in range(40)] + ["the cat sat on the mat. " * 20, "", "Étude \x00 nul", "b" * 3000, "b" * 3000]
    _, _, retained, prob = plain_model(rows)
    assert {len(c) for c in retained} >= {1, 2, 3, 4}
    asked = [*rows[:5], *rows[40:], "the mat", "zzz ~", "cat" * 700, None]
    train = texts(*rows, None).select("doc_id", "text").withColumn("held_out", F.lit(False))
    _, _, retained, prob = plain_model([*rows, ""])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = lm.score(texts(*asked, **{"score": 1, "row": "clash", "part": 2}).withColumn("held_out", F.lit(True)), train, most=most, filter_bytes=size).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(asked)
    for r in got:
        assert r.score == pytest.approx(plain_score(prob, asked[r.doc_id] or ""), rel=1e-5)


def test_distributions_sum_to_one():
    rng = np.random.default_rng(3)
    s, off = lm.stream(block(["".join(rng.choice(list("ab c"), 60)) for _ in range(40)]))
    keys, counts = np.unique(lm.contexts(s, off), return_counts=True)
    root, near, above = lm.grown(lm.at_depth(keys, counts, lm.NEAR - 1, lm.DEPTH), len(s))
    far = lm.deep(keys, counts, above, len(s))
    tree = lm.Tree(root, np.concatenate([near[0], far[0]]), np.concatenate([near[1], far[1]]))
    for key in np.unique(lm.contexts(s, off))[:200]:
        each = (key & np.uint64(~255 & (1 << 64) - 1)) | np.arange(1, 256, dtype=np.uint64)  # symbol 0 does not occur
        assert (10 ** tree.logs(each)).sum() == pytest.approx(1, abs=1e-4)


def test_table_finds_what_it_has():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(1, 1 << 56, 5000).astype(np.uint64))
    t = common.Table(keys, np.arange(len(keys)))
    assert (t.values[t.find(keys)] == np.arange(len(keys))).all()
    assert (t.find(rng.integers(1 << 56, 1 << 57, 1000).astype(np.uint64)) == -1).all()
    assert (common.Table(keys[:0], np.empty(0)).find(keys) == -1).all()


def test_attested_contexts_stay_beside_much_other_text(texts):
    rare, other = "facade " * 60, "abcdef " * 30_000
    df = texts(*[other] * 60, rare).select("doc_id", "text").withColumn("held_out", F.col("doc_id") < 0)
    got = lm.score(texts("facade facade facade").select("doc_id", "text", F.lit(True).alias("held_out")), df).first().score
    # 60 times "facade" among 12 million symbols: only the first letter is unlikely
    assert got > -3 * math.log10(60 * 30_000) - 3


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "some words"), (1, "some words"), (1, "some words"), (2, None)], "doc_id long, text string").withColumn("held_out", F.lit(False))
    got = lm.score(df, df).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known) for r in got) == [(-1, 3, 3), (1, 3, 3), (1, 3, 3), (2, 1, 1)]
    assert len({r.score for r in got if r.n_tokens == 3}) == 1


def shares(sizes, weights=(5, 2, 1), cap=3):
    w = [weights[i % 3] for i in range(len(sizes))]
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        unit = left / sum(w[i] for i in free)
        over = [i for i in free if w[i] * unit > cap * sizes[i]]
        if not over:
            for i in free:
                target[i] = w[i] * unit
            break
        for i in over:
            target[i] = float(cap * sizes[i])
            left -= target[i]
            free.discard(i)
    return target


def test_targets(spark):
    for sizes in ([100, 1000, 5, 40], [10], [0, 0], [7, 7, 7, 7000], [1, 10**9, 3]):
        df = spark.createDataFrame([(f"s{i}" if i else None, n) for i, n in enumerate(sizes)], "source string, size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        order = [f"s{i}" for i in range(1, len(sizes))] + [None]
        assert [got[s] for s in order] == pytest.approx(shares([*sizes[1:], sizes[0]]))


def test_mix(spark, docs):
    odd = spark.createDataFrame([(9001, None, "src1"), (9002, " ", None), (9003, "one two", None), (9003, "one two", None), (None, "three four five", "src1")], "doc_id long, text string, source string")
    df = docs.select("doc_id", "text", "source").unionByName(odd).withColumn("taken", F.lit("clash"))
    rows, slots, _ = mixing.mix(df)
    got = rows.collect()
    assert len(got) == df.count() and all(r.taken <= 3 * r.size for r in got)
    by = collections.defaultdict(lambda: [0, 0.0])
    for r in got:
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
    assert all(abs(t - want) <= max(0.05 * want, 3 * mixing.BLOCK) for t, want in by.values())
    again, _, _ = mixing.mix(df.repartition(7))
    key = lambda rs: sorted((str(r.doc_id), r.size, r.taken) for r in rs)
    assert key(got) == key(again.collect())
    assert slots.groupBy("shard", "pos").count().where("count > 1").count() == 0
    assert mixing.mix(df.limit(0))[0].count() == 0


def test_taken_by_brute_force(spark, docs):
    """taken is what the drawn blocks hold of each row; the rows of a source fill its blocks without gap or overlap."""
    df = docs.select("doc_id", "text", "source")
    rows, slots, pieces = mixing.mix(df)
    rows, times = rows.collect(), collections.Counter((r.sid, r.block) for r in slots.select("sid", "block").collect())
    held, taken = collections.defaultdict(list), collections.Counter()
    for p in pieces.collect():
        taken[p.sid, p.off] += p.words * times[p.sid, p.block]
        held[p.sid].append((p.off, p.block, p.words))
    assert max(times.values()) <= mixing.CAP
    for r in rows:
        assert r.taken == (taken[r.sid, r.off] if r.size else 0) and r.taken <= mixing.CAP * r.size
    for sid in held:
        own = sorted((r.off, r.size) for r in rows if r.sid == sid and r.size)
        assert [o for o, _ in own] == np.concatenate([[0], np.cumsum([n for _, n in own])])[:-1].tolist()
        assert sum(w for _, _, w in held[sid]) == sum(n for _, n in own)
    size = {(r.doc_id, r.size) for r in rows}
    assert size == {(r.doc_id, len(tokens(r.text)) - 1) for r in df.collect()}


def test_slots_are_not_broadcast(spark, docs):
    """Only the table of sources, which is checked by count, may be sent to all tasks."""
    rows, _, _ = mixing.mix(docs)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan and plan.count("SortMergeJoin") >= 2


def test_shards_are_drawn(spark):
    """Over many shards the counts of a source have a multinomial's mean and, for many more slots than a shard has, its variance."""
    src = spark.createDataFrame([(s, 0, n, float(n)) for s, n in enumerate((6_400_000, 3_200_000, 640_000))], "sid long, weight int, source_size long, target double")
    planned = mixing.plan(src.withColumn("source", F.col("sid").cast("string")))
    sizes = {r.sid: r.slots for r in planned.collect()}
    dealt, total = mixing.slots(planned, 4), sum(sizes.values())
    counts = collections.defaultdict(list)
    for r in mixing.shard_counts(dealt).collect():
        if (r.shard + 1) * mixing.SHARD_SLOTS <= total:
            counts[r.sid].append(r.n)
    for sid, n in counts.items():
        p = sizes[sid] / total
        assert np.mean(n) == pytest.approx(mixing.SHARD_SLOTS * p, rel=0.03)
        assert 0.3 < np.var(n) / (mixing.SHARD_SLOTS * p * (1 - p)) < 3


def test_feistel_is_a_permutation(spark):
    for a, b in ((1, 1), (3, 4), (7, 7)):
        got = spark.range(a * b).select(mixing._feistel(F.col("id"), F.lit(a).cast("long"), F.lit(b).cast("long"), F.lit(3)).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(a * b))


def test_topk_by_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(size=16) * 0.2]) for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(300)]  # ties
    rows += [(5000, None), (5050, [None] + [0.0] * 15), (5100, [float("nan")] * 16), (5150, [float("inf")] * 16), (None, [0.1] * 16), (6000, [0.5] * 4), (50, rows[50][1]), (7000, [3.0e12] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    ok = [(i, np.array([math.floor(256 * x) for x in v] + [0] * (16 - len(v)), object)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for size in (1 << 23, 200):
        got = collections.defaultdict(list)
        for r in topk.search(df.where("vec_id is null or vec_id <> 7000"), df.where("vec_id % 50 = 0 and vec_id <> 7000"), round_values=size).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        want = {}
        for q, v in ok:
            if q % 50 == 0 and q != 7000:
                want[q] = [(i, -s) for s, i in sorted((-int(v.dot(w)), i) for i, w in ok if i not in (q, 7000))[:5]]
        assert dict(got) == want
    # components beyond 2**31 are exact too
    big = topk.search(df.where("vec_id in (7000, 1, 2)"), df.where("vec_id = 7000")).collect()
    values = dict((i, v) for i, v in ok)
    assert {r.vec_id: r.score for r in big} == {i: int(values[7000].dot(values[i])) for i in (1, 2)}
    assert topk.search(df.limit(0), df).count() == 0


def test_topk_odd_rows(spark):
    """Queries under one id, scores beyond a long, clashing columns."""
    rows = [(50, [0.5, 0.25]), (50, [0.25, 0.5]), (50, [None, 1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (100, [1e16, 0.0]), (3, [1e16, 1.0]), (4, [-1e16, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "v": F.lit("y"), "score": F.lit(1)}).repartition(3)
    got = collections.defaultdict(list)
    for r in topk.search(df, df.where("vec_id % 50 = 0"), k=9).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    # the query of 50 is its least vector, (64, 128)
    assert got[50] == [(3, topk.MOST), (100, topk.MOST), (2, 128 * 256), (1, 64 * 256), (1, 64 * 256), (4, topk.LEAST)]
    assert got[100] == [(1, topk.MOST)] * 2 + [(3, topk.MOST)] + [(50, topk.MOST)] * 2 + [(2, 0), (4, topk.LEAST)]


def test_possible_members_are_few():
    rng = np.random.default_rng(5)
    m = np.floor(rng.normal(size=(5000, 32)) * 50).astype(np.int64)
    b = topk.Block(np.arange(5000), m)
    assert np.mean([len(b.possible(m[i], i, 5)) for i in range(20)]) < 1000


def test_matrix_keeps_valid_rows():
    ids, m = topk.matrix(pa.array([1, 2, None]), pa.array([[0.5, -0.001], None, [1.0, 1.0]]))
    assert ids.tolist() == [1] and m.tolist() == [[128, -1]]
