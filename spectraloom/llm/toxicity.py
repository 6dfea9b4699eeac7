"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are the letter runs of a lower-cased text (letters: a-z and all that is
not ASCII) and the first STEM letters of longer ones, told apart by 64-bit
hashes.  A term's weight in a text is (1 + ln tf) * idf * relevance, where
relevance is the root of the standardised difference between the number of
toxic labelled rows that have the term and the number expected without a
relation; no term is left out for its class.  idf and relevance count all
labelled rows.  Vectors have length one.

Examples are distinct labelled texts with the number of their rows and of the
toxic ones.  They lie in blocks of an inverted index in which every term has
its largest weight per block.  The DENSE commonest terms, which nearly every
block has, are a matrix instead: one product gives what they add for a run of
queries.  A query sums both into a bound for each block, scores the blocks with
the largest bounds, and goes on only to blocks whose bound reaches its K-th
best cosine, so the K nearest are exact (ties: smaller example number).  Votes are weighted by 1 / (distance + SPREAD) and by how
many rows an example stands for, and drawn to the rate of all rows with the
strength PRIOR.

Bounds: MOST_EXAMPLES texts and MOST_BYTES bytes of them are indexed, half of
each for texts with a toxic row (room that one kind leaves is the other's), by
the smallest hash; every one is taken whole.  Terms of none of them have no
weight, in queries too.

A text without a term of any weight (null and empty ones too) gets the rate of
all labelled rows; without labelled rows every score is 0.  A row labelled both
ways (equal texts) counts for both; a document with several labels is toxic if
one of them says so.  Repeated rows give repeated rows; input columns named
score, predicted or evidence are replaced, others are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

STEM = 4
K, SPREAD, PRIOR, THRESHOLD = 24, 0.05, 1.0, 0.3
MOST_EXAMPLES, MOST_BYTES = 2048, 1 << 24
BLOCK = 64
#: Blocks that a query scores before it compares bounds; texts whose scores a task remembers.
FIRST, SAME = 8, 50_000
#: Terms whose weights are a matrix, and queries that are multiplied with it at once.
DENSE, QUERIES = 256, 128
#: Ranges of terms that are counted apart.
SLOTS = 64
_U = np.uint64

_GAP = np.ones(256, bool)
_GAP[97:123] = False
_GAP[128:] = False


def terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, term hash, tf) of the different terms of texts, by text and hash."""
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    w = C.Words(buf, off, space=_GAP)
    sums = C.byte_sums(buf)
    doc, h = w.doc, w.hashes(sums)
    letters = np.flatnonzero((buf & 0xC0) != 0x80)  # first bytes of characters
    at = np.searchsorted(letters, w.start)
    long = np.searchsorted(letters, w.end) - at >= STEM + 2
    stems = C.span_hashes(buf, w.start[long], letters[at[long] + STEM], sums) ^ _U(0x5EED)
    doc, h = np.concatenate([doc, doc[long]]), np.concatenate([h, stems])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])) if len(doc) else np.empty(0, np.int64)
    return doc[first], h[first], np.diff(np.append(first, len(doc)))


def spans(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All numbers of the ranges start .. stop, one range after another."""
    n = stop - start
    return np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))


class Index:
    """Examples in a block-max inverted index.

    names, stands, share: of each example its text's hash, the rows it stands for and the toxic share of them;
    entries (example, term hash, tf); weight: of each distinct term hash, ascending.
    """

    def __init__(self, names: np.ndarray, stands: np.ndarray, share: np.ndarray, entries: tuple[np.ndarray, np.ndarray, np.ndarray], hashes: np.ndarray, weight: np.ndarray, rate: float):
        self.names, self.stands, self.share, self.rate = names, stands, share, rate
        self.vocab, self.weight = C.Table(hashes, np.arange(len(hashes), dtype=np.int32)), weight
        self.blocks, self.number = (len(names) + BLOCK - 1) // BLOCK, None
        example, h, tf = entries
        example, term, w = self.unit(example, h, tf, len(names))
        # the commonest terms come first
        often = np.argsort(-np.bincount(term, minlength=len(hashes)), kind="stable")
        self.number = np.empty(len(hashes), np.int32)
        self.number[often] = np.arange(len(hashes))
        term = self.number[term]
        self.dense = np.zeros((min(DENSE, len(hashes)), self.blocks * BLOCK))
        few = term >= len(self.dense)
        self.dense[term[~few], example[~few]] = w[~few]
        example, term, w = example[few], term[few], w[few]
        order = np.lexsort((example, term))
        self.at, term, self.w = example[order].astype(np.int32), term[order], w[order]
        block = self.at // BLOCK
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.empty(0, np.int64)
        #: of each (term, block): the block, its largest weight, and where its entries start
        self.block, self.most, self.start = block[first].astype(np.int32), np.maximum.reduceat(self.w, first) if len(first) else self.w, np.append(first, len(term))
        self.of = np.searchsorted(term[first], np.arange(len(hashes) + 1))

    def unit(self, doc: np.ndarray, h: np.ndarray, tf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term number, weight) of the terms that have a weight, of length one for each text."""
        at = self.vocab.find(h)
        term = self.vocab.values[at]
        ok = (at >= 0) & (self.weight[term] > 0) if len(self.weight) else np.zeros(len(h), bool)
        doc, term, tf = doc[ok], term[ok], tf[ok]
        w = (1 + np.log(tf)) * self.weight[term]
        return doc, term if self.number is None else self.number[term], w / np.sqrt(np.bincount(doc, w * w, n))[doc]

    def common(self, doc: np.ndarray, term: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
        """What the commonest terms add to the cosines of n queries with all examples."""
        ok = term < len(self.dense)
        queries = np.zeros((n, len(self.dense)))
        queries[doc[ok], term[ok]] = q[ok]
        return queries @ self.dense

    def nearest(self, term: np.ndarray, q: np.ndarray, cosine: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a cosine above 0, best first; cosine: what the commonest terms add."""
        ok = term >= len(self.dense)
        term, q = term[ok], q[ok]
        lo, hi = self.of[term], self.of[term + 1]
        at = spans(lo, hi)
        q, block = np.repeat(q, hi - lo), self.block[at]
        base = cosine.reshape(-1, BLOCK).max(1)
        bound = base + np.bincount(block, q * self.most[at], self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        worst, part, done = 0.0, order[:FIRST], np.zeros(self.blocks, bool)
        while len(part):
            done[part] = True
            chosen = np.zeros(self.blocks, bool)
            chosen[part] = True
            some = np.flatnonzero(chosen[block])
            start, stop = self.start[at[some]], self.start[at[some] + 1]
            p = spans(start, stop)
            cosine = cosine + np.bincount(self.at[p], np.repeat(q[some], stop - start) * self.w[p], len(cosine))
            if len(part) == len(order):
                break
            if done.sum() * BLOCK > k:
                worst = np.partition(cosine.reshape(-1, BLOCK)[done].ravel(), -k)[-k]
            order = order[len(part) :]
            # blocks left whose bound does not reach the worst of the k have none of them
            part = order = order[bound[order] >= worst - 1e-9]
        found = np.flatnonzero(np.repeat(done, BLOCK) & (cosine > 0))
        if len(found) > 4 * k:
            found = found[cosine[found] >= np.partition(cosine[found], -k)[-k] - 1e-9]
        best = np.lexsort((found, -np.round(cosine[found], 9)))[:k]
        return found[best], cosine[found[best]]

    def vote(self, ids: np.ndarray, cosines: np.ndarray) -> float:
        w = self.stands[ids] / (np.maximum(1 - cosines, 0) + SPREAD)
        scale = PRIOR * (self.stands[ids].mean() if len(ids) else 1.0)
        return float(((w * self.share[ids]).sum() + scale * self.rate) / (w.sum() + scale))

    def score(self, texts: list[str | None]) -> list[tuple[float, list[tuple[int, float]]]]:
        """(score, evidence) of each text; evidence: examples and cosines."""
        if not len(self.names):
            return [(0.0, [])] * len(texts)
        doc, term, q = self.unit(*terms(texts), len(texts))
        cut = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
        out = []
        for lo in range(0, len(texts), QUERIES):
            hi = min(lo + QUERIES, len(texts))
            here = slice(cut[lo], cut[hi])
            added = self.common(doc[here] - lo, term[here], q[here], hi - lo)
            for i in range(lo, hi):
                a, b = cut[i], cut[i + 1]
                if a == b:
                    out.append((self.rate, []))
                    continue
                ids, cosines = self.nearest(term[a:b], q[a:b], added[i - lo])
                out.append((self.vote(ids, cosines), list(zip(ids.tolist(), cosines.tolist(), strict=True))))
        return out


def _counts(rows: DataFrame, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each term, the rows of (text, toxic) and the toxic ones that have it."""
    held = rows.sparkSession.sparkContext.broadcast(C.Table(hashes, np.arange(len(hashes), dtype=np.int64)))
    per = -(-max(len(hashes), 1) // SLOTS)

    def run(batches):
        n = np.zeros((2, len(hashes)), np.int64)
        for batch in batches:
            for a, b in C.cuts(batch.column(0)):
                doc, h, _ = terms(batch.column(0)[a:b].to_pylist())
                toxic = np.array(batch.column(1)[a:b].to_pylist(), np.int64)
                at = held.value.find(h)
                term = held.value.values[at[at >= 0]]
                n[0] += np.bincount(term, minlength=len(hashes))
                n[1] += np.bincount(term, toxic[doc[at >= 0]], len(hashes)).astype(np.int64)
        at = np.flatnonzero(n[0])
        for slot, data in C.scattered(at // per, [(at % per).astype("<u4"), n[0][at], n[1][at]]):
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), *[pa.array([d], pa.binary()) for d in data]], names=["slot", "at", "n", "toxic"])

    def add(group: pa.Table) -> pa.Table:
        at = C.gathered(group.column("at"), "<u4")
        sums = [np.bincount(at, C.gathered(group.column(c), "<i8"), per).astype(np.int64).tobytes() for c in ("n", "toxic")]
        return pa.table([group.column("slot").slice(0, 1), pa.array([b""], pa.binary()), *[pa.array([s], pa.binary()) for s in sums]], names=["slot", "at", "n", "toxic"])

    kind = "slot int, at binary, n binary, toxic binary"
    out = np.zeros((2, per * SLOTS), np.int64)
    for r in rows.mapInArrow(run, kind).groupBy("slot").applyInArrow(add, kind).toArrow().to_pylist():
        out[:, r["slot"] * per : (r["slot"] + 1) * per] = [np.frombuffer(r["n"], "<i8"), np.frombuffer(r["toxic"], "<i8")]
    return out[0, : len(hashes)], out[1, : len(hashes)]


def relevance(n: np.ndarray, toxic: np.ndarray, all_n: int, all_toxic: int) -> np.ndarray:
    """The root of the standardised difference of toxic counts from those without a relation."""
    rate = all_toxic / max(all_n, 1)
    return np.sqrt(np.abs(toxic - n * rate) / np.sqrt(n * rate * (1 - rate) + 1))


def fit(train: DataFrame, text_col: str = "text", most: int = MOST_EXAMPLES, most_bytes: int = MOST_BYTES) -> Index:
    """The index of labelled rows (text_col, toxic), made on the driver from the sample that the module names and counts over all rows."""
    rows = train.select(F.col(text_col).alias("text"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null")
    keyed = rows.withColumn("name", F.xxhash64("text"))
    texts = keyed.groupBy("name").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.max(F.coalesce(F.octet_length("text"), F.lit(0))).cast("long").alias("size"))
    texts = C.written(texts.withColumn("kind", (F.col("toxic") > 0).cast("int")), "examples")
    kinds = {r.kind: r for r in texts.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"), F.count("*").alias("texts"), F.sum("size").alias("size")).collect()}
    if not kinds:
        return Index(*[np.empty(0)] * 3, (np.empty(0, np.int64), np.empty(0, _U), np.empty(0, np.int64)), np.empty(0, _U), np.empty(0), 0.0)
    n, toxic = sum(r.n for r in kinds.values()), sum(r.toxic for r in kinds.values())
    # per kind the first by hash, out of somewhat more that lie below a hash threshold
    room = {k: (max(most // 2, most - sum(r.texts for j, r in kinds.items() if j != k)), max(most_bytes // 2, most_bytes - sum(r.size for j, r in kinds.items() if j != k))) for k in kinds}
    key, wanted = F.pmod("name", F.lit(1 << 40)), F.lit(False)
    for k, (count, _) in room.items():
        wanted |= (F.col("kind") == k) & (key < int((1 << 40) * min(1.0, (1.3 * count + 200) / kinds[k].texts)))
    by = Window.partitionBy("kind").orderBy("key", "name")
    some = texts.withColumn("key", key).where(wanted).withColumn("nth", F.row_number().over(by))
    some = some.withColumn("before", F.coalesce(F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    wanted = F.lit(False)
    for k, (count, size) in room.items():
        wanted |= (F.col("kind") == k) & (F.col("nth") <= count) & (F.col("before") < size)
    some = some.where(wanted).select("name", "n", "toxic", "kind")
    chosen = keyed.select("name", "text").join(F.broadcast(some.select("name")), "name", "left_semi").dropDuplicates(["name"]).join(some, "name")

    def run(batches):
        for batch in batches:
            for a, b in C.cuts(batch.column(1)):
                doc, h, tf = terms(batch.column(1)[a:b].to_pylist())
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                blobs = [pa.array([x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for x in (h, tf.astype("<u4"))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *[c[a:b] for c in batch.columns[2:]], *blobs], names=["name", "n", "toxic", "kind", "hashes", "tfs"])

    got = chosen.select("name", "text", "n", "toxic", "kind").mapInArrow(run, "name long, n long, toxic long, kind int, hashes binary, tfs binary").toArrow()
    hashes, tfs = (C.gathered(got.column(c), t) for c, t in (("hashes", "<u8"), ("tfs", "<u4")))
    size = np.array([len(b) // 8 for b in got.column("hashes").to_pylist()], np.int64)
    vocab = np.unique(hashes)
    name, own_n, own_toxic, kind = (got.column(c).to_numpy() for c in ("name", "n", "toxic", "kind"))
    with_term, toxic_with = _counts(rows, vocab)
    weight = (np.log((n + 1) / (with_term + 1)) + 1) * relevance(with_term, toxic_with, n, toxic)
    # neighbours in the index: equal kinds, then by the term of most weight
    of = np.repeat(np.arange(len(name)), size)
    term = np.searchsorted(vocab, hashes)
    top = np.full(len(name), -1)
    best = np.lexsort((weight[term], of))
    last = np.flatnonzero(np.append(of[best][1:] != of[best][:-1], True)) if len(of) else np.empty(0, np.int64)
    top[of[best][last]] = term[best][last]
    order = np.lexsort((name, top, kind))
    place = np.empty(len(name), np.int64)
    place[order] = np.arange(len(name))
    each = np.array([kinds[k].n / own_n[kind == k].sum() if k in kinds and (kind == k).any() else 1.0 for k in (0, 1)])
    stands = each[kind] * np.minimum(own_n, 8)
    return Index(name[order], stands[order], (own_toxic / own_n)[order], (place[of], hashes, tfs), vocab, weight, toxic / n)


EVIDENCE = T.ArrayType(T.StructType([T.StructField("example", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("toxic_share", T.DoubleType())]))


def score(df: DataFrame, train: DataFrame, text_col: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD, evidence: bool = False) -> DataFrame:
    """df (or its columns in keep) with score and predicted, and with evidence the nearest examples (xxhash64 of their texts), their cosines and toxic shares."""
    held = df.sparkSession.sparkContext.broadcast(fit(train, text_col))
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    if evidence:
        fields.append(T.StructField("evidence", EVIDENCE))
    if keep is not None:
        df = df.select(*dict.fromkeys([*keep, text_col]))
    known: dict = {}

    def run(batch: pa.RecordBatch) -> dict:
        index, texts = held.value, batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        new = list(dict.fromkeys(t for t in texts if t not in known))
        if len(known) + len(new) > SAME:
            known.clear()
            new = list(dict.fromkeys(texts))
        known.update(zip(new, index.score(new), strict=True))
        got = [known[t] for t in texts]
        out = {"score": pa.array([s for s, _ in got], pa.float64()), "predicted": pa.array([int(s >= threshold) for s, _ in got], pa.int32())}
        if evidence:
            kind = pa.list_(pa.struct([("example", pa.int64()), ("cosine", pa.float64()), ("toxic_share", pa.float64())]))
            out["evidence"] = pa.array([[{"example": int(index.names[i]), "cosine": c, "toxic_share": float(index.share[i])} for i, c in e] for _, e in got], kind)
        return out

    return C.map_append(df, run, fields, keep, text_col)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(C.crc_mod("doc_id", 4) == 2, F.lit(False)))
    labels = C.table(spark, sf_dir, "labels").select("doc_id", "toxic").where("doc_id is not null and toxic is not null")
    labels = labels.where(C.crc_mod("doc_id", 4) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = docs.select("doc_id", "text").join(labels.hint("shuffle_hash"), "doc_id")
    train = C.written(train.select("text", "toxic"), "toxic")
    out = score(docs, train, keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", "predicted")
