"""Exact top-k inner-product search, score at a time over impact-ordered segments.

A block of vectors is indexed by component: the rows of a component fall into
LEVELS segments by quantised value.  For a query, a segment has a largest and
a least contribution.  Segments are processed by descending impact (largest
contribution above the least that their component gives); each adds its impact
to its rows' accumulators.  At any time a row's score is at most its
accumulator plus the sum over components of the largest impact not yet
processed, and at least its accumulator less the width of the segments.
Processing stops once these bounds prove that no more than a small share of
rows can be among the k best; all of those are scored exactly.

Vectors stay where they were read and are indexed once.  Queries come in
rounds of at most ROUND_VALUES numbers, each a broadcast of its own, of which a
task holds one; every block gives its k best for each query, and the k best of
all blocks meet by query.

Components become floor(256 * x) of x as double.  A vector that is null, or
has a null or non-finite component, takes no part; nor does a null vec_id.
Missing trailing components count as 0.  Rows with the query's vec_id are its
own.  Other repeated rows are candidates of their own.  Of several valid vectors
under one query's vec_id the least, number by number, is the query.  Ties go to
the smaller vec_id.  A query without candidates has no rows.  A score beyond the
range of a long counts as the range's end.
Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cuts, table

K, SCALE = 5, 256.0
LEVELS, BLOCK_ROWS = 32, 1 << 16
#: Segments added in one step.
TOGETHER = 48
ROUND_VALUES = 1 << 23
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def matrix(ids: pa.Array, vectors: pa.Array, scale: float = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """(ids, integer rows) of the valid vectors, padded with zeros."""
    values = vectors.flatten()  # of the rows that are not null
    ok = np.array(vectors.is_valid()) & np.array(ids.is_valid())
    n = np.array(vectors.value_lengths().fill_null(0), np.int64)
    off = np.concatenate([[0], np.cumsum(n)])
    x = np.array(values.cast(pa.float64()).fill_null(float("nan")), np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    ok &= bad[off[1:]] == bad[off[:-1]]
    keep = np.flatnonzero(ok)
    wide = int(n[keep].max()) if len(keep) else 0
    at = off[keep][:, None] + np.arange(wide)
    inside = np.arange(wide) < n[keep][:, None]
    x = np.floor(np.append(x, 0.0) * scale)
    rows = np.where(inside, x[np.minimum(at, len(x) - 1)], 0.0)
    big = np.abs(rows).max(initial=0) >= 2.0**31
    rows = np.array([[int(v) for v in r] for r in rows], object).reshape(rows.shape) if big else rows.astype(np.int64)
    return np.array(ids.fill_null(0), np.int64)[keep], rows


class Block:
    """Impact-ordered segments of up to BLOCK_ROWS rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.n, self.dims = rows.shape
        self.plain = rows.dtype == object
        self.largest = 0.0 if self.plain else float(np.abs(rows).max(initial=0))
        if self.plain or not self.n:
            return
        self.order = np.argsort(ids, kind="stable")
        low, high = rows.min(0), rows.max(0)
        step = np.maximum(1, -(-(high - low + 1) // LEVELS))
        self.seg_dim, self.seg_low, self.seg_high, self.seg_rows = [], [], [], []
        for d in range(self.dims):
            level = (rows[:, d] - low[d]) // step[d]
            by = np.argsort(level, kind="stable").astype(np.int32)
            cut = np.searchsorted(level[by], np.arange(level.max() + 2))
            for j in range(len(cut) - 1):
                if cut[j] < cut[j + 1]:
                    part = by[cut[j] : cut[j + 1]]
                    self.seg_dim.append(d)
                    v = rows[part, d]
                    self.seg_low.append(v.min())
                    self.seg_high.append(v.max())
                    self.seg_rows.append(part)
        self.seg_size = np.array([len(r) for r in self.seg_rows])
        self.seg_dim, self.seg_low, self.seg_high = np.array(self.seg_dim), np.array(self.seg_low), np.array(self.seg_high)

    def own(self, query_id: int) -> np.ndarray:
        a, b = np.searchsorted(self.ids, [query_id, query_id + 1], sorter=self.order)
        return self.order[a:b]

    def possible(self, query: np.ndarray, query_id: int, k: int) -> np.ndarray:
        """Rows that may be among the k best, all of them among those returned."""
        own = self.own(query_id)
        if self.n - len(own) <= 4 * k:
            return np.arange(self.n)
        q = query[self.seg_dim]
        top, least = np.maximum(q * self.seg_low, q * self.seg_high), np.minimum(q * self.seg_low, q * self.seg_high)
        base = np.full(self.dims, np.iinfo(np.int64).max)
        np.minimum.at(base, self.seg_dim, least)
        impact = top - base[self.seg_dim]
        width = np.zeros(self.dims, np.int64)
        np.maximum.at(width, self.seg_dim, top - least)
        slack = int(width.sum())
        order = np.argsort(-impact, kind="stable")
        acc = np.zeros(self.n, np.int64)
        done, most = 0, max(8 * k, self.n // 32)
        for stop in (len(order) * np.array([10, 12, 14, 16]) // 16).tolist():
            for a in range(done, stop, TOGETHER):
                some = order[a : min(a + TOGETHER, stop)]
                at = np.concatenate([self.seg_rows[s] for s in some.tolist()])
                acc += np.bincount(at, np.repeat(impact[some], self.seg_size[some]), self.n).astype(np.int64)
            done = stop
            left = np.zeros(self.dims, np.int64)  # the largest impact not yet processed in each component
            rest = order[done:]
            np.maximum.at(left, self.seg_dim[rest], impact[rest])
            seen = acc.copy()
            seen[own] = -1
            kth = np.partition(seen, self.n - k)[self.n - k]
            maybe = np.flatnonzero(seen >= kth - slack - int(left.sum()))
            if len(maybe) <= most:
                break
        return maybe

    def best(self, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(vec_ids, scores) of the k best, best first."""
        wide = max(self.dims, len(query))
        if len(query) < self.dims:
            query = np.concatenate([query, np.zeros(self.dims - len(query), query.dtype)])
        q = query[: self.dims]
        big = self.plain or q.dtype == object or self.largest * float(np.abs(q).max(initial=0)) * max(wide, 1) >= 2.0**52
        rows = np.arange(self.n) if big else self.possible(q, query_id, k)
        rows = rows[self.ids[rows] != query_id]
        part = self.rows[rows]
        score = part.astype(object).dot(q.astype(object)) if big else part @ q
        ids = self.ids[rows]
        if big:
            score = np.array([min(max(int(s), LEAST), MOST) for s in score], np.int64)
        at = np.lexsort((ids, ~score))[:k]  # ~x falls as x rises, at both ends too
        return ids[at], score[at]


def search(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = SCALE, round_values: int = ROUND_VALUES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of vectors for each row of queries."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    queries = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id is not null and v is not null").where(~bad)
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    values = queries.agg(F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0))).first()[0]
    # halves a round again would leave room for uneven hashing
    rounds = max(1, -(-2 * values // round_values)) if values > round_values // 2 else 1
    vectors = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    sc = vectors.sparkSession.sparkContext
    held = []
    for r in range(rounds):
        some = (queries.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r) if rounds > 1 else queries).toArrow()
        held.append(sc.broadcast(matrix(some.column("id").combine_chunks(), some.column("v").combine_chunks(), scale)))

    def run(batches):
        def blocks():
            ids, rows, n = [], [], 0
            for batch in batches:
                for a, b in cuts(batch.column(1), BLOCK_ROWS * 64):
                    i, m = matrix(batch.column(0)[a:b], batch.column(1)[a:b], scale)
                    ids.append(i)
                    rows.append(m)
                    n += len(i)
                    if n >= BLOCK_ROWS:
                        yield joined(ids, rows)
                        ids, rows, n = [], [], 0
            if n:
                yield joined(ids, rows)

        for block in blocks():
            for one in held:
                qids, q = one.value
                found = [(qid, v, s) for j, qid in enumerate(qids.tolist()) for v, s in zip(*block.best(q[j], qid, k), strict=True)]
                if found:
                    a, b, c = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["query_id", "vec_id", "score"])
                if rounds > 1:
                    vars(one).pop("_value", None)  # a worker keeps one round's queries

    out = vectors.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def joined(ids: list[np.ndarray], rows: list[np.ndarray]) -> Block:
    wide = max(m.shape[1] for m in rows)
    kind = object if any(m.dtype == object for m in rows) else np.int64
    return Block(np.concatenate(ids), np.concatenate([np.pad(m, ((0, 0), (0, wide - m.shape[1]))).astype(kind) for m in rows]))


def op10_topk(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where("vec_id % 50 = 0"))


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
           from embeddings where vec_id is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
