"""Exact n-gram Jaccard self-join with skipping by set relations.

Sets of word shingles link at a Jaccard similarity of PERCENT or more.  Equal
sets are one node.  All shingles are in one order, rarest first (counts of the
commoner ones, then hashes), and each node is indexed under its first
|x| - ceil(t |x|) + SHARED shingles, its prefix.  What linked sets share of
their prefixes at least follows from their sizes (must_share), so pairs are
counted over lists before any set is fetched.  Blocks of an index list that
cannot link by size or by the shingles left behind their positions are skipped
(see paired()).  A list longer than HOT lies in several groups in every step.

Near-copies are reduced first.  In every list, size cells choose two leaders,
the one with the largest share of common shingles and one by hash; a node is compared with the leaders it shares most lists with.  Its
differences from a linked leader are kept.  Of two nodes of one component no
link needs a proof, so lists then pair only nodes of different components.
For such a pair (x, y) the answer of x's leader c is computed first, once for
all its members, and x's answer is derived from it:
d(x, y) >= d(c, y) - d(c, x) rules out most pairs, and otherwise
|x & y| = |c & y| - |(c - x) & y| + |(x - c) & y|.

Order, leaders and cells only steer cost; every pair that can link is compared.
Shingles travel as blobs in hash ranges.  MOST_COMMON bounds the counts that
are broadcast.  Shingles and sets are told apart by 64-bit hashes.

A text with fewer words than a shingle is one shingle; with none, or null, it is
empty and linked with nothing (component: its doc_id).  Rows with a null
doc_id take part and have the smallest other doc_id that they reach, or null.
Repeated rows are linked with each other, as are equal sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WORDS, PERCENT = 3, 90
#: Prefix shingles that linked sets have in common.
SHARED = 4
#: Ids up to which the wanted texts are found by a broadcast, and beyond by a shuffle.
FEW_IDS = 200_000
#: Shingles whose counts are broadcast to order the index, at most, and the least such count.
MOST_COMMON, LEAST_COMMON = 1 << 20, 8
#: Shingles that a task holds before it hands counts on.
HOLD = 1_500_000
#: Shingles of a hash range, about, and entries of a list or of a list's part that are paired in one group.
PART_SHINGLES, HOT = 2_000_000, 20_000
#: Entries in a block of a list.
SKIP = 64
#: Nodes that a task remembers in order not to index them again.
SEEN = 200_000
#: Bits of a shingle's hash under which it is counted.
COUNT_BITS = 44
SALTS = (0x243F6A8885A308D3, 0x13198A2E03707344)
_U = np.uint64


def shingle_sets(w: C.Words, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    h = w.hashes()
    sums = C.gram_sums(h)
    out = []
    grams = C.gram_hashes(sums, np.arange(max(0, len(h) - words + 1)), words)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= words:
            s = np.sort(grams[a : b - words + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(C.gram_hashes(sums, np.array([a]), b - a))
        else:
            out.append(np.empty(0, _U))
    return out


def node_of(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def needed(n, percent: int):
    """Least overlap of two sets of n elements together that link."""
    return -(-n * percent // (100 + percent))


def prefix_size(n, percent: int):
    """Elements of a set of n of which a linked set has SHARED at least, or all that both must have."""
    return np.minimum(n, n + (-n * percent // 100) + SHARED)


def must_share(n, m, percent: int):
    """Prefix elements that linked sets of n and m elements share at least.

    Of the prefix that ends first in the common order, all common elements up to
    its end lie in both prefixes; those after it are among the rest of its set.
    """
    rest = np.maximum(n - prefix_size(n, percent), m - prefix_size(m, percent))
    return np.maximum(np.minimum(SHARED, -(-np.minimum(n, m) * percent // 100)), needed(n + m, percent) - rest)


def _blocks(batches, column: str):
    for batch in batches:
        for a, b, buf, off in C.slices(batch, column):
            yield batch, a, b, C.Words(buf, off, lower=True)


FIRST = "kind string, part int, id long, node long, n long, keys binary, counts binary"
_FIRST = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _nodes(df: DataFrame, words: int) -> DataFrame:
    """(id, th, node, n) of each row of (id, text); th: a hash of the text."""

    def run(batches):
        for batch, a, b, w in _blocks(batches, "text"):
            sets = shingle_sets(w, words)
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], names=["id", "th", "node", "n"])

    return C.written(df.select("id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, "id long, th long, node long, n long"), "nodes")


def _common(df: DataFrame, words: int, parts: int, most: int = MOST_COMMON) -> tuple[np.ndarray, np.ndarray]:
    """(hash >> (64 - COUNT_BITS), texts that have it) of the commoner shingles, at most `most`."""
    down = _U(64 - COUNT_BITS)
    out = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        held, size = [], 0

        def hand_on():
            k, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            at = (k >> _U(COUNT_BITS - 24)).astype(np.int64) * parts >> 24
            for p, (keys, counts) in C.scattered(at, [k, c.astype("<u4")]):
                keys = np.frombuffer(keys, "<u8")
                step = np.diff(keys, prepend=_U(0))
                wide = np.flatnonzero(step >= _U(1 << 32))
                big = step[wide]
                counts = np.frombuffer(counts, "<u4")
                many = np.flatnonzero(counts > 1)
                full = np.concatenate([np.array([len(keys), len(wide), len(many)], "<u4").view(np.uint8), step.astype("<u4").view(np.uint8), wide.astype("<u4").view(np.uint8), big.astype("<u8").view(np.uint8), many.astype("<u4").view(np.uint8)])
                yield pa.RecordBatch.from_pylist([{"part": p, "keys": full.tobytes(), "counts": counts[many].tobytes()}], schema=out)

        for _, _, _, w in _blocks(batches, "text"):
            for s in shingle_sets(w, words):
                held.append(s >> down)
                size += len(s)
            if size > HOLD:
                yield from hand_on()
                size = 0
        if held:
            yield from hand_on()

    def reduce(group: pa.Table) -> pa.Table:
        keys, counts = [], []
        for blob, many_counts in zip(group.column("keys").to_pylist(), group.column("counts").to_pylist(), strict=True):
            n, n_wide, n_many = np.frombuffer(blob, "<u4", 3).tolist()
            at = 12
            step = np.frombuffer(blob, "<u4", n, at).astype(_U)
            wide = np.frombuffer(blob, "<u4", n_wide, at + 4 * n)
            step[wide] = np.frombuffer(blob, "<u8", n_wide, at + 4 * n + 4 * n_wide)
            many = np.frombuffer(blob, "<u4", n_many, at + 4 * n + 12 * n_wide)
            c = np.ones(n, np.int64)
            c[many] = np.frombuffer(many_counts, "<u4")
            keys.append(np.cumsum(step, dtype=_U))
            counts.append(c)
        k, c = np.concatenate(keys), np.concatenate(counts)
        s = np.sort(k)
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        often = s[first][np.diff(np.append(first, len(s))) > 1]
        # a shingle of one hand-on only counts there
        at = np.searchsorted(often, k)
        hit = (often[np.minimum(at, max(len(often) - 1, 0))] == k if len(often) else np.zeros(len(k), bool)) | (c > 1)
        k, c = C.tally(k[hit], c[hit])
        k, c = k[c >= LEAST_COMMON], c[c >= LEAST_COMMON]
        return pa.table([group.column("part").slice(0, 1), pa.array([k.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], schema=out)

    kind = "part int, keys binary, counts binary"
    table = C.written(df.mapInArrow(run, kind).groupBy("part").applyInArrow(reduce, kind), "common")

    def bins(batches):
        for batch in batches:
            n = np.concatenate([np.frombuffer(c, "<i8") for c in batch.column(0).to_pylist()])
            v, m = np.unique(np.log2(np.maximum(n, 1)).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(m)], names=["bin", "n"])

    hist = table.select("counts").mapInArrow(bins, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy(F.desc("bin")).collect()
    least, sum_ = 1 << 62, 0
    for b, n in hist:
        if (sum_ := sum_ + n) > most:
            break
        least = 1 << b

    def top(batches):
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k, c = np.frombuffer(k, "<u8"), np.frombuffer(c, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([k[c >= least].tobytes()], pa.binary()), pa.array([c[c >= least].tobytes()], pa.binary())], names=["keys", "counts"])

    got = table.select("keys", "counts").mapInArrow(top, "keys binary, counts binary").toArrow()
    return C.tally(C.gathered(got.column(0).to_pylist(), "<u8"), C.gathered(got.column(1).to_pylist(), "<i8"))


LISTS = "kind string, key long, node long, n long, pos long, leader long, lists long, cell long, rank long"
_LISTS = pa.schema([("kind", pa.string()), ("key", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("pos", pa.int64()), ("leader", pa.int64()), ("lists", pa.int64()), ("cell", pa.int64()), ("rank", pa.int64())])


def _index(df: DataFrame, words: int, percent: int, parts: int, common: tuple[np.ndarray, np.ndarray], hot: int = HOT) -> DataFrame:
    """Rows e: the entries of lists with two nodes or more; rows s: lists that a node shares with a leader of its cell or the one below, by salt (pos).

    A list of a shingle that more than `hot` texts have lies in several groups by its nodes' hashes.  Such a group has
    rows h for its entries, with their size cell, and l for the best of each cell, of which _leaders chooses.
    """
    held = df.sparkSession.sparkContext.broadcast(common)
    down = _U(64 - COUNT_BITS)
    cell = np.log(100 / percent)

    def run(batches):
        keys, counts = held.value
        seen, blobs, size = set(), [], 0

        def out():
            cols = [np.concatenate(c) for c in zip(*blobs, strict=True)]
            blobs.clear()
            sub = C.mix(cols[1].astype(_U)) % np.maximum(cols[5], 1).astype(_U)
            part = (C.mix(cols[0] + sub * _U(0x9E3779B97F4A7C15)) % _U(parts)).astype(np.int32)
            cols[5] = (cols[5] > 1).astype(np.uint8)
            for p, data in C.scattered(part, cols):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *[pa.array([d], pa.binary()) for d in data]], names=["part", "key", "node", "n", "pos", "central", "hot"])

        for _, _, _, w in _blocks(batches, "text"):
            for s in shingle_sets(w, words):
                node = node_of(s)
                if not len(s) or node in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(node)
                n = int(prefix_size(len(s), percent))
                split = np.zeros(n, np.int32)
                if len(keys):
                    short = s >> down
                    at = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
                    count = np.where(keys[at] == short, counts[at], 0)
                    if count.any():
                        order = np.lexsort((s, count))[:n]
                        first, split = s[order], (-(-count[order] // hot)).astype(np.int32)
                    else:
                        first = s[:n]
                    # the original of a large group has few shingles that are its own
                    central = int(255 * (count > 0).mean())
                else:
                    first, central = s[:n], 0
                blobs.append((first, np.full(n, node, np.int64), np.full(n, len(s), np.int32), np.arange(n, dtype=np.int32), np.full(n, central, np.uint8), split))
                size += n
            if size > HOLD // 4:
                yield from out()
                size = 0
        if blobs:
            yield from out()

    def rows(kind: str, count: int, /, **columns) -> pa.Table:
        return pa.table([pa.array([kind] * count, pa.string()), *[pa.array(columns[c], pa.int64()) if c in columns else pa.nulls(count, pa.int64()) for c in _LISTS.names[1:]]], schema=_LISTS)

    def lists(group: pa.Table) -> pa.Table:
        cols = [C.gathered(group.column(c), t) for c, t in (("key", "<u8"), ("node", "<i8"), ("n", "<i4"), ("pos", "<i4"), ("central", "u1"), ("hot", "u1"))]
        order = np.lexsort((cols[1], cols[0]))
        key, node, n, pos, central, split = (c[order] for c in cols)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        more = np.zeros(int(new.sum()), bool)
        more[1:] = key[new][1:] == key[new][:-1]
        more[:-1] |= more[1:]
        more |= split[new] > 0
        key, node, n, pos, central, split = (c[new][more].astype(c.dtype if c.dtype == _U else np.int64) for c in (key, node, n, pos, central, split))
        size = np.floor(np.log(np.maximum(n, 1)) / cell + 1e-9).astype(np.int64)
        split = split > 0
        out = [rows("e", int((~split).sum()), key=key[~split].astype(np.int64), node=node[~split], n=n[~split], pos=pos[~split])]
        out.append(rows("h", int(split.sum()), key=key[split].astype(np.int64), node=node[split], n=n[split], pos=pos[split], cell=size[split]))
        pairs = []
        for nth, salt in enumerate(SALTS if len(key) else ()):
            rank = C.mix(node.astype(_U) ^ _U(salt)) >> _U(12)
            if not nth:  # the most central first
                rank |= (255 - central).astype(_U) << _U(52)
            order = np.lexsort((rank, size, key))
            k, z, who = key[order], size[order], node[order]
            head = np.ones(len(k), bool)
            head[1:] = (k[1:] != k[:-1]) | (z[1:] != z[:-1])
            best = head & split[order]
            out.append(rows("l", int(best.sum()), key=k[best].astype(np.int64), leader=who[best], cell=z[best], pos=np.full(best.sum(), nth), rank=rank[order][best].astype(np.int64)))
            head &= ~split[order]
            cells = C.mix(k[head]) + z[head].astype(_U) * _U(0x9E3779B97F4A7C15)
            leader = who[head]
            by = np.argsort(cells)
            cells, leader = cells[by], leader[by]
            for below in (0, 1) if len(cells) else ():
                want = C.mix(key) + (size - below).astype(_U) * _U(0x9E3779B97F4A7C15)
                at = np.minimum(np.searchsorted(cells, want), len(cells) - 1)
                ok = (cells[at] == want) & (leader[at] != node) & ~split
                pairs.append((node[ok], leader[at][ok], np.full(ok.sum(), nth), n[ok]))
        if pairs:
            a, b, c, size = (np.concatenate(x) for x in zip(*pairs, strict=True))
            name = np.lexsort((c, b, a))
            a, b, c, size = a[name], b[name], c[name], size[name]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])) if len(a) else np.empty(0, np.int64)
            out.append(rows("s", len(first), node=a[first], n=size[first], pos=c[first], leader=b[first], lists=np.diff(np.append(first, len(a)))))
        return pa.concat_tables(out)

    entries = df.mapInArrow(run, "part int, key binary, node binary, n binary, pos binary, central binary, hot binary")
    return C.written(entries.groupBy("part").applyInArrow(lists, LISTS), "lists")


def _leaders(lists: DataFrame) -> DataFrame:
    """Rows s of the lists that lie in several groups: their cells' leaders are chosen from the groups' best."""
    best = lists.where("kind = 'l'").groupBy("key", "cell", "pos").agg(F.min_by("leader", F.struct("rank", "leader")).alias("leader"))
    # a cell's leader also leads the cell above
    best = best.select("key", F.explode(F.array(F.col("cell"), F.col("cell") + 1)).alias("cell"), "pos", "leader")
    met = lists.where("kind = 'h'").select("key", "cell", "node", "n").join(best.hint("merge"), ["key", "cell"]).where("node <> leader")
    return met.groupBy("node", "leader", "pos").agg(F.count("*").alias("lists"), F.min("n").alias("n"))


def _sets(df: DataFrame, nodes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, set) of the wanted nodes, from one text each."""
    wanted = C.written(nodes.where("n > 0").groupBy("node").agg(F.min("id").alias("id")).join(wanted, "node", "left_semi"), "wanted")
    n, with_id = wanted.agg(F.count("*"), F.count("id")).first()
    ids = wanted.where("id is not null").select("id").distinct()
    texts = df.join(F.broadcast(ids) if with_id <= FEW_IDS else ids.hint("shuffle_hash"), "id", "left_semi").select("text")
    if n > with_id:
        texts = texts.unionAll(df.where("id is null").select("text"))

    def run(batches):
        for _, _, _, w in _blocks(batches, "text"):
            sets = shingle_sets(w, words)
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "set"])

    made = C.written(texts.mapInArrow(run, "node long, set binary"), "sets")
    # rows of one id may repeat or differ in their texts
    return made if made.count() == n else made.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


VERDICT = "a long, b long, na long, nb long, both long, link boolean, gone binary, come binary"
_VERDICT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64()), ("both", pa.int64()), ("link", pa.bool_()), ("gone", pa.binary()), ("come", pa.binary())])


def common_size(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(b) else 0


def _verify(pairs: DataFrame, sets: DataFrame, percent: int, differences: bool) -> DataFrame:
    """pairs (a, b) with their overlap, and with differences a - b (gone) and b - a (come) of linked ones."""
    one = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            rows = []
            for a, b, sa, sb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = np.frombuffer(sa, "<u8"), np.frombuffer(sb, "<u8")
                n = common_size(x, y)
                link = 100 * n >= percent * (len(x) + len(y) - n)
                show = link and differences
                rows.append((a, b, len(x), len(y), n, link, np.setdiff1d(x, y, True).tobytes() if show else None, np.setdiff1d(y, x, True).tobytes() if show else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _VERDICT, strict=True)], schema=_VERDICT)

    return both.mapInArrow(run, VERDICT)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of the nodes of edges (a, b): the least node of each component.  Labels pass along edges and are halved in depth each round."""
    both = C.written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = C.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        # comp is a node itself: take its label too
        jump = step.join(labels.select(F.col("node").alias("comp"), F.col("comp").alias("far")), "comp").select("node", "old", F.least("comp", "far").alias("comp"))
        jump = C.written(jump, "labels")
        if not jump.where("old <> comp").limit(1).count():
            return labels
        labels = jump.select("node", "comp")


def paired(key: np.ndarray, side: np.ndarray, size: np.ndarray, pos: np.ndarray, comp: np.ndarray, node: np.ndarray, lists: np.ndarray, percent: int, flush: int = HOLD):
    """(x, y, need) of the pairs of entries of one list (equal key) that can link by size and position, have different components and, with sides 0 and 1, different sides.

    Entries stand by component and size in blocks of SKIP.  Of two blocks all pairs are skipped at once if they are of
    one component or side, or if the blocks' sizes, positions and numbers of lists leave too little to share.
    """
    order = np.lexsort((pos, size, side, comp, key))
    key, side, size, pos, comp, node, lists = (c[order] for c in (key, side, size, pos, comp, node, lists))
    left, last = size - pos, prefix_size(size, percent) - pos  # what stands from the entry on, in the set and in its prefix
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    found, held = [], 0
    for a, b in zip(new.tolist(), np.append(new[1:], len(key)).tolist(), strict=True):
        start = np.arange(a, b, SKIP)
        stop = np.minimum(start + SKIP, b)
        small, large = np.minimum.reduceat(size[a:b], start - a), np.maximum.reduceat(size[a:b], start - a)
        most, ahead = np.maximum.reduceat(left[a:b], start - a), np.maximum.reduceat(last[a:b], start - a)
        shared = np.maximum.reduceat(lists[a:b], start - a)
        one = np.minimum.reduceat(comp[a:b], start - a) == np.maximum.reduceat(comp[a:b], start - a)
        flat = np.minimum.reduceat(side[a:b], start - a) == np.maximum.reduceat(side[a:b], start - a)
        before = np.maximum.reduceat(pos[a:b], start - a)
        for i in range(len(start)):
            j = np.arange(i, len(start))
            # sizes in reach; enough elements left behind both positions, with at most the smaller position before
            lo, hi = np.maximum(small[i], small[j]), np.minimum(large[i], large[j])
            ok = lo * percent <= hi * 100
            ok &= ~(one[i] & one[j] & (comp[start[i]] == comp[start[j]]))
            ok &= ~(flat[i] & flat[j] & (side[start[i]] >= 0) & (side[start[i]] == side[start[j]]))
            ok &= np.minimum(most[i], most[j]) + np.minimum(before[i], before[j]) >= needed(small[i] + small[j], percent)
            ok &= (np.minimum(shared[i], shared[j]) >= 1) & (np.minimum(ahead[i], ahead[j]) >= 1)
            for k in j[ok].tolist():
                x, y = np.arange(start[i], stop[i])[:, None], np.arange(start[k], stop[k])[None, :]
                n, m = size[x], size[y]
                fit = (comp[x] != comp[y]) & ((side[x] < 0) | (side[x] != side[y])) & (np.maximum(n, m) * percent <= np.minimum(n, m) * 100)
                if i == k:
                    fit &= x < y
                if not fit.any():
                    continue
                p, q = np.nonzero(fit)
                x, y = p + start[i], q + start[k]
                need = must_share(size[x], size[y], percent)
                # no more common shingles than lists of either; before both positions no more than the earlier one
                # the first of them lie early in both prefixes, so later entries of a pair need not be counted
                first = np.minimum(SHARED, need)
                fit = (last[x] > need - first) & (last[y] > need - first) & (np.minimum(lists[x], lists[y]) >= need)
                fit &= np.minimum(left[x], left[y]) >= needed(size[x] + size[y], percent) - np.minimum(pos[x], pos[y])
                if fit.any():
                    u, v = node[x[fit]], node[y[fit]]
                    found.append(np.stack([np.minimum(u, v), np.maximum(u, v), first[fit]]))
                    held += int(fit.sum())
                    if held > flush:
                        yield np.concatenate(found, 1)
                        found, held = [], 0
    if found:
        yield np.concatenate(found, 1)


PAIRS = "x long, y long, lists long, need long"


def _across(entries: DataFrame, labels: DataFrame, percent: int, parts: int, hot: int = HOT) -> DataFrame:
    """Pairs (x, y) of nodes of different components that share enough lists and can link by size and position.

    Lists of one component are left out.  In a list of more than `hot` entries those of its largest component meet the
    others only; both lie in cells of about `hot` entries, and a group holds two cells.
    """
    known = entries.groupBy("node").agg(F.count("*").alias("shared")).join(labels, "node", "left").select("node", "shared", F.coalesce("comp", "node").alias("comp"))
    rows = C.written(entries.join(known, "node").select("key", "node", "n", "pos", "shared", "comp"), "entries")
    by = rows.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.count("*").alias("comps"), F.sum("c").alias("c"), F.max(F.struct("c", "comp")).alias("top"))
    mixed = by.where("comps > 1").select("key", F.when(F.col("c") > hot, F.col("top.comp")).alias("top"), F.ceil(F.col("top.c") / hot).alias("cells"), F.ceil((F.col("c") - F.col("top.c")) / hot).alias("rest"))
    rows = rows.join(mixed.hint("merge"), "key")
    large, mine = F.col("top").isNotNull(), F.col("comp") == F.col("top")
    at = F.pmod(F.xxhash64("node"), F.when(mine, F.col("cells")).otherwise(F.col("rest")))

    def group(u, v, side):
        return F.struct(F.xxhash64("key", u, v).alias("list"), side.cast("long").alias("side"))

    with_top = F.transform(F.sequence(F.lit(0).cast("long"), F.when(mine, F.col("rest")).otherwise(F.col("cells")) - 1), lambda o: group(F.when(mine, at).otherwise(o), F.when(mine, o).otherwise(at), mine))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rest") - 1), lambda o: group(-1 - F.least(at, o), -1 - F.greatest(at, o), F.when(at == o, -1).otherwise((at > o).cast("int"))))
    groups = F.when(~large, F.array(group(F.lit(0), F.lit(0), F.lit(-1)))).when(mine, with_top).otherwise(F.concat(with_top, others))
    rows = rows.select("node", "n", "pos", "shared", "comp", F.explode(groups).alias("g"))
    rows = rows.select(F.pmod(F.col("g.list"), F.lit(parts)).cast("int").alias("part"), F.col("g.list").alias("key"), F.col("g.side").alias("side"), "node", "n", "pos", "shared", "comp")
    out = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("lists", pa.int64()), ("need", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        made = []
        for x, y, need in paired(*(group.column(c).to_numpy() for c in ("key", "side", "n", "pos", "comp", "node", "shared")), percent):
            order = np.lexsort((y, x))
            x, y, need = x[order], y[order], need[order]
            first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
            made.append(pa.table([pa.array(x[first]), pa.array(y[first]), pa.array(np.diff(np.append(first, len(x)))), pa.array(need[first])], schema=out))
        return pa.concat_tables(made) if made else out.empty_table()

    # few bytes, much work: no fewer tasks than parts
    pairs = rows.repartition(parts, "part").groupBy("part").applyInArrow(run, PAIRS)
    return pairs.groupBy("x", "y").agg(F.sum("lists").alias("lists"), F.max("need").alias("need")).where("lists >= need").select("x", "y")


def _derived(pairs: DataFrame, base: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among pairs (x, y, c, nx, gone, come), from the answers (c, y, both, nc, ny) of the leaders c."""
    near = pairs.join(base, ["c", "y"])
    d_cy = 1 - F.col("both") / (F.col("nc") + F.col("ny") - F.col("both"))
    kept = F.col("nc") - F.coalesce(F.length("gone"), F.lit(0)) / 8
    d_cx = 1 - kept / (F.col("nc") + F.coalesce(F.length("come"), F.lit(0)) / 8)
    near = near.where(d_cy - d_cx <= 1 - percent / 100 + 1e-9)
    both = near.join(sets.select(F.col("node").alias("y"), "set"), "y").select("x", "y", "both", "nc", "gone", "come", "set")

    def run(batches):
        for batch in batches:
            rows = []
            for x, y, n, nc, gone, come, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ys = np.frombuffer(s, "<u8")
                out, new = np.frombuffer(gone or b"", "<u8"), np.frombuffer(come or b"", "<u8")
                n = n - common_size(out, ys) + common_size(new, ys)
                if 100 * n >= percent * (nc - len(out) + len(new) + len(ys) - n):
                    rows.append((x, y))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def jaccard_components(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = WORDS, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """(id_col, n_shingles, component_id, th, class) of each row.

    class: a name of the component, null for texts without words; th: xxhash64 of the text.
    """
    spark = df.sparkSession
    df = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    nodes = _nodes(df, words)
    shingles = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shingles // PART_SHINGLES))
    lists = _index(df, words, percent, parts, _common(df, words, parts), hot)
    entries, shared = lists.where("kind in ('e', 'h')").select("key", "node", "n", "pos"), lists.where("kind = 's'").select("node", "leader", "pos", "lists", "n")
    if lists.where("kind = 'l'").limit(1).count():
        shared = shared.unionByName(_leaders(lists))

    star = shared.groupBy("node", "leader", "pos").agg(F.sum("lists").alias("lists"), F.min("n").alias("n"))
    star = star.where(F.col("lists") >= F.least(F.lit(SHARED), F.floor(F.col("n") * (percent * percent) / 10000)))
    star = star.groupBy("node", "pos").agg(F.max_by("leader", F.struct("lists", "leader")).alias("leader")).select("node", "leader").distinct()
    star = C.written(star, "star")
    sets = _sets(df, nodes, star.select("node").union(star.select("leader")).distinct(), words)
    checked = C.written(_verify(star.select(F.col("leader").alias("a"), F.col("node").alias("b")), sets, percent, True), "leaders")
    linked = checked.where("link")
    labels = components(linked)

    pairs = C.written(_across(entries, labels, percent, parts, hot), "pairs")
    edges = linked.select("a", "b")
    if pairs.limit(1).count():
        least = linked.groupBy(F.col("b").alias("x")).agg(F.min_by(F.struct(F.col("a").alias("c"), "gone", "come"), F.struct(F.length("gone") + F.length("come"), F.col("a"))).alias("l"))
        led = pairs.join(least, "x", "left").select("x", "y", F.coalesce("l.c", "x").alias("c"), "l.gone", "l.come")
        led = C.written(led, "led")
        sets = _sets(df, nodes, led.select(F.col("c").alias("node")).union(led.select("y")).distinct(), words)
        ask = led.select(F.col("c").alias("a"), F.col("y").alias("b")).distinct()
        base = _verify(ask, sets, percent, False).select(F.col("a").alias("c"), F.col("b").alias("y"), "both", F.col("na").alias("nc"), F.col("nb").alias("ny"))
        more = C.written(_derived(led, base, sets, percent), "links")
        if more.limit(1).count():
            edges = edges.unionAll(more)
            labels = components(edges)

    # the least id of each component, by node first so that equal sets do not crowd
    by_node = nodes.where("n > 0").groupBy("node").agg(F.min("id").alias("id")).join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = by_node.groupBy("comp").agg(F.min("id").alias("component_id"))
    names = by_node.select("node", "comp").join(least, "comp").select("node", "comp", "component_id")
    out = nodes.join(names, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), "th", F.when(F.col("n") > 0, F.col("comp")).alias("class"))


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    out = jaccard_components(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id")


ORACLE = f"""
with recursive d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
  s as (select distinct rid, unnest(case when len(ws) >= {WORDS} then list_transform(range(1, len(ws) - {WORDS - 2}), lambda i: array_to_string(ws[i : i + {WORDS - 1}], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as shingle from d),
  n as (select rid, count(*) as n from s group by rid),
  c as (select a.rid as x, b.rid as y, count(*) as c from s a join s b on a.shingle = b.shingle and a.rid < b.rid group by all),
  e as (select x, y from c join n a on a.rid = x join n b on b.rid = y where 100 * c >= {PERCENT} * (a.n + b.n - c)),
  r as (select rid, rid as other from n union select r.rid, u.y from r join (select x, y from e union all select y, x from e) u on r.other = u.x),
  m as (select r.rid, min(d.doc_id) as component_id from r join d on d.rid = r.other group by r.rid)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, case when n.n > 0 then m.component_id else d.doc_id end as component_id from d left join n using (rid) left join m using (rid)
"""
