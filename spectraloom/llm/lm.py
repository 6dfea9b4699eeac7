"""Language-model scoring by a probabilistic suffix tree.

Symbols are the bytes of a text's words, lower-cased in A-Z, with one blank
between words and one end symbol.  Over the training texts the continuations
of every context of up to DEPTH symbols are counted; a context does not reach
past its text's start.  A context that occurs LEAST times is retained if its
continuations diverge from those of its next shorter context by more than it
costs to name one: n * KL >= CUT * ln(all symbols).  Hash ranges by the NEAR
most recent symbols test their own contexts, so each is tested on its counts
from all texts, and the tree grows with what the data bear out.  A context's
distribution is its counts drawn to that of its next shorter one with the
number of its different continuations as strength.  A symbol is scored by the
longest retained suffix of what stands before it; the entries are a hash
table of (context, symbol).

What is broadcast is bounded: contexts of up to NEAR - 1 symbols, and of the
deeper ones those that occur most (a threshold that at most ENTRIES entries
meet).  Contexts beyond set bits in a filter of FILTER_BYTES; a symbol that may
stand after one goes to that context's hash range, is scored there by the same
rule, and comes back in sums for each row.

The unigram base takes words and one end for each text.  Its counts stay in
hash ranges; the most frequent words (a count threshold that at most HEAD
words meet) are broadcast, and other words go to their range and come back as
sums for each row.  Counts cover all training texts.  Words are told apart by
64-bit hashes.

A null text is empty and has its end only.  Rows with a null id are neither
held out nor training.  Repeated rows count and are scored each.  With no
training rows all symbols are equally likely, and the base of a token is 0 (log10 of 1/1).
Columns of the input other than the id, held_out and the text are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

DEPTH, LEAST, CUT = 6, 2, 1.0
HEAD = 1 << 19
END, BLANK = 10, 32
_U = np.uint64
END_HASH = _U(0x5EED5EED5EED5EED)
#: Distinct contexts that a task holds before it hands them on, and words and symbols for the parts beyond the broadcast.
HOLD, HOLD_TAILS = 3_000_000, 500_000
#: Hash ranges of contexts for each shuffle partition.
FINER = 4
#: Entries of deeper contexts that are broadcast, at most; bytes of the filter of the others; slots of a task's memory of scores, as a power of two.
ENTRIES, FILTER_BYTES, MEMO_BITS = 1 << 22, 1 << 23, 20
#: Counts are placed by the NEAR most recent symbols, so contexts of at least that depth are whole in one part.
NEAR = 3

MODEL = "part int, keys binary, logs binary, n binary"
_MODEL = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("logs", pa.binary()), ("n", pa.binary())])
PARTS = "kind string, part int, keys binary, counts binary, n long"
_PARTS = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("n", pa.int64())])


def stream(w: C.Words) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, offsets of the texts in them) of a block of texts; byte 0 counts as byte 1."""
    n_docs = len(w.n)
    size = w.end - w.start
    empty = np.concatenate([[0], np.cumsum(w.n == 0)])
    lead = np.arange(len(size)) + empty[w.doc]
    begin = np.concatenate([[0], np.cumsum(size)])[:-1] + lead
    out = np.full(int(size.sum()) + len(size) + int(empty[-1]), BLANK, np.uint8)
    out[np.arange(int(size.sum())) + np.repeat(lead, size)] = np.maximum(w.buf[~w.space], 1)
    solid = np.concatenate([[0], np.cumsum(size)])[w.first]
    off = solid + w.first + empty
    out[off[1:] - 1] = END
    return out, off if n_docs else np.zeros(1, np.int64)


def contexts(symbols: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of each symbol: its context of DEPTH symbols, most recent first and 0 past the text's start, then itself."""
    x = np.concatenate([np.full(DEPTH, END, np.uint8), symbols]).astype(_U)
    key, shifted = x[DEPTH:].copy(), np.empty(len(symbols), _U)
    for d in range(1, DEPTH + 1):
        key |= np.left_shift(x[DEPTH - d : len(x) - d], _U(8 * (DEPTH + 1 - d)), out=shifted)
    # the end before a text is the oldest symbol of its contexts
    for i in range(DEPTH - 1):
        at = off[:-1][off[1:] - off[:-1] > i] + i
        key[at] &= _U(255 | ((1 << 8 * (i + 1)) - 1) << 8 * (DEPTH - i))
    return key


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (C.mix(keys) % _U(parts)).astype(np.int32)


def _near(keys: np.ndarray, parts: int) -> np.ndarray:
    """The hash range of contexts by their NEAR most recent symbols."""
    return _part(keys >> _U(8 * (DEPTH + 1 - NEAR)), FINER * parts)


def counted(train: DataFrame, text_col: str, parts: int) -> DataFrame:
    """Counts of words (kind w) and of contexts with continuation (kind c) in hash ranges, as a table."""

    def run(batches):
        held: dict[str, list] = {"w": [], "c": []}
        symbols = 0

        def merged(kind):
            k, c = C.tally(np.concatenate([k for k, _ in held[kind]]), np.concatenate([c for _, c in held[kind]]))
            held[kind] = [(k, c)]
            return k, c

        def out(kind):
            k, c = merged(kind)
            held[kind] = []
            at = _part(k, parts) if kind == "w" else _near(k, parts)
            for p, (keys, counts) in C.scattered(at, [k, c.astype("<u4")]):
                yield pa.RecordBatch.from_pylist([{"kind": kind, "part": p, "keys": keys, "counts": counts, "n": 0}], schema=_PARTS)

        for batch in batches:
            for _, _, buf, off in C.slices(batch, text_col):
                w = C.Words(buf, off, lower=True)
                k, c = np.unique(w.hashes(), return_counts=True)
                held["w"].append((np.append(k, END_HASH), np.append(c, len(off) - 1)))
                held["c"].append(np.unique(contexts(*stream(w)), return_counts=True))
                symbols += len(buf)
                for kind in ("w", "c"):
                    if symbols >> 31 or sum(len(k) for k, _ in held[kind]) > HOLD:  # counts fit 32 bits
                        k, _ = merged(kind)
                        if symbols >> 31 or len(k) > HOLD // 2:
                            yield from out(kind)
                symbols &= (1 << 31) - 1
        for kind in ("w", "c"):
            if held[kind]:
                yield from out(kind)

    def reduce(group: pa.Table) -> pa.Table:
        k, c = C.tally(C.gathered(group.column("keys"), "<u8"), C.gathered(group.column("counts"), "<u4").astype(np.int64))
        return pa.table([group.column("kind").slice(0, 1), group.column("part").slice(0, 1), pa.array([k.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary()), pa.array([int(c.sum())], pa.int64())], schema=_PARTS)

    return C.written(train.select(text_col).mapInArrow(run, PARTS).groupBy("kind", "part").applyInArrow(reduce, PARTS), "counts")


def model(counts: DataFrame, near: tuple[np.ndarray, np.ndarray], total: int, depth: int = DEPTH, least: int = LEAST, cut: float = CUT) -> DataFrame:
    """The retained contexts of NEAR symbols and more in hash ranges, as a table: entries (see entries()) of each part."""
    held = counts.sparkSession.sparkContext.broadcast(near)

    def run(batches):
        for batch in batches:
            for part, blob, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = deep(np.frombuffer(blob, "<u8"), np.frombuffer(n, "<i8"), held.value, total, depth, least, cut)
                yield pa.RecordBatch.from_pylist([dict(zip(("part", "keys", "logs", "n"), (part, *(x.tobytes() for x in found)), strict=True))], schema=_MODEL)

    return C.written(counts.where("kind = 'c'").select("part", "keys", "counts").mapInArrow(run, MODEL), "model")


def near_levels(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of the contexts of up to NEAR - 1 symbols, of which there are at most 256 ** (NEAR - 1)."""

    def run(batches):
        for batch in batches:
            for keys, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k, n = at_depth(np.frombuffer(keys, "<u8"), np.frombuffer(n, "<i8"), NEAR - 1, DEPTH)
                yield pa.RecordBatch.from_arrays([pa.array([k.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["keys", "counts"])

    got = counts.where("kind = 'c'").select("keys", "counts").mapInArrow(run, "keys binary, counts binary").toArrow()
    return C.tally(C.gathered(got.column(0), "<u8"), C.gathered(got.column(1), "<i8"))


def grown(two: tuple[np.ndarray, np.ndarray], total: int, depth: int = DEPTH, least: int = LEAST, cut: float = CUT) -> tuple[np.ndarray, tuple, tuple]:
    """From the counts of contexts of NEAR - 1 symbols: log10 probabilities of single symbols, entries of the depths up to there, and (keys, probabilities) of the last."""
    keys, n = at_depth(*two, 0, NEAR - 1)
    root = np.full(256, 1 / 256)
    root[(keys & _U(255)).astype(np.int64)] += n
    root /= total + 1
    prob, found = root[(keys & _U(255)).astype(np.int64)], []
    for d in range(1, min(NEAR - 1, depth) + 1):
        # a context at a text's start has fewer symbols than two: its counts stand at depth one
        x, y = at_depth(*two, d, NEAR - 1)
        x, y = frequent(*strip(x, y), least)
        keep, prob, n, soft = tested(x, y, keys, prob, cut * np.log(max(total, 2)))
        found.append(entries(x, prob, n, soft, keep))
        keys = x
    return np.log10(root), _joined(found), (keys, prob)


def deep(keys: np.ndarray, counts: np.ndarray, near: tuple[np.ndarray, np.ndarray], total: int, depth: int = DEPTH, least: int = LEAST, cut: float = CUT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of the retained contexts of NEAR symbols and more of one part, from its counts and the level above."""
    above, prob = near
    found = []
    for d in range(NEAR, depth + 1):
        x, y = frequent(*strip(*at_depth(keys, counts, d, DEPTH)), least)
        if not len(x):
            break
        keep, prob, n, soft = tested(x, y, above, prob, cut * np.log(max(total, 2)))
        above = x
        found.append(entries(x, prob, n, soft, keep))
    return _joined(found)


def _joined(found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not found:
        return np.empty(0, _U), np.empty(0, np.float32), np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def entries(keys: np.ndarray, prob: np.ndarray, n: np.ndarray, soft: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, log10, occurrences of the context): of each (context, symbol) its probability, and under symbol 0 the share of a retained context that its other symbols have."""
    keys, prob, n, soft = keys[keep], prob[keep], n[keep], soft[keep]
    ctx, first = np.unique(keys >> _U(8), return_index=True)
    rest = np.log10(soft[first] / (n[first] + soft[first]))
    return np.concatenate([keys, ctx << _U(8)]), np.concatenate([np.log10(prob), rest]).astype(np.float32), np.concatenate([n, n[first]]).astype(np.int64)


def tested(keys: np.ndarray, counts: np.ndarray, above_keys: np.ndarray, above: np.ndarray, cut: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whether its context is retained, probability, occurrences and strength of its context) of each entry of a depth, from the probabilities of the depth above."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0), np.zeros(0), np.zeros(0)
    before = above[np.searchsorted(above_keys, ((keys >> _U(16)) << _U(8)) | (keys & _U(255)))]
    ctx = keys >> _U(8)
    row = np.concatenate([[0], np.cumsum(ctx[1:] != ctx[:-1])])
    n, soft = np.bincount(row, counts)[row], np.bincount(row).astype(float)[row]
    keep = (np.bincount(row, counts * np.log(counts / n / before)) >= cut)[row]
    return keep, np.where(keep, (counts + soft * before) / (n + soft), before), n, soft


def at_depth(keys: np.ndarray, counts: np.ndarray, d: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts by the d most recent symbols and the continuation."""
    return C.tally(((keys >> _U(8 * (depth + 1 - d))) << _U(8)) | (keys & _U(255)), counts)


def strip(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without contexts that reach past a text's start."""
    full = ((keys >> _U(8)) & _U(255)) > 0
    return keys[full], counts[full]


def frequent(keys: np.ndarray, counts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    ctx, n = C.tally(keys >> _U(8), counts)
    keep = n >= least
    at = np.searchsorted(ctx, keys >> _U(8))
    hit = keep[at] if len(ctx) else np.zeros(0, bool)
    return keys[hit], counts[hit]


class Tree:
    """Scores by the longest retained suffix: entries of contexts and the single symbols' log10 probabilities."""

    def __init__(self, root: np.ndarray, keys: np.ndarray, logs: np.ndarray, depth: int = DEPTH):
        self.root, self.table, self.depth = root, C.Table(keys, logs), depth

    def logs(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of the symbol of each key (see contexts()) after its context."""
        out, live, symbol = np.zeros(len(key)), np.arange(len(key)), key & _U(255)
        for d in range(self.depth, 0, -1):
            ctx = (key >> _U(8 * (DEPTH + 1 - d))) << _U(8)
            at = self.table.find(ctx | symbol)
            hit = at >= 0
            out[live[hit]] += self.table.values[at[hit]]
            live, key, symbol, ctx = live[~hit], key[~hit], symbol[~hit], ctx[~hit]
            at = self.table.find(ctx)
            back = at >= 0  # retained, but without the symbol
            out[live[back]] += self.table.values[at[back]]
        out[live] += self.root[symbol.astype(np.int64)]
        return out


class Filter:
    """Bits of the contexts that are beyond the broadcast entries; a bit may stand for others too."""

    def __init__(self, bits: np.ndarray, depth: int = DEPTH):
        self.bits, self.size, self.depth = bits, _U(8 * len(bits)), depth

    def any(self, key: np.ndarray) -> np.ndarray:
        """Whether a context of NEAR symbols or more of each key may be beyond."""
        out = np.zeros(len(key), bool)
        if len(self.bits):
            for d in range(NEAR, self.depth + 1):
                at = C.mix(key >> _U(8 * (DEPTH + 1 - d))) % self.size
                out |= (self.bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & np.uint8(1) > 0
        return out


class Memo:
    """log10 probabilities of the keys met last, one in each slot of a hash; NaN where a context may be beyond the tree."""

    def __init__(self, tree: Tree, beyond: Filter, bits: int = MEMO_BITS):
        self.tree, self.beyond, self.shift = tree, beyond, _U(64 - bits)
        self.keys, self.values = np.zeros(1 << bits, _U), np.zeros(1 << bits, np.float32)

    def logs(self, key: np.ndarray) -> np.ndarray:
        slot = (key * _U(0x9E3779B97F4A7C15)) >> self.shift
        out = self.values[slot].astype(float)
        miss = np.flatnonzero(self.keys[slot] != key)
        if len(miss):
            asked = key[miss]
            out[miss] = got = np.where(self.beyond.any(asked), np.nan, self.tree.logs(asked))
            self.keys[slot[miss]], self.values[slot[miss]] = asked, got
        return out


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, kind string, part int, keys binary, rows binary"
_SCORED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("kind", pa.string()), ("part", pa.int32()), ("keys", pa.binary()), ("rows", pa.binary())])


def _least(table: DataFrame, dtype: str, column: str, most: int) -> int:
    """The least power of two such that at most `most` of the numbers in a column's blobs meet it."""

    def bins(batches):
        for batch in batches:
            n = np.concatenate([np.frombuffer(c, dtype) for c in batch.column(0).to_pylist()])
            v, m = np.unique(np.log2(np.maximum(n, 1)).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(m)], names=["bin", "n"])

    hist = table.select(column).mapInArrow(bins, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy(F.desc("bin")).collect()
    least, sum_ = 1 << 62, 0
    for b, n in hist:
        if (sum_ := sum_ + n) > most:
            break
        least = 1 << b
    return least


def _meeting(table: DataFrame, columns: list[tuple[str, str]], by: str, least: int) -> list[np.ndarray]:
    """The numbers of columns (name, dtype) where that of `by`, which need not be one of them, is `least` or more."""

    def run(batches):
        for batch in batches:
            for *row, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = [np.frombuffer(b, t) for b, (_, t) in zip(row, columns, strict=True)]
                ok = np.frombuffer(n, "<i8") >= least
                yield pa.RecordBatch.from_arrays([pa.array([h[ok].tobytes()], pa.binary()) for h in held], names=[c for c, _ in columns])

    got = table.select(*[c for c, _ in columns], F.col(by).alias("_by")).mapInArrow(run, ", ".join(f"{c} binary" for c, _ in columns)).toArrow()
    return [C.gathered(got.column(i), t) for i, (_, t) in enumerate(columns)]


def _beyond(table: DataFrame, least: int, size: int, slots: int = 256) -> np.ndarray:
    """Bits of the contexts that occur less than `least` times; a slot is a range of the bits."""
    per = 8 * size // slots

    def run(batches):
        for batch in batches:
            for keys, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = np.frombuffer(keys, "<u8")[np.frombuffer(n, "<i8") < least]
                bit = np.unique((C.mix(keys[keys & _U(255) == 0] >> _U(8)) % _U(8 * size)).astype(np.int64))
                for slot, (data,) in C.scattered(bit // per, [(bit % per).astype("<u4")]):
                    yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([data], pa.binary())], names=["slot", "bits"])

    def union(group: pa.Table) -> pa.Table:
        bits = np.zeros(per, bool)
        bits[C.gathered(group.column("bits"), "<u4")] = True
        return pa.table([group.column("slot").slice(0, 1), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["slot", "bits"])

    got = table.select("keys", "n").mapInArrow(run, "slot int, bits binary").groupBy("slot").applyInArrow(union, "slot int, bits binary").toArrow().to_pylist()
    if not got:
        return np.empty(0, np.uint8)
    out = np.zeros(size, np.uint8)
    for r in got:
        out[r["slot"] * per // 8 : (r["slot"] + 1) * per // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def score(df: DataFrame, train: DataFrame, text_col: str = "text", id_col: str = "doc_id", head: int = HEAD, depth: int = DEPTH, most: int = ENTRIES, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of df's rows; df has a boolean held_out."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = counted(train, text_col, parts)
    sizes = {r.kind: (r.n, r.v) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.sum(F.length("keys") / 8).cast("long").alias("v")).collect()}
    tokens, distinct = sizes.get("w", (0, 0))
    symbols = sizes.get("c", (0, 0))[0]
    whole = float(tokens + distinct + 1)

    words = counts.where("kind = 'w'")
    word_keys, word_counts = _meeting(words, [("keys", "<u8"), ("counts", "<i8")], "counts", _least(words, "<i8", "counts", head))
    root, (near_keys, near_logs, _), near = grown(near_levels(counts), symbols, depth)
    contexts_ = model(counts, near, symbols, depth)
    least = _least(contexts_, "<i8", "n", most)
    deep_keys, deep_logs = _meeting(contexts_, [("keys", "<u8"), ("logs", "<f4")], "n", least)
    tree = Tree(root, np.concatenate([near_keys, deep_keys]), np.concatenate([near_logs, deep_logs]), depth)
    known = C.Table(word_keys, np.log10((word_counts + 1) / whole))
    held = spark.sparkContext.broadcast((tree, known, Filter(_beyond(contexts_, least, filter_bytes), depth)))

    def run(batches):
        from pyspark import TaskContext

        tree, known, beyond = held.value
        memo = Memo(tree, beyond)
        row0, tails, size = TaskContext.get().partitionId() << 36, {"w": [], "c": []}, 0

        def out():
            for kind, some in tails.items():
                if some:
                    k, r = np.concatenate([k for k, _ in some]), np.concatenate([r for _, r in some])
                    some.clear()
                    for p, (a, b) in C.scattered(_part(k, parts) if kind == "w" else _near(k, parts), [k, r]):
                        yield pa.RecordBatch.from_pylist([{"kind": kind, "part": p, "keys": a, "rows": b}], schema=_SCORED)

        for batch in batches:
            for a, b, buf, off in C.slices(batch, text_col):
                w = C.Words(buf, off, lower=True)
                doc, h = np.concatenate([w.doc, np.arange(b - a)]), np.append(w.hashes(), np.full(b - a, END_HASH))
                at = known.find(h)
                hit = at >= 0
                base = np.bincount(doc[hit], known.values[at[hit]], b - a)
                n_known = np.bincount(doc[hit], minlength=b - a)
                rows = row0 + np.arange(b - a)
                row0 += b - a
                tails["w"].append((h[~hit], rows[doc[~hit]]))
                symbols, ends = stream(w)
                key, of = contexts(symbols, ends), np.repeat(np.arange(b - a), np.diff(ends))
                logs = memo.logs(key)
                far = np.isnan(logs)
                if far.any():
                    tails["c"].append((key[far], rows[of[far]]))
                    logs[far] = 0
                sums = np.bincount(of, logs, b - a)
                size += sum(len(t[-1][0]) for t in tails.values() if t)
                yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column(0)[a:b], batch.column(1)[a:b], pa.array(w.n + 1), pa.array(n_known), pa.array(base), pa.array(sums), *[pa.nulls(b - a, f.type) for f in list(_SCORED)[7:]]], schema=_SCORED)
                if size > HOLD_TAILS:
                    yield from out()
                    size = 0
        yield from out()

    made = C.written(df.select(F.col(id_col).cast("long").alias("doc_id"), "held_out", text_col).mapInArrow(run, SCORED), "scored")
    nothing = F.lit(None).cast("binary")
    sides = words.select("kind", "part", "keys", F.col("counts").alias("held"), nothing.alias("rows"))
    sides = sides.unionAll(contexts_.select(F.lit("c"), "part", "keys", "logs", nothing))
    tails = made.where("part is not null").select("kind", "part", "keys", nothing.alias("held"), "rows")
    # of a kind and part that no row asks, nothing is sent
    sides = sides.join(F.broadcast(tails.select("kind", "part").distinct()), ["kind", "part"], "left_semi")
    upper = spark.sparkContext.broadcast((root, near_keys, near_logs))

    def look(group: pa.Table) -> pa.Table:
        kind = group.column("kind")[0].as_py()
        keys = C.gathered(group.filter(group.column("held").is_valid()).column("keys"), "<u8")
        asked, row = C.gathered(group.filter(group.column("rows").is_valid()).column("keys"), "<u8"), C.gathered(group.column("rows"), "<i8")
        if kind == "w":
            n = C.Table(keys, C.gathered(group.column("held"), "<i8"))
            at = n.find(asked)
            c = np.where(at >= 0, n.values[at], 0)
            logs, found = np.log10((c + 1) / whole), (c > 0).astype(np.int64)
        else:
            root, near_keys, near_logs = upper.value
            part = Tree(root, np.concatenate([near_keys, keys]), np.concatenate([near_logs, C.gathered(group.column("held"), "<f4")]), depth)
            logs, found = part.logs(asked), np.zeros(len(asked), np.int64)
        row, first = np.unique(row, return_inverse=True)
        sums, founds = np.bincount(first, logs, len(row)), np.bincount(first, found, len(row)).astype(np.int64)
        empty = np.zeros(len(row))
        back = list(C.scattered(_part(row.astype(_U), parts), [row, *((sums, empty) if kind == "w" else (empty, sums)), founds]))
        return pa.table([pa.array([p for p, _ in back], pa.int32()), *[pa.array([c[i] for _, c in back], pa.binary()) for i in range(4)]], names=["part", "row", "base", "score", "known"])

    def total(group: pa.Table) -> pa.Table:
        row, base, logs, known = (C.gathered(group.column(n), t) for n, t in (("row", "<i8"), ("base", "<f8"), ("score", "<f8"), ("known", "<i8")))
        keys, first = np.unique(row, return_inverse=True)
        return pa.table([pa.array(keys), pa.array(np.bincount(first, base, len(keys))), pa.array(np.bincount(first, logs, len(keys))), pa.array(np.bincount(first, known, len(keys)).astype(np.int64))], names=["row", "tail_base", "tail_score", "tail_known"])

    sums = sides.unionByName(tails).groupBy("kind", "part").applyInArrow(look, "part int, row binary, base binary, score binary, known binary")
    sums = sums.groupBy("part").applyInArrow(total, "row long, tail_base double, tail_score double, tail_known long")
    out = made.where("row is not null").join(sums, "row", "left")
    return out.select(
        F.col("doc_id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("tail_score", F.lit(0.0))).alias("score"),
    )


def op8_lm(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.coalesce(C.crc_mod("doc_id", 7) == 2, F.lit(False)))
    return score(docs, docs.where(C.crc_mod("doc_id", 7) != 2))
