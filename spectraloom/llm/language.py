"""Language identification by cross-parsing entropy.

For each language a suffix automaton of sampled labelled text recognises that
text's substrings.  A document is parsed against every language into phrases,
each the longest match that the language's text has; the language that needs
fewest phrases, normalised by the logarithm of its text's length over the
document's length, wins.  Whole texts are parsed, in blocks of BLOCK codes that
step through the automata together by array gathers.  A block first starts a
phrase of its own; then it is parsed again from the state in which the block
before it ended, up to the first place where both parses start a phrase and so
agree from there on, until no block's end changes.  The result is the
sequential parse.

Codes: lower-case letters met in the sample, one code for other letters, one
for each run of anything else.  Every language with a text is learned.  The
sample of one is bounded: its SAMPLE_DOCS different texts of least hash, of
each at most SAMPLE_CHARS characters, as many of them as fit SAMPLE_CODES in
all.  The model is made once, on the driver.

A text that is null or has no letter is `und` with score 0.  With no learned
language all are `und`.  Ties go to the first language by code point.
Repeated rows give repeated rows; input columns named lang_pred or score are
replaced, others are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_CODES = 64, 3_000, 24_000
BLOCK = 256
#: Languages that are parsed together; numbers up to which the transitions of branching states are a plain table.
TOGETHER, DENSE = 32, 1 << 24
MIN_SCORE = 0.5
_U = np.uint64


def code_table(letters: str) -> np.ndarray:
    """Code of each code point: 0 for what is no letter, 1 for a letter outside `letters`."""
    number = {c: i + 2 for i, c in enumerate(letters)}
    table = np.zeros(0x110000, np.uint16)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            table[cp] = number.get(c.lower(), 1)
    return table


def codes(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, offsets, letters of each text); runs of code 0 are one."""
    raw = table[np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] > 0) | (raw[:-1] > 0)
    keep[off[:-1][off[:-1] < len(raw)]] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    return raw[keep], place[off], C.per_doc(raw > 0, off)


def suffix_automaton(seq: np.ndarray) -> list[dict[int, int]]:
    """Transitions of each state of the substrings of seq; state 0 is the start."""
    go, link, size, last = [{}], [-1], [0], 0
    for c in seq.tolist():
        cur = len(go)
        go.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return go


class Model:
    """Automata of all languages: each state's first transition, and a table of the others."""

    def __init__(self, samples: dict[str, list[str]], sample_codes: int = SAMPLE_CODES):
        self.langs = sorted(samples)
        letters = sorted({c for t in samples.values() for x in t for c in x.lower() if c.isalpha()})
        # beyond 65,534 letters the rarest would share a code; Unicode has fewer in all scripts but one
        self.table = code_table("".join(letters[: (1 << 16) - 3]))
        width = int(self.table.max()) + 1
        code, after, more, keys, values = [], [], [], [], []
        self.roots, self.bits, at = [], [], 0
        self.first = np.empty((len(self.langs), width), np.int32)
        for row, lang in enumerate(self.langs):
            used, n = [], 0
            for t in samples[lang]:
                s = codes([t], self.table)[0][:sample_codes]
                if not n or n + len(s) <= sample_codes:
                    used += [s, np.zeros(1, np.uint16)]
                    n += len(s)
            seq = np.concatenate(used)
            go = suffix_automaton(seq)
            self.roots.append(at)
            self.bits.append(np.log2(max(len(seq), 2)))
            self.first[row] = at
            for c, t in go[0].items():
                self.first[row, c] = at + t
            for s, g in enumerate(go):
                edges = iter(g.items())
                c, t = next(edges, (0xFFFF, -1))
                code.append(c)
                after.append(t + at if t >= 0 else -1)
                more.append(len(g) > 1)
                for c, t in edges:
                    keys.append((s + at) << 16 | c)
                    values.append(t + at)
            at += len(go)
        self.code, self.after, self.more = np.array(code, np.uint16), np.array(after, np.int32), np.array(more, bool)
        self.literal = np.log2(max(at, 2)) + np.log2(width)
        branch, keys, values = np.array(more, bool), np.array(keys, _U), np.array(values, np.int32)
        self.others, self.row, self.dense = C.Table(keys, values), None, None
        if int(branch.sum()) * width <= DENSE:
            self.row = np.where(branch, np.cumsum(branch) - 1, -1).astype(np.int32)
            self.dense = np.full((int(branch.sum()), width), -1, np.int32)
            self.dense[self.row[(keys >> _U(16)).astype(np.int64)], (keys & _U(0xFFFF)).astype(np.int64)] = values
            self.others = None

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The states after a code, -1 where there is none."""
        new = np.where(self.code[state] == c, self.after[state], np.int32(-1))
        look = np.flatnonzero((new < 0) & self.more[state])
        if len(look) and self.dense is not None:
            new[look] = self.dense[self.row[state[look]], c[look]]
        elif len(look):
            at = self.others.find(state[look].astype(_U) << _U(16) | c[look].astype(_U))
            new[look] = np.where(at >= 0, self.others.values[at], -1)
        return new

    def phrases(self, seq: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Phrases [language, text] of the sequential parse of each text."""
        k = len(self.langs)
        if not len(seq):
            return np.zeros((k, len(off) - 1), np.int64)
        return np.concatenate([self._phrases(seq, off, np.arange(lo, min(lo + TOGETHER, k))) for lo in range(0, k, TOGETHER)])

    def _phrases(self, seq: np.ndarray, off: np.ndarray, langs: np.ndarray) -> np.ndarray:
        n = np.diff(off)
        per = (n + BLOCK - 1) // BLOCK
        doc = np.repeat(np.arange(len(n)), per)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        begin = off[doc] + nth * BLOCK
        size = np.minimum(BLOCK, off[doc + 1] - begin)
        starts, ends = np.zeros((len(langs), len(seq)), bool), np.empty((len(langs), len(doc)), np.int32)
        # lanes: a language and a block; at first every block, from a phrase of its own
        lang, block = (x.ravel() for x in np.meshgrid(np.arange(len(langs)), np.arange(len(doc)), indexing="ij"))
        state, fresh = np.array(self.roots, np.int32)[langs][lang], True
        while len(lang):
            order = np.argsort(-size[block], kind="stable")
            lang, block, state = lang[order], block[order], state[order]
            row, place, left = langs[lang], begin[block], size[block]
            root = np.array(self.roots, np.int32)[row]
            changed = []
            for i in range(BLOCK):
                m = int(np.searchsorted(-left, -i, "left"))  # lanes with a code left
                if m < len(lang):
                    differ = ends[lang[m:], block[m:]] != state[m:]
                    ends[lang[m:], block[m:]] = state[m:]
                    changed.append((lang[m:][differ], block[m:][differ]))
                    lang, block, state, row, place, left, root = (x[:m] for x in (lang, block, state, row, place, left, root))
                if not m:
                    break
                c = seq[place + i]
                new = self.step(state, c)
                begun = (new < 0) | (state == root)
                state = np.where(begun, self.first[row, c], new)
                if fresh:
                    starts[lang, place + i] = begun
                    continue
                same = begun & starts[lang, place + i]
                starts[lang, place + i] = begun
                if same.any():  # both parses start a phrase here
                    lang, block, state, row, place, left, root = (x[~same] for x in (lang, block, state, row, place, left, root))
            differ = ends[lang, block] != state
            ends[lang, block] = state
            changed.append((lang[differ], block[differ]))
            if fresh:
                lang, block = (x.ravel() for x in np.meshgrid(np.arange(len(langs)), np.flatnonzero(nth[1:] > 0), indexing="ij"))
            else:
                lang, block = (np.concatenate(x) for x in zip(*changed, strict=True))
            fresh = False
            on = (block + 1 < len(doc)) & (nth[np.minimum(block + 1, len(doc) - 1)] > 0)
            lang, block = lang[on], block[on] + 1
            state = ends[lang, block - 1]
        return np.stack([C.per_doc(row, off) for row in starts])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        seq, off, letters = codes([t or "" for t in texts], self.table)
        if not self.langs or not len(seq):
            return ["und"] * len(texts), [0.0] * len(texts)
        missing = np.stack([C.per_doc(first[seq] == root, off) for first, root in zip(self.first, self.roots, strict=True)])
        cost = (self.phrases(seq, off) - missing) * np.array(self.bits)[:, None] + missing * self.literal
        best = cost.min(0)
        gap = cost - best  # few bits or a small share of the best cost: unsure
        score = 1 / np.exp2(-np.minimum(gap / 8, 40 * gap / np.maximum(best, 1))).sum(0)
        who = cost.argmin(0)
        known = letters > 0
        return [self.langs[w] if k else "und" for w, k in zip(who, known, strict=True)], np.where(known, score, 0).tolist()


def samples(df: DataFrame, text_col: str, lang_col: str, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS, most: int = SAMPLE_CODES) -> dict[str, list[str]]:
    """Texts of each language: different ones by the smallest hash, up to `docs`, until they have `most` characters, of each its first `chars`."""
    df = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(text_col), F.lit(1 << 40)).alias("key"))
    counts = df.groupBy("lang").agg(F.approx_count_distinct("key").alias("distinct"), F.min("key").alias("least")).collect()
    if not counts:
        return {}
    # a hash threshold of about four times the wanted share of the different texts lets few of them through, whatever their number
    bound = {r.lang: max(r.least, int((1 << 40) * min(1.0, (4.0 * docs + 40) / max(r.distinct, 1)))) for r in counts}
    share = F.create_map(*[F.lit(x) for pair in bound.items() for x in pair])
    drawn = df.where(F.col("key") <= F.element_at(share, F.col("lang"))).withColumn("text", F.substring("text", 1, chars)).dropDuplicates(["lang", "key"])
    by = Window.partitionBy("lang").orderBy("key")
    before = F.coalesce(F.sum(F.length("text")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = drawn.withColumn("nth", F.row_number().over(by)).withColumn("before", before).where((F.col("nth") <= docs) & (F.col("before") < most))
    out: dict[str, list] = {}
    for r in sorted(drawn.select("lang", "nth", "text").collect()):
        out.setdefault(r.lang, []).append(r.text)
    return out


def identify(df: DataFrame, train: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns in keep) with lang_pred and score, learned from train's text and lang_col."""
    held = df.sparkSession.sparkContext.broadcast(Model(samples(train, text_col, lang_col)))
    if keep is not None:
        df = df.select(*dict.fromkeys([*keep, text_col]))

    def run(batch: pa.RecordBatch) -> dict:
        langs, scores = held.value.predict(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
        return {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}

    return C.map_append(df, run, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], keep, text_col)


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(C.crc_mod("doc_id", 5) == 0, F.lit(False))
    docs = docs.withColumn("held_out", held_out)
    out = identify(docs, docs.where(~F.col("held_out")), keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")
