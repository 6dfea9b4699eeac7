"""Quality rules by repetition coverage.

Rolling hashes of word n-grams of several lengths, made in numpy from one
prefix sum per block of texts, mark the words inside n-grams found twice or
more in their own text; the share of a text's word characters under the marks
is held against a limit for each length.  Lines with a word that equal an
earlier line of their text are measured in the same way, and so is the number
of symbol characters per word.

Words are runs of bytes that are not ASCII white space.  A null text has no
words and is rejected, as is an empty one.  Repeated rows give repeated rows;
a new column replaces an input column of the same name.  No row depends on
another, so nothing is shuffled and any task can be run again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common as C

#: Words in an n-gram, and the largest share of word characters inside repeated ones.
GRAM_LIMITS = ((5, 0.20), (8, 0.18), (12, 0.15))
#: Largest share of characters in lines that equal an earlier one; of symbols per word.
LINE_LIMIT, SYMBOL_LIMIT = 0.30, 0.10
MIN_WORDS = 10

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_U = np.uint64

FIELDS = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
FIELDS += [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("dup_line_share", T.DoubleType())]
FIELDS += [T.StructField(f"repeat_share_{n}", T.DoubleType()) for n, _ in GRAM_LIMITS]


def measure(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The output columns for one block of texts."""
    w = C.Words(buf, off)
    n_docs, doc = len(off) - 1, w.doc
    solid = ~w.space & ((buf & 0xC0) != 0x80)  # first bytes of characters in words
    chars = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(solid, out=chars[1:])
    word_chars = chars[off[1:]] - chars[off[:-1]]
    wlen = chars[w.end] - chars[w.start]
    out = {"n_words": w.n, "word_chars": word_chars, "n_symbols": C.per_doc(_SYMBOL[buf], off)}

    sums = C.byte_sums(buf)
    begin = np.unique(np.concatenate([off[:-1], np.flatnonzero(buf == 10) + 1]))
    begin = begin[begin < len(buf)]
    # a text's end also ends its last line
    stop = np.minimum(np.append(begin[1:], len(buf)), len(buf))
    stop = np.where((stop > begin) & (buf[stop - 1] == 10), stop - 1, stop) if len(begin) else stop
    full = chars[stop] > chars[begin]
    begin, stop = begin[full], stop[full]
    line_doc = np.searchsorted(off, begin, "right") - 1
    keys = C.mix(C.span_hashes(buf, begin, stop, sums) + line_doc.astype(_U) * _U(0x9E3779B97F4A7C15))
    order = np.flatnonzero(C.repeated(keys))
    order = order[np.argsort(keys[order], kind="stable")]
    again = order[1:][keys[order][1:] == keys[order][:-1]] if len(order) else order
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=n_docs)
    line_chars = np.bincount(line_doc[again], chars[stop[again]] - chars[begin[again]], n_docs)
    total = np.maximum(word_chars, 1)
    out["dup_line_share"] = line_chars / total

    salted = w.hashes(sums) + C.mix(doc.astype(_U))
    grams = C.gram_sums(salted)
    good = out["dup_line_share"] <= LINE_LIMIT
    good &= out["n_symbols"] <= SYMBOL_LIMIT * w.n
    for n, limit in GRAM_LIMITS:
        at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.empty(0, np.int64)
        hit = at[C.repeated(C.gram_hashes(grams, at, n))]
        edge = np.zeros(len(doc) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + n, -1)
        covered = np.cumsum(edge[:-1]) > 0
        if n == 5:
            out["n_repeat_words"] = np.bincount(doc[covered], minlength=n_docs)
        out[f"repeat_share_{n}"] = share = np.bincount(doc[covered], wlen[covered], n_docs) / total
        good &= share <= limit
    out["base_failed"] = (w.n < MIN_WORDS) | (100 * out["n_repeat_words"] > 20 * w.n)
    out["kept"] = ~out["base_failed"] & good
    return out


def quality(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns in keep) with the measures and kept."""
    types = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_()}
    if keep is not None:
        df = df.select(*dict.fromkeys([*keep, text_col]))

    def run(batch: pa.RecordBatch) -> dict:
        parts = [measure(buf, off) for _, _, buf, off in C.slices(batch, text_col)]
        return {f.name: pa.array(np.concatenate([p[f.name] for p in parts]), types[f.dataType]) for f in FIELDS}

    return C.map_append(df, run, FIELDS, keep, text_col)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    out = quality(C.table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", *[f.name for f in FIELDS])


def _gram_sql(n: int) -> str:
    """Words of p inside n-word windows found twice or more in their text."""
    after, before = f"rows between current row and {n - 1} following", f"rows between {n - 1} preceding and current row"
    return f"""g{n} as (select rid, i, len, case when i + {n - 1} <= words then string_agg(word, ' ') over (partition by rid order by i {after}) end as gram from p),
  h{n} as (select *, gram is not null and count(*) over (partition by rid, gram) > 1 as twice from g{n}),
  c{n} as (select rid, len, max(cast(twice as integer)) over (partition by rid order by i {before}) as inside from h{n}),
  r{n} as (select rid, sum(inside) as n, sum(inside * len) as chars from c{n} group by rid)"""


ORACLE = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
  w as (select rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws from d),
  p as (select rid, len(ws) as words, unnest(ws) as word, generate_subscripts(ws, 1) as i, length(unnest(ws)) as len from w),
  l as (select rid, line, count(*) as c, length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) as chars from (select rid, unnest(string_split(t, chr(10))) as line from d) group by rid, line),
  k as (select rid, sum(c - 1) as n, sum((c - 1) * chars) as chars from l where chars > 0 group by rid),
  {", ".join(_gram_sql(n) for n, _ in GRAM_LIMITS)},
  a as (select d.doc_id, len(w.ws) as n_words, coalesce((select sum(length(x)) from (select unnest(w.ws) as x)), 0) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(k.n, 0) as n_dup_lines, coalesce(r5.n, 0) as n_repeat_words, coalesce(k.chars, 0) as dup_chars, {", ".join(f"coalesce(r{n}.chars, 0) as chars_{n}" for n, _ in GRAM_LIMITS)}
    from d join w using (rid) left join k using (rid) {" ".join(f"left join r{n} using (rid)" for n, _ in GRAM_LIMITS)}),
  b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > 20 * n_words as base_failed, dup_chars / cast(greatest(word_chars, 1) as double) as dup_line_share, {", ".join(f"chars_{n} / cast(greatest(word_chars, 1) as double) as repeat_share_{n}" for n, _ in GRAM_LIMITS)} from a)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
  not base_failed and dup_line_share <= {LINE_LIMIT!r}e0 and n_symbols <= {SYMBOL_LIMIT!r}e0 * n_words and {" and ".join(f"repeat_share_{n} <= {m!r}e0" for n, m in GRAM_LIMITS)} as kept, dup_line_share, {", ".join(f"repeat_share_{n}" for n, _ in GRAM_LIMITS)}
from b
"""
