"""Shared helpers: Arrow pass-through maps, block-wise text arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import written

#: Text bytes handled at once in one Python worker; a longer single text is its own block.
BLOCK_BYTES = 1 << 19

_U = np.uint64
_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 1 << 64)
_GRAM = 0xD6E8FEB86659FD93 | 1
_GRAM_INV = pow(_GRAM, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int):
    """crc32 of a column as text, modulo n; null for a null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def map_append(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], fields: list[T.StructField], keep: list[str] | None = None, by: str = "text") -> DataFrame:
    """Append columns made by fn from Arrow batches, in runs of rows with about BLOCK_BYTES in the column `by`; a new column replaces an input column of its name."""
    new = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in new and (keep is None or f.name in keep)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in cuts(whole.column(whole.schema.get_field_index(by))):
                batch = whole.slice(a, b - a)
                made = fn(batch)
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [made[f.name] for f in fields], names=names + [f.name for f in fields])

    return df.mapInArrow(run, T.StructType(kept + fields))


def cuts(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows with about `most` bytes or values each; a longer row is a run of its own."""
    size = (pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length)(column).fill_null(0)
    off = np.concatenate([[0], np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))])
    a = 0
    while a < len(column):
        b = min(max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1), len(column))
        yield a, b
        a = b


def slices(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `most` text bytes each; a null is an empty text."""
    whole = batch.column(batch.schema.get_field_index(column))
    for a, b in cuts(whole, most):
        arr = whole.slice(a, b - a).cast(pa.large_string()).fill_null("")
        _, offs, data = arr.buffers()
        off = np.frombuffer(offs, np.int64)[arr.offset : arr.offset + len(arr) + 1]
        buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        yield a, b, buf[off[0] : off[-1]], off - off[0]


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h = h * _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


class _Powers:
    def __init__(self, base: int, inverse: int):
        self.base, self.inverse, self.up, self.down = base, inverse, np.ones(1, _U), np.ones(1, _U)

    @staticmethod
    def _grow(a: np.ndarray, base: int, n: int) -> np.ndarray:
        while len(a) <= n:
            a = np.concatenate([a, a * _U(pow(base, len(a), 1 << 64))])
        return a

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        self.up, self.down = self._grow(self.up, self.base, n), self._grow(self.down, self.inverse, n)
        return self.up, self.down


_BYTES, _GRAMS = _Powers(_MUL, _INV), _Powers(_GRAM, _GRAM_INV)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit polynomial hashes of byte spans; equal spans hash alike in every process."""
    if not len(starts):
        return np.empty(0, _U)
    up, down = _BYTES.get(len(buf))
    if sums is None:
        sums = byte_sums(buf)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xC2B2AE3D27D4EB4F))


def byte_sums(buf: np.ndarray) -> np.ndarray:
    up, _ = _BYTES.get(len(buf))
    sums = np.zeros(len(buf) + 1, _U)
    np.cumsum((buf.astype(_U) + _U(1)) * up[: len(buf)], out=sums[1:])
    return sums


class Words:
    """Words (runs of bytes that are not in `space`, ASCII white space) of a block of texts, by arrays.

    start, end: byte offsets; first[d] .. first[d + 1]: the words of text d; doc: text of each word.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray, lower: bool = False, space: np.ndarray = SPACE):
        self.buf = LOWER[buf] if lower else buf
        self.off, n = off, len(buf)
        self.space = sp = space[self.buf]
        begin, stop = ~sp, ~sp
        if n:
            begin[1:] &= sp[:-1] | False
            stop[:-1] &= sp[1:]
            cut = off[(off > 0) & (off < n)]
            begin[cut] = ~sp[cut]
            stop[cut - 1] = ~sp[cut - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, off)
        self.n = np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)

    def hashes(self, sums: np.ndarray | None = None) -> np.ndarray:
        return span_hashes(self.buf, self.start, self.end, sums)


def gram_sums(h: np.ndarray) -> np.ndarray:
    """Prefix sums for gram_hashes: one pass serves every length."""
    up, _ = _GRAMS.get(len(h))
    sums = np.zeros(len(h) + 1, _U)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return sums


def gram_hashes(sums: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes of the n hashes from each position of at."""
    _, down = _GRAMS.get(len(sums))
    return mix((sums[at + n] - sums[at]) * down[at] + _U(n))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that occur twice or more."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])]
    seen = np.zeros(1 << 16, bool)
    seen[twice >> _U(48)] = True
    maybe = np.flatnonzero(seen[keys >> _U(48)])
    at = np.searchsorted(twice, keys[maybe])
    out = np.zeros(len(keys), bool)
    out[maybe] = twice[np.minimum(at, len(twice) - 1)] == keys[maybe]
    return out


def per_doc(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of a per-byte array over the texts."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def scattered(part: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """(part, bytes of each column) of the entries of each part; order inside a part is kept."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part = part[order]
    cut = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
    columns = [c[order] for c in columns]
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(part[a]), [c[a:b].tobytes() for c in columns]


def gathered(blobs: list[bytes] | pa.Array | pa.ChunkedArray, dtype: str) -> np.ndarray:
    """The numbers of all blobs in one array; nulls are empty."""
    if isinstance(blobs, list):
        return np.frombuffer(b"".join(blobs), dtype)
    out = [np.empty(0, dtype)]
    for chunk in blobs.chunks if isinstance(blobs, pa.ChunkedArray) else [blobs]:
        _, offs, data = chunk.buffers()
        if data is not None and len(chunk):
            off = np.frombuffer(offs, np.int64 if pa.types.is_large_binary(chunk.type) else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            out.append(np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(dtype))
    return np.concatenate(out)


def tally(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


class Table:
    """Values by 64-bit key: keys in the order of a hash, with the first of each bucket."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = _U(64 - max(1, int(len(keys)).bit_length()))
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        self.keys, self.values = np.append(keys[order], _U(0)), np.append(values[order], values.dtype.type(0))
        self.start = np.zeros((1 << (64 - int(self.shift))) + 1, np.int32)
        np.cumsum(np.bincount(bucket.astype(np.int64), minlength=len(self.start) - 1), out=self.start[1:])

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _U(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, asked: np.ndarray) -> np.ndarray:
        """Place of each asked key, or -1."""
        b = self._bucket(asked).astype(np.int64)
        at, end = self.start[b], self.start[b + 1]
        out = np.full(len(asked), -1, np.int32)
        live = np.flatnonzero(at < end)
        at, end, asked = at[live], end[live], asked[live]
        while len(live):
            hit = self.keys[at] == asked
            out[live[hit]] = at[hit]
            at += 1
            more = ~hit & (at < end)
            live, at, end, asked = live[more], at[more], end[more], asked[more]
        return out
