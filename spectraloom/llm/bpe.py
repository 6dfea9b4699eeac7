"""BPE encoding and decoding by tree concatenation.

A run of text that the pre-tokenizer does not split is cut in halves down to
leaves; leaves are encoded by the merge model, and the two encodings of each
join are reconciled by re-encoding a window of tokens around it.  The window
grows until its first and its last token are those that stood there before.
A token sequence is the BPE encoding of its text exactly if each adjacent pair
is (the first merge that crosses a seam would also be made on the pair alone),
and with unchanged outer tokens every pair of the result has already been
adjacent in an encoding, so the result is exact.

Texts of more than long_chars characters are cut into pieces that different
tasks encode; the pieces meet in one group per distinct text, where the cuts
inside a run are joined the same way.  Shorter texts need no shuffle.

Nulls: a null text counts as empty.  An empty text has no ids.  Repeated rows
give repeated rows.  A new column replaces an input column of the same name.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_append, written

#: Characters up to which a white-space-free run goes to the merge model whole.
LEAF_CHARS = 128
#: Characters above which a text is cut into pieces for several tasks, and of such a piece.
LONG_CHARS, PIECE_CHARS = 1 << 20, 1 << 18
#: Runs kept with their ids in each worker; when full, the store starts anew.
CACHE_RUNS = 100_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Store(dict):
    """Values of the keys met last, made when missing; a key longer than `most` is not kept."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.most:
            if len(self) >= CACHE_RUNS:
                self.clear()
            self[key] = value
        return value


class Bpe:
    """The tokenizer of a tokenizers-library file with a lower-casing, white-space-dropping BPE with word ends."""

    def __init__(self, path: str, special: bool = True, leaf: int = LEAF_CHARS):
        import regex
        from tokenizers.models import BPE

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.leaf, self.suffix = leaf, model["end_of_word_suffix"]
        self.vocab = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.inner = BPE(vocab=self.vocab, merges=merges, cache_capacity=0)
        self.final = BPE(vocab=self.vocab, merges=merges, cache_capacity=0, end_of_word_suffix=self.suffix)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]} if special else {}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.blank = regex.compile(r"[\t-\r \x85\p{Z}]+")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.word = regex.compile(split.replace(r"\s", r"\t-\r \x85\p{Z}"))
        self.byte = dict(enumerate(_byte_letters()))
        #: Ids of the runs and of the pre-tokens met last; only those of a leaf's length or less.
        self.runs, self.words = Store(self.run_ids, leaf), Store(self.word_ids, leaf)

    def normal(self, text: str) -> str:
        return self.blank.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()

    def pretokens(self, text: str):
        """(normalised pre-token, special id or -1) of a text."""
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                yield "", self.special[part]
            elif part:
                for w in self.word.findall(self.normal(part)):
                    yield w, -1

    def merge(self, letters: str, end: bool) -> list[int]:
        return [t.id for t in (self.final if end else self.inner).tokenize(letters)]

    def letters(self, ids: list[int]) -> str:
        return "".join(map(self.names.__getitem__, ids))

    def tree(self, letters: str, end: bool = True) -> list[int]:
        """Ids of one unsplit run; end: its last letter ends a word."""
        if len(letters) <= self.leaf:
            return self.merge(letters, end) if letters else []
        half = len(letters) // 2
        return self.join(self.tree(letters[:half], False), self.tree(letters[half:], end), end)

    def join(self, left: list[int], right: list[int], end: bool) -> list[int]:
        """Ids of the two encoded runs written together."""
        if not left or not right:
            return left or right
        width = 4
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            last = b == len(right)
            old = left[a:] + right[:b]
            run = self.letters(old)
            if last and end:
                run = run.removesuffix(self.suffix)
            # a window longer than a leaf is itself a run of two halves
            new = self.merge(run, last and end)
            if (a == 0 or new[0] == old[0]) and (last or new[-1] == old[-1]) or (a == 0 and last):
                return left[:a] + new + right[b:]
            width *= 2

    def word_ids(self, word: str) -> bytes:
        """Ids of one normalised pre-token."""
        letters = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.byte)
        return struct.pack(f"<{len(ids)}I", *ids) if (ids := self.tree(letters)) else b""

    def run_ids(self, raw: bytes) -> bytes:
        """Ids, as little-endian uint32, of a run without ASCII white space."""
        run = raw.decode("utf-8", "replace")
        if run.isalpha() and unicodedata.is_normalized("NFC", run):
            return self.words[run.replace("Σ", "σ").lower()]
        if self.cut and "<|" in run:
            return b"".join([self.words[w] if s < 0 else struct.pack("<I", s) for w, s in self.pretokens(run)])
        return b"".join(map(self.words.__getitem__, self.word.findall(self.normal(run))))

    def encode(self, text: bytes) -> bytes:
        """Ids of a whole text as little-endian uint32."""
        return b"".join(map(self.runs.__getitem__, text.split()))

    def decode(self, ids: list[int]) -> str:
        """As the library's decode without a decoder: token strings with a blank between; unknown ids go."""
        try:
            return " ".join(map(self.names.__getitem__, ids))
        except KeyError:
            return " ".join([self.names[i] for i in ids if i in self.names])


def _byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


_held: dict[tuple, Bpe] = {}


def bpe(path: str, special: bool = True) -> Bpe:
    if (path, special) not in _held:
        _held[path, special] = Bpe(path, special)
    return _held[path, special]


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _columns(model: Bpe, blobs: list[bytes], digest: bool) -> dict:
    """The output columns; decoded texts are made from the ids."""
    arrays = [np.frombuffer(b, "<u4") for b in blobs]
    out = {"n_tokens": pa.array([len(a) for a in arrays], pa.int64())}
    texts = (model.decode(a.tolist()) for a in arrays)
    if digest:
        return out | {"ids_sha256": pa.array([_sha(b) for b in blobs], pa.string()), "decoded_sha256": pa.array([_sha(t.encode()) for t in texts], pa.string())}
    return out | {"ids": pa.array([a.astype(np.int32) for a in arrays], pa.list_(pa.int32())), "decoded": pa.array(list(texts), pa.string())}


def encode(df: DataFrame, path: str | None = None, text_col: str = "text", keep: list[str] | None = None, digest: bool = False, special: bool = True, long_chars: int = LONG_CHARS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """df (or its columns in keep) with n_tokens, and ids and decoded, or with digest their SHA-256.

    special: strings of special tokens in a text become those tokens, else they are ordinary text.
    """
    path = path or default_path()
    fields = [T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")] if digest else [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    names = [f.name for f in fields]
    if keep is not None:
        df = df.select(*dict.fromkeys([*keep, text_col]))

    def whole(batch: pa.RecordBatch) -> dict:
        model = bpe(path, special)
        texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()
        return _columns(model, [model.encode(t or b"") for t in texts], digest)

    is_long = F.coalesce(F.length(text_col), F.lit(0)) > long_chars
    out = map_append(df.where(~is_long), whole, fields, keep, text_col)
    kept = [c for c in df.columns if c not in names and (keep is None or c in keep)]
    # long texts: once for each distinct text, in pieces
    key = F.sha2(F.col(text_col).cast("binary"), 256)
    long_rows = written(df.where(is_long).withColumn("_key", key), "long")
    if long_rows.limit(1).count() == 0:
        return out
    texts = long_rows.select("_key", F.col(text_col).alias("_text")).dropDuplicates(["_key"])
    piece = "_key string, seq int, parts array<string>, special array<int>, open_start boolean, open_end boolean"

    def cut(batches):
        model = bpe(path, special)
        for batch in batches:
            for k, t in zip(*(batch.column(c).to_pylist() for c in ("_key", "_text")), strict=True):
                rows = [(k, i, *p) for i, p in enumerate(pieces(model, t, piece_chars))]
                yield pa.RecordBatch.from_pylist([dict(zip(("_key", "seq", "parts", "special", "open_start", "open_end"), r, strict=True)) for r in rows], schema=pa.schema([("_key", pa.string()), ("seq", pa.int32()), ("parts", pa.list_(pa.string())), ("special", pa.list_(pa.int32())), ("open_start", pa.bool_()), ("open_end", pa.bool_())]))

    def leaves(batches):
        model = bpe(path, special)
        for batch in batches:
            for r in batch.to_pylist():
                ids, counts = [], []
                for j, (p, s) in enumerate(zip(r["parts"], r["special"], strict=True)):
                    got = [s] if s >= 0 else model.tree(p, not (r["open_end"] and j == len(r["parts"]) - 1))
                    ids += got
                    counts.append(len(got))
                yield pa.RecordBatch.from_pylist([{"_key": r["_key"], "seq": r["seq"], "ids": ids, "head": counts[0] if counts else 0, "tail": counts[-1] if counts else 0, "parts": len(counts), "open_start": r["open_start"], "open_end": r["open_end"]}], schema=pa.schema([("_key", pa.string()), ("seq", pa.int32()), ("ids", pa.list_(pa.int32())), ("head", pa.int32()), ("tail", pa.int32()), ("parts", pa.int32()), ("open_start", pa.bool_()), ("open_end", pa.bool_())]))

    def join(group: pa.Table) -> pa.Table:
        model = bpe(path, special)
        rows = sorted(group.to_pylist(), key=lambda r: r["seq"])
        done, tail = [], []
        for r in rows:
            ids = r["ids"]
            head = ids[: r["head"]]
            rest = ids[r["head"] :]
            one = r["parts"] == 1
            if r["open_start"]:
                head = model.join(tail, head, not (one and r["open_end"]))
            if one and r["open_end"]:
                tail = head
                continue
            done += head
            tail = []
            if r["open_end"]:
                done, tail = done + rest[: len(rest) - r["tail"]], rest[len(rest) - r["tail"] :]
            else:
                done += rest
        ids = np.array(done + tail, "<u4")
        made = _columns(model, [ids.tobytes()], digest)
        return pa.table({"_key": pa.array([rows[0]["_key"]]), **made})

    made = texts.mapInArrow(cut, piece).repartition("_key", "seq").mapInArrow(leaves, "_key string, seq int, ids array<int>, head int, tail int, parts int, open_start boolean, open_end boolean")
    made = made.groupBy("_key").applyInArrow(join, T.StructType([T.StructField("_key", T.StringType()), *fields]))
    return out.unionByName(long_rows.select("_key", *kept).join(made, "_key").select(*kept, *names))


def pieces(model: Bpe, text: str, most: int):
    """(parts, special ids, open start, open end) of successive pieces of a text, of about `most` characters; one empty piece without pre-tokens."""
    parts, special, size, open_start = [], [], 0, False
    for word, s in model.pretokens(text):
        letters = word.encode().decode("latin-1").translate(model.byte)
        while size + len(letters) > most and letters:
            room = max(1, most - size)
            if len(letters) <= room:
                break
            if len(letters) <= most and parts:  # whole in the next piece
                yield parts, special, open_start, False
                parts, special, size, open_start = [], [], 0, False
                continue
            yield [*parts, letters[:room]], [*special, -1], open_start, True
            parts, special, size, open_start, letters = [], [], 0, True, letters[room:]
        parts.append(letters)
        special.append(s)
        size += len(letters) or 1
    yield parts, special, open_start, False


def decode(df: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """df with decoded: token strings of ids_col with a blank between; null ids give an empty text."""
    path = path or default_path()

    def run(batch: pa.RecordBatch) -> dict:
        model = bpe(path)
        return {"decoded": pa.array([model.decode(i or []) for i in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()], pa.string())}

    return map_append(df, run, [T.StructField("decoded", T.StringType())], by=ids_col)


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, keep=["doc_id"], digest=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def written_ids(df: DataFrame, **options) -> DataFrame:
    """encode() held as a table in the shared folder."""
    return written(encode(df, **options), "ids")
