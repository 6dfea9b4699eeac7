"""Token counts by separator scan.

A flat token stream has one end-of-document id after each document and no
index.  Blocks of a stream are searched for that id with one vectorised
comparison each; a block hands on only its length, its separators' positions
and so the tokens after its last one.  The document that is open at a block's
start began after the last separator of all blocks before it: a prefix maximum
over the block summaries, by stream, stitches boundaries across blocks.

Streams are rows (stream, block, data) with little-endian ids, made by
flat_streams, or raw files read by read_files.  Tokens after a stream's last
separator are a document of their own if there are any.  An empty stream has
no documents; two separators in a row hold an empty document between them.
Null data counts as empty; a null text is an empty document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .bpe import bpe, default_path

#: Ids in a block of a stream; documents go on across blocks.
BLOCK_TOKENS = 1 << 18
END_ID = 49407


def flat_streams(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str | None = None, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The texts as flat streams, one for each task: rows (stream, block, data uint16 bytes, first, ids).

    ids: id_col of the documents that end in the block, of which the first is the stream's
    first-th.  Only label_documents reads them; the scan does not.
    """
    path = path or default_path()

    def run(batches):
        from pyspark import TaskContext

        # a string of an end token in a text is ordinary text here, or it would end the document
        model, stream, end = bpe(path, False), TaskContext.get().partitionId(), np.array([end_id], "<u2").tobytes()
        held, size, block, first, ids, most = [], 0, 0, 0, [], 2 * block_tokens
        schema = pa.schema([("stream", pa.int64()), ("block", pa.int64()), ("data", pa.binary()), ("first", pa.int64()), ("ids", pa.list_(pa.int64()))])

        def row(data: bytes):
            nonlocal block, first, ids
            out = pa.RecordBatch.from_pylist([{"stream": stream, "block": block, "data": data, "first": first, "ids": ids}], schema=schema)
            block, first, ids = block + 1, first + len(ids), []
            return out

        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for text, key in zip(texts, batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer(model.encode(text or b""), "<u4").astype("<u2").tobytes() + end
                held.append(data)
                size += len(data)
                while size >= most:
                    data = b"".join(held)
                    if size == most:
                        ids.append(key)
                        key = ...
                    yield row(data[:most])
                    held, size = [data[most:]], size - most
                if key is not ...:
                    ids.append(key)
        if size:
            yield row(b"".join(held))

    return df.select(F.col(text_col), F.col(id_col).cast("long")).mapInArrow(run, "stream long, block long, data binary, first long, ids array<long>")


def read_files(spark: SparkSession, path: str, block_bytes: int = 2 * BLOCK_TOKENS) -> DataFrame:
    """Raw token files as streams (stream: the file's path), read in ranges of block_bytes by the tasks.

    Only names and lengths are listed.  Ranges are read through Arrow's file
    systems (local, HDFS and the object stores it knows); a store that only
    Spark reads is read file by file, and such a file must fit a row.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("stream"), "length")
    cut = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block_bytes).cast("long")))
    ranges = files.select("stream", "length", F.explode(cut).alias("block"))
    first = files.first()
    if first is None or _system(first.stream) is None:
        whole = spark.read.format("binaryFile").load(path)
        return whole.select(F.col("path").alias("stream"), F.explode(cut).alias("block"), "content").select("stream", "block", F.substring("content", (F.col("block") * block_bytes + 1).cast("int"), F.lit(block_bytes)).alias("data"))

    def run(batches):
        for batch in batches:
            for name, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, place = _system(name)
                with system.open_input_file(place) as f:
                    f.seek(block * block_bytes)
                    data = f.read(block_bytes)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([data], pa.binary())], names=["stream", "block", "data"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranges.select("stream", "block").repartition(n, "stream", "block").mapInArrow(run, "stream string, block long, data binary")


def _system(uri: str):
    """(Arrow file system, path in it) of a file's name, or None if Arrow does not know its kind."""
    from urllib.parse import unquote

    from pyarrow import fs

    try:
        if uri.startswith("file:"):
            return fs.LocalFileSystem(), unquote("/" + uri.removeprefix("file:").lstrip("/"))
        return fs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None


def separators(streams: DataFrame, end_id: int = END_ID, dtype: str = "<u2") -> DataFrame:
    """(stream, block, n, ends): the ids in each block, and the positions of the separators."""

    def run(batches):
        for batch in batches:
            blocks = [np.frombuffer(d or b"", dtype) for d in batch.column(2).to_pylist()]
            ends = [np.flatnonzero(b == end_id) for b in blocks]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(b) for b in blocks], pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=["stream", "block", "n", "ends"])

    kind = dict(streams.dtypes)["stream"]
    return streams.select("stream", "block", "data").mapInArrow(run, f"stream {kind}, block long, n long, ends array<long>")


def scan(streams: DataFrame, end_id: int = END_ID, dtype: str = "<u2") -> DataFrame:
    """(stream, doc, start, n_tokens): each document's place in its stream, from 0, and its ids without the separator."""
    # one row for each block meets here
    by = Window.partitionBy("stream").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy("stream")
    blocks = separators(streams, end_id, dtype).withColumn("at", F.coalesce(F.sum("n").over(by), F.lit(0)))
    blocks = blocks.withColumn("before", F.coalesce(F.sum(F.size("ends")).over(by), F.lit(0)))
    blocks = blocks.withColumn("tail", F.when(F.size("ends") > 0, F.col("at") + F.element_at("ends", -1) + 1))
    blocks = blocks.withColumn("open", F.coalesce(F.max("tail").over(by), F.lit(0)))
    blocks = blocks.withColumn("closed", F.coalesce(F.max("tail").over(last), F.lit(0))).withColumn("stop", F.sum("n").over(last)).withColumn("final", F.col("block") == F.max("block").over(last))
    ends = F.transform("ends", lambda e: e + F.col("at"))
    rest = F.when(F.col("final") & (F.col("closed") < F.col("stop")), F.array("stop"))
    ends = F.concat(ends, F.coalesce(rest, F.array().cast("array<bigint>")))
    starts = F.concat(F.array("open"), F.transform("ends", lambda e: e + F.col("at") + 1))
    docs = F.zip_with(ends, F.slice(starts, 1, F.size(ends)), lambda e, s: F.struct(s.alias("start"), (e - s).alias("n_tokens")))
    return blocks.select("stream", "before", F.posexplode(docs).alias("i", "d")).select("stream", (F.col("before") + F.col("i")).alias("doc"), "d.start", "d.n_tokens")


def label_documents(counts: DataFrame, streams: DataFrame) -> DataFrame:
    """counts with the doc_id that the writer of the streams noted for each document."""
    noted = streams.select("stream", "first", F.posexplode("ids").alias("i", "doc_id")).select("stream", (F.col("first") + F.col("i")).alias("doc"), "doc_id")
    return counts.join(noted, ["stream", "doc"])


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    streams = C.written(flat_streams(C.table(spark, sf_dir, "documents")), "streams")
    return label_documents(scan(streams), streams).select("doc_id", "n_tokens", "stream", "doc", "start")
