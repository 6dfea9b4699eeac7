"""Chat formatting by a prefix tree.

Conversations that share initial turns are merged: sorted by the hashes of
their turns they stand in the depth-first order of a tree, so each can tell
from its neighbour before it which turns are new.  A pack is a run of
neighbours of at most PACK_CHARS formatted characters; within it each tree
node (a turn after its ancestors) is emitted once, with its parent, the position its first
character has in its conversation and the intervals of the pack that its
ancestors fill, which are what it may attend to besides itself.  Intervals of
ancestors that stand side by side are one, so a conversation of many turns has
few.  A tree larger than a pack goes on in the next one, where its shared turns
stand once more.  tokens() gives packs as token ids with a position for each
token and intervals in tokens.

Template: <s>role[INST]text[/INST]</s> for each turn.  In roles and texts a
backslash follows the first character of each control string, and a backslash
is doubled; dropping the first of each backslash pair restores the text.

Turns are ordered by turn, role and text; a null role or text is empty; null
turns come first.  A null conv_id is a conversation of its own.  A repeated
row is a turn of its own.  Sorting by (turn hashes, conv_id) deals equal or
hot first turns out over many tasks.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
LEARNED_ROLE = "assistant"
PACK_CHARS = 1 << 16
#: Characters of a turn's hash.
HASH_CHARS = 24

_start = re.compile(r"\\|[<\[](?=" + "|".join(re.escape(c[1:]) for c in CONTROLS) + ")")
_turn = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>", re.S)
_pair = re.compile(r"\\(.)", re.S)

PACKS = "pack string, text string, nodes array<struct<start:long,end:long,parent:int,position:long,role:string,loss_start:long,loss_end:long,attend:array<struct<start:long,end:long>>>>, leaves array<struct<conv_id:long,node:int>>"
_interval = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_node = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("parent", pa.int32()), ("position", pa.int64()), ("role", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("attend", pa.list_(_interval))])
_PACKS = pa.schema([("pack", pa.string()), ("text", pa.string()), ("nodes", pa.list_(_node)), ("leaves", pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])))])


def escape(text: str) -> str:
    return _start.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _pair.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its escaped text starts and ends in it."""
    head = f"<s>{escape(role)}[INST]"
    body = escape(text)
    return f"{head}{body}[/INST]</s>", len(head), len(head) + len(body)


def conversations(df: DataFrame) -> DataFrame:
    """(conv_id, turns, key): ordered turns, and the hashes of all turns one after another, whose order is the tree's depth-first order."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    out = df.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    own = F.transform("turns", lambda t: F.substring(F.sha2(F.concat_ws("\x00", F.length(t["role"]).cast("string"), t["role"], t["text"]).cast("binary"), 256), 1, HASH_CHARS))
    return out.select("conv_id", "turns", F.array_join(own, "").alias("key"))


def attended(above: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """Intervals with one more, joined to the last if it follows it."""
    return [*above[:-1], (above[-1][0], end)] if above and above[-1][1] == start else [*above, (start, end)]


def pack(df: DataFrame, pack_chars: int = PACK_CHARS, partitions: int | None = None) -> DataFrame:
    """Packs of rows (conv_id, turn, role, text): pack, text, nodes and the leaf node of each conversation."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, since dealing by ranges reads it twice
    convs = C.written(conversations(df), "conversations")
    convs = convs.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")

    def run(batches):
        state: dict = {}

        def fresh():
            state.update(parts=[], size=0, nodes=[], at={}, leaves=[])

        def packed():
            name = hashlib.sha256(repr((state["leaves"][0], state["nodes"][:1], len(state["leaves"]))).encode()).hexdigest()[:24]
            row = {"pack": name, "text": "".join(state["parts"]), "nodes": state["nodes"], "leaves": state["leaves"]}
            fresh()
            return pa.RecordBatch.from_pylist([row], schema=_PACKS)

        fresh()
        for batch in batches:
            for conv, turns, key in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turns", "key")), strict=True):
                made = [format_turn(t["role"], t["text"]) for t in turns]
                path, last = [], b""
                for i in range(len(turns)):  # a node is named by all turns up to it
                    last = hashlib.blake2b(last + key[i * HASH_CHARS : (i + 1) * HASH_CHARS].encode(), digest_size=16).digest()
                    path.append(last)
                new = sum(len(m[0]) for m, p in zip(made, path, strict=True) if p not in state["at"])
                if state["leaves"] and state["size"] + new > pack_chars:
                    yield packed()
                above, position, node = [], 0, -1
                for (text, a, b), t, p in zip(made, turns, path, strict=True):
                    if p not in state["at"]:
                        start, learned = state["size"], t["role"] == LEARNED_ROLE
                        state["at"][p] = len(state["nodes"])
                        attend = [{"start": x, "end": y} for x, y in above]
                        state["nodes"].append({"start": start, "end": start + len(text), "parent": node, "position": position, "role": t["role"], "loss_start": start + a if learned else None, "loss_end": start + b if learned else None, "attend": attend})
                        state["parts"].append(text)
                        state["size"] += len(text)
                    node = state["at"][p]
                    here = state["nodes"][node]
                    above = attended(above, here["start"], here["end"])
                    position += len(text)
                state["leaves"].append({"conv_id": conv, "node": node})
        if state["leaves"]:
            yield packed()

    return convs.select("conv_id", "turns", "key").mapInArrow(run, PACKS)


def read_back(packs: DataFrame) -> DataFrame:
    """Per conversation, from packs alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, pack, shared_chars."""
    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, pack string"

    def run(batches):
        for batch in batches:
            rows = []
            for p in batch.to_pylist():
                text, nodes = p["text"], p["nodes"]
                starts = [n["start"] for n in nodes]  # nodes stand in the order of their places
                for leaf in p["leaves"]:
                    end = nodes[leaf["node"]]
                    spans = [*((i["start"], i["end"]) for i in end["attend"]), (end["start"], end["end"])]
                    whole = "".join(text[a:b] for a, b in spans)
                    turns = [(unescape(r), unescape(t)) for r, t in _turn.findall(whole)]
                    own = (n for a, b in spans for n in nodes[bisect_left(starts, a) : bisect_left(starts, b)])
                    loss = "".join(unescape(text[n["loss_start"] : n["loss_end"]]) for n in own if n["loss_start"] is not None)
                    said = "".join(f"{r}\n{t}\n" for r, t in turns)
                    rows.append({"conv_id": leaf["conv_id"], "n_turns": len(turns), "turns_sha256": _sha(said), "loss_chars": len(loss), "loss_sha256": _sha(loss), "formatted_chars": len(whole), "pack": p["pack"]})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("pack", pa.string())]))

    return packs.mapInArrow(run, out)


TOKENS = "pack string, ids array<int>, positions array<int>, nodes array<struct<start:long,end:long,attend:array<struct<start:long,end:long>>>>"


def tokens(packs: DataFrame, path: str | None = None) -> DataFrame:
    """Packs as token ids, each turn encoded alone: ids, the position of each in its conversation, and for each node its tokens and those it attends to besides."""
    from .bpe import bpe, default_path

    path = path or default_path()
    node = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("attend", pa.list_(_interval))])
    schema = pa.schema([("pack", pa.string()), ("ids", pa.list_(pa.int32())), ("positions", pa.list_(pa.int32())), ("nodes", pa.list_(node))])

    def run(batches):
        model = bpe(path, False)
        for batch in batches:
            for p in batch.to_pylist():
                ids, positions, made, above = [], [], [], []
                for n in p["nodes"]:
                    own = np.frombuffer(model.encode(p["text"][n["start"] : n["end"]].encode("utf-8", "replace")), "<u4").tolist()
                    up = made[n["parent"]] if n["parent"] >= 0 else None
                    attend = attended(above[n["parent"]], up["start"], up["end"]) if up else []
                    first = sum(b - a for a, b in attend)
                    made.append({"start": len(ids), "end": len(ids) + len(own), "attend": [{"start": a, "end": b} for a, b in attend]})
                    above.append(attend)
                    ids += own
                    positions += range(first, first + len(own))
                yield pa.RecordBatch.from_pylist([{"pack": p["pack"], "ids": ids, "positions": positions, "nodes": made}], schema=schema)

    return packs.select("pack", "text", "nodes").mapInArrow(run, TOKENS)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def op5_chat(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(pack(rows))
