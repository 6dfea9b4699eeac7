"""Mixing sources to target weights, in DataFrame functions only.

Words are laid end to end within each source and cut into blocks of BLOCK
words.  Sources share the total size by weight; a share stops at CAP times its
source, and the excess is shared again (water filling over sources by cap per
weight).  A source's share becomes a number of slots.  Shards have SHARD_SLOTS
slots, and their source counts are a multinomial draw given that each source
gets its slots in all: the slots of all sources together are dealt to the
shards by one pseudorandom permutation.  Independent draws would miss a
source's total by the root of its slots, and could take a document more than
CAP times.  A source's slots run through its block indices by pseudorandom
permutations, one for each pass, and the blocks are joined by index.

Permutations are four-round Feistel networks on a * b index pairs with
a * b at least the number of indices and less than a root of it more; the
indices beyond are empty blocks.

A null text has size 0, as has one without words; such rows are taken 0 times.
A null source is a source of its own, last.  Repeated rows are rows of their
own; rows are ordered within a source by a hash bucket, doc_id, text hash and
size, so reruns agree.  An empty table gives an empty result.  A hot source is
spread over buckets; only one row for each source and bucket meets in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, CAP = (5, 2, 1), 3
BLOCK, SHARD_SLOTS, CHUNK = 64, 4096, 16384
#: Rows in a bucket of the running sums, about.
BUCKET_ROWS = 20_000
#: Sources up to which their table is broadcast.
BROADCAST_SOURCES = 20_000


def _feistel(index: Column, a: Column, b: Column, *salt: Column) -> Column:
    """A pseudorandom permutation of 0 .. a * b - 1 at index."""
    left, right = F.floor(index / b).cast("long"), F.pmod(index, b)
    left = (index - right) / b
    left = left.cast("long")
    for r in (0, 1):
        left = F.pmod(left + F.pmod(F.xxhash64(F.lit(2 * r), right, *salt), a), a)
        right = F.pmod(right + F.pmod(F.xxhash64(F.lit(2 * r + 1), left, *salt), b), b)
    return left * b + right


def sized(df: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, source, size and text hash of each row, as a narrow table."""
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    return written(df.select("doc_id", "source", size.alias("size"), F.xxhash64(text_col).alias("th")), "sizes")


def targets(rows: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, sid, source_size, weight, target) from rows with source and size."""
    src = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    # these windows see one row for each source
    src = src.withColumn("sid", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    src = src.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("sid") % len(weights) + 1).cast("int")))
    src = src.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    total = F.sum("source_size").over(Window.partitionBy())
    src = src.withColumn("rank", F.row_number().over(order))
    src = src.withColumn("left", total - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    src = src.withColumn("level", F.col("left") / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    # the first source by cap per weight that its level does not fill sets the level of all
    free = F.when(F.col("cap") > F.col("weight") * F.col("level"), F.struct("rank", "level"))
    level = F.min(free).over(Window.partitionBy())["level"]
    return src.withColumn("target", F.least("cap", F.coalesce(F.col("weight") * level, F.col("cap")))).select("source", "sid", "source_size", "weight", "target")


def plan(src: DataFrame, block: int = BLOCK, cap: int = CAP) -> DataFrame:
    """src with blocks, the index grid a * b, and slots."""
    n = F.ceil(F.col("source_size") / block).cast("long")
    out = src.withColumn("blocks", n).withColumn("a", F.greatest(F.lit(1), F.ceil(F.sqrt("blocks"))).cast("long"))
    out = out.withColumn("b", F.greatest(F.lit(1), F.ceil(F.col("blocks") / F.col("a"))).cast("long"))
    grid = F.col("a") * F.col("b")
    out = out.withColumn("slots", F.when(F.col("source_size") > 0, F.least(grid * cap, F.round(F.col("target") * grid / F.col("source_size")).cast("long"))).otherwise(0).cast("long"))
    below = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("base", F.coalesce(F.sum("slots").over(below), F.lit(0)).cast("long"))
    out = out.withColumn("all", F.sum("slots").over(Window.partitionBy()))
    out = out.withColumn("ga", F.greatest(F.lit(1), F.ceil(F.sqrt("all"))).cast("long"))
    return out.withColumn("gb", F.greatest(F.lit(1), F.ceil(F.col("all") / F.col("ga"))).cast("long"))


def slots(planned: DataFrame, partitions: int, seed: int = 0) -> DataFrame:
    """(sid, block, shard, pos): the blocks of each output shard."""
    some = planned.where("slots > 0")
    out = some.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(CHUNK).cast("long"))).alias("from"))
    out = out.repartition(partitions, "sid", "from")
    last = F.least(F.col("from") + CHUNK, F.col("slots")) - 1
    out = out.select("*", F.explode(F.sequence("from", last)).alias("slot"))
    grid = F.col("a") * F.col("b")
    turn = F.floor(F.col("slot") / grid).cast("long")
    block = _feistel(F.pmod("slot", grid), F.col("a"), F.col("b"), F.lit(seed), F.col("sid"), turn)
    at = _feistel(F.col("base") + F.col("slot"), F.col("ga"), F.col("gb"), F.lit(seed + 1))
    out = out.withColumn("block", block).withColumn("at", at).where(F.col("block") < F.col("blocks"))
    return out.select("sid", "block", F.floor(F.col("at") / SHARD_SLOTS).cast("long").alias("shard"), F.pmod("at", F.lit(SHARD_SLOTS)).alias("pos"))


def placed(rows: DataFrame, planned: DataFrame, few: bool, buckets: int) -> DataFrame:
    """rows with sid, source_size, target and off: the words before the row in its source."""
    side = planned.select(F.col("source").alias("_s"), "sid", "source_size", "target")
    out = rows.join(F.broadcast(side) if few else side, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    out = out.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "th"), F.lit(buckets)))
    sums = out.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = Window.partitionBy("sid", "bucket").orderBy("doc_id", "th", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    out = out.join(sums, ["sid", "bucket"])
    return out.withColumn("off", F.when(F.col("size") > 0, F.col("before") + F.col("within"))).drop("before", "within", "bucket")


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(sid, off, block, words): the parts of each row in the blocks of its source."""
    end = F.col("off") + F.col("size")
    out = rows.where("size > 0").select("sid", "off", "size", F.explode(F.sequence((F.col("off") / block).cast("long"), ((end - 1) / block).cast("long"))).alias("block"))
    words = F.least(end, (F.col("block") + 1) * block) - F.greatest(F.col("off"), F.col("block") * block)
    return out.select("sid", "off", "block", words.alias("words"))


def mix(df: DataFrame, text_col: str = "text", seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, slots, pieces): rows have doc_id, source, th, size, source_size, target, sid, off and taken."""
    rows = sized(df, text_col)
    src = written(plan(targets(rows)), "sources")
    n_sources, n = src.count(), rows.count()
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = written(placed(rows, src, n_sources <= BROADCAST_SOURCES, max(64, n // BUCKET_ROWS)), "placed")
    dealt, parts = slots(src, partitions, seed), pieces(at)
    # the estimate for rows exploded from a few sources is tiny; both sides grow with the data and are merged
    times = dealt.groupBy("sid", "block").agg(F.count("*").alias("times"))
    taken = parts.join(times.hint("merge"), ["sid", "block"]).groupBy("sid", "off").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    out = at.join(taken.hint("merge"), ["sid", "off"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return out, dealt, parts


def shard_counts(dealt: DataFrame) -> DataFrame:
    """(shard, sid, n): the blocks of each source in each output shard."""
    return dealt.groupBy("shard", "sid").agg(F.count("*").alias("n"))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    rows, _, _ = mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")
