"""Target-decoy error rates, robust statistics and entrapment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .topn import worst_if_nan

# The calibration of precursor masses.
STRIDE, SAMPLE_CAP, LEAST_KEYS, LEAST_RESIDUALS, RESIDUAL_CAP = 10, 500, 10_000, 150, 200
RESIDUAL_PPM, RESIDUAL_Q = 50.0, 0.01
SIGMAS, MARGIN, FLOOR, MAD_SCALE = 3.0, 0.5, 2.0, 1.4826


def q_values(df: DataFrame, score: str, decoy: str) -> DataFrame:
    """df with q: the least rate of decoys to targets at or below each score, the worst of equal scores, at most 1.

    Counts are made for distinct scores first.  The scores are dealt to ranges
    in order; running counts and least rates run within a range, and only the
    sums of the ranges, one row each, meet in one task.
    """
    value = worst_if_nan(F.col(score))
    by = df.groupBy(value.alias("_s")).agg(F.sum(F.when(F.col(decoy), 1).otherwise(0)).alias("_d"), F.sum(F.when(F.col(decoy), 0).otherwise(1)).alias("_t"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, since the range a row falls into must not change between the steps
    by = written(by.repartitionByRange(n, F.desc("_s")).withColumn("_p", F.spark_partition_id()), "rates")
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = by.groupBy("_p").agg(F.sum("_d").alias("_pd"), F.sum("_t").alias("_pt"))
    sums = sums.select("_p", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_pd", "_pt")])
    down = Window.partitionBy("_p").orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # targets of a score come before its decoys: the last row of a score has the worst rate of it
    rate = (F.col("_pd") + F.sum("_d").over(down)) / F.greatest(F.col("_pt") + F.sum("_t").over(down), F.lit(1))
    by = by.join(F.broadcast(sums), "_p").withColumn("_rate", rate)
    later = Window.orderBy("_p").rowsBetween(1, Window.unboundedFollowing)
    least = by.groupBy("_p").agg(F.min("_rate").alias("_least")).select("_p", F.min("_least").over(later).alias("_after"))
    up = Window.partitionBy("_p").orderBy(F.desc("_s")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    by = by.join(F.broadcast(least), "_p").select("_s", F.least(F.lit(1.0), F.min("_rate").over(up), F.col("_after")).alias("q"))
    return df.withColumn("_s", value).join(by, "_s").drop("_s")


def best_per_spectrum(psms: DataFrame) -> DataFrame:
    w = Window.partitionBy("spectrum_idx").orderBy(worst_if_nan(F.col("rank_score")).desc(), "cand_idx")
    return psms.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def accepted_targets(df: DataFrame, fdr: float, key: str | None = None) -> Column:
    hit = F.when(~F.col("is_decoy") & (F.col("q") <= fdr), F.col(key) if key else F.lit(1))
    return F.count_distinct(hit) if key else F.count(hit)


def median_of(df: DataFrame, value: str) -> float:
    return float(df.agg(F.coalesce(F.median(value), F.lit(0.0))).first()[0])


def robust_spread(df: DataFrame, value: str) -> DataFrame:
    """(median, mad, sigma) of a column; zeros if it is empty."""
    m = df.agg(F.coalesce(F.median(value), F.lit(0.0)).alias("median"))
    dev = df.crossJoin(F.broadcast(m)).agg(F.coalesce(F.first("median"), F.lit(0.0)).alias("median"), F.coalesce(F.median(F.abs(F.col(value) - F.col("median"))), F.lit(0.0)).alias("mad"))
    return dev.withColumn("sigma", F.col("mad") * MAD_SCALE)


def tightened_ppm(user: float, sigma: Column) -> Column:
    return F.least(F.lit(user), F.greatest(F.lit(FLOOR), sigma * SIGMAS + MARGIN))


def systematic_sample(df: DataFrame, order: list[str], stride: int = STRIDE, cap: int = SAMPLE_CAP) -> DataFrame:
    """Every stride-th row in an order, at most cap; the sample is the operator's result.

    The columns of the order name a row.  Only they are sorted, down to the
    first stride * cap; the rows themselves are fetched by them.
    """
    first = df.select(*order).orderBy(*order).limit(stride * cap)
    some = first.withColumn("_n", F.row_number().over(Window.orderBy(*order)) - 1).where(F.col("_n") % stride == 0).drop("_n")
    return df.join(F.broadcast(some), order, "left_semi")


def entrapment(df: DataFrame, prefix: str = "ENT_") -> DataFrame:
    """(n, entrapped, fdp): a match is entrapped if all its proteins bear the prefix; fdp is twice their share."""
    hit = F.forall("proteins", lambda p: p.startswith(prefix)) & (F.size("proteins") > 0)
    out = df.agg(F.count("*").alias("n"), F.count(F.when(hit, 1)).alias("entrapped"))
    return out.withColumn("fdp", F.coalesce(F.try_divide(2.0 * F.col("entrapped"), F.col("n")), F.lit(0.0)))


def distinct_accepted(df: DataFrame, fdr: float = 0.01) -> DataFrame:
    """(matches, peptides, proteins) among targets at a rate; df has q, is_decoy, sequence and proteins."""
    good = df.where(~F.col("is_decoy") & (F.col("q") <= fdr))
    return good.agg(F.count("*").alias("matches"), F.count_distinct("sequence").alias("peptides"), F.size(F.array_distinct(F.flatten(F.collect_set("proteins")))).alias("proteins"))


def out_of_bounds(metrics: DataFrame, bounds: DataFrame) -> DataFrame:
    """(metric, problem, failure) of metrics (metric, value text) against bounds (metric, min, max, optional).

    A missing value fails unless it is optional; bounds without numbers are passed over.
    """
    rows = bounds.where("metric <> '' and (min is not null or max is not null)").join(metrics, "metric", "left")
    text = F.trim("value")
    missing = F.coalesce(text, F.lit("")).isin("", "NA", "na")
    value = text.try_cast("double")
    problem = F.when(missing, "missing").when(value.isNull(), "not a number").when((value < F.col("min")) | (value > F.col("max")), "outside its bounds")
    out = rows.select("metric", problem.alias("problem"), F.coalesce(F.col("optional"), F.lit(False)).alias("optional")).where("problem is not null")
    return out.select("metric", "problem", (~(F.col("optional") & (F.col("problem") == "missing"))).alias("failure"))
