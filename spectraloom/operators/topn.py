"""Top matches with ties, their merging, and the values each spectrum's matches share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAILOR_LEAST, TAILOR_SHARE = 100, 0.01


def worst_if_nan(score: Column) -> Column:
    return F.nanvl(score.cast("double"), F.lit(float("-inf")))


def top_with_ties(df: DataFrame, keys: list[str], score: str, n: int) -> DataFrame:
    """Rows whose rank by score within keys is at most n; all rows tied at the last rank stay."""
    w = Window.partitionBy(*keys).orderBy(worst_if_nan(F.col(score)).desc())
    return df.withColumn("_rank", F.rank().over(w)).where(F.col("_rank") <= n).drop("_rank")


def merged_top(df: DataFrame, n: int) -> DataFrame:
    """Top n of each spectrum and charge, equal peptides of equal score merged, then top n of each spectrum."""
    return top_with_ties(dedup(top_with_ties(df, ["spectrum_idx", "charge"], "rank_score", n)), ["spectrum_idx"], "rank_score", n)


def dedup(df: DataFrame) -> DataFrame:
    """One row for each spectrum, charge, peptide, modification mass in 1e-5 Da and rounded score, with all candidates."""
    keys = ["spectrum_idx", "charge", "sequence", "mod_units", "score_round"]
    df = df.withColumn("mod_units", F.round(F.aggregate("residues", F.lit(0.0), lambda a, r: a + F.coalesce(r["mod_delta"], F.lit(0.0))) * 1e5).cast("long"))
    df = df.withColumn("score_round", F.round("rank_score").cast("long"))
    first = F.struct(worst_if_nan(F.col("rank_score")).alias("s"), (-F.col("cand_idx")).alias("c"))
    rest = [c for c in df.columns if c not in (*keys, "cand_idx")]
    out = df.groupBy(*keys).agg(F.max_by(F.struct("cand_idx", *rest), first).alias("m"), F.array_sort(F.collect_set("cand_idx")).alias("candidate_idxs"))
    return out.select(*keys[:3], "m.cand_idx", *[F.col(f"m.{c}") for c in rest], "candidate_idxs")


def with_output_rank(df: DataFrame) -> DataFrame:
    """rank (dense, by rank_score), row_idx and multi_row in output order."""
    by = Window.partitionBy("spectrum_idx").orderBy(worst_if_nan(F.col("rank_score")).desc())
    order = Window.partitionBy("spectrum_idx").orderBy(worst_if_nan(F.col("rank_score")).desc(), worst_if_nan(F.col("score")).desc(), "cand_idx")
    return df.withColumns({"rank": F.dense_rank().over(by), "row_idx": F.row_number().over(order) - 1, "multi_row": F.count("*").over(Window.partitionBy("spectrum_idx")) > 1})


def delta_score(scored: DataFrame) -> DataFrame:
    """(spectrum_idx, charge, delta): the best score less the best of another peptide mass, 0 with one mass only."""
    by_mass = scored.groupBy("spectrum_idx", "charge", "mass_key").agg(F.max("score").alias("s"))
    two = by_mass.groupBy("spectrum_idx", "charge").agg(F.slice(F.sort_array(F.collect_list("s"), False), 1, 2).alias("s"))
    return two.select("spectrum_idx", "charge", F.when(F.size("s") == 2, F.col("s")[0] - F.col("s")[1]).otherwise(0.0).alias("delta"))


def tailor(scored: DataFrame, keys: list[str]) -> DataFrame:
    """keys with n and tailor: the score at the upper hundredth of at least 100 rounded scores, else 1."""
    hist = scored.withColumn("bin", F.round("score").cast("int")).groupBy(*keys, "bin").count()
    w = Window.partitionBy(*keys)
    hist = hist.withColumn("n", F.sum("count").over(w)).withColumn("above", F.sum("count").over(w.orderBy(F.desc("bin"))))
    at = F.max(F.when(F.col("above") >= F.ceil(F.col("n") * TAILOR_SHARE), F.col("bin")))
    out = hist.groupBy(*keys).agg(F.first("n").alias("n"), at.alias("at"))
    return out.select(*keys, "n", F.when((F.col("n") >= TAILOR_LEAST) & (F.col("at") > 0), F.col("at").cast("double")).otherwise(1.0).alias("tailor"))


def null_stats(scored: DataFrame, keys: list[str]) -> DataFrame:
    """keys with n, mean and population deviation of the scores, at least 1e-6; 1 below two scores."""
    out = scored.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("dev"))
    return out.withColumn("dev", F.when(F.col("n") < 2, 1.0).otherwise(F.greatest("dev", F.lit(1e-6))))


def listwise(df: DataFrame, key: str, score: str) -> DataFrame:
    """df with entropy of the softmax of its key's scores, and the gap between its two best."""
    w = Window.partitionBy(key)
    shifted = F.exp(F.col(score) - F.max(score).over(w))
    p = shifted / F.sum(shifted).over(w)
    term = F.when(p > 0, -p * F.ln(p)).otherwise(0.0)
    df = df.withColumn("_term", term)
    second = F.nth_value(score, 2).over(w.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    gap = F.coalesce(F.max(score).over(w) - second, F.lit(0.0))
    return df.withColumn("entropy", F.when(F.count("*").over(w) < 2, 0.0).otherwise(F.sum("_term").over(w))).withColumn("gap", gap).drop("_term")


def leave_one_out(df: DataFrame, key: str, score: str) -> DataFrame:
    """df with loo: the score's distance from the others of its key in their deviations (at least 1e-6); 0 alone."""
    w = Window.partitionBy(key)
    n = F.count("*").over(w) - 1
    mean = F.try_divide(F.sum(score).over(w) - F.col(score), n)
    square = F.try_divide(F.sum(F.col(score) * F.col(score)).over(w) - F.col(score) * F.col(score), n)
    dev = F.greatest(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))), F.lit(1e-6))
    return df.withColumn("loo", F.when(n > 0, (F.col(score) - mean) / dev).otherwise(0.0))


def longest_run(flags: Column) -> Column:
    """Length of the longest run of true in an array."""
    step = lambda a, x: F.struct(F.when(x, a["run"] + 1).otherwise(0).alias("run"), F.greatest(a["best"], F.when(x, a["run"] + 1).otherwise(0)).alias("best"))
    return F.aggregate(flags, F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")), step)["best"]
