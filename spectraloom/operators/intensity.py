"""Fragment intensity statistics: merging, files, lookup with backoff, and the signal of a match."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("ion_type", "flank_n", "flank_c", "pos_bin", "charge", "nce_bin")
ANY_NCE, ANY_FLANK, MIN_COUNT = "__any__", "*", 30


def read_partial(spark: SparkSession, *paths: str) -> DataFrame:
    """KEYS with count, sum_log_rel and sum_log_rel_sq; files that hold means and variances give their sums back."""
    out = None
    for path in paths:
        df = spark.read.parquet(path)
        if "mean_log_rel" in df.columns:
            mean, var, n = F.col("mean_log_rel"), F.col("var_log_rel"), F.col("count")
            df = df.withColumn("sum_log_rel", mean * n).withColumn("sum_log_rel_sq", (var + mean * mean) * n)
        df = df.select(*KEYS, "count", "sum_log_rel", "sum_log_rel_sq")
        out = df if out is None else out.unionByName(df)
    return out


def merged(partial: DataFrame) -> DataFrame:
    """KEYS with count, mean_log_rel and var_log_rel (population, at least 0); keys without counts go."""
    out = partial.groupBy(*KEYS).agg(F.sum("count").alias("count"), F.sum("sum_log_rel").alias("s"), F.sum("sum_log_rel_sq").alias("q")).where("count > 0")
    mean = F.col("s") / F.col("count")
    return out.select(*KEYS, "count", mean.alias("mean_log_rel"), F.greatest(F.col("q") / F.col("count") - mean * mean, F.lit(0.0)).alias("var_log_rel"))


def write_model(model: DataFrame, path: str) -> None:
    model.orderBy(*KEYS).write.parquet(path)


def global_mean(model: DataFrame) -> DataFrame:
    return model.agg(F.coalesce(F.try_divide(F.sum(F.col("mean_log_rel") * F.col("count")), F.sum("count")), F.lit(0.0)).alias("mean_log_rel"))


def looked_up(wanted: DataFrame, model: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """wanted (KEYS) with mean_log_rel and var_log_rel: of the key, without collision energy, without flanks, without both, or of all (variance 1)."""
    good = model.where(F.col("count") >= min_count).select(*KEYS, "mean_log_rel", "var_log_rel")
    out, found = wanted, []
    for i, changes in enumerate(({}, {"nce_bin": ANY_NCE}, {"flank_n": ANY_FLANK, "flank_c": ANY_FLANK}, {"nce_bin": ANY_NCE, "flank_n": ANY_FLANK, "flank_c": ANY_FLANK})):
        side = good.select(*[F.col(k).alias(f"_{k}") for k in KEYS], F.struct("mean_log_rel", "var_log_rel").alias(f"_v{i}"))
        on = None
        for k in KEYS:
            c = (F.lit(changes[k]) if k in changes else out[k]).eqNullSafe(side[f"_{k}"])
            on = c if on is None else on & c
        out = out.join(side, on, "left").drop(*[f"_{k}" for k in KEYS])
        found.append(F.col(f"_v{i}"))
    out = out.crossJoin(F.broadcast(global_mean(model).withColumnRenamed("mean_log_rel", "_all")))
    best = F.coalesce(*found, F.struct(F.col("_all").alias("mean_log_rel"), F.lit(1.0).alias("var_log_rel")))
    return out.select(*wanted.columns, best["mean_log_rel"].alias("mean_log_rel"), best["var_log_rel"].alias("var_log_rel"))


class IntensityModel:
    """A model's table for use inside Arrow functions; the last of equal keys counts."""

    def __init__(self, rows, min_count: int = MIN_COUNT):
        self.table, s, n = {}, 0.0, 0
        for r in rows:
            if any(r[k] is None for k in (*KEYS, "count", "mean_log_rel", "var_log_rel")) or r["count"] < 0:
                continue
            self.table[tuple(r[k] for k in KEYS)] = (r["count"], r["mean_log_rel"], r["var_log_rel"])
        for c, m, _ in self.table.values():
            s, n = s + m * c, n + c
        self.mean, self.min_count = (s / n if n else 0.0), min_count

    @classmethod
    def load(cls, spark: SparkSession, path: str, min_count: int = MIN_COUNT) -> IntensityModel:
        return cls((r.asDict() for r in spark.read.parquet(path).toLocalIterator()), min_count)

    def predict(self, ion: str, left: str, right: str, pos: int, charge: int, nce: str) -> tuple[float, float]:
        for key in ((ion, left, right, pos, charge, nce), (ion, left, right, pos, charge, ANY_NCE), (ion, ANY_FLANK, ANY_FLANK, pos, charge, nce), (ion, ANY_FLANK, ANY_FLANK, pos, charge, ANY_NCE)):
            got = self.table.get(key)
            if got and got[0] >= self.min_count:
                return got[1], got[2]
        return self.mean, 1.0

    def signal(self, s, sequence: str, mz: np.ndarray, is_b: np.ndarray, position: np.ndarray, width) -> float:
        """Cosine of predicted and observed intensities of the singly charged fragments."""
        n = len(sequence)
        hit = s.strongest(mz, width(mz))
        observed = np.where(hit >= 0, s.intensity[hit].astype(float), 0.0)
        predicted = []
        for b, i in zip(is_b.tolist(), position.tolist(), strict=True):
            at = i if b else n - i
            pos = int(np.clip(np.floor(10.0 * i / n + 0.5), 0, 10))
            predicted.append(np.exp(self.predict("b" if b else "y", sequence[at - 1], sequence[at], pos, s.charge, "unknown")[0]))
        predicted = np.array(predicted)
        norm = np.sqrt((predicted**2).sum()) * np.sqrt((observed**2).sum())
        return float(np.clip((predicted * observed).sum() / norm, 0, 1)) if norm > 0 else 0.0
