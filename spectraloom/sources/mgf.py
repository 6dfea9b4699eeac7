"""MGF: one row for each spectrum, split at END IONS so that a large file is read in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import with_index

SPECTRUM = ("spec_file", "spectrum_idx", "title", "scan", "precursor_mz", "precursor_intensity", "precursor_charge", "rt_seconds", "activation", "isolation_lower", "isolation_upper", "peaks")


def parse_charge(text: Column) -> Column:
    """`2+`, `3-` or `2`: an integer, or null."""
    return F.regexp_replace(F.trim(text), "[+-]$", "").try_cast("int")


def read_mgf(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """Spectra in file order; rows with an error go unless mode is ALL, and stop the read if it is FAILFAST."""
    text = spark.read.option("lineSep", "END IONS").text(path)
    text = text.select(F.col("value"), F.col("_metadata.file_path").alias("spec_file"))
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    rows = text.withColumn("lines", lines).where(F.array_contains("lines", "BEGIN IONS") | (F.size("lines") > 0))
    begun = F.array_position("lines", F.lit("BEGIN IONS"))
    rows = rows.where(begun > 0).withColumn("lines", F.slice("lines", (begun + 1).cast("int"), F.size("lines")))
    is_key = lambda x: x.rlike(r"^[A-Za-z_]+\s*=")
    get = lambda key: F.trim(F.regexp_extract(F.coalesce(F.get(F.filter("keys", lambda x: F.upper(x).rlike(rf"^{key}\s*=")), 0), F.lit("")), r"=(.*)$", 1))
    rows = rows.withColumn("keys", F.filter("lines", is_key)).withColumn("data", F.filter("lines", lambda x: ~is_key(x)))
    peak = lambda x: F.struct(F.get(F.split(x, r"\s+"), 0).try_cast("double").alias("mz"), F.get(F.split(x, r"\s+"), 1).try_cast("float").alias("intensity"))
    rows = rows.withColumn("raw", F.transform("data", peak))
    mass = F.split(get("PEPMASS"), r"\s+")
    charge = get("CHARGE")
    mz = F.get(mass, 0).try_cast("double")
    error = (
        F.when(get("PEPMASS") == "", "no PEPMASS")
        .when(mz.isNull() | F.isnan(mz) | ~(mz > 0), "bad PEPMASS")
        .when((charge != "") & parse_charge(charge).isNull(), "bad CHARGE")
        .when(F.exists("raw", lambda p: p["mz"].isNull() | p["intensity"].isNull()), "bad peak line")
        .when(F.array_contains("lines", "BEGIN IONS"), "unterminated block")
    )
    by_mz = F.array_sort("raw", lambda a, b: F.when(a["mz"] < b["mz"], -1).when(a["mz"] > b["mz"], 1).otherwise(0))
    out = rows.select(
        "spec_file",
        get("TITLE").alias("title"),
        get("SCANS").try_cast("int").alias("scan"),
        mz.alias("precursor_mz"),
        F.get(mass, 1).try_cast("float").alias("precursor_intensity"),
        F.nullif(parse_charge(charge), F.lit(0)).alias("precursor_charge"),
        get("RTINSECONDS").try_cast("double").alias("rt_seconds"),
        F.lit(None).cast("string").alias("activation"),
        F.lit(None).cast("double").alias("isolation_lower"),
        F.lit(None).cast("double").alias("isolation_upper"),
        by_mz.alias("peaks"),
        error.alias("error"),
    )
    if mode == "FAILFAST":
        out = out.withColumn("title", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("title")))
    out = with_index(out, "spectrum_idx")
    return out if mode == "ALL" else out.where("error is null").select(*SPECTRUM)
