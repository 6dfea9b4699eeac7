"""FASTA: one row for each protein, split at record starts so that a large file is read in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import decoy_accession
from ..operators.order import with_index


def split_header(header: Column) -> tuple[Column, Column]:
    """(accession, description): the first word and the rest."""
    form = r"^\s*(\S*)\s*(.*?)\s*$"
    return F.regexp_extract(header, form, 1), F.regexp_extract(header, form, 2)


def parse_records(records: DataFrame) -> DataFrame:
    """(accession, description, sequence, error) of a column value, each a record without its '>'."""
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: (F.trim(x) != "") & ~F.ltrim(x).startswith(";"))
    first = F.coalesce("_first", F.lit(False)) & F.ltrim("value").startswith(">")
    body = F.when(first, F.regexp_replace("value", r"^\s*>", "")).otherwise(F.col("value"))
    header = F.regexp_extract(body, r"^([^\r\n]*)", 1)
    accession, description = split_header(header)
    sequence = F.upper(F.regexp_replace(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), ""), r"\s+", ""))
    error = F.when(~F.col("headed"), "sequence before the first header").when(accession == "", "empty accession")
    return records.select("*", accession.alias("accession"), description.alias("description"), sequence.alias("sequence"), error.alias("error"))


def read_fasta(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """(protein_index, accession, description, sequence) in file order.

    PERMISSIVE keeps bad records with their error; FAILFAST stops at one.
    """
    text = spark.read.option("lineSep", "\n>").text(path)
    text = text.select("value", F.col("_metadata.file_block_start").alias("_start"), F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row"))
    # a file's first record still has its '>'; blank and comment lines may stand before it
    first = text.where("_start = 0").groupBy("_file").agg(F.min("_row").alias("_row")).select("_row", F.lit(True).alias("_first"))
    text = text.join(F.broadcast(first), "_row", "left")
    is_first = F.coalesce("_first", F.lit(False))
    lead = F.regexp_replace("value", r"^(?:[ \t]*(?:;[^\n]*)?\r?\n)*(?:;[^\n]*$)?", "")
    text = text.withColumn("value", F.when(is_first, lead).otherwise(F.col("value"))).withColumn("headed", ~is_first | F.ltrim("value").startswith(">"))
    text = text.where(F.trim("value") != "")
    rows = parse_records(text).drop("value", "_start", "_file", "_first", "headed")
    if mode == "FAILFAST":
        rows = rows.withColumn("accession", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("accession"))).drop("error")
    rows = with_index(rows, "protein_index", ids="_row")
    return rows.select("protein_index", *[c for c in rows.columns if c not in ("protein_index", "_row")])


def with_decoys(proteins: DataFrame, prefix: str = "XXX") -> DataFrame:
    """Targets and, after them, their reversed sequences under the decoy prefix."""
    n = proteins.agg(F.coalesce(F.max("protein_index") + 1, F.lit(0))).first()[0]
    targets = proteins.withColumn("is_decoy", F.lit(False))
    decoys = proteins.withColumns({"protein_index": F.col("protein_index") + n, "accession": decoy_accession(F.col("accession"), prefix), "sequence": F.reverse("sequence"), "is_decoy": F.lit(True)})
    return targets.unionByName(decoys)
