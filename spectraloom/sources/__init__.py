"""Readers.  Every reader goes through Spark's own file sources, so any store that Spark reads will do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import written
from .fasta import read_fasta
from .mgf import read_mgf
from .mzml import read_mzml, spectra_of, with_ms1_peaks
from .vendor import VendorDataSource

__all__ = ["read_fasta", "read_linked", "read_mgf", "read_mzml", "read_spectra", "register", "spectrum_format"]


def register(spark: SparkSession) -> None:
    """Formats that only explain how to convert their files."""
    for kind in ("thermo_raw", "bruker_d"):
        spark.dataSource.register(type(f"{kind}_source", (VendorDataSource,), {"name": classmethod(lambda cls, k=kind: k)}))


def spectrum_format(path: str) -> str:
    """mzml, raw, d or mgf by the end of a path; what is none of the first three is read as MGF."""
    low = path.rstrip("/").lower().removesuffix(".gz")
    return next((kind for kind in ("mzml", "raw", "d") if low.endswith("." + kind)), "mgf")


def read_spectra(spark: SparkSession, *paths: str, ms_levels: tuple[int, int] = (2, 2), limit: int | None = None) -> DataFrame:
    """Spectra of one or several files, pooled; with several, titles start with the file's stem.  mzML is parsed once, into a table."""

    def one(path: str) -> DataFrame:
        kind = spectrum_format(path)
        if kind in ("raw", "d"):
            raise VendorDataSource.error(path)
        return read_mgf(spark, path) if kind == "mgf" else spectra_of(written(read_mzml(spark, path, ms_levels), "scans"))

    return _pooled(paths, one, limit)


def read_linked(spark: SparkSession, *paths: str, limit: int | None = None) -> DataFrame:
    """MS2 spectra of mzML files with ms1_peaks, those of the last MS1 before each."""

    def one(path: str) -> DataFrame:
        if spectrum_format(path) != "mzml":
            raise ValueError(f"{path}: MS1 scans are read from mzML only")
        return spectra_of(with_ms1_peaks(written(read_mzml(spark, path, (1, 2)).where("error is null"), "scans")), "ms1_peaks")

    return _pooled(paths, one, limit)


def _pooled(paths: tuple[str, ...], one: Callable[[str], DataFrame], limit: int | None) -> DataFrame:
    out, base = None, 0
    for path in paths:
        df = one(path)
        if len(paths) > 1:
            stem = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
            df = df.withColumns({"title": F.concat(F.lit(stem + "/"), "title"), "spectrum_idx": F.col("spectrum_idx") + base})
            last = df.agg(F.max("spectrum_idx")).first()[0]
            base = base if last is None else last + 1
        out = df if out is None else out.unionByName(df)
    return out if limit is None else out.orderBy("spectrum_idx").limit(limit)
