"""Scores and features of matched peptides: spectra and candidates cogrouped, each spectrum prepared once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chem import Enzyme, cleavage_score
from .model import Model
from .spectrum import FEATURES, ScoredSpectrum, features

_ARROW = {"int": pa.int32(), "float": pa.float32(), "long": pa.int64(), "double": pa.float64()}


def _peaks(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.array([p["mz"] for p in row["peaks"]], float), np.array([p["intensity"] for p in row["peaks"]], np.float32)


def _masses(residues: list[dict]) -> np.ndarray:
    return np.array([r["mass"] + (r["mod_delta"] or 0.0) for r in residues])


def prepared(spectra: DataFrame, model: Model, charge: int = 2, window: tuple[float, int] | None = None) -> DataFrame:
    """(spectrum_idx, rank, density, total_intensity, peak_chance): what scoring knows of each spectrum's peaks.

    rank: place of each peak by intensity, 0 for one that the filters take; density: peaks per Da around it.
    """
    held = spectra.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            rows = [ScoredSpectrum(*_peaks(r), r["precursor_mz"], charge, held.value, window) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.rank.tolist() for s in rows], pa.list_(pa.int32())), pa.array([s.density(s.raw_mz).tolist() for s in rows], pa.list_(pa.float64())), pa.array([s.total_intensity for s in rows], pa.float64()), pa.array([s.peak_chance for s in rows], pa.float64())],
                names=["spectrum_idx", "rank", "density", "total_intensity", "peak_chance"],
            )

    some = spectra.select(F.col("spectrum_idx").cast("long").alias("spectrum_idx"), "precursor_mz", "peaks")
    return some.mapInArrow(run, "spectrum_idx long, rank array<int>, density array<double>, total_intensity double, peak_chance double")


def strongest_peaks(spectra: DataFrame, model: Model, tolerance: float) -> DataFrame:
    """(spectrum_idx, hits): of each m/z in `targets` the place of the strongest peak within tolerance Da, -1 for none."""
    held = spectra.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            hits = []
            for r in batch.to_pylist():
                targets = np.array(r["targets"], float)
                hits.append(ScoredSpectrum(*_peaks(r), r["precursor_mz"], 2, held.value).strongest(targets, np.full(len(targets), tolerance)).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.list_(pa.int32()))], names=["spectrum_idx", "hits"])

    some = spectra.select(F.col("spectrum_idx").cast("long").alias("spectrum_idx"), "precursor_mz", "peaks", "targets")
    return some.mapInArrow(run, "spectrum_idx long, hits array<int>")


def _per_spectrum(matches: DataFrame, spectra: DataFrame, model: Model, kinds: list[tuple[str, str]], fn) -> DataFrame:
    """(spectrum_idx, charge, cand_idx, kinds...) from fn(scored spectrum, match row)."""
    held = matches.sparkSession.sparkContext.broadcast(model)
    names = [n for n, _ in kinds]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        spectrum = right.slice(0, 1).to_pylist()
        out: dict[str, list] = {n: [] for n in ("spectrum_idx", "charge", "cand_idx", *names)}
        prepared: dict[int, ScoredSpectrum] = {}
        if spectrum:
            mz, intensity = _peaks({"peaks": spectrum[0]["_peaks"]})
            for row in left.to_pylist():
                z = row["charge"]
                if z not in prepared:
                    prepared[z] = ScoredSpectrum(mz, intensity, row.get("precursor_mz_override") or spectrum[0]["_mz"], z, held.value)
                got = fn(prepared[z], row)
                for n in ("spectrum_idx", "charge", "cand_idx"):
                    out[n].append(row[n])
                for n in names:
                    out[n].append(got[n])
        types = [pa.int64(), pa.int32(), pa.int64(), *[_ARROW[t] for _, t in kinds]]
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    schema = "spectrum_idx long, charge int, cand_idx long, " + ", ".join(f"{n} {t}" for n, t in kinds)
    some = spectra.select(F.col("spectrum_idx").alias("_spectrum"), F.col("precursor_mz").alias("_mz"), F.col("peaks").alias("_peaks"))
    return matches.groupBy("spectrum_idx").cogroup(some.groupBy("_spectrum")).applyInArrow(run, schema)


def _all_scores(once: DataFrame, spectra: DataFrame, model: Model) -> DataFrame:
    """(spectrum_idx, charge, cand_idx, node_score, edge_score) of rows (spectrum_idx, charge, cand_idx, masses): all of a spectrum and charge in one call."""
    held = once.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("spectrum_idx", pa.int64()), ("charge", pa.int32()), ("cand_idx", pa.int64()), ("node_score", pa.float32()), ("edge_score", pa.int32())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            return out.empty_table()
        left = left.combine_chunks()
        peaks = right.column("_peaks").combine_chunks().slice(0, 1).flatten()
        mz, intensity = (peaks.field(f).to_numpy(zero_copy_only=False) for f in ("mz", "intensity"))
        masses = left.column("masses").combine_chunks()
        values, off = masses.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(masses.value_lengths().to_numpy(zero_copy_only=False))])
        charge = left.column("charge").to_numpy()
        raw, edge = np.zeros(len(charge), np.float32), np.zeros(len(charge), np.int32)
        for z in np.unique(charge).tolist():
            at = np.flatnonzero(charge == z)
            size = np.diff(off)[at]
            own = np.concatenate([[0], np.cumsum(size)])
            flat = values[np.repeat(off[at] - own[:-1], size) + np.arange(int(own[-1]))]
            s = ScoredSpectrum(mz, intensity, right.column("_mz")[0].as_py(), z, held.value)
            raw[at], edge[at] = s.scores(flat, own)
        return pa.table([left.column("spectrum_idx"), left.column("charge"), left.column("cand_idx"), pa.array(raw), pa.array(edge)], schema=out)

    some = spectra.select(F.col("spectrum_idx").cast("long").alias("_spectrum"), F.col("precursor_mz").alias("_mz"), F.col("peaks").alias("_peaks"))
    left = once.select(F.col("spectrum_idx").cast("long").alias("spectrum_idx"), F.col("charge").cast("int").alias("charge"), F.col("cand_idx").cast("long").alias("cand_idx"), "masses")
    return left.groupBy("spectrum_idx").cogroup(some.groupBy("_spectrum")).applyInArrow(run, "spectrum_idx long, charge int, cand_idx long, node_score float, edge_score int")


def scored(matches: DataFrame, spectra: DataFrame, candidates: DataFrame, model: Model, enzyme: Enzyme) -> DataFrame:
    """matches with node_score, cleavage, edge_score, score (node + cleavage), rank_score (score + edge) and mass_key.

    The scores do not depend on the isotope, so they are computed once for each
    spectrum, charge and candidate.  Equal peptides of several proteins are
    scored once; what travels to the scoring is their residues' masses.
    """
    some = candidates.select("cand_idx", "sequence", "residues", "pre", "post", "nominal_residue_mass")
    some = some.withColumn("_form", F.xxhash64("sequence", F.transform("residues", lambda r: r["mod_delta"])))
    joined = matches.select("spectrum_idx", "charge", "cand_idx").join(some, "cand_idx")
    masses = F.transform("residues", lambda r: r["mass"] + F.coalesce(r["mod_delta"], F.lit(0.0)))
    once = joined.groupBy("spectrum_idx", "charge", "_form").agg(F.min_by(F.struct("cand_idx", masses.alias("masses")), "cand_idx").alias("c")).select("spectrum_idx", "charge", "_form", "c.cand_idx", "c.masses")
    got = _all_scores(once, spectra, model)
    forms = once.select("spectrum_idx", "charge", "cand_idx", "_form").join(got, ["spectrum_idx", "charge", "cand_idx"]).drop("cand_idx")
    n = F.length("sequence")
    cleavage = cleavage_score(F.col("pre"), F.substring("sequence", 1, 1), F.substring("sequence", n, F.lit(1)), F.col("post"), enzyme)
    out = joined.withColumn("cleavage", cleavage).join(forms, ["spectrum_idx", "charge", "_form"])
    out = out.withColumn("score", (F.col("node_score") + F.col("cleavage")).cast("float")).withColumn("rank_score", (F.col("score") + F.col("edge_score")).cast("float"))
    out = out.withColumn("mass_key", F.col("nominal_residue_mass"))
    return matches.join(out.drop("_form", "pre", "post", "nominal_residue_mass"), ["spectrum_idx", "charge", "cand_idx"])


def with_features(psms: DataFrame, spectra: DataFrame, model: Model, intensity_model=None) -> DataFrame:
    """psms (with sequence and residues) and the fragment features of each."""
    held = psms.sparkSession.sparkContext.broadcast(intensity_model)

    def fn(s: ScoredSpectrum, row: dict) -> dict:
        return features(s, row["sequence"], _masses(row["residues"]), held.value)

    kinds = [(n, t) for n, t in FEATURES if n != "edge_score"]
    got = _per_spectrum(psms.select("spectrum_idx", "charge", "cand_idx", "sequence", "residues"), spectra, model, kinds, fn)
    return psms.join(got, ["spectrum_idx", "charge", "cand_idx"])
