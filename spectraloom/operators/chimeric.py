"""Co-isolated precursors: isotope envelopes in MS1, detection, and a second pass on unexplained peaks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chem import ISOTOPE, PROTON, PrecursorTolerance, Tolerance, averagine_of
from ..functions.names import HIGH_RESOLUTION
from ..shared import written
from .match import MatchOptions, precursor_matches
from .model import Model
from .score import _masses, scored
from .spectrum import by_ions

# Fixed values of the detection.
NO_ENVELOPE, MAX_KL, MOST, ENVELOPE, FALLBACK_WINDOW, LEAST_TOLERANCE = 10.0, 0.3, 2, 4, 1.5, 0.01


def _strongest(mz: np.ndarray, intensity: np.ndarray, at: float, tol: float) -> float:
    a, b = np.searchsorted(mz, at - tol, "left"), np.searchsorted(mz, at + tol, "right")
    return float(intensity[a:b].max(initial=0.0))


def _strongest_at(mz: np.ndarray, intensity: np.ndarray, at: float, tol: float) -> float | None:
    a, b = np.searchsorted(mz, at - tol, "left"), np.searchsorted(mz, at + tol, "right")
    return float(mz[a + int(np.argmax(intensity[a:b]))]) if b > a else None


def isotope_match(mz: np.ndarray, intensity: np.ndarray, mono: float, charge: int, mass: float, tol: float, n: int = ENVELOPE) -> tuple[float, float]:
    """(divergence of the observed envelope from the average one, mono peak over the median of nonzero peaks)."""
    if not len(mz) or n == 0 or charge == 0:
        return NO_ENVELOPE, 0.0
    seen = np.array([_strongest(mz, intensity, mono + k * ISOTOPE / charge, tol) for k in range(n)])
    total = seen.sum()
    if total <= 0:
        return NO_ENVELOPE, 0.0
    p, theory = seen / total, np.maximum(averagine_of(mass, n), 1e-9)
    kl = float((p[p > 0] * np.log(p[p > 0] / theory[p > 0])).sum())
    some = intensity[intensity > 0]
    return max(kl, 0.0), float(seen[0] / np.median(some)) if len(some) else 0.0


def detect(mz: np.ndarray, intensity: np.ndarray, low: float, high: float, selected: float, charges: tuple[int, int], tol: float, max_kl: float = MAX_KL, most: int = MOST) -> list[tuple[float, int, float]]:
    """(m/z, charge, neutral mass) of other precursors in a window, strongest first."""
    at = np.flatnonzero((mz >= low) & (mz <= high))
    at = at[np.argsort(-intensity[at], kind="stable")]
    zs = [z for z in range(charges[0], charges[1] + 1) if z]
    on_ladder = lambda d, z, first: any(abs(d - k * ISOTOPE / z) <= tol for k in range(first, 6))
    out: list[tuple[float, int, float]] = []

    def known(m: float) -> bool:
        d = abs(m - selected)
        return d <= tol or any(on_ladder(d, z, 1) for z in zs) or any(on_ladder(abs(m - o), z, 0) for o, z, _ in out)

    for m in mz[at].tolist():
        if known(m):
            continue
        fits = [(isotope_match(mz, intensity, m, z, (m - PROTON) * z, tol)[0], z) for z in zs]
        fits = [f for f in fits if f[0] <= max_kl]
        if fits:
            kl, z = min(fits, key=lambda f: f[0])
            # the second peak of a heavy peptide is stronger than its first and may fit too: down while a peak before fits better
            while (before := _strongest_at(mz, intensity, m - ISOTOPE / z, tol)) is not None and before >= low and not known(before):
                less = isotope_match(mz, intensity, before, z, (before - PROTON) * z, tol)[0]
                if less >= kl:
                    break
                m, kl = before, less
            out.append((m, z, (m - PROTON) * z))
            if len(out) >= most:
                break
    return out


def envelopes(rows: DataFrame, tolerance: float) -> DataFrame:
    """(id, kl, snr) of rows (id, ms1_peaks, mono, charge, mass): isotope_match of each."""

    def run(batches):
        for batch in batches:
            got = [isotope_match(np.array([p["mz"] for p in r["ms1_peaks"]]), np.array([p["intensity"] for p in r["ms1_peaks"]]), r["mono"], r["charge"], r["mass"], tolerance) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k for k, _ in got], pa.float64()), pa.array([s for _, s in got], pa.float64())], names=["id", "kl", "snr"])

    return rows.select(F.col("id").cast("long").alias("id"), "ms1_peaks", "mono", "charge", "mass").mapInArrow(run, "id long, kl double, snr double")


FOUND = "spectrum_idx long, nth int, co_mz double, co_charge int, co_mass double"


def coisolated(linked: DataFrame, tolerance: PrecursorTolerance, charges: tuple[int, int], width: float = FALLBACK_WINDOW) -> DataFrame:
    """Co-isolated precursors of MS2 rows with ms1_peaks and isolation offsets; `width` stands in for an offset that is not known."""

    def run(batches):
        schema = pa.schema([("spectrum_idx", pa.int64()), ("nth", pa.int32()), ("co_mz", pa.float64()), ("co_charge", pa.int32()), ("co_mass", pa.float64())])
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                peaks = r["ms1_peaks"] or []
                mz, inten = np.array([p["mz"] for p in peaks]), np.array([p["intensity"] for p in peaks])
                c = r["precursor_mz"]
                low, high = c - (r["isolation_lower"] or width), c + (r["isolation_upper"] or width)
                tol = max(float(tolerance.left.as_da(c)), LEAST_TOLERANCE)
                rows += [{"spectrum_idx": r["spectrum_idx"], "nth": i, "co_mz": m, "co_charge": z, "co_mass": mass} for i, (m, z, mass) in enumerate(detect(mz, inten, low, high, c, charges, tol))]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    # peaks of the window and of the envelopes that may begin in it
    low, high = F.coalesce(F.nullif("isolation_lower", F.lit(0.0)), F.lit(width)) + 1, F.coalesce(F.nullif("isolation_upper", F.lit(0.0)), F.lit(width)) + ENVELOPE + 1
    near = F.filter("ms1_peaks", lambda p: (p["mz"] >= F.col("precursor_mz") - low) & (p["mz"] <= F.col("precursor_mz") + high))
    return linked.select("spectrum_idx", "precursor_mz", "isolation_lower", "isolation_upper", near.alias("ms1_peaks")).mapInArrow(run, FOUND)


def claimed_keys(mz: np.ndarray, intensity: np.ndarray, masses: np.ndarray, ppm: bool) -> list[int]:
    """Thousandths of m/z of the peaks that a peptide's singly charged fragments take."""
    out = set()
    for at in by_ions(masses, 1)[0].tolist():
        tol = at * 20e-6 if ppm else 0.5
        a, b = np.searchsorted(mz, at - tol, "left"), np.searchsorted(mz, at + tol, "right")
        if b > a:
            out.add(int(np.floor(mz[a + int(np.argmax(intensity[a:b]))] * 1000 + 0.5)))
    return sorted(out)


def residual(spectra: DataFrame, claims: DataFrame, model: Model) -> DataFrame:
    """spectra without the peaks that their claims (spectrum_idx, residues; any number each) take; those without a claim as they are."""
    ppm = model.instrument in HIGH_RESOLUTION

    def run(batches):
        for batch in batches:
            keys = []
            for peaks, residues in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                mz, inten = np.array([p["mz"] for p in peaks]), np.array([p["intensity"] for p in peaks])
                keys.append(claimed_keys(mz, inten, _masses(residues), ppm) if len(mz) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["spectrum_idx", "claimed"])

    taken = spectra.select("spectrum_idx", "peaks").join(claims.select("spectrum_idx", "residues"), "spectrum_idx").select("spectrum_idx", "peaks", "residues").mapInArrow(run, "spectrum_idx long, claimed array<long>")
    taken = taken.groupBy("spectrum_idx").agg(F.flatten(F.collect_list("claimed")).alias("claimed"))
    out = spectra.join(taken, "spectrum_idx", "left")
    return out.withColumn("peaks", F.when(F.col("claimed").isNull(), F.col("peaks")).otherwise(unclaimed(F.col("peaks"), F.col("claimed")))).drop("claimed")


def unclaimed(peaks, claimed):
    """Peaks whose thousandths of m/z are not among the claimed ones."""
    return F.filter(peaks, lambda p: ~F.array_contains(claimed, F.round(p["mz"] * 1000).cast("long")))


class _AtLeast(Tolerance):
    """A tolerance of LEAST_TOLERANCE Da at least."""

    def as_da(self, mass):
        width = super().as_da(mass)
        return F.greatest(width, F.lit(LEAST_TOLERANCE)) if isinstance(width, Column) else np.maximum(width, LEAST_TOLERANCE)


def rounds(spectra: DataFrame, found: DataFrame, primary: DataFrame, candidates: DataFrame, model: Model, options: MatchOptions, enzyme) -> Iterator[tuple[DataFrame, DataFrame, DataFrame]]:
    """For each co-isolated precursor in order of detection: (residual spectra, all scored candidates, the best of each spectrum).

    primary: spectrum_idx, cand_idx and residues of the first match, whose
    peptide is not found again.  A round's best take their peaks of the whole
    spectrum away from the next round.  At most MOST rounds, each a join of its own.
    """
    side = _AtLeast(options.tolerance.left.value, options.tolerance.left.unit)
    options = replace(options, isotopes=(0, 0), min_peaks=0, tolerance=PrecursorTolerance(side, side))
    same = F.struct("sequence", "pre", "post", F.transform("residues", lambda r: r["mod_delta"]).alias("mods"))
    known = candidates.withColumn("form", same).select("cand_idx", "form")
    first = primary.select("spectrum_idx", "cand_idx").join(known, "cand_idx").select("spectrum_idx", "form")
    claims = primary.select("spectrum_idx", "residues")
    spectra = spectra.join(found.select("spectrum_idx").distinct(), "spectrum_idx", "left_semi")
    for i in range(MOST):
        one = found.where(F.col("nth") == i).select("spectrum_idx", "co_mz", "co_charge")
        some = residual(spectra, claims, model).join(one, "spectrum_idx").withColumns({"precursor_mz": F.col("co_mz"), "precursor_charge": F.col("co_charge")}).drop("co_mz", "co_charge")
        some = written(some, "residual")
        matches = precursor_matches(some, candidates, options)
        matches = matches.join(known, "cand_idx").join(first, ["spectrum_idx", "form"], "left_anti").drop("form")
        got = scored(matches, some, candidates, model, enzyme).join(one.select("spectrum_idx", F.col("co_mz").alias("precursor_mz_override")), "spectrum_idx")
        got = written(got, "secondary")
        best = got.groupBy("spectrum_idx").agg(F.max_by(F.struct(*[c for c in got.columns if c != "spectrum_idx"]), F.struct("rank_score", (-F.col("cand_idx")).alias("c"))).alias("b")).select("spectrum_idx", "b.*")
        yield some, got, best
        claims = claims.unionByName(best.select("spectrum_idx", "residues"))


def secondaries(spectra: DataFrame, found: DataFrame, primary: DataFrame, candidates: DataFrame, model: Model, options: MatchOptions, enzyme) -> DataFrame:
    """The best other peptide of each co-isolated precursor, see rounds()."""
    out = None
    for _, _, best in rounds(spectra, found, primary, candidates, model, options, enzyme):
        out = best if out is None else out.unionByName(best)
    return out


def overlap(a: str = "a", b: str = "b"):
    """Jaccard overlap of two arrays of claimed peaks; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))
