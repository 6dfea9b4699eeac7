"""Training: histograms of matched ions, their algebra, smoothed estimates and labels."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chem import RESIDUE_MASS, ion_mz, nominal_of
from ..functions.names import HIGH_RESOLUTION
from .fdr import best_per_spectrum, q_values
from .model import NOISE, Model, Part
from .score import _masses, _peaks
from .spectrum import ScoredSpectrum, half_away

COUNT_KEYS = ("kind", "charge", "seg", "mass", "ion_kind", "ion_charge", "ion_offset", "bin")
COUNTS = "kind string, charge int, seg int, mass float, ion_kind string, ion_charge int, ion_offset float, bin int, n long"


@dataclass(frozen=True)
class EstimateOptions:
    pseudo: float = 1.0
    noise_pseudo: float = 0.05
    min_count: int = 50
    backoff: float = 20.0
    smooth: bool = False


def _facts(s: ScoredSpectrum, masses: np.ndarray):
    """(partition, ion, rank or 0, error bin or None) of each ion of each split, in the model's error scale."""
    m = s.model
    wide = m.instrument in HIGH_RESOLUTION
    heads = nominal_of(np.cumsum(masses)[:-1])
    tails = int(nominal_of(float(masses.sum()))) - heads
    for seg, part in enumerate(s.parts):
        for (kind, z, offset), _ in s.ratios[seg]:
            at = ion_mz(heads if kind == "prefix" else tails, z, offset)
            tol = at * 20e-6 if wide else m.mme.as_da(at)
            hit = s.strongest(at, tol)
            here = s.segment(at) == seg
            error = np.where(hit >= 0, s.mz[hit] - at, 0.0) if len(s.mz) else np.zeros(len(at))
            bins = np.clip(half_away(error * m.error_scale), -m.error_scale, m.error_scale).astype(int) + m.error_scale
            for ok, h, b in zip(here.tolist(), hit.tolist(), bins.tolist(), strict=True):
                if ok:
                    yield part, (kind, z, offset), int(s.rank[h]) if h >= 0 else 0, b if h >= 0 else None


def count_facts(s: ScoredSpectrum, masses: np.ndarray) -> dict[tuple, int]:
    """Histogram entries of one match; noise is the reversed peptide through the same matcher."""
    out: dict[tuple, int] = {}

    def bump(kind: str, part: Part | None, ion, b: int) -> None:
        key = (kind, *(part or (0, 0, 0.0)), *(ion or ("", 0, 0.0)), b)
        out[key] = out.get(key, 0) + 1

    top = s.model.max_rank
    slot = lambda r: top if r == 0 else min(max(r, 1), top) - 1
    for part, ion, rank, b in _facts(s, masses):
        bump("rank", part, ion, slot(rank))
        if rank and b is not None:
            bump("error", part, None, b)
    for part, _, rank, b in _facts(s, masses[::-1]):
        bump("rank", part, NOISE, slot(rank))
        if rank and b is not None:
            bump("noise_error", part, None, b)
    if s.edge_part and len(masses) > 1:
        for pattern in s.edge_facts(masses)[0].tolist():
            bump("existence", s.edge_part, None, int(pattern))
    bump("charge", None, None, s.charge)
    return out


def counted(psms: DataFrame, spectra: DataFrame, model: Model) -> DataFrame:
    """COUNTS of psms (spectrum_idx, charge, residues), partly summed in each task."""
    held = psms.sparkSession.sparkContext.broadcast(model)
    joined = psms.select("spectrum_idx", "charge", "residues").join(spectra.select("spectrum_idx", "precursor_mz", "peaks"), "spectrum_idx")

    def run(batches):
        total: dict[tuple, int] = {}

        def out():
            rows = [dict(zip((*COUNT_KEYS, "n"), (*k, v), strict=True)) for k, v in total.items()]
            total.clear()
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("kind", pa.string()), ("charge", pa.int32()), ("seg", pa.int32()), ("mass", pa.float32()), ("ion_kind", pa.string()), ("ion_charge", pa.int32()), ("ion_offset", pa.float32()), ("bin", pa.int32()), ("n", pa.int64())]))

        for batch in batches:
            for r in batch.to_pylist():
                s = ScoredSpectrum(*_peaks(r), r["precursor_mz"], r["charge"], held.value)
                for k, v in count_facts(s, _masses(r["residues"])).items():
                    total[k] = total.get(k, 0) + v
            if len(total) > 100_000:
                yield out()
        if total:
            yield out()

    return merge(joined.mapInArrow(run, COUNTS))


def merge(*counts: DataFrame) -> DataFrame:
    """Sum of counts."""
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy(*COUNT_KEYS).agg(F.sum("n").alias("n")).where("n > 0")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """a - b, at least 0."""
    minus = b.withColumn("n", -F.col("n"))
    return a.unionByName(minus).groupBy(*COUNT_KEYS).agg(F.sum("n").alias("n")).where("n > 0")


def scale(counts: DataFrame, weight) -> DataFrame:
    """Each bin times a weight, rounded."""
    return counts.withColumn("n", F.round(F.col("n") * weight).cast("long")).where("n > 0")


def combined(counts: DataFrame, sources: DataFrame) -> DataFrame:
    """counts (source_id, COUNTS) summed with the weights of sources (source_id, weight), each bin rounded first."""
    out = counts.join(sources.select("source_id", "weight"), "source_id")
    return merge(out.withColumn("n", F.round(F.col("n") * F.col("weight")).cast("long")).drop("weight", "source_id"))


def backoff_levels(counts: DataFrame) -> DataFrame:
    """Rank counts at three levels: partition (0), its segments together (1), everywhere (2)."""
    sets = "((charge, mass, seg, ion_kind, ion_charge, ion_offset, bin), (charge, mass, ion_kind, ion_charge, ion_offset, bin), (ion_kind, ion_charge, ion_offset, bin))"
    return counts.sparkSession.sql(f"SELECT charge, mass, seg, ion_kind, ion_charge, ion_offset, bin, sum(n) AS n, CASE WHEN grouping(charge) = 1 THEN 2 WHEN grouping(seg) = 1 THEN 1 ELSE 0 END AS level FROM {{df}} WHERE kind = 'rank' GROUP BY GROUPING SETS {sets}", df=counts)


def laplace(raw: np.ndarray, pseudo: float) -> np.ndarray:
    return ((raw + pseudo) / (raw.sum() + len(raw) * pseudo)).astype(np.float32)


def blend(own: np.ndarray, above: np.ndarray, n: float, weight: float) -> np.ndarray:
    return ((n * own + weight * above) / (n + weight)).astype(np.float32)


def smooth(dist: np.ndarray) -> np.ndarray:
    """Means over windows that widen with rank (half widths 0 to 5 from ranks 3, 5, 10, 20 and 50); the last slot stays."""
    n = len(dist) - 1
    out = dist.astype(float).copy()
    for i in range(3, n):
        half = 1 if i < 5 else 2 if i < 10 else 3 if i < 20 else 4 if i < 50 else 5
        out[i] = dist[max(0, i - half) : min(n, i + half + 1)].mean()
    return (out / out.sum()).astype(np.float32) if out.sum() > 0 else dist


def estimate(counts: DataFrame, template: Model, options: EstimateOptions = EstimateOptions(), prior: Model | None = None) -> Model:
    """A model with the template's structure and the counts' distributions.

    A table with fewer than min_count counts is drawn to its parent: the prior's
    table, else its partition's segments together if they have as many, else
    all partitions.  The counts of one model are few and come to the driver;
    their number is bounded by the template's tables.
    """
    o = options
    levels: dict[tuple, dict[int, int]] = {}
    for r in backoff_levels(counts).toLocalIterator():
        place = (r.level, *((r.charge, r.seg, r.mass) if r.level == 0 else (r.charge, r.mass) if r.level == 1 else ()), (r.ion_kind, r.ion_charge, r.ion_offset))
        levels.setdefault(place, {})[r.bin] = r.n
    other: dict[tuple, dict[int, int]] = {}
    for r in counts.where("kind <> 'rank'").toLocalIterator():
        other.setdefault((r.kind, (r.charge, r.seg, r.mass)), {})[r.bin] = r.n

    def dense(bins: dict[int, int] | None, size: int) -> np.ndarray:
        out = np.zeros(size)
        for b, n in (bins or {}).items():
            if 0 <= b < size:
                out[b] += n
        return out

    slots = template.max_rank + 1
    ranks = {}
    for part, frags in template.fragments.items():
        if not frags:
            continue
        table = {}
        for ion in [*(i for i, _ in frags), NOISE]:
            pseudo = o.noise_pseudo if ion == NOISE else o.pseudo
            raw = dense(levels.get((0, *part, ion)), slots)
            dist = laplace(raw, pseudo)
            if raw.sum() < o.min_count:
                known = prior.ranks.get(part, {}).get(ion) if prior else None
                if known is not None and len(known) == slots:
                    above = known
                else:
                    wide = dense(levels.get((1, part[0], part[2], ion)), slots)
                    above = laplace(wide if wide.sum() >= o.min_count else dense(levels.get((2, ion)), slots), pseudo)
                dist = blend(dist, above, raw.sum(), o.backoff)
            table[ion] = smooth(dist) if o.smooth and ion != NOISE else dist
        ranks[part] = table

    def backed(kind: str, size: int, pseudo: float, attr: str) -> dict[Part, np.ndarray]:
        whole = sum((dense(v, size) for (k, _), v in other.items() if k == kind), np.zeros(size))
        out = {}
        for part in template.partitions:
            raw = dense(other.get((kind, part)), size)
            dist = laplace(raw, pseudo)
            if raw.sum() < o.min_count:
                known = getattr(prior, attr).get(part) if prior else None
                dist = blend(dist, known if known is not None and len(known) == size else laplace(whole, pseudo), raw.sum(), o.backoff)
            out[part] = dist
        return out

    new = replace(template, ranks=ranks)
    if template.error_scale > 0:
        size = 2 * template.error_scale + 1
        new.ion_errors, new.noise_errors = backed("error", size, o.pseudo, "ion_errors"), backed("noise_error", size, o.noise_pseudo, "noise_errors")
        new.existence = backed("existence", 4, o.pseudo, "existence")
    charges = other.get(("charge", (0, 0, 0.0)), {})
    new.charge_hist = sorted(charges.items()) or template.charge_hist
    return new


def labelled(psms: DataFrame, fdr: float = 0.01) -> DataFrame:
    """Targets among the best matches of their spectra whose q-value is at most fdr."""
    return q_values(best_per_spectrum(psms), "rank_score", "is_decoy").where(~F.col("is_decoy") & (F.col("q") <= fdr))


def accept(current: int, candidate: int, force: bool = False, validate: bool = True) -> bool:
    """Whether a candidate model replaces the current one: it finds as many targets, or nothing was asked."""
    return force or not validate or candidate >= current


def flat_peptides(rows: DataFrame) -> DataFrame:
    """Training rows (seq, charge, prec_mz, res_mod_pos, res_mod_delta, nterm_delta, cterm_delta, mz, intensity) as spectra with residues.

    Terminal deltas go onto the end residues; positions count from 0.  Rows with
    another letter than the residues, arrays of unequal length or a position outside are left out.
    """
    pairs = F.arrays_zip(F.col("mz").alias("mz"), F.col("intensity").alias("intensity"))
    mass = F.create_map(*[F.lit(x) for r, m in RESIDUE_MASS.items() for x in (r, m)])
    n = F.length("seq")
    pos, delta = F.coalesce("res_mod_pos", F.array().cast("array<int>")), F.coalesce("res_mod_delta", F.array().cast("array<double>"))
    ok = n.isNotNull() & (n > 0) & ~F.col("seq").rlike(f"[^{''.join(RESIDUE_MASS)}]") & (F.size("mz") == F.size("intensity")) & (F.size(pos) == F.size(delta)) & ~F.exists(pos, lambda p: (p < 0) | (p >= n))

    def residue(i):
        mods = F.aggregate(F.filter(F.arrays_zip(pos.alias("p"), delta.alias("d")), lambda x: x["p"] == i - 1), F.lit(0.0), lambda a, x: a + x["d"])
        mods = mods + F.when(i == 1, F.coalesce("nterm_delta", F.lit(0.0))).otherwise(0.0) + F.when(i == n, F.coalesce("cterm_delta", F.lit(0.0))).otherwise(0.0)
        letter = F.substring("seq", i, F.lit(1))
        return F.struct(letter.alias("residue"), F.element_at(mass, letter).alias("mass"), F.when(mods != 0, mods).alias("mod_delta"), F.lit(False).alias("mod_fixed"))

    out = rows.where(ok).withColumn("residues", F.transform(F.sequence(F.lit(1), n), residue))
    peaks = F.array_sort(F.transform(pairs, lambda p: F.struct(p["mz"].cast("double").alias("mz"), p["intensity"].cast("float").alias("intensity"))))
    return out.withColumn("peaks", peaks).withColumn("precursor_mz", F.col("prec_mz")).withColumn("spectrum_idx", F.monotonically_increasing_id())
