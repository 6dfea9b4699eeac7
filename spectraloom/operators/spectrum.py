"""One spectrum under a model: ranks, deconvolution, node and edge scores, fragment features.

Pure functions of arrays, for use inside Arrow functions.
"""

from __future__ import annotations

import numpy as np

from ..functions.chem import H2O, ISOTOPE, PROTON, SCALER64, nominal_of
from ..functions.names import HIGH_RESOLUTION
from .model import Model

# Fixed values of fragment features.
WATER_LOSS, AMMONIA_LOSS, PPM_SIGMA, DENSITY_HALF, TOP_ERRORS = 18.0106, 17.0265, 7.0, 50.0, 7
#: Width and count of the peak filter of isobaric labels.
WINDOW, PER_WINDOW = 100.0, 20
C14_C13 = 0.99988617
UNRANKED = 0


def half_away(x):
    x = np.asarray(x)
    return np.sign(x) * np.floor(np.abs(x) + x.dtype.type(0.5))


def deconvolute(mz: np.ndarray, intensity: np.ndarray, rank: np.ndarray, charge: int, tol: float):
    """Peaks with isotope pairs of fragment charges 2 and 3 moved to charge 1; their ranks stay with them."""
    gone = np.zeros(len(mz), bool)
    out = []
    for i in range(len(mz)):
        if gone[i]:
            continue
        here = mz[i]
        for z in range(2, min(charge, 4)):
            single = lambda m, z=z: z * m - (z - 1) * PROTON
            j = _within(mz, i + 1, here + ISOTOPE / z, tol)
            if j is None:
                continue
            gone[j] = True
            k = _within(mz, j + 1, mz[j] + C14_C13 / z, tol)
            if k is not None:
                gone[k] = True
                out.append((single(mz[k]), intensity[k], rank[k]))
            out.append((single(mz[j]), intensity[j], rank[j]))
            here = single(here)
            break
        out.append((here, intensity[i], rank[i]))
    out.sort(key=lambda p: p[0])
    m, i, r = zip(*out, strict=True) if out else ((), (), ())
    return np.array(m, float), np.array(i, np.float32), np.array(r, np.int64)


def _within(mz: np.ndarray, start: int, target: float, tol: float) -> int | None:
    """The first peak from start strictly within tol of target."""
    i = start + int(np.searchsorted(mz[start:], target - tol, "right"))
    return i if i < len(mz) and mz[i] - target < tol else None


class ScoredSpectrum:
    def __init__(self, mz: np.ndarray, intensity: np.ndarray, precursor_mz: float, charge: int, model: Model, window: tuple[float, int] | None = None):
        self.raw_mz, self.charge, self.model = np.asarray(mz, float), charge, model
        intensity = np.asarray(intensity, np.float32)
        self.parent = (precursor_mz - PROTON) * charge
        keep = np.ones(len(mz), bool)
        for reduced, offset, tol, _ in model.precursor_offsets.get(charge, []):
            c = charge - reduced
            if c > 0:
                at = (self.parent + c * PROTON) / c + offset
                keep &= np.abs(self.raw_mz - at) > tol.as_da(at)
        if window is None and model.protocol in ("TMT", "iTRAQ", "iTRAQPhospho"):
            window = (WINDOW, PER_WINDOW)
        if window and window[0] > 0 and window[1] > 0:
            at = np.flatnonzero(keep)
            bins = np.floor(self.raw_mz[at] / window[0])
            order = np.lexsort((at, -intensity[at], bins))
            b = bins[order]
            start = np.searchsorted(b, b, "left")
            keep[at[order][np.arange(len(b)) - start >= window[1]]] = False
        kept = np.flatnonzero(keep)
        self.total_intensity = float(intensity[kept].astype(float).sum())
        rank = np.zeros(len(mz), np.int64)
        order = np.lexsort((self.raw_mz[kept], -intensity[kept]))
        rank[kept[order]] = np.arange(1, len(kept) + 1)
        self.mz, self.intensity, self.rank = self.raw_mz, intensity, rank
        count = len(kept)
        if model.deconvolute:
            self.mz, self.intensity, self.rank = deconvolute(self.raw_mz, intensity, rank, charge, model.deconvolution_tolerance)
            count = len(self.mz)
        width = model.mme.value * 2
        bins = self.parent / width if width > 0 else 1.0
        self.peak_chance = float(np.float32(max(count, 1) / max(bins, 1.0)))
        self._strength()
        self.parts = [model.partition(charge, self.parent, s) for s in range(max(model.segments, 0))]
        self.ratios = [model.log_ratios(p) if p else [] for p in self.parts]
        last = model.partition(charge, self.parent, max(model.segments - 1, 0))
        self.edge_part = self.parts[-1] if self.parts else last
        self.main_ion = model.main_ion(last)
        self._nodes: dict[bool, np.ndarray] = {}
        self._edges: tuple[np.ndarray, np.ndarray] | None = None

    def _strength(self) -> None:
        """Least place by strength in every run of 2**k peaks, so that any window's strongest peak takes two looks."""
        n = len(self.mz)
        place = np.full(n, n, np.int64)
        ranked = np.flatnonzero(self.rank != UNRANKED)
        self.by_place = ranked[np.lexsort((ranked, -self.intensity[ranked]))]
        place[self.by_place] = np.arange(len(ranked))
        self.runs = [place]
        k = 1
        while 2 * k <= n:
            a = self.runs[-1]
            self.runs.append(np.minimum(a[:-k], a[k:]))
            k *= 2

    def strongest(self, target: np.ndarray, tol: np.ndarray) -> np.ndarray:
        """Index of the strongest ranked peak within tol of each target, -1 for none."""
        target = np.asarray(target, float)
        lo = np.searchsorted(self.mz, target - tol, "left")
        hi = np.searchsorted(self.mz, target + tol, "right")
        out = np.full(len(target), -1, np.int64)
        some = np.flatnonzero(hi > lo)
        if not len(some):
            return out
        a, b = lo[some], hi[some]
        k = np.floor(np.log2(b - a)).astype(int)
        best = np.empty(len(some), np.int64)
        for level in np.unique(k):
            at = k == level
            run = self.runs[level]
            best[at] = np.minimum(run[a[at]], run[b[at] - (1 << int(level))])
        hit = best < len(self.by_place)
        out[some[hit]] = self.by_place[best[hit]]
        return out

    def segment(self, mz: np.ndarray) -> np.ndarray:
        n = self.model.segments
        if self.parent <= 0 or n <= 0:
            return np.zeros(len(mz), int)
        return np.clip((mz / self.parent * n).astype(int), 0, n - 1)

    def node_scores(self, nodes: np.ndarray, prefix: bool) -> np.ndarray:
        """Summed log ratios of the ions of nominal node masses in one direction, in single precision."""
        total = np.zeros(len(nodes), np.float32)
        for seg, ratios in enumerate(self.ratios):
            for (kind, z, offset), table in ratios:
                if (kind == "prefix") != prefix:
                    continue
                mz = nodes / SCALER64 / z + offset
                here = self.segment(mz) == seg
                hit = self.strongest(mz, self.model.mme.as_da(mz))
                rank = np.where(hit >= 0, self.rank[hit], 0)
                slot = np.where(rank > 0, np.clip(rank, 1, self.model.max_rank) - 1, self.model.max_rank)
                score = np.where(slot < len(table), table[np.minimum(slot, len(table) - 1)], np.float32(0))
                total = np.where(here, total + score, total).astype(np.float32)
        return total

    def nodes(self, masses: np.ndarray, prefix: bool) -> np.ndarray:
        """node_scores from a table over all masses up to the parent, made on first use."""
        if prefix not in self._nodes:
            self._nodes[prefix] = self.node_scores(np.arange(max(int(nominal_of(self.parent)), 0) + 1, dtype=float), prefix)
        table = self._nodes[prefix]
        inside = (masses >= 1) & (masses < len(table))
        out = np.zeros(len(masses), np.float32)
        out[inside] = table[masses[inside]]
        if (~inside).any():
            out[~inside] = self.node_scores(masses[~inside].astype(float), prefix)
        return out

    def raw_score(self, masses: np.ndarray) -> float:
        """Sum over splits of the rounded prefix and suffix scores; masses: of the residues."""
        if self.charge == 0 or len(masses) < 2:
            return 0.0
        heads = nominal_of(np.cumsum(masses)[:-1])
        whole = int(nominal_of(float(np.cumsum(masses)[-1])))
        return float(half_away(self.nodes(heads, True) + self.nodes(whole - heads, False)).sum())

    def edge_facts(self, masses: np.ndarray):
        """(pattern, error or NaN) of each step along the main ion's series."""
        sums = np.concatenate([[0.0], np.cumsum(masses)])
        nominals = nominal_of(sums)
        n = len(masses)
        kind, z, offset = self.main_ion
        if kind == "prefix":
            at = np.arange(1, n)
            cur, prev, theory = nominals[at], nominals[at - 1], sums[at] - sums[at - 1]
        else:
            at = np.arange(n - 1, 0, -1)
            cur, prev, theory = nominals[n] - nominals[at], nominals[n] - nominals[at + 1], sums[at + 1] - sums[at]
        a, b = self.observed(cur), self.observed(prev)
        pattern = (~np.isnan(a)).astype(int) + 2 * (~np.isnan(b)).astype(int)
        return pattern, a - b - theory

    def observed(self, nodes: np.ndarray) -> np.ndarray:
        """Mass at which the main ion of each node is seen, NaN for none; node 0 is seen at 0."""
        kind, z, offset = self.main_ion
        mz = nodes / SCALER64 / z + offset
        hit = self.strongest(mz, self.model.mme.as_da(mz))
        seen = np.where(hit >= 0, (self.mz[hit] - offset) * z if len(self.mz) else np.nan, np.nan)
        return np.where(nodes == 0, 0.0, seen)

    def edge_score(self, masses: np.ndarray) -> int:
        m = self.model
        if self.charge == 0 or len(masses) < 2 or m.error_scale == 0 or not m.existence:
            return 0
        total = 0
        for pattern, error in zip(*self.edge_facts(masses), strict=True):
            s = m.existence_score(self.edge_part, int(pattern), self.peak_chance)
            if pattern == 3:
                s += m.error_score(self.edge_part, float(error))
            total += int(np.clip(np.nan_to_num(half_away(np.float64(np.float32(s))), nan=0.0), -(2**31), 2**31 - 1))
        return total

    def scores(self, values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """raw_score and edge_score of many peptides at once: residue masses laid end to end."""
        n = np.diff(off)
        raw, edge = np.zeros(len(n)), np.zeros(len(n), np.int64)
        if self.charge == 0 or not len(n) or n.max() < 2:
            return raw, edge
        wide = int(n.max())
        col = np.arange(wide)
        inside = col < n[:, None]
        at = np.where(inside, off[:-1, None] + col, 0)
        sums = np.cumsum(np.where(inside, values[at], 0.0), 1)  # from the left, as for one peptide
        split = col[:-1] < n[:, None] - 1
        heads, whole = nominal_of(sums[:, :-1]), nominal_of(sums[np.arange(len(n)), np.maximum(n - 1, 0)])
        score = np.zeros(split.shape, np.float32)
        score[split] = half_away(self.nodes(heads[split], True) + self.nodes((whole[:, None] - heads)[split], False))
        raw = score.sum(1).astype(float)
        m = self.model
        if m.error_scale == 0 or not m.existence:
            return raw, edge
        full = np.concatenate([np.zeros((len(n), 1)), sums], 1)
        nominals = nominal_of(full)
        r, c = np.nonzero(split)
        if self.main_ion[0] == "prefix":
            cur, prev, theory = nominals[r, c + 1], nominals[r, c], full[r, c + 1] - full[r, c]
        else:
            end = nominals[r, n[r]]
            cur, prev, theory = end - nominals[r, c + 1], end - nominals[r, c + 2], full[r, c + 2] - full[r, c + 1]
        a, b = self.observed(cur), self.observed(prev)
        pattern = (~np.isnan(a)).astype(int) + 2 * (~np.isnan(b)).astype(int)
        if self._edges is None:
            scale = m.error_scale
            self._edges = np.array([m.existence_score(self.edge_part, k, self.peak_chance) for k in range(4)]), np.array([m.error_score(self.edge_part, (k - scale) / scale) for k in range(2 * scale + 1)])
        existence, errors = self._edges
        s = existence[pattern].astype(float)
        both = pattern == 3
        x = (a - b - theory)[both].astype(np.float32) * np.float32(m.error_scale)
        s[both] += errors[(np.clip(half_away(x), -m.error_scale, m.error_scale) + m.error_scale).astype(int)]
        step = np.clip(np.nan_to_num(half_away(s.astype(np.float32).astype(float)), nan=0.0), -(2**31), 2**31 - 1).astype(np.int64)
        return raw, np.bincount(r, step, len(n)).astype(np.int64)

    def density(self, mz: np.ndarray) -> np.ndarray:
        """Peaks per Da around each m/z, of the peaks as they were read."""
        return (np.searchsorted(self.raw_mz, mz + DENSITY_HALF, "right") - np.searchsorted(self.raw_mz, mz - DENSITY_HALF, "left")) / (2 * DENSITY_HALF)


def by_ions(masses: np.ndarray, charge: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(m/z, is_b, position) of the b and y fragments of one charge: b then y at each position."""
    heads = np.cumsum(masses)[:-1]
    tails = np.cumsum(masses[::-1])[:-1]
    mz = np.stack([(heads + charge * PROTON) / charge, (tails + H2O + charge * PROTON) / charge], 1).ravel()
    n = len(heads)
    return mz, np.tile([True, False], n), np.repeat(np.arange(1, n + 1), 2)


def longest_run(flags: np.ndarray) -> int:
    padded = np.concatenate([[False], flags, [False]])
    change = np.flatnonzero(padded[1:] != padded[:-1])
    return int((change[1::2] - change[::2]).max(initial=0))


FEATURES = (
    ("num_matched", "int"), ("longest_b", "int"), ("longest_y", "int"), ("longest_y_pct", "float"), ("matched_ion_ratio", "float"),
    ("explained_ratio", "float"), ("n_term_ratio", "float"), ("c_term_ratio", "float"), ("ms2_current", "float"), ("isolation_efficiency", "float"),
    ("mean_error7", "float"), ("stdev_error7", "float"), ("mean_rel_error7", "float"), ("stdev_rel_error7", "float"), ("edge_score", "int"),
    ("precursor_kl", "float"), ("precursor_snr", "float"), ("ppm_gaussian", "float"), ("ladder", "int"), ("neutral_losses", "int"),
    ("mean_rank", "float"), ("doubly_charged", "int"), ("surprise", "float"), ("unique_fraction", "float"), ("intensity_signal", "float"), ("competition", "float"),
)


def features(s: ScoredSpectrum, sequence: str, masses: np.ndarray, intensity_model=None) -> dict:
    """Fragment features of a peptide, those of FEATURES; zeros for fewer than two residues."""
    out = {name: 0 for name, _ in FEATURES}
    n = len(masses)
    if n < 2:
        return out
    ppm = s.model.instrument in HIGH_RESOLUTION
    width = (lambda mz: mz * 20e-6) if ppm else (lambda mz: np.full(np.shape(mz), 0.5))
    mz, is_b, position = by_ions(masses, 1)
    hit = s.strongest(mz, width(mz))
    found = hit >= 0
    obs, pred, peak = s.mz[hit[found]], mz[found], s.intensity[hit[found]].astype(float)
    losses = (s.strongest(pred - WATER_LOSS, width(pred)) >= 0) | (s.strongest(pred - AMMONIA_LOSS, width(pred)) >= 0)
    double, _, _ = by_ions(masses, 2)
    out["num_matched"] = matched = int(found.sum())
    out["neutral_losses"] = int(losses.sum())
    out["doubly_charged"] = int((s.strongest(double, width(double)) >= 0).sum())

    # ions of the model at exact residue sums
    any_b, any_y = np.zeros(n - 1, bool), np.zeros(n - 1, bool)
    current = {True: 0.0, False: 0.0}
    heads, tails = np.cumsum(masses)[:-1], np.cumsum(masses[::-1])[:-1]
    for seg, part in enumerate(s.parts):
        for (kind, z, offset), _ in s.model.fragments.get(part, []):
            prefix = kind == "prefix"
            at = (heads if prefix else tails) / z + offset
            peaks = s.strongest(at, width(at))
            ok = (s.segment(at) == seg) & (peaks >= 0)
            current[prefix] += float(s.intensity[peaks[ok]].astype(float).sum())
            (any_b if prefix else any_y)[ok] = True
    out["longest_b"], out["longest_y"] = longest_run(any_b), longest_run(any_y)
    out["ladder"] = longest_run(any_b & any_y[::-1])
    out["longest_y_pct"], out["matched_ion_ratio"] = out["longest_y"] / n, matched / n
    total = s.total_intensity
    if total > 0:
        out["explained_ratio"], out["n_term_ratio"], out["c_term_ratio"], out["ms2_current"] = (current[True] + current[False]) / total, current[True] / total, current[False] / total, total

    if matched:
        error = (obs - pred) / pred * 1e6
        top = error[np.argsort(-peak, kind="stable")[:TOP_ERRORS]]
        for values, mean, dev in ((np.abs(top), "mean_error7", "stdev_error7"), (top, "mean_rel_error7", "stdev_rel_error7")):
            out[mean] = float(values.mean())
            out[dev] = float(np.sqrt(max((values * values).mean() - values.mean() ** 2, 0.0)))
        out["ppm_gaussian"] = float(np.exp(-0.5 * (error / PPM_SIGMA) ** 2).sum())
        density = s.density(obs)
        chance = density * 2 * width(pred)
        out["surprise"] = float(np.maximum(-np.log(np.where(chance > 0, chance, 1.0)), 0.0).sum())
        out["mean_rank"] = float(np.float32(s.rank[hit[found]].astype(np.float32).sum() / np.float32(matched)))
        theory = np.concatenate([mz, mz - WATER_LOSS, mz - AMMONIA_LOSS])
        near = (np.abs(theory[None] - obs[:, None]) <= np.reshape(width(obs), (-1, 1))) & (np.abs(theory[None] - pred[:, None]) > 1e-9)
        others = near.sum(1)
        out["unique_fraction"] = float((1 / (1 + others)).sum() / matched)
        out["competition"] = float((1 / (1 + others + density)).sum())
    out["edge_score"] = s.edge_score(masses)
    if intensity_model is not None:
        out["intensity_signal"] = intensity_model.signal(s, sequence, mz, is_b, position, width)
    return out
