"""Masses, enzymes and tolerances, as constants and as column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from math import log

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Atomic and particle masses in Da.
H, C12, N14, O16, S32 = 1.007825035, 12.0, 14.003074, 15.99491463, 31.9720707
PROTON, C13 = 1.00727649, 13.00335483
H2O, ISOTOPE = 2 * H + O16, C13 - C12
SCALER = 0.999497

# Atoms C, H, N, O, S of each residue.
COMPOSITION = {
    "G": (2, 3, 1, 1, 0), "A": (3, 5, 1, 1, 0), "S": (3, 5, 1, 2, 0), "P": (5, 7, 1, 1, 0), "V": (5, 9, 1, 1, 0),
    "T": (4, 7, 1, 2, 0), "C": (3, 5, 1, 1, 1), "L": (6, 11, 1, 1, 0), "I": (6, 11, 1, 1, 0), "N": (4, 6, 2, 2, 0),
    "D": (4, 5, 1, 3, 0), "Q": (5, 8, 2, 2, 0), "K": (6, 12, 2, 1, 0), "E": (5, 7, 1, 3, 0), "M": (5, 9, 1, 1, 1),
    "H": (6, 7, 3, 1, 0), "F": (9, 9, 1, 1, 0), "R": (6, 12, 4, 1, 0), "Y": (9, 9, 1, 2, 0), "W": (11, 10, 2, 1, 0),
}
RESIDUE_MASS = {r: c * C12 + h * H + n * N14 + o * O16 + s * S32 for r, (c, h, n, o, s) in COMPOSITION.items()}
RESIDUES = "".join(COMPOSITION)


@dataclass(frozen=True)
class Enzyme:
    """Cleaves after residues of `after` or before those of `before`; `any`: at every bond."""

    name: str
    after: str = ""
    before: str = ""
    any: bool = False
    aliases: tuple[str, ...] = ()

    @property
    def n_terminal(self) -> bool:
        return bool(self.before)

    @property
    def residues(self) -> str:
        return self.after or self.before

    def cleavable_after(self, residue: Column) -> Column:
        return F.lit(True) if self.any else residue.isin(*self.after) if self.after else F.lit(False)

    def cleavable_before(self, residue: Column) -> Column:
        return F.lit(True) if self.any else residue.isin(*self.before) if self.before else F.lit(False)


# Cleavage rules.
ENZYMES = {
    e.name: e
    for e in (
        Enzyme("Trypsin", after="KR"),
        Enzyme("Chymotrypsin", after="FYWL"),
        Enzyme("LysC", after="K"),
        Enzyme("AspN", before="D"),
        Enzyme("GluC", after="E"),
        Enzyme("LysN", before="K"),
        Enzyme("ArgC", after="R"),
        Enzyme("aLP", any=True),
        Enzyme("NoCleavage"),
        Enzyme("NonSpecific", any=True),
    )
}
TRYPSIN = ENZYMES["Trypsin"]


def cleavage_credit(enzyme: Enzyme, peptide_efficiency: float = 0.95, neighbour_efficiency: float = 0.95) -> dict[str, int]:
    """Integer log ratios of a cleaved or uncleaved end against chance, for the peptide's own end and its neighbour's."""
    if enzyme.any or not enzyme.residues:
        return {"peptide_credit": 0, "peptide_penalty": 0, "neighbour_credit": 0, "neighbour_penalty": 0}
    p = 0.05 * len(enzyme.residues)
    half_away = lambda x: int(np.sign(x) * np.floor(abs(x) + 0.5))
    out = {}
    for name, eff in (("peptide", peptide_efficiency), ("neighbour", neighbour_efficiency)):
        out[f"{name}_credit"] = half_away(log(eff / p))
        out[f"{name}_penalty"] = half_away(log((1 - eff) / (1 - p)))
    return out


def cleavage_score(pre: Column, first: Column, last: Column, post: Column, enzyme: Enzyme) -> Column:
    """Credit or penalty of both ends of a peptide: its own cleavable residue, and that of its neighbour.

    An end at the protein's end (`_` before, `-` after) has the credit.
    """
    if enzyme.any or not enzyme.residues:
        return F.lit(0)
    c = cleavage_credit(enzyme)
    inner, outer, edge_inner, edge_outer = (first, post, pre == "_", post == "-") if enzyme.n_terminal else (last, pre, post == "-", pre == "_")
    own = F.when(edge_inner | inner.isin(*enzyme.residues), c["peptide_credit"]).otherwise(c["peptide_penalty"])
    near = F.when(edge_outer | outer.isin(*enzyme.residues), c["neighbour_credit"]).otherwise(c["neighbour_penalty"])
    return own + near


def _boundary(before: Column, after: Column, enzyme: Enzyme) -> Column:
    if enzyme.any or not enzyme.residues:
        return F.lit(enzyme.any)
    if enzyme.n_terminal:
        return after.isin(*enzyme.residues)
    rule = before.isin(*enzyme.residues)
    return rule & (after != "P") if enzyme.name == "Trypsin" else rule


def enzymatic_boundary(before: Column, after: Column, enzyme: Enzyme) -> Column:
    """Whether a bond is one the enzyme cleaves, for the report: trypsin not before P; protein ends always."""
    if enzyme.any:
        return F.lit(True)
    return before.isin("-", "_") | after.isin("-", "_") | _boundary(before, after, enzyme)


def internal_boundaries(sequence: Column, enzyme: Enzyme) -> Column:
    """Bonds inside a sequence that the enzyme cleaves."""
    at = F.sequence(F.lit(1), F.greatest(F.length(sequence) - 1, F.lit(1)))
    inside = F.filter(at, lambda i: _boundary(F.substring(sequence, i, F.lit(1)), F.substring(sequence, i + 1, F.lit(1)), enzyme))
    return F.when(F.length(sequence) < 2, 0).otherwise(F.size(inside))


def residue_mass(residue: Column) -> Column:
    """Monoisotopic mass of a one-letter residue; null for another letter."""
    return F.element_at(F.create_map(*[F.lit(x) for r, m in RESIDUE_MASS.items() for x in (r, m)]), residue)


def sequence_mass(sequence: Column) -> Column:
    """Mass of an unmodified sequence's residues, added from the left."""
    letters = F.filter(F.split(sequence, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0.0), lambda acc, c: acc + residue_mass(c))


def nominal(mass: Column) -> Column:
    """Nominal mass: the scaled mass as FLOAT, rounded half away from zero."""
    return F.round(F.lit(SCALER).cast("float") * mass.cast("float")).cast("int")


def nominal_of(mass: np.ndarray | float) -> np.ndarray:
    """nominal() on numpy values."""
    x = np.float32(SCALER) * np.asarray(mass, np.float32)
    return (np.sign(x) * np.floor(np.abs(x) + np.float32(0.5))).astype(np.int32)


#: The scale of nominal masses as a double: the value of the single-precision constant.
SCALER64 = float(np.float32(SCALER))


@dataclass(frozen=True)
class Tolerance:
    value: float
    unit: str = "ppm"

    @classmethod
    def parse(cls, text: str) -> Tolerance:
        """`20ppm`, `20 ppm`, `0.5Da`; a bare number is ppm."""
        low = text.strip().lower()
        unit = "Da" if low.endswith("da") else "ppm"
        return cls(float(low.removesuffix("ppm").removesuffix("da").strip()), unit)

    @property
    def is_ppm(self) -> bool:
        return self.unit == "ppm"

    def as_da(self, mass):
        """Width in Da at a mass: a column, an array or a number."""
        return mass * self.value * 1e-6 if self.is_ppm else mass * 0 + self.value


@dataclass(frozen=True)
class PrecursorTolerance:
    left: Tolerance = Tolerance(20.0)
    right: Tolerance = Tolerance(20.0)


def ppm_residual(observed, theoretical):
    return (observed - theoretical) / theoretical * 1e6


def neutral_mass(mz, charge):
    """Neutral mass of a charged precursor."""
    return mz * charge - charge * PROTON


def calibrated(mass, shift_ppm: float):
    """Mass freed of a systematic shift; itself without one."""
    return mass if shift_ppm == 0.0 else mass * (1.0 - shift_ppm * 1e-6)


def ion_mz(node: Column | np.ndarray, charge, offset):
    """m/z at which a nominal node mass shows as an ion."""
    return node / SCALER64 / charge + offset


def ion_node_mass(mz, charge, offset):
    """Inverse of ion_mz, in exact mass units of nodes."""
    return (mz - offset) * charge


def segment(mz: Column, parent: Column, segments: int) -> Column:
    """Part of the m/z range that a peak lies in."""
    part = F.when(parent > 0, F.least(F.greatest((mz / parent * segments).cast("int"), F.lit(0)), F.lit(segments - 1))).otherwise(0)
    return part if segments > 0 else F.lit(0)


def averagine(mass: Column, n: int) -> Column:
    """Isotope envelope of an average peptide: Poisson with rate 4.76e-4 per Da, scaled to one."""
    rate = mass * 4.76e-4
    raw = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.exp(-rate) * F.pow(rate, k) / F.factorial(k))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: F.try_divide(x, total))


def averagine_of(mass: float, n: int) -> np.ndarray:
    from math import factorial

    rate = mass * 4.76e-4
    raw = np.array([np.exp(-rate) * rate**k / factorial(k) for k in range(n)])
    return raw / raw.sum() if raw.sum() > 0 else raw


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, from 0 to 1; 0 if a norm is 0 or the lengths differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    value = F.try_divide(dot, norm(a) * norm(b))
    return F.when(F.size(a) == F.size(b), F.least(F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def position_bin(index: Column, length: Column) -> Column:
    return F.when(length > 0, F.least(F.greatest(F.round(10.0 * index / length), F.lit(0)), F.lit(10))).otherwise(0).cast("int")


def flanks(sequence: Column, kind: Column, index: Column) -> Column:
    """Residues on both sides of a fragment's bond, as one string of two; null outside the sequence."""
    n = F.length(sequence)
    left = F.when(kind == "b", index).otherwise(n - index)
    return F.when((index >= 1) & (index < n), F.substring(sequence, left, F.lit(2)))
