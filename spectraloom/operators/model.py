"""Scoring models: their tables, lookups, binary form and DataFrames."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from math import log

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.chem import ENZYMES, Tolerance
from ..functions.names import ACTIVATIONS, INSTRUMENTS, PROTOCOLS

NOISE = ("noise", 0, 0.0)
Ion = tuple[str, int, float]  # prefix | suffix | noise, charge, offset
Part = tuple[int, int, float]  # charge, segment, parent mass: the order of partitions
END_MARK = 2**31 - 1


@dataclass
class Model:
    activation: str = "HCD"
    instrument: str = "QExactive"
    enzyme: str | None = None
    protocol: str = "Automatic"
    version: int = 10001
    mme: Tolerance = Tolerance(20.0)
    deconvolute: bool = False
    deconvolution_tolerance: float = 0.0
    charge_hist: list[tuple[int, int]] = field(default_factory=list)
    segments: int = 1
    partitions: list[Part] = field(default_factory=list)
    precursor_offsets: dict[int, list[tuple[int, float, Tolerance, float]]] = field(default_factory=dict)
    fragments: dict[Part, list[tuple[Ion, float]]] = field(default_factory=dict)
    max_rank: int = 0
    ranks: dict[Part, dict[Ion, np.ndarray]] = field(default_factory=dict)
    error_scale: int = 0
    ion_errors: dict[Part, np.ndarray] = field(default_factory=dict)
    noise_errors: dict[Part, np.ndarray] = field(default_factory=dict)
    existence: dict[Part, np.ndarray] = field(default_factory=dict)

    @property
    def charges(self) -> tuple[int, int]:
        z = [c for c, _ in self.charge_hist]
        return (min(z), max(z)) if z else (0, 0)

    def partition(self, charge: int, mass: float, seg: int) -> Part | None:
        """The last partition at or below (charge, segment, mass) in their order, of that charge; else of the nearest charge.

        The order is charge, segment, mass, so a mass below all of its segment's
        partitions gives one of a lower segment.  A charge inside the model's
        range that has none takes the last partition below, whatever its charge.
        """
        parts = self.partitions
        if not parts:
            return None
        mass = float(np.float32(mass))

        def floor(z: int) -> Part | None:
            below = [p for p in parts if p <= (z, seg, mass)]
            return below[-1] if below else None

        found = floor(charge)
        if found and found[0] == charge:
            return found
        least, most = min(p[0] for p in parts), max(p[0] for p in parts)
        if least <= charge <= most:
            if found:
                return found
            near = least
        else:
            near = least if charge < least else most
        found = floor(near)
        return found if found and found[0] == near else next(p for p in parts if p[0] == near)

    def log_ratios(self, part: Part) -> list[tuple[Ion, np.ndarray]]:
        """For each ion of a partition, in the model's order: ln of its rank frequencies over noise, per rank and for missing."""
        table = self.ranks.get(part, {})
        if NOISE not in table:
            return []
        out = []
        for ion, _ in self.fragments.get(part, []):
            if ion != NOISE and ion in table:
                a, b = table[ion], table[NOISE]
                n = min(len(a), len(b))
                share = np.float32(min(ion[1], self.segments))
                with np.errstate(divide="ignore", invalid="ignore"):
                    out.append((ion, np.log(a[:n] / (b[:n] * share)).astype(np.float32)))
        return out

    def main_ion(self, part: Part | None) -> Ion:
        """The ion with the largest summed frequency over segments; ties by kind, charge and offset."""
        total: dict[Ion, float] = {}
        for seg in range(max(self.segments, 1)):
            for ion, freq in self.fragments.get((part[0], seg, part[2]), []) if part else []:
                if ion != NOISE:
                    total[ion] = float(np.float32(total.get(ion, 0.0)) + np.float32(freq))
        return min(total, key=lambda i: (-total[i], i)) if total else ("prefix", 1, 0.0)

    def existence_score(self, part: Part | None, index: int, p: float) -> float:
        """ln of the chance of one of four edge patterns against noise peaks of chance p; NaN counts as 0 when rounded."""
        table = self.existence.get(part)
        if table is None or index >= len(table):
            return 0.0
        base = {0: (1 - p) * (1 - p), 3: p * p}.get(index, p * (1 - p))
        ratio = (float(table[index]) or 0.01) / base if base else float("inf")
        return log(ratio) if 0 < ratio < float("inf") else float("inf") if ratio > 0 else float("nan")

    def error_score(self, part: Part | None, error: float) -> float:
        """ln of the chance of a binned mass error against noise; 0 where a table has none."""
        scale = self.error_scale
        ion, noise = self.ion_errors.get(part), self.noise_errors.get(part)
        if not scale or ion is None or noise is None:
            return 0.0
        x = np.float32(error) * np.float32(scale)
        i = int(np.clip(np.sign(x) * np.floor(abs(x) + np.float32(0.5)), -scale, scale)) + scale
        if i >= len(ion) or i >= len(noise) or ion[i] <= 0 or noise[i] <= 0:
            return 0.0
        return float(np.log(ion[i] / noise[i]))


def tiny_model(ions: bool = False) -> Model:
    """A hand-computable model of one partition and one prefix ion; with ions it is also listed as a fragment."""
    part, ion = (2, 0, 1000.0 if ions else 1500.0), ("prefix", 1, 0.0)
    table = {ion: np.array([0.6, 0.3, 0.05, 0.001], np.float32), NOISE: np.array([0.1, 0.2, 0.3, 0.4], np.float32)}
    return Model(mme=Tolerance(0.5, "Da") if ions else Tolerance(20.0), charge_hist=[(2, 100)], partitions=[part], fragments={part: [(ion, 0.7)] if ions else []}, max_rank=3, ranks={part: table})


def starter_model(charges: tuple[int, ...] = (2, 3, 4), max_rank: int = 150, masses: tuple[float, ...] = (0.0, 1200.0, 2000.0)) -> Model:
    """A plausible untrained model with b and y ions: the seed for training where no trained model is given."""
    noise = np.full(max_rank + 1, 0.3 / max_rank, np.float32)
    noise[-1] = 0.7
    decay = np.exp(-np.arange(max_rank) / 25.0)
    ranks, fragments, parts, ion_err, noise_err, exist = {}, {}, [], {}, {}, {}
    scale = 20
    bins = np.arange(-scale, scale + 1)
    for z in charges:
        for m in masses:
            part = (z, 0, float(np.float32(m)))
            parts.append(part)
            table, frags = {NOISE: noise}, []
            kinds = [("suffix", 1, 19.0229, 0.7), ("prefix", 1, 1.00727649, 0.5)] + [("suffix", 2, 10.0151, 0.2)] * (z > 2)
            for kind, charge, offset, seen in kinds:
                ion = (kind, charge, float(np.float32(offset)))
                dist = np.append(decay / decay.sum() * seen, 1 - seen).astype(np.float32)
                table[ion] = dist
                frags.append((ion, seen))
            ranks[part], fragments[part] = table, frags
            e = np.exp(-0.5 * (bins / 4.0) ** 2)
            ion_err[part] = (e / e.sum()).astype(np.float32)
            noise_err[part] = np.full(len(bins), 1 / len(bins), np.float32)
            exist[part] = np.array([0.25, 0.15, 0.15, 0.45], np.float32)
    return Model(enzyme="Trypsin", protocol="Standard", mme=Tolerance(0.5, "Da"), charge_hist=[(z, 100) for z in charges], partitions=sorted(parts), fragments=fragments, max_rank=max_rank, ranks=ranks, error_scale=scale, ion_errors=ion_err, noise_errors=noise_err, existence=exist)


class ModelFormatError(ValueError):
    pass


def load_binary(data: bytes) -> Model:
    """The big-endian binary form of a model."""
    at = 0

    def take(form: str):
        nonlocal at
        size = struct.calcsize(">" + form)
        if at + size > len(data):
            raise ModelFormatError(f"the data end at {at}, {size} more bytes are needed")
        out = struct.unpack_from(">" + form, data, at)
        at += size
        return out if len(out) != 1 else out[0]

    def text() -> str:
        n = take("B")
        return b"".join(take("2s") for _ in range(n)).decode("utf-16-be") if n else ""

    def named(kind: str, names) -> str | None:
        value = text()
        if not value:
            return None
        for name in names:
            if name.lower() == value.lower():
                return name
        raise ModelFormatError(f"unknown {kind} {value!r}")

    tolerance = lambda: (lambda ppm, v: Tolerance(v, "ppm" if ppm else "Da"))(take("?"), take("f"))
    m = Model(version=take("i"))
    m.activation = named("activation", ACTIVATIONS) or _fail("activation")
    m.instrument = named("instrument", INSTRUMENTS) or _fail("instrument")
    m.enzyme = named("enzyme", ENZYMES)
    m.protocol = named("protocol", PROTOCOLS) or "Automatic"
    m.mme = tolerance()
    m.deconvolute, m.deconvolution_tolerance = take("?"), take("f")
    m.charge_hist = [take("ii") for _ in range(take("i"))]
    n, m.segments = take("i"), take("i")
    wire = [(lambda z, mass, seg: (z, seg, mass))(*take("ifi")) for _ in range(n)]
    m.partitions = sorted(wire)
    if wire != m.partitions:
        raise ModelFormatError("partitions are not in the order charge, segment, mass")
    for _ in range(take("i")):
        z, reduced, offset = take("iif")
        tol = tolerance()
        m.precursor_offsets.setdefault(z, []).append((reduced, offset, tol, take("f")))
    for part in m.partitions:
        m.fragments[part] = [(lambda prefix, z, off, freq: (("prefix" if prefix else "suffix", z, off), freq))(*take("?iff")) for _ in range(take("i"))]
    m.max_rank = take("i")
    floats = lambda k: np.array([take("f") for _ in range(k)], np.float32)
    for part in m.partitions:
        if m.fragments[part]:
            m.ranks[part] = {ion: floats(m.max_rank + 1) for ion in [*(i for i, _ in m.fragments[part]), NOISE]}
    m.error_scale = take("i")
    if m.error_scale > 0:
        for part in m.partitions:
            m.ion_errors[part], m.noise_errors[part], m.existence[part] = floats(2 * m.error_scale + 1), floats(2 * m.error_scale + 1), floats(4)
    if (mark := take("i")) != END_MARK:
        raise ModelFormatError(f"the end mark is {mark}")
    if at != len(data):
        raise ModelFormatError(f"{len(data) - at} bytes follow the end mark")
    return m


def _fail(kind: str):
    raise ModelFormatError(f"no {kind}")


def dump_binary(m: Model) -> bytes:
    """Inverse of load_binary."""
    out = []
    put = lambda form, *v: out.append(struct.pack(">" + form, *v))
    text = lambda s: (put("B", len(s)), out.append(s.encode("utf-16-be")))
    tol = lambda t: put("?f", t.is_ppm, t.value)
    put("i", m.version)
    for s in (m.activation, m.instrument, m.enzyme or "", m.protocol):
        text(s)
    tol(m.mme)
    put("?f", m.deconvolute, m.deconvolution_tolerance)
    put("i", len(m.charge_hist))
    for row in m.charge_hist:
        put("ii", *row)
    put("ii", len(m.partitions), m.segments)
    for z, seg, mass in m.partitions:
        put("ifi", z, mass, seg)
    offsets = [(z, r, o, t, f) for z, rows in m.precursor_offsets.items() for r, o, t, f in rows]
    put("i", len(offsets))
    for z, r, o, t, f in offsets:
        put("iif", z, r, o)
        tol(t)
        put("f", f)
    for part in m.partitions:
        rows = m.fragments.get(part, [])
        put("i", len(rows))
        for (kind, z, off), freq in rows:
            put("?iff", kind == "prefix", z, off, freq)
    put("i", m.max_rank)
    for part in m.partitions:
        for ion in [*(i for i, _ in m.fragments.get(part, [])), NOISE] if m.fragments.get(part) else []:
            put(f"{m.max_rank + 1}f", *m.ranks[part][ion])
    put("i", m.error_scale)
    if m.error_scale > 0:
        for part in m.partitions:
            for table in (m.ion_errors[part], m.noise_errors[part], m.existence[part]):
                put(f"{len(table)}f", *table)
    put("i", END_MARK)
    return b"".join(out)


def log_ratio_frame(spark: SparkSession, m: Model) -> DataFrame:
    """(charge, seg, mass, kind, ion_charge, offset, slot, llr): small, for broadcast joins; the last slot is a missing ion."""
    rows = [(*part, *ion, slot, float(v)) for part in m.partitions for ion, table in m.log_ratios(part) for slot, v in enumerate(table)]
    return spark.createDataFrame(rows, "charge int, seg int, mass float, kind string, ion_charge int, offset float, slot int, llr float")


def partition_lookup(keys: DataFrame, parts: DataFrame) -> DataFrame:
    """keys (charge, mass, seg) with the partition (p_charge, p_seg, p_mass) at or below them: an as-of join.

    parts is a model's list of partitions and is broadcast; keys of a charge
    outside the model's take its nearest charge.
    """
    edge = parts.agg(F.min("charge").alias("lo"), F.max("charge").alias("hi"))
    keys = keys.crossJoin(F.broadcast(edge)).withColumn("_z", F.least(F.greatest("charge", "lo"), F.col("hi"))).drop("lo", "hi")
    by_charge = parts.groupBy("charge").agg(F.array_sort(F.collect_list(F.struct(F.col("seg").alias("seg"), F.col("mass").alias("mass")))).alias("list"))
    out = keys.join(F.broadcast(by_charge.withColumnRenamed("charge", "_z")), "_z", "left")
    key = F.struct(F.col("seg").alias("seg"), F.col("mass").cast("float").alias("mass"))
    below = F.filter("list", lambda p: p <= key)
    hit = F.when(F.size(below) > 0, F.element_at(below, -1)).otherwise(F.get("list", 0))
    out = out.withColumn("_p", hit)
    return out.select(*[c for c in keys.columns if c != "_z"], F.col("_z").alias("p_charge"), F.col("_p.seg").alias("p_seg"), F.col("_p.mass").alias("p_mass"))


def rank_slot(rank, max_rank: int):
    """Slot of a rank column: clamped to the model's ranks; the slot after them if there is no peak."""
    return F.when(rank.isNull(), max_rank).otherwise(F.least(F.greatest(rank, F.lit(1)), F.lit(max_rank)) - 1)


LABELS = ("tmt", "itraq")


def select_model(manifest: DataFrame, activation: str, instrument: str, enzyme: str, classes: set[str], family: str | None = None, generic: str | None = None) -> str | None:
    """The model that fits best.

    manifest: model_id, activation, instrument, enzyme, experiment_class (sorted array).
    In order, first for the instrument and then for its family: the same
    classes; the largest proper subset (a labelled one first, then the
    smallest id); a model of just a label that is asked for; then, for either,
    a model without classes; at last `generic`.
    """
    want = F.array(*[F.lit(c) for c in sorted(classes)]).cast("array<string>")
    mine = F.col("experiment_class")
    inside = (F.size(mine) > 0) & (F.size(F.array_except(mine, want)) == 0) & (F.size(mine) < len(classes))
    labelled = F.arrays_overlap(mine, F.array(*map(F.lit, LABELS)))
    alone = lambda tag: (F.size(mine) == 1) & (F.array_contains(mine, tag)) & F.lit(tag in classes)
    step = F.when(F.array_sort(mine) == want, 1).when(inside, 2).when(alone("tmt"), 3).when(alone("itraq"), 4).when(F.size(mine) == 0, 9)
    places = [instrument] + ([family] if family and family != instrument else [])
    place = F.coalesce(*[F.when(F.col("instrument") == p, i) for i, p in enumerate(places)])
    fit = manifest.where((F.col("activation") == activation) & (F.col("enzyme") == enzyme)).withColumn("step", step).withColumn("place", place).where("step is not null and place is not null")
    # models without classes come after all others of either instrument
    order = [F.col("step") == 9, F.col("place"), F.col("step"), F.when(F.col("step") == 2, -F.size(mine)).otherwise(0), F.when(F.col("step") == 2, (~labelled).cast("int")).otherwise(0), F.col("model_id")]
    first = fit.withColumn("n", F.row_number().over(Window.orderBy(*order))).where("n = 1").select("model_id").first()
    return first.model_id if first else generic


def selection_key(activation: str | None, instrument: str | None, protocol: str, enzyme: str) -> tuple[str, str, str, bool]:
    """(activation, instrument, enzyme, keep classes) asked of the store: combinations without models become their nearest."""
    if activation is None and instrument is None:
        return "HCD", "QExactive", enzyme, True
    a = "CID" if activation in (None, "PQD") else activation
    i = instrument or "LowRes"
    if a == "HCD" and i == "LowRes":
        return "HCD", "QExactive", enzyme, True
    if a == "HCD" and i == "TOF":
        return "CID", "TOF", enzyme, False
    if a == "CID" and i == "QExactive":
        return "CID", "LowRes", enzyme, False
    if a == "ETD" and i not in ("LowRes", "HighRes"):
        return "ETD", "LowRes", enzyme, False
    if a == "UVPD" and i != "QExactive":
        return "CID", "LowRes", enzyme, False
    return a, i, enzyme, True


def instrument_family(instrument: str) -> str:
    """The instrument whose models serve another one too."""
    return {"OrbitrapAstral": "QExactive", "TimsTOF": "TOF"}.get(instrument, instrument)
