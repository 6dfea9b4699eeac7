"""The model store: one table of manifest, table, source and stat rows, and its incremental updates."""

from __future__ import annotations

import re
import struct
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chem import Tolerance
from ..functions.names import age_days
from .model import NOISE, Model
from .train import COUNT_KEYS, EstimateOptions, combined, estimate

SCHEMA = (
    "record_kind string not null, model_id string not null, activation string, instrument string, enzyme string, protocol string, experiment_class string, version int, mme_val float, mme_is_ppm boolean, apply_deconv boolean, deconv_tol float, num_segments int, max_rank int, error_scaling_factor int, min_charge int, max_charge int, num_precursor_off int, charge_hist array<struct<charge:int,count:int>>, "
    "part_charge int, part_mass_bits int, part_seg int, ion_kind string, ion_charge int, ion_offset_bits int, table_kind string, values array<float>, precursor_offsets array<struct<reduced_charge:int,offset:float,tol_is_ppm:boolean,tol_val:float,frequency:float>>, "
    "source_id string, dataset string, n_psms long, date string, weight float, train_fdr float, src_instrument string, src_experiment_class string, counts array<long>, charge_keys array<int>"
)


NAMES = re.findall(r"(?:^|, )(\w+) ", SCHEMA)


def bits(x: float) -> int:
    return struct.unpack("<i", struct.pack("<f", x))[0]


def of_bits(x: int) -> float:
    return struct.unpack("<f", struct.pack("<i", x))[0]


def model_rows(model_id: str, m: Model, experiment_class: str = "") -> list[dict]:
    lo, hi = m.charges
    rows = [{
        "record_kind": "manifest", "model_id": model_id, "activation": m.activation, "instrument": m.instrument, "enzyme": m.enzyme or "", "protocol": m.protocol, "experiment_class": experiment_class, "version": m.version,
        "mme_val": m.mme.value, "mme_is_ppm": m.mme.is_ppm, "apply_deconv": m.deconvolute, "deconv_tol": m.deconvolution_tolerance, "num_segments": m.segments, "max_rank": m.max_rank, "error_scaling_factor": m.error_scale,
        "min_charge": lo, "max_charge": hi, "num_precursor_off": sum(map(len, m.precursor_offsets.values())), "charge_hist": [{"charge": c, "count": n} for c, n in m.charge_hist],
    }]

    def table(kind: str, part=None, ion=None, values=None, **more):
        row = {"record_kind": "table", "model_id": model_id, "table_kind": kind, "values": None if values is None else [float(v) for v in values]} | more
        if part:
            row |= {"part_charge": part[0], "part_seg": part[1], "part_mass_bits": bits(part[2])}
        if ion:
            row |= {"ion_kind": ion[0], "ion_charge": ion[1], "ion_offset_bits": bits(ion[2])}
        rows.append(row)

    for z, offsets in m.precursor_offsets.items():
        table("precursor_off", (z, 0, 0.0), precursor_offsets=[{"reduced_charge": r, "offset": o, "tol_is_ppm": t.is_ppm, "tol_val": t.value, "frequency": f} for r, o, t, f in offsets])
    for part in m.partitions:
        table("partition", part)
        for i, (ion, freq) in enumerate(m.fragments.get(part, [])):
            table("fragment", part, ion, [freq, i])
        for ion, values in m.ranks.get(part, {}).items():
            table("rank", part, ion, values)
        for kind, tables in (("ion_error", m.ion_errors), ("noise_error", m.noise_errors), ("existence", m.existence)):
            if part in tables:
                table(kind, part, None, tables[part])
    return rows


def load_model(store: DataFrame, model_id: str) -> Model:
    """A model of the store; its rows are few and come to the driver."""
    rows = store.where((F.col("model_id") == model_id) & F.col("record_kind").isin("manifest", "table")).collect()
    head = next((r for r in rows if r.record_kind == "manifest"), None)
    if head is None:
        raise KeyError(f"the store has no model {model_id}")
    m = Model(head.activation, head.instrument, head.enzyme or None, head.protocol, head.version, Tolerance(head.mme_val, "ppm" if head.mme_is_ppm else "Da"), head.apply_deconv, head.deconv_tol, [(c.charge, c["count"]) for c in head.charge_hist or []], head.num_segments, max_rank=head.max_rank, error_scale=head.error_scaling_factor)
    frags: dict = {}
    for r in rows:
        if r.record_kind != "table":
            continue
        part = (r.part_charge, r.part_seg, of_bits(r.part_mass_bits)) if r.part_charge is not None else None
        ion = (r.ion_kind, r.ion_charge, of_bits(r.ion_offset_bits)) if r.ion_kind is not None else None
        values = np.array(r["values"] or [], np.float32)
        if r.table_kind == "precursor_off":
            m.precursor_offsets[part[0]] = [(o.reduced_charge, o.offset, Tolerance(o.tol_val, "ppm" if o.tol_is_ppm else "Da"), o.frequency) for o in r.precursor_offsets]
        elif r.table_kind == "partition":
            m.partitions.append(part)
        elif r.table_kind == "fragment":
            frags.setdefault(part, []).append((values[1], ion, float(values[0])))
        elif r.table_kind == "rank":
            m.ranks.setdefault(part, {})[NOISE if ion[0] == "noise" else ion] = values
        else:
            {"ion_error": m.ion_errors, "noise_error": m.noise_errors, "existence": m.existence}[r.table_kind][part] = values
    m.partitions.sort()
    m.fragments = {p: [(ion, f) for _, ion, f in sorted(frags.get(p, []), key=lambda x: x[0])] for p in m.partitions}
    return m


def frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r.get(f) for f in NAMES) for r in rows], SCHEMA)


def manifest(store: DataFrame) -> DataFrame:
    """The models of a store with their class sets, for select_model."""
    from ..functions.names import parse_class

    protocol = F.when(F.col("protocol") == "Phosphorylation", "phospho").when(F.col("protocol").isin("Automatic", "Standard"), "").otherwise(F.lower("protocol"))
    named = F.coalesce(F.nullif(F.col("experiment_class"), F.lit("")), protocol)
    return store.where("record_kind = 'manifest'").select("model_id", "activation", "instrument", "enzyme", "protocol", parse_class(F.regexp_replace(named, "^standard$", "")).alias("experiment_class"))


def sources(store: DataFrame, model_id: str) -> DataFrame:
    some = store.where((F.col("record_kind") == "source") & (F.col("model_id") == model_id))
    return some.select("source_id", "dataset", "n_psms", "date", "weight", "train_fdr", "src_instrument", "src_experiment_class")


def source_rows(model_id: str, source_id: str, dataset: str, n_psms: int, date: str, fdr: float, instrument: str, experiment_class: str, counts: DataFrame, weight: float = 1.0) -> list[dict]:
    """A ledger row and the histograms of a source; the histograms of one source are few."""
    rows = [{"record_kind": "source", "model_id": model_id, "source_id": source_id, "dataset": dataset, "n_psms": n_psms, "date": date, "weight": weight, "train_fdr": fdr, "src_instrument": instrument, "src_experiment_class": experiment_class}]
    by = counts.groupBy(*[k for k in COUNT_KEYS if k != "bin"]).agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"))
    for r in by.toLocalIterator():
        rows.append({"record_kind": "stat", "model_id": model_id, "source_id": source_id, "table_kind": r.kind, "part_charge": r.charge, "part_seg": r.seg, "part_mass_bits": bits(r.mass), "ion_kind": r.ion_kind, "ion_charge": r.ion_charge, "ion_offset_bits": bits(r.ion_offset), "charge_keys": [b.bin for b in r.bins], "counts": [b.n for b in r.bins]})
    return rows


def source_stats(store: DataFrame, model_id: str) -> DataFrame:
    """(source_id, COUNTS) of a model's sources."""
    some = store.where((F.col("record_kind") == "stat") & (F.col("model_id") == model_id))
    some = some.select("*", F.explode(F.arrays_zip("charge_keys", "counts")).alias("c"))
    floats = {b: of_bits(b) for c in ("part_mass_bits", "ion_offset_bits") for (b,) in some.select(c).distinct().collect()}
    as_float = lambda c: F.element_at(F.create_map(*[F.lit(x) for b, v in floats.items() for x in (b, v)]), F.col(c)).cast("float") if floats else F.lit(0.0).cast("float")
    return some.select("source_id", F.col("table_kind").alias("kind"), F.col("part_charge").alias("charge"), F.col("part_seg").alias("seg"), as_float("part_mass_bits").alias("mass"), "ion_kind", "ion_charge", as_float("ion_offset_bits").alias("ion_offset"), F.col("c.charge_keys").alias("bin"), F.col("c.counts").alias("n"))


class Store:
    """A store at a path of any Hadoop file system.

    A commit writes a new generation beside the old ones and then names it in
    the folder's pointer; readers see one or the other, never a part.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def generation(self) -> str | None:
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.path)) if s.getPath().getName().startswith("gen-")) if self._fs.exists(self._path(self.path)) else []
        return names[-1] if names else None

    def read(self) -> DataFrame:
        name = self.generation()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{name}") if name else frame(self.spark, [])

    def commit(self, rows: DataFrame) -> None:
        """Rename of a fully written folder makes the generation visible."""
        last = self.generation()
        n = int(last.split("-")[1]) + 1 if last else 1
        hidden = f"{self.path}/_new-{uuid.uuid4().hex}"
        rows.select(*NAMES).orderBy("model_id", "record_kind").write.parquet(hidden)
        if not self._fs.rename(self._path(hidden), self._path(f"{self.path}/gen-{n:08d}")):
            raise OSError(f"{self.path}: the new generation could not be put in place")

    def put(self, model_id: str, rows: list[dict]) -> None:
        """Replace one model; all others stay."""
        self.commit(self.read().where(F.col("model_id") != model_id).unionByName(frame(self.spark, rows)))

    def import_binaries(self, path: str) -> list[str]:
        """All binary models under a path, named by their files."""
        from .model import load_binary

        names = []
        for r in self.spark.read.format("binaryFile").load(path).select("path", "content").orderBy("path").toLocalIterator():
            name = r.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            self.put(name, model_rows(name, load_binary(bytes(r.content))))
            names.append(name)
        return names


def rebuilt(store: Store, model_id: str, changed: list[dict], options: EstimateOptions = EstimateOptions()) -> Model:
    """A model estimated again from the stats and weights of a ledger (source and stat rows)."""
    template = load_model(store.read(), model_id)
    held = frame(store.spark, changed)
    weights = held.where("record_kind = 'source'").select("source_id", "weight")
    return estimate(combined(source_stats(held, model_id), weights), template, options)


def _commit(store: Store, model_id: str, changed: list[dict], options: EstimateOptions) -> None:
    store.put(model_id, model_rows(model_id, rebuilt(store, model_id, changed, options)) + changed)


def ledger(store: Store, model_id: str) -> list[dict]:
    """The source and stat rows of a model; few."""
    some = store.read().where((F.col("model_id") == model_id) & F.col("record_kind").isin("source", "stat"))
    return [r.asDict(recursive=True) for r in some.toLocalIterator()]


def with_source(held: list[dict], rows: list[dict]) -> list[dict]:
    new = {r["source_id"] for r in rows}
    if not rows:
        raise KeyError("there is no such source")
    if new & {r["source_id"] for r in held}:
        raise ValueError(f"the model already has the source {sorted(new)}")
    return held + rows


def without_source(held: list[dict], source_id: str) -> list[dict]:
    left = [r for r in held if r["source_id"] != source_id]
    if len(left) == len(held):
        raise KeyError(f"the model has no source {source_id}")
    return left


def with_weight(held: list[dict], source_id: str, weight: float) -> list[dict]:
    if source_id not in {r["source_id"] for r in held}:
        raise KeyError(f"the model has no source {source_id}")
    return [r | ({"weight": float(weight)} if r["record_kind"] == "source" and r["source_id"] == source_id else {}) for r in held]


def with_decay(store: Store, model_id: str, held: list[dict], half_life: float, today: str) -> list[dict]:
    new = {r.source_id: r.weight for r in decayed(sources(store.read(), model_id), half_life, today).collect()}
    return [r | ({"weight": new[r["source_id"]]} if r["record_kind"] == "source" else {}) for r in held]


def add_source(store: Store, model_id: str, rows: list[dict], options: EstimateOptions = EstimateOptions()) -> None:
    _commit(store, model_id, with_source(ledger(store, model_id), rows), options)


def remove_source(store: Store, model_id: str, source_id: str, options: EstimateOptions = EstimateOptions()) -> None:
    _commit(store, model_id, without_source(ledger(store, model_id), source_id), options)


def reweight(store: Store, model_id: str, source_id: str, weight: float, options: EstimateOptions = EstimateOptions()) -> None:
    _commit(store, model_id, with_weight(ledger(store, model_id), source_id, weight), options)


def decay(store: Store, model_id: str, half_life: float, today: str, options: EstimateOptions = EstimateOptions()) -> None:
    _commit(store, model_id, with_decay(store, model_id, ledger(store, model_id), half_life, today), options)


def decayed(sources: DataFrame, half_life: float, today: str) -> DataFrame:
    """Weights halved for each half life of a source's age; a source without a date keeps its weight."""
    if not half_life > 0:
        raise ValueError("the half life must be above 0")
    age = age_days(F.col("date"), today)
    return sources.withColumn("weight", F.when(age.isNull(), F.col("weight")).otherwise(F.col("weight") * F.pow(F.lit(2.0), -age / half_life)).cast("float"))
