"""mzML: Spark's text source cut at </spectrum>, so that parts of a large file are read by several tasks.

A record holds one element, or more if an element does not end; each is parsed
alone, and a malformed one becomes a row with an error.  seq rises with the
place in a file; it is no count.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Accessions of the controlled vocabulary.
MS_LEVEL, SCAN_TIME, SELECTED_MZ, PLAIN_MZ = "MS:1000511", "MS:1000016", "MS:1000744", "MS:1000040"
CHARGE, INTENSITY, ISOLATION_LOWER, ISOLATION_UPPER = "MS:1000041", "MS:1000042", "MS:1000828", "MS:1000829"
MZ_ARRAY, INTENSITY_ARRAY, BITS_64, BITS_32, ZLIB = "MS:1000514", "MS:1000515", "MS:1000523", "MS:1000521", "MS:1000574"
MINUTES = "UO:0000031"
ACTIVATION = {"MS:1000133": "CID", "MS:1000422": "HCD", "MS:1000598": "ETD", "MS:1000250": "ETD", "MS:1000599": "PQD", "MS:1000435": "UVPD"}
ANALYZER = {"MS:1000264": "LowRes", "MS:1000082": "LowRes", "MS:1000083": "LowRes", "MS:1000291": "LowRes", "MS:1000484": "QExactive", "MS:1000079": "HighRes", "MS:1000084": "TOF"}
MODEL = {"MS:1003378": "OrbitrapAstral", "MS:1001911": "QExactive", "MS:1002523": "QExactive", "MS:1002634": "QExactive", "MS:1002877": "QExactive", "MS:1002416": "QExactive"}

SCHEMA = "spec_file string, seq long, title string, scan int, ms_level int, precursor_mz double, precursor_intensity float, precursor_charge int, rt_seconds double, activation string, isolation_lower double, isolation_upper double, peaks array<struct<mz:double,intensity:float>>, instrument_ref string, error string"
_PEAK = pa.struct([("mz", pa.float64()), ("intensity", pa.float32())])
_ARROW = pa.schema([("spec_file", pa.string()), ("seq", pa.int64()), ("title", pa.string()), ("scan", pa.int32()), ("ms_level", pa.int32()), ("precursor_mz", pa.float64()), ("precursor_intensity", pa.float32()), ("precursor_charge", pa.int32()), ("rt_seconds", pa.float64()), ("activation", pa.string()), ("isolation_lower", pa.float64()), ("isolation_upper", pa.float64()), ("peaks", pa.list_(_PEAK)), ("instrument_ref", pa.string()), ("error", pa.string())])
END = "</spectrum>"
#: Rows handed on together.
ROWS = 500


def _number(text, kind=float):
    try:
        return kind(text)
    except (TypeError, ValueError):
        return None


def decode_array(text: str, bits64: bool, zipped: bool) -> np.ndarray:
    raw = base64.b64decode(text or "")
    return np.frombuffer(zlib.decompress(raw) if zipped and raw else raw, "<f8" if bits64 else "<f4").astype(np.float64)


def build_peaks(mz: np.ndarray, intensity: np.ndarray) -> list[dict]:
    """Peaks by m/z without those that are not finite, not above 0 in m/z or below 0 in intensity."""
    if len(mz) != len(intensity):
        raise ValueError(f"{len(mz)} m/z values and {len(intensity)} intensities")
    ok = np.isfinite(mz) & np.isfinite(intensity) & (mz > 0) & (intensity >= 0)
    mz, intensity = mz[ok], intensity[ok].astype(np.float32)
    order = np.argsort(mz, kind="stable")
    return [{"mz": float(m), "intensity": float(i)} for m, i in zip(mz[order], intensity[order], strict=True)]


def parse_spectrum(xml: str, levels: tuple[int, int] | None = None) -> dict | None:
    """The fields of one <spectrum>; None if its level is outside `levels`."""
    root = ElementTree.fromstring(xml)
    params = lambda node: ((p.get("accession"), p.get("value"), p.get("unitAccession")) for p in node.findall("cvParam"))
    title = root.get("id", "")
    scan = re.search(r"(?:^|\s)scan=(\d+)", title)
    out = {"title": title, "scan": int(scan[1]) if scan else None, "error": None}
    for acc, value, _ in params(root):
        if acc == MS_LEVEL:
            out["ms_level"] = _number(value, int)
    if levels and not levels[0] <= (out.get("ms_level") or 1) <= levels[1]:
        return None
    mono = None
    for node in root.iter("scan"):
        out.setdefault("instrument_ref", node.get("instrumentConfigurationRef"))
        for acc, value, unit in params(node):
            if acc == SCAN_TIME and _number(value) is not None:
                out["rt_seconds"] = _number(value) * (60 if unit == MINUTES else 1)
        for p in node.iter("userParam"):
            if "Monoisotopic M/Z" in p.get("name", "") and (_number(p.get("value")) or 0) > 0:
                mono = _number(p.get("value"))
    for node in root.iter("isolationWindow"):
        for acc, value, _ in params(node):
            if acc in (ISOLATION_LOWER, ISOLATION_UPPER):
                out["isolation_lower" if acc == ISOLATION_LOWER else "isolation_upper"] = _number(value)
    for node in root.iter("selectedIon"):
        found = {acc: value for acc, value, _ in params(node)}
        out["precursor_mz"] = _number(found.get(SELECTED_MZ, found.get(PLAIN_MZ)))
        out["precursor_charge"] = _number(found.get(CHARGE), int) or None
        out["precursor_intensity"] = _number(found.get(INTENSITY))
        break
    kinds = [ACTIVATION[acc] for node in root.iter("activation") for acc, _, _ in params(node) if acc in ACTIVATION]
    exact = any(acc == "MS:1000598" for node in root.iter("activation") for acc, _, _ in params(node))
    out["activation"] = "ETD" if exact else next(iter(kinds), None)
    if mono:
        out["precursor_mz"] = mono
    arrays = {}
    for node in root.iter("binaryDataArray"):
        found = {acc for acc, _, _ in params(node)}
        data = decode_array(node.findtext("binary", ""), BITS_32 not in found, ZLIB in found)
        arrays["mz" if MZ_ARRAY in found else "intensity" if INTENSITY_ARRAY in found else "other"] = data
    none = np.empty(0)
    out["peaks"] = build_peaks(arrays.get("mz", none), arrays.get("intensity", none))
    return out


def elements(text: DataFrame) -> DataFrame:
    """(spec_file, seq, xml) of the <spectrum> elements in records (spec_file, value) that end at END."""
    pieces = text.select("spec_file", F.posexplode(F.split("value", r"(?=<spectrum\s)")).alias("k", "xml"), F.size(F.split("value", r"(?=<spectrum\s)")).alias("n"))
    pieces = pieces.where(F.col("xml").rlike(r"^<spectrum\s"))
    return pieces.select("spec_file", F.monotonically_increasing_id().alias("seq"), F.when(F.col("k") == F.col("n") - 1, F.concat("xml", F.lit(END))).otherwise(F.col("xml")).alias("xml"))


def parsed(found: DataFrame, levels: tuple[int, int] | None) -> DataFrame:
    """SCHEMA of elements; those of other levels go."""

    def run(batches):
        rows = []
        for batch in batches:
            for i in range(batch.num_rows):
                name, seq, xml = (batch.column(c)[i].as_py() for c in range(3))
                try:
                    row = parse_spectrum(xml, levels)
                except (ElementTree.ParseError, ValueError, zlib.error) as e:
                    row = {"error": f"{type(e).__name__}: {e}"[:300]}
                if row is not None:
                    rows.append(row | {"spec_file": name, "seq": seq})
                if len(rows) == ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return found.mapInArrow(run, SCHEMA)


def read_mzml(spark: SparkSession, path: str, ms_levels: tuple[int, int] | None = None) -> DataFrame:
    """All spectra of the levels, and errors for those that cannot be read.  Each use reads and parses the file."""
    text = spark.read.option("lineSep", END).text(path)
    return parsed(elements(text.select(F.col("_metadata.file_path").alias("spec_file"), "value")), ms_levels)


def spectra_of(scans: DataFrame, *more: str) -> DataFrame:
    """Spectra with a usable precursor (and the columns `more`), numbered in reading order; elements that are left out leave gaps."""
    from ..operators.order import with_index
    from .mgf import SPECTRUM

    good = scans.where("error is null and precursor_mz is not null and not isnan(precursor_mz) and precursor_mz > 0 and precursor_mz < double('inf')")
    return with_index(good, "spectrum_idx", ids="seq").select(*SPECTRUM, *more)


def with_ms1(scans: DataFrame) -> DataFrame:
    """MS2 rows with ms1_seq: the place of the last MS1 before each in its file."""
    w = Window.partitionBy("spec_file").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    link = F.last(F.when(F.col("ms_level") == 1, F.col("seq")), ignorenulls=True).over(w)
    return scans.withColumn("ms1_seq", link).where("ms_level = 2")


def with_ms1_peaks(scans: DataFrame) -> DataFrame:
    """MS2 rows with ms1_seq and the linked MS1 peaks.  Only places and levels are sorted by file."""
    links = with_ms1(scans.select("spec_file", "seq", "ms_level")).drop("ms_level")
    ms1 = scans.where("ms_level = 1").select("spec_file", F.col("seq").alias("ms1_seq"), F.col("peaks").alias("ms1_peaks"))
    return scans.where("ms_level = 2").join(links, ["spec_file", "seq"]).join(ms1, ["spec_file", "ms1_seq"], "left")


def rejects(scans: DataFrame) -> DataFrame:
    """(spec_file, errors, first three messages) of unreadable spectra."""
    bad = scans.where("error is not null")
    return bad.groupBy("spec_file").agg(F.count("*").alias("errors"), F.slice(F.array_sort(F.collect_list(F.struct("seq", "error"))), 1, 3).alias("first"))


def detect_activation(scans: DataFrame, n: int = 64) -> str | None:
    """The most frequent activation of the first n MS2 spectra in reading order; ties in the order CID, ETD, HCD, PQD, UVPD."""
    from ..functions.names import ACTIVATIONS

    got = Counter(r.activation for r in scans.where("ms_level = 2").select("activation").limit(n).collect() if r.activation)
    return max(got, key=lambda a: (got[a], -ACTIVATIONS.index(a))) if got else None


def detect(spark: SparkSession, path: str, n: int = 64) -> tuple[str | None, str | None]:
    """(activation, instrument) of a file by its head and its first n MS2 spectra; only its first parts are read."""
    head = spark.read.option("lineSep", "<spectrum ").text(path).limit(1).collect()
    scans = read_mzml(spark, path, (2, 2))
    refs = [r.instrument_ref for r in scans.select("instrument_ref").limit(n).collect()]
    return detect_activation(scans, n), detect_instrument(head[0].value, refs) if head else None


def detect_instrument(header: str, config_refs: list[str | None]) -> str | None:
    """Instrument of a file from its text before the spectra and the configurations its first MS2 spectra name.

    The most frequent named configuration decides, else the run's default, else the only one.
    """
    if any(acc in header for acc in MODEL):
        model = next((MODEL[a] for a in MODEL if a in header), None)
        if model == "OrbitrapAstral":
            return model
    kinds = {}
    for m in re.finditer(r'<instrumentConfiguration\b[^>]*\bid="([^"]*)".*?</instrumentConfiguration>', header, re.S):
        kinds[m[1]] = next((ANALYZER[a] for a in re.findall(r'accession="([^"]+)"', m[0]) if a in ANALYZER), None)
    named = Counter(r for r in config_refs[:64] if r in kinds)
    default = re.search(r'defaultInstrumentConfigurationRef="([^"]*)"', header)
    key = named.most_common(1)[0][0] if named else default[1] if default and default[1] in kinds else next(iter(kinds)) if len(kinds) == 1 else None
    return (kinds.get(key) if key else None) or next((MODEL[a] for a in MODEL if a in header), None)
