import base64
import struct
import zlib

import pytest

from spectraloom.sources import read_fasta, read_linked, read_mgf, read_mzml, read_spectra, spectrum_format
from spectraloom.sources.fasta import with_decoys
from spectraloom.sources.mzml import detect, detect_activation, detect_instrument, rejects, spectra_of, with_ms1, with_ms1_peaks


def put(tmp_path, name, content):
    path = tmp_path / name
    path.write_text(content)
    return str(path)


def test_fasta(spark, tmp_path):
    path = put(tmp_path, "a.fasta", "; a comment\n>sp|P1|A first protein\nmkv lk\n;inner\nAAK\n\n>P2\r\nGGG\r\n>P3 x > y\nCC*\n")
    rows = read_fasta(spark, path).orderBy("protein_index").collect()
    assert [(r.protein_index, r.accession, r.description, r.sequence) for r in rows] == [(0, "sp|P1|A", "first protein", "MKVLKAAK"), (1, "P2", "", "GGG"), (2, "P3", "x > y", "CC*")]


def test_fasta_errors(spark, tmp_path):
    path = put(tmp_path, "b.fasta", "AAK\n>\nGG\n>P3\nCC\n")
    got = read_fasta(spark, path, "PERMISSIVE").orderBy("protein_index").collect()
    assert [r.error for r in got] == ["sequence before the first header", "empty accession", None]
    with pytest.raises(Exception, match="header|accession"):
        read_fasta(spark, path).collect()


def test_decoys(spark, tmp_path):
    both = with_decoys(read_fasta(spark, put(tmp_path, "c.fasta", ">A\nMK\n>B\nPEP\n")), "XXX_").orderBy("protein_index").collect()
    assert [(r.accession, r.sequence, r.is_decoy) for r in both] == [("A", "MK", False), ("B", "PEP", False), ("XXX_A", "KM", True), ("XXX_B", "PEP", True)]


MGF = """# comment
BEGIN IONS
TITLE=one
PEPMASS=500.25 1000
CHARGE=2+
RTINSECONDS=12.5
SCANS=7
OTHER=x
300.5 5
100.5 10.5
END IONS
BEGIN IONS
TITLE=two
CHARGE=2+
100 1
END IONS
BEGIN IONS
TITLE=three
PEPMASS=-1
END IONS
BEGIN IONS
TITLE=four
PEPMASS=400
CHARGE=x
END IONS
BEGIN IONS
TITLE=five
PEPMASS=400
100 abc
END IONS
"""


def test_mgf(spark, tmp_path):
    path = put(tmp_path, "a.mgf", MGF)
    rows = read_mgf(spark, path, "ALL").orderBy("spectrum_idx").collect()
    assert [(r.title, r.error) for r in rows] == [("one", None), ("two", "no PEPMASS"), ("three", "bad PEPMASS"), ("four", "bad CHARGE"), ("five", "bad peak line")]
    r = rows[0]
    assert (r.precursor_mz, r.precursor_intensity, r.precursor_charge, r.rt_seconds, r.scan) == (500.25, 1000.0, 2, 12.5, 7)
    assert [(p.mz, p.intensity) for p in r.peaks] == [(100.5, 10.5), (300.5, 5.0)]
    assert read_mgf(spark, path).count() == 1
    two = read_spectra(spark, path, put(tmp_path, "b.mgf", MGF)).orderBy("spectrum_idx").collect()
    assert [(r.spectrum_idx, r.title) for r in two] == [(0, "a/one"), (1, "b/one")]


def array(values, kind, bits64=True, zipped=False):
    raw = struct.pack(f"<{len(values)}{'d' if bits64 else 'f'}", *values)
    data = base64.b64encode(zlib.compress(raw) if zipped else raw).decode()
    return f'<binaryDataArray><cvParam accession="{"MS:1000523" if bits64 else "MS:1000521"}"/><cvParam accession="{kind}"/>{"<cvParam accession=%sMS:1000574%s/>" % (chr(34), chr(34)) if zipped else ""}<binary>{data}</binary></binaryDataArray>'


def scan(i, level, mz=None, body="", activation="MS:1000422"):
    ion = f'<precursorList><precursor><isolationWindow><cvParam accession="MS:1000828" value="0.8"/><cvParam accession="MS:1000829" value="1.2"/></isolationWindow><selectedIonList><selectedIon><cvParam accession="MS:1000744" value="{mz}"/><cvParam accession="MS:1000041" value="2"/><cvParam accession="MS:1000042" value="9"/></selectedIon></selectedIonList><activation><cvParam accession="{activation}"/></activation></precursor></precursorList>' if mz else ""
    return f'<spectrum index="{i}" id="controllerType=0 scan={i + 1}"><cvParam accession="MS:1000511" value="{level}"/><scanList><scan><cvParam accession="MS:1000016" value="1.5" unitAccession="UO:0000031"/></scan></scanList>{ion}<binaryDataArrayList>{body}</binaryDataArrayList></spectrum>'


def test_mzml(spark, tmp_path):
    peaks = array([300.0, 100.0, -1.0], "MS:1000514") + array([3.0, 1.0, 2.0], "MS:1000515", False, True)
    short = array([300.0, 100.0], "MS:1000514") + array([3.0], "MS:1000515")
    body = scan(0, 1, None, peaks) + scan(1, 2, 500.5, peaks) + '<spectrum index="2" id="scan=3"><cvParam </spectrum>' + scan(3, 2, 600.5, short) + scan(4, 1, None, peaks) + scan(5, 2, 700.5, peaks, "MS:1000598")
    path = put(tmp_path, "a.mzML", f'<mzML><run><spectrumList count="6">{body}</spectrumList></run></mzML>')
    scans = read_mzml(spark, path)
    good = spectra_of(scans.where("ms_level = 2")).orderBy("spectrum_idx").collect()
    assert [(r.scan, r.precursor_mz, r.precursor_charge, r.rt_seconds, r.activation) for r in good] == [(2, 500.5, 2, 90.0, "HCD"), (6, 700.5, 2, 90.0, "ETD")]
    assert [(p.mz, p.intensity) for p in good[0].peaks] == [(100.0, 1.0), (300.0, 3.0)]
    assert (good[0].isolation_lower, good[0].isolation_upper) == (0.8, 1.2)
    bad = rejects(scans).first()
    assert bad.errors == 2 and len(bad["first"]) == 2
    links = {r.scan: r.ms1_seq for r in with_ms1(scans).collect()}
    assert links == {2: 0, 6: 4}
    assert all(r.ms1_peaks for r in with_ms1_peaks(scans).collect())
    assert detect_activation(scans) == "ETD"  # a tie: in the order CID, ETD, HCD
    assert read_mzml(spark, path, (2, 2)).where("error is null").count() == 2
    assert detect(spark, path) == ("ETD", None)


def test_mzml_is_read_in_parts(spark, tmp_path):
    """A file cut into many splits gives the rows of one, in order; an element that does not end is an error of its own."""
    peaks = array([300.0, 100.0], "MS:1000514") + array([3.0, 1.0], "MS:1000515")
    body = "".join(scan(i, 1 + i % 3 // 1 % 2, 400.5 + i, peaks) if i != 20 else '<spectrum index="20" id="scan=21"><cvParam accession="MS:1000511" value="2"/>\n' for i in range(60))
    head = '<instrumentConfigurationList><instrumentConfiguration id="IC1"><cvParam accession="MS:1000484"/></instrumentConfiguration></instrumentConfigurationList>'
    path = put(tmp_path, "big.mzML", f'<mzML>{head}<run defaultInstrumentConfigurationRef="IC1"><spectrumList count="60">{body}</spectrumList></run><indexList/></mzML>')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        scans = read_mzml(spark, path)
        assert scans.rdd.getNumPartitions() > 5
        rows = scans.orderBy("seq").collect()
        linked = {r.scan: r.precursor_mz for r in read_linked(spark, path).where("size(ms1_peaks) = 2").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.scan for r in rows if not r.error] == [i + 1 for i in range(60) if i != 20] and sum(r.error is not None for r in rows) == 1
    assert set(linked) == {r.scan for r in rows if r.ms_level == 2} and detect(spark, path) == ("HCD", "QExactive")
    two = read_spectra(spark, path, path).orderBy("spectrum_idx")
    assert [r.scan for r in two.collect()] == 2 * [r.scan for r in rows if r.ms_level == 2] and two.select("spectrum_idx").distinct().count() == two.count()


def test_instrument_and_formats(spark):
    head = '<instrumentConfigurationList><instrumentConfiguration id="IC1"><cvParam accession="MS:1000484"/></instrumentConfiguration><instrumentConfiguration id="IC2"><cvParam accession="MS:1000264"/></instrumentConfiguration></instrumentConfigurationList><run defaultInstrumentConfigurationRef="IC1">'
    assert detect_instrument(head, ["IC2", "IC2", "IC1"]) == "LowRes" and detect_instrument(head, []) == "QExactive"
    assert detect_instrument('<cvParam accession="MS:1003378"/>' + head, []) == "OrbitrapAstral"
    assert [spectrum_format(p) for p in ("a.mzML", "b.raw", "c.d", "d.mgf", "e.txt")] == ["mzml", "raw", "d", "mgf", "mgf"]
    with pytest.raises(NotImplementedError, match="convert"):
        read_spectra(spark, "x.raw")
