import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.functions import chem, mods, names, text


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_masses():
    assert chem.RESIDUE_MASS["G"] == pytest.approx(57.02146373, abs=1e-6)
    assert chem.H2O == pytest.approx(18.0105647, abs=1e-6)
    assert chem.SCALER64 == 0.9994969964027405


def test_nominal_rounds_half_away(spark):
    values = [0.0, 57.02146, 128.09496, 1000.5, 2345.678]
    got = [one(spark, chem.nominal(F.lit(v)))[0] for v in values]
    assert got == chem.nominal_of(np.array(values)).tolist() == [0, 57, 128, 1000, 2344]


def test_cleavage_credit():
    assert chem.cleavage_credit(chem.TRYPSIN) == {"peptide_credit": 2, "peptide_penalty": -3, "neighbour_credit": 2, "neighbour_penalty": -3}


@pytest.mark.parametrize(("before", "after", "want"), [("K", "A", True), ("K", "P", False), ("A", "C", False), ("_", "A", True), ("A", "-", True), ("-", "P", True)])
def test_boundary(spark, before, after, want):
    assert one(spark, chem.enzymatic_boundary(F.lit(before), F.lit(after), chem.TRYPSIN))[0] is want


def test_internal_boundaries(spark):
    for s, n in (("AKRPKA", 2), ("A", 0), ("KK", 1), ("", 0)):
        assert one(spark, chem.internal_boundaries(F.lit(s), chem.TRYPSIN))[0] == n


def test_cosine_and_averagine(spark):
    v = F.array(F.lit(1.0), F.lit(2.0))
    assert one(spark, chem.cosine(v, v))[0] == pytest.approx(1.0)
    assert one(spark, chem.cosine(v, F.array(F.lit(0.0), F.lit(0.0))))[0] == 0.0
    env = one(spark, chem.averagine(F.lit(1500.0), 4))[0]
    assert env == pytest.approx(chem.averagine_of(1500.0, 4).tolist()) and sum(env) == pytest.approx(1.0)


@pytest.mark.parametrize(("value", "want"), [(0.0, "0"), (float("nan"), "0"), (float("inf"), "0"), (1234567.0, "1.23457e+06"), (123.4560, "123.456"), (1e-5, "1e-05"), (-0.25, "-0.25"), (999999.9, "1000000"), (0.0001, "0.0001"), (100.0, "100")])
def test_report_number(spark, value, want):
    assert one(spark, text.report_number(F.lit(value)))[0] == want


def test_peptide_text_round_trip(spark):
    form = "K.PEC+57.02146TM+15.99491K.-"
    got = one(spark, text.parse_peptide(F.lit(form)).alias("p"))[0]
    assert "".join(r.residue for r in got.residues) == "PECTMK" and got.residues[2].mod_delta == 57.02146
    p = text.parse_peptide(F.lit(form))
    assert one(spark, text.peptide_text(p["pre"], p["residues"], p["post"]))[0] == form
    assert one(spark, text.parse_peptide(F.lit("PEPTIDE")))[0] is None


def test_mods_file():
    table = "NumMods=2 # cap\n57.02146,C,fix,any,Carbamidomethyl\n15.99491,M,opt,any,Oxidation\n42.01057,*,opt,Prot-N-term,Acetyl\n"
    assert mods.parse_num_mods(table) == 2
    got = mods.parse_mods(table)
    assert [m.name for m in got] == ["Carbamidomethyl", "Oxidation", "Acetyl"]
    v = mods.VariantTable(got)
    assert [d for _, d, _ in v.variants("M")] == [None, 15.99491]
    assert [d for _, d, _ in v.variants("M", first=True, protein_first=True)] == [None, 15.99491, 42.01057]
    assert [d for _, d, _ in v.variants("C")] == [57.02146]


@pytest.mark.parametrize("line", ["H2O,C,fix,any,x", "57,CM,fix,any,x", "57,C,fixed,any,x", "57,C,fix,nterm,x", "57,C,fix,any", "57,c1,fix,any,x"])
def test_bad_mods(line):
    with pytest.raises(mods.ModError):
        mods.Modification.parse(line)


def test_conflicting_mods():
    with pytest.raises(mods.ModError):
        mods.VariantTable([mods.Modification("a", 10.0, "C", "any", True), mods.Modification("b", 20.0, "C", "any", True)])
    with pytest.raises(mods.ModError):
        mods.VariantTable([mods.Modification("a", 1000.5, "C", "any", False)])


def test_names(spark):
    assert names.decoy_prefix(" XXX_ ") == "XXX" and names.decoy_prefix("") == "XXX" and names.decoy_prefix("rev__") == "rev"
    assert names.canonical_set(["TMT10", "phosphorylation"]) == "phospho+tmt" and names.canonical_set(["none"]) == "standard"
    assert names.infer_class([(79.966, "S"), (229.163, "K")]) == "phospho+tmt" and names.infer_class([(79.966, "K")]) == "standard"
    assert names.day_number("1970-02-31") == 61 and names.day_number("1969-01-01") is None and names.day_number("x") is None
    assert names.parse_instrument("3") == "QExactive" and names.parse_activation("auto") is None and names.parse_protocol("tmt") == "TMT"
    assert names.parse_specificity("semi") == 1 and names.parse_calibration("AUTO") == "auto" and names.parse_enzyme("lys-c").name == "LysC"
    with pytest.raises(ValueError):
        names.parse_enzyme("pepsin")
    assert one(spark, names.canonical_class(F.lit("tmtpro+ gg+")))[0] == "tmt+ubiquitin"
    assert one(spark, names.parse_class(F.lit("B+a+ a")))[0] == ["a", "b"]


def test_tolerance():
    assert chem.Tolerance.parse("20 ppm").as_da(1000.0) == pytest.approx(0.02)
    assert chem.Tolerance.parse("0.5Da").as_da(1000.0) == 0.5
    assert chem.calibrated(1000.0, 0.0) == 1000.0 and chem.calibrated(1000.0, 5.0) == pytest.approx(999.995)
    assert math.isclose(chem.ion_node_mass(chem.ion_mz(100.0, 2, 1.0), 2, 1.0), 100.0 / chem.SCALER64)
