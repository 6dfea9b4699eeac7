import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.functions.chem import ENZYMES, H2O, PROTON, PrecursorTolerance, Tolerance, averagine_of
from spectraloom.functions.mods import Modification, VariantTable
from spectraloom.operators import chimeric, digest, fdr, intensity, match, model, store, topn, train
from spectraloom.operators.digest import DigestOptions
from spectraloom.operators.match import MatchOptions, digested_matches, precursor_matches
from spectraloom.operators.spectrum import ScoredSpectrum, by_ions, deconvolute, features
from spectraloom.plans import search as S
from spectraloom.plans import training

BSA = "MKWVTFISLLLLFSSAYSRGVFRRDTHKSEIAHRFKDLGEEHFKGLVLIAFSQYLQQCPFDEHVKLVNELTEFAKTCVADESHAGCEKSLHTLFGDELCKVASLRETYGDMADCCEKQEPERNECFLSHKDDSPDLPK"


def proteins(spark, *seqs):
    return spark.createDataFrame([(i, f"P{i}", "", s, False) for i, s in enumerate(seqs)], "protein_index long, accession string, description string, sequence string, is_decoy boolean")


def spans(seq, o):
    """All spans by the definition, of both walks."""
    out = []
    for walk in (0, 1) if seq.startswith("M") else (0,):
        q, n = seq[walk:], len(seq) - walk
        cut = lambda i, q=q, n=n: i in (0, n) or q[i - 1] in o.enzyme.after or q[i] in o.enzyme.before or o.enzyme.any
        sites = [i for i in range(n + 1) if cut(i)]
        for a in range(n):
            for b in range(a + o.min_length, min(a + o.max_length, n) + 1):
                ends = cut(a) + cut(b)
                missed = sum(a < i < b for i in sites)
                ok = o.specificity == 0 or o.enzyme.any or (ends == 2 and missed <= o.missed) or (o.specificity == 1 and ends == 1)
                if ok and not set(q[a:b]) - set("ACDEFGHIKLMNPQRSTVWY"):
                    out.append((a + walk, q[a:b], q[a - 1] if a else ("M" if walk else "_"), q[b] if b < n else "-"))
    return sorted(out)


@pytest.mark.parametrize("o", [DigestOptions(), DigestOptions(missed=0), DigestOptions(specificity=1), DigestOptions(specificity=0, max_length=9), DigestOptions(enzyme=ENZYMES["AspN"], missed=2), DigestOptions(enzyme=ENZYMES["NoCleavage"], max_length=200), DigestOptions(enzyme=ENZYMES["aLP"], max_length=8), DigestOptions(enzyme=ENZYMES["GluC"], specificity=1, min_length=4)])
def test_digest(spark, o):
    seqs = [BSA, "PEPTIDEKPEPX" + BSA[:40], "K", "", BSA[1:] * 4]
    got = digest.peptides(proteins(spark, *seqs), o).collect()
    for i, s in enumerate(seqs):
        assert sorted((r.start_offset, r.sequence, r.pre, r.post) for r in got if r.protein_index == i) == spans(s, o)


def test_candidates(spark):
    c = digest.candidates(proteins(spark, "AAMKCCMMMMR"), VariantTable(), DigestOptions(min_length=3, max_mods=3)).collect()
    m4 = [r for r in c if r.sequence == "CCMMMMR"]
    assert len(m4) == 1 + 4 + 6 + 4
    plain = [r for r in m4 if all(x.mod_delta is None for x in r.residues if x.residue == "M")][0]
    assert plain.neutral_mass == pytest.approx(sum(x.mass + (x.mod_delta or 0) for x in plain.residues) + H2O)
    assert [x.mod_delta for x in plain.residues[:2]] == [57.02146, 57.02146]
    assert len({r.cand_idx for r in c}) == len(c)
    assert [[x.mod_delta for x in r.residues[2:6]] for r in sorted(m4, key=lambda r: r.cand_idx)][:2] == [[None] * 4, [None, None, None, 15.99491]]


def test_precursor_join(spark):
    rng = random.Random(1)
    cands = [(i, rng.uniform(800, 1200)) for i in range(300)]
    c = spark.createDataFrame(cands, "cand_idx long, neutral_mass double").withColumn("nominal_residue_mass", F.round(F.lit(0.999497).cast("float") * (F.col("neutral_mass") - H2O).cast("float")).cast("int"))
    specs = [(i, rng.uniform(400, 600), rng.choice([None, 2]), [(1.0, 1.0)] * 10) for i in range(60)] + [(99, 500.0, 2, [])]
    s = spark.createDataFrame(specs, "spectrum_idx long, precursor_mz double, precursor_charge int, peaks array<struct<mz:double,intensity:float>>")
    for tol in (Tolerance(50.0), Tolerance(0.4, "Da")):
        o = MatchOptions(tolerance=PrecursorTolerance(tol, tol), charges=(1, 3))
        got = {(r.spectrum_idx, r.charge, r.cand_idx): r.isotope_offset for r in precursor_matches(s, c, o).collect()}
        want = {}
        for i, mz, z0, peaks in specs:
            for z in ([z0] if z0 else [1, 2, 3]) if peaks else []:
                for k, m in cands:
                    hits = [(abs((m - obs) / obs), iso) for iso in range(-1, 3) for obs in [mz * z - z * PROTON - iso * (13.00335483 - 12)] if abs(m - obs) <= tol.as_da(obs)]
                    if hits:
                        want[i, z, k] = min(hits)[1]
        assert got == want


@pytest.mark.parametrize("left, right", [(Tolerance(1.2, "Da"), Tolerance(0.7, "Da")), (Tolerance(300.0), Tolerance(0.0)), (Tolerance(30.0), Tolerance(0.2, "Da")), (Tolerance(900.0), Tolerance(900.0))])
def test_precursor_join_of_wide_and_uneven_tolerances(spark, left, right):
    """Isotopes overlap, sides differ; columns of candidates go along."""
    rng = random.Random(2)
    cands = [(i, rng.uniform(500, 2500)) for i in range(400)]
    c = spark.createDataFrame([(i, m, f"p{i}") for i, m in cands], "cand_idx long, neutral_mass double, sequence string")
    specs = [(i, rng.uniform(250, 1250)) for i in range(80)] + [(80, cands[0][1] / 2 + PROTON)]
    s = spark.createDataFrame(specs, "spectrum_idx long, precursor_mz double").select("*", F.lit(2).alias("precursor_charge"), F.array(F.lit(0)).alias("peaks"))
    got = precursor_matches(s, c, MatchOptions(tolerance=PrecursorTolerance(left, right), min_peaks=1), keep=("sequence",)).collect()
    want = {}
    for i, mz in specs:
        for k, m in cands:
            obs = {iso: mz * 2 - 2 * PROTON - iso * (13.00335483 - 12) for iso in range(-1, 3)}
            hits = [(abs((m - o) / o * 1e6), iso) for iso, o in obs.items() if abs(m - o) <= (left if m < o else right).as_da(o)]
            if hits:
                want[i, k] = (min(hits)[1], f"p{k}")
    assert len(want) > 10 and len(got) == len(want)
    assert {(r.spectrum_idx, r.cand_idx): (r.isotope_offset, r.sequence) for r in got} == want


def test_precursor_join_broadcasts_nothing(spark):
    """Neither exploded precursors nor candidates: small files may hold many of them."""
    from spectraloom.plans.registry import flagship

    out = flagship(spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


MODS = [Modification("C", 57.02146, "C", "any", True), Modification("O", 15.99491, "M", "any", False), Modification("P", 79.96633, "S", "any", False), Modification("A", 42.01057, "*", "prot-n-term", False), Modification("T", 100.0, "K", "c-term", True), Modification("E", -17.5, "E", "n-term", False)]


@pytest.mark.parametrize("mods, how, tol, size", [(None, DigestOptions(), Tolerance(20.0), 1 << 20), (MODS, DigestOptions(missed=2, min_length=1), Tolerance(900.0), 100), (MODS, DigestOptions(enzyme=ENZYMES["AspN"], max_mods=1), Tolerance(1.4, "Da"), 1 << 20), ([], DigestOptions(specificity=1, max_length=9), Tolerance(20.0), 1 << 20)])
def test_matches_where_candidates_are_digested(spark, monkeypatch, mods, how, tol, size):
    """The same rows as of the join of tables, in groups of precursors too and for indices that are missing or repeated."""
    monkeypatch.setattr("spectraloom.operators.match.KEYS", size)
    rng = random.Random(3)
    seqs = [BSA, "MMAMMSMKMMMMR" + BSA[:50], "PEPTXDEKPEPé" + BSA[50:90], "K", "", "M", None, "M" * 14 + "SEMCK" * 9, "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=3000))]
    rows = [(i, i % 2 == 0, s) for i, s in enumerate(seqs)] + [(None, False, BSA[100:200]), (50, False, "MAMSK" * 5), (50, False, "MAMSK" * 5)]
    p = spark.createDataFrame(rows, "protein_index long, is_decoy boolean, sequence string")
    t = VariantTable() if mods is None else VariantTable(mods)
    cands = digest.candidates(p, t, how)
    masses = sorted(r.neutral_mass for r in cands.select("neutral_mass").distinct().collect())
    specs = [(i, (m + PROTON * 2 + rng.choice([-1, 0, 1, 2]) * 1.00335483) / 2 * (1 + rng.uniform(-3e-5, 3e-5)), rng.choice([None, 2])) for i, m in enumerate(masses[:: len(masses) // 150])]
    specs += [(900, None, 2), (901, float("nan"), 2), (902, float("inf"), 2), (903, 0.1, 2), (None, masses[3] + PROTON, 1)]
    s = spark.createDataFrame(specs, "spectrum_idx long, precursor_mz double, precursor_charge int").withColumn("peaks", F.array(F.lit(0)))
    o, keep = MatchOptions(tolerance=PrecursorTolerance(tol, tol), min_peaks=1), ("sequence", "is_decoy")
    got, want = digested_matches(s, p, o, t, how, keep), precursor_matches(s, cands.select("cand_idx", "neutral_mass", *keep), o, keep)
    assert got.schema.simpleString() == want.schema.simpleString()
    got, want = (sorted(map(repr, df.collect())) for df in (got, want))
    assert len(want) > 100 and got == want


def test_long_ranges_are_cut():
    """All pairs once, in rows and batches of bounded size."""
    low, high = np.array([5, 0, 3, 7, 0]), np.array([5, 10_000, 4, 6, 300_000])
    found = list(match._cut(low, high))
    got = [(a, k) for at, begin, size in found for a, b, n in zip(at, begin, size, strict=True) for k in range(b, b + n)]
    assert got == [(a, k) for a in range(5) for k in range(low[a], high[a])]
    assert all(size.max() <= match.ROW and size.sum() <= match.PAIRS for _, _, size in found)


def test_search_candidates_shuffle_nothing(spark):
    """Candidates are many times the documents: no disk holds them between the steps."""
    from spectraloom.plans.registry import flagship

    out = flagship(spark, "/root/testdata/sf0.001")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_tiny_model_scores():
    m = model.tiny_model(ions=True)
    part = (2, 0, 1000.0)
    (_, table), = m.log_ratios(part)
    assert table.tolist() == pytest.approx([np.log(6), np.log(1.5), np.log(1 / 6), np.log(0.0025)], rel=1e-5)
    masses = np.array([100.0, 150.0, 200.0, 250.0])
    mz = 100.0 / 1.0 + 0.0
    s = ScoredSpectrum(np.array([mz, 500.0]), np.array([10.0, 1.0]), 351.5, 2, m)
    # splits at nominal 100, 250, 450: one peak of rank 1, two missing
    assert s.raw_score(masses) == round(float(np.log(6))) + 2 * round(float(np.log(0.0025)))
    assert s.edge_score(masses) == 0


def test_partition_floor():
    m = model.Model(partitions=[(2, 0, 500.0), (2, 0, 1000.0), (2, 1, 800.0), (4, 0, 700.0)])
    assert m.partition(2, 1200.0, 0) == (2, 0, 1000.0)
    assert m.partition(2, 600.0, 1) == (2, 0, 1000.0)  # below its segment: the last of the lower one
    assert m.partition(2, 100.0, 0) == (2, 0, 500.0) or m.partition(2, 100.0, 0)[0] == 2
    assert m.partition(9, 900.0, 0) == (4, 0, 700.0)
    assert m.partition(1, 900.0, 0) == (2, 0, 500.0)
    assert m.partition(3, 900.0, 0) == (2, 1, 800.0)


def test_binary_and_store_round_trip(spark, tmp_path):
    m = model.starter_model()
    m.precursor_offsets = {2: [(0, -18.0, Tolerance(0.5, "Da"), 0.25)]}
    data = model.dump_binary(m)
    back = model.load_binary(data)
    assert model.dump_binary(back) == data and back.partitions == m.partitions
    for bad in (data[:-1], data + b"x", data[:-4] + b"\0\0\0\1"):
        with pytest.raises(model.ModelFormatError):
            model.load_binary(bad)
    st = store.Store(spark, f"file://{tmp_path}/store")
    st.put("a", store.model_rows("a", m))
    st.put("b", store.model_rows("b", model.tiny_model(True)))
    assert model.dump_binary(store.load_model(st.read(), "a")) == data
    assert {r.model_id for r in store.manifest(st.read()).collect()} == {"a", "b"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "c.param").write_bytes(data)
    assert st.import_binaries(f"file://{tmp_path}/in") == ["c"]


def test_selection(spark):
    rows = [("g", "HCD", "QExactive", "Trypsin", []), ("p", "HCD", "QExactive", "Trypsin", ["phospho"]), ("t", "HCD", "QExactive", "Trypsin", ["tmt"]), ("x", "HCD", "OrbitrapAstral", "Trypsin", ["acetyl"])]
    m = spark.createDataFrame(rows, "model_id string, activation string, instrument string, enzyme string, experiment_class array<string>")
    pick = lambda *c, i="QExactive": model.select_model(m, "HCD", i, "Trypsin", set(c), model.instrument_family(i), "none")
    assert pick("phospho") == "p" and pick("phospho", "tmt") == "t" and pick() == "g" and pick("glyco") == "g"
    assert pick("tmt", i="OrbitrapAstral") == "t" and pick("acetyl", i="OrbitrapAstral") == "x"
    assert model.select_model(m, "ETD", "LowRes", "Trypsin", set(), None, "none") == "none"
    assert model.selection_key("HCD", "TOF", "Automatic", "Trypsin") == ("CID", "TOF", "Trypsin", False)
    assert model.selection_key(None, None, "Automatic", "Trypsin")[:2] == ("HCD", "QExactive")


def test_strongest_peak_brute():
    rng = np.random.default_rng(2)
    mz = np.sort(rng.uniform(100, 1000, 200))
    inten = rng.integers(1, 20, 200).astype(np.float32)
    s = ScoredSpectrum(mz, inten, 600.0, 2, model.tiny_model(True))
    for t, w in zip(rng.uniform(90, 1010, 300), rng.uniform(0.1, 30, 300), strict=True):
        got = s.strongest(np.array([t]), np.array([w]))[0]
        at = [i for i in range(200) if t - w <= mz[i] <= t + w]
        assert got == (min(at, key=lambda i: (-inten[i], mz[i])) if at else -1)


def test_deconvolution():
    mz = np.array([300.0, 300.0 + 1.00335483 / 2, 300.0 + 1.00335483 / 2 + 0.99988617 / 2, 500.0])
    out, _, rank = deconvolute(mz, np.ones(4, np.float32), np.arange(1, 5), 3, 0.01)
    assert np.allclose(np.sort(out), np.sort([2 * 300.0 - PROTON, 2 * mz[1] - PROTON, 2 * mz[2] - PROTON, 500.0])) and sorted(rank) == [1, 2, 3, 4]
    same, _, _ = deconvolute(mz, np.ones(4, np.float32), np.arange(1, 5), 2, 0.01)
    assert same.tolist() == mz.tolist()


def spectra(spark, cands, n=12, seed=3):
    rng = random.Random(seed)
    rows = []
    for i, r in enumerate(cands.where("not is_decoy and length(sequence) > 8").orderBy("cand_idx").select("sequence", "residues", "neutral_mass").limit(n).collect()):
        mz = by_ions(np.array([x.mass + (x.mod_delta or 0) for x in r.residues]), 1)[0]
        peaks = sorted([(float(x), rng.uniform(50, 100)) for x in mz] + [(rng.uniform(100, 1500), rng.uniform(1, 20)) for _ in range(30)])
        rows.append((i, f"s{i}", i + 1, (r.neutral_mass + 2 * PROTON) / 2, 2, peaks, r.sequence))
    return spark.createDataFrame(rows, "spectrum_idx long, title string, scan int, precursor_mz double, precursor_charge int, peaks array<struct<mz:double,intensity:float>>, truth string").withColumn("activation", F.lit("HCD"))


def test_search_and_training(spark, tmp_path):
    both, cands = S.build_candidates(proteins(spark, BSA, BSA[::-1][:60]))
    sp = spectra(spark, cands)
    seed = model.starter_model()
    psms = S.search(sp.drop("truth"), cands, seed).cache()
    best = psms.where("rank = 1").join(sp.select("spectrum_idx", "truth"), "spectrum_idx").where("sequence = truth")
    assert best.select("spectrum_idx").distinct().count() == sp.count()
    lines = [r.line.split("\t") for r in S.pin_rows(psms, sp, cands, both).collect()]
    head = S.pin_header((2, 5))
    assert len(head) == 52 and all(len(x) >= 52 for x in lines)
    at = {n: i for i, n in enumerate(head)}
    assert all(x[at["mass"]] == x[at["ExpMass"]] and x[at["charge2"]] == "1" and x[at["dm"]].lstrip("-") == x[at["absdm"]] for x in lines)
    S.write_pin(S.pin_rows(psms, sp, cands, both), (2, 5), f"file://{tmp_path}/pin")
    assert spark.read.text(f"file://{tmp_path}/pin").count() == len(lines) + 1
    assert set(S.tsv_rows(psms, sp, cands, both, "a.mgf", True).columns) >= {"#SpecFile", "Title", "PrecursorError(ppm)"}
    assert S.trace(psms, sp, 1).count() >= 1

    st = store.Store(spark, f"file://{tmp_path}/store")
    trained = training.train(st, "m", sp, cands, seed, {"source_id": "one", "date": "2024-01-01"}, fdr=0.5)
    assert trained.charge_hist[0][0] == 2
    before = model.dump_binary(store.load_model(st.read(), "m"))
    counts = store.source_stats(st.read(), "m").drop("source_id")
    extra = store.source_rows("m", "two", "", 5, "2020-01-01", 0.01, "", "", counts)
    store.add_source(st, "m", extra)
    with pytest.raises(ValueError):
        store.add_source(st, "m", extra)
    store.remove_source(st, "m", "two")
    assert model.dump_binary(store.load_model(st.read(), "m")) == before
    store.decay(st, "m", 365.0, "2025-01-01")
    assert store.sources(st.read(), "m").first().weight == pytest.approx(2 ** (-366 / 365), rel=1e-3)
    with pytest.raises(ValueError):
        store.decay(st, "m", 0.0, "2025-01-01")
    assert training.gated(st, "m", seed, [], sp, cands, force=True)


def test_count_algebra(spark):
    a = spark.createDataFrame([("rank", 2, 0, 1.0, "p", 1, 0.0, 0, 5), ("rank", 2, 0, 1.0, "p", 1, 0.0, 1, 2)], train.COUNTS)
    b = a.withColumn("n", F.lit(1).cast("long"))
    total = lambda df: sorted((r.bin, r.n) for r in df.collect())
    assert total(train.merge(a, b)) == [(0, 6), (1, 3)] and total(train.subtract(train.merge(a, b), b)) == total(a)
    assert total(train.subtract(b, a)) == [] and total(train.scale(a, 0.5)) == [(0, 3), (1, 1)]


def test_estimate_prefers_counts_when_many():
    assert train.laplace(np.array([8.0, 0.0]), 1.0).tolist() == pytest.approx([0.9, 0.1])
    assert train.blend(np.array([1.0, 0.0]), np.array([0.0, 1.0]), 20, 20).tolist() == [0.5, 0.5]
    d = train.smooth(np.array([0.5, 0.2, 0.1, 0.06, 0.02, 0.02, 0.1], np.float32))
    assert d.sum() == pytest.approx(1.0, abs=1e-5)


def test_topn_windows(spark):
    rows = [(1, 10.0), (1, 10.0), (1, 9.0), (1, float("nan")), (2, 5.0)]
    df = spark.createDataFrame(rows, "k int, s double")
    assert sorted(r.s for r in topn.top_with_ties(df, ["k"], "s", 1).collect()) == [5.0, 10.0, 10.0]
    many = spark.createDataFrame([(1, float(i)) for i in range(1, 201)], "k int, score double")
    assert topn.tailor(many, ["k"]).first().tailor == 199.0
    assert topn.tailor(many.limit(50), ["k"]).first().tailor == 1.0
    loo = {r.s: r.loo for r in topn.leave_one_out(spark.createDataFrame([(1, 1.0), (1, 2.0)], "k int, s double"), "k", "s").collect()}
    assert loo == {1.0: pytest.approx(-1e6), 2.0: pytest.approx(1e6)}
    assert spark.range(1).select(topn.longest_run(F.array(*map(F.lit, [True, True, False, True])))).first()[0] == 2


def test_q_values(spark):
    rng = random.Random(4)
    rows = [(float(rng.randint(0, 30)), rng.random() < 0.3) for _ in range(200)]
    got = {(r.score): r.q for r in fdr.q_values(spark.createDataFrame(rows, "score double, d boolean"), "score", "d").collect()}
    rate, best = {}, 1.0
    for s in sorted({s for s, _ in rows}, reverse=True):
        d, t = sum(x for v, x in rows if v >= s), sum(not x for v, x in rows if v >= s)
        rate[s] = d / max(t, 1)
    for s in sorted(rate):
        best = min(best, rate[s])
        assert got[s] == pytest.approx(best)


def test_calibration_needs_enough(spark):
    both, cands = S.build_candidates(proteins(spark, BSA))
    from dataclasses import replace

    assert S.calibration(spectra(spark, cands), cands, model.starter_model(), replace(S.SearchOptions(), calibration="auto")) == (0.0, None)


def test_chimeric():
    env = [100.0, 60.0, 20.0, 5.0]
    mz = np.array([500.0 + k * 1.00335483 / 2 for k in range(4)] + [500.8 + k * 1.00335483 / 3 for k in range(4)])
    inten = np.array([*env, *(0.5 * x for x in env)], np.float32)
    order = np.argsort(mz)
    found = chimeric.detect(mz[order], inten[order], 499.0, 502.5, 500.0, (2, 3), 0.01, max_kl=1.0)
    assert [(round(m, 1), z) for m, z, _ in found] == [(500.8, 3)]
    assert chimeric.isotope_match(np.empty(0), np.empty(0), 500.0, 2, 998.0, 0.01) == (10.0, 0.0)


def test_first_peak_of_heavy_coisolated():
    """The second peak of an envelope of 3 to 5 kDa is its strongest, fits within the limit and is not taken for the first."""
    for first in (702.21, 1000.21, 1290.21):
        share = averagine_of((first - PROTON) * 3, 4)
        mz = np.array([first - 0.21 + k * 1.00335483 / 2 for k in range(4)] + [first + k * 1.00335483 / 3 for k in range(4)])
        inten = np.concatenate([averagine_of((first - 0.21 - PROTON) * 2, 4) * 1000, share * 500]).astype(np.float32)
        order = np.argsort(mz)
        assert share[1] > share[0]
        (got, z, mass), *_ = chimeric.detect(mz[order], inten[order], first - 1.21, first + 0.79, first - 0.21, (2, 3), 0.013)
        assert (round(got, 4), z) == (first, 3) and mass == pytest.approx((first - PROTON) * 3)


def test_coisolated_envelopes_of_large_keys(spark, tmp_path):
    """Keys of heavy envelopes, and those whose m/z no instrument has."""
    import duckdb

    from spectraloom.plans.registry import ORACLE_SQL, QUERIES

    spark.sql("select explode(array(0, 101, 102, 600, 683, 5000, 9999, 10000, 10102, 12345, 59999, 7000000))").selectExpr("cast(col as bigint) as s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    got = QUERIES["coisolated_envelopes"](spark, str(tmp_path)).select("spectrum_idx", "co_mz", "co_charge", "co_mass").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(ORACLE_SQL["coisolated_envelopes"]).fetchall())


def test_second_pass(spark):
    _, cands = S.build_candidates(proteins(spark, BSA))
    a, b = cands.where("not is_decoy and sequence in ('LVNELTEFAK', 'SLHTLFGDELCK')").orderBy("sequence").collect()[:1][0], cands.where("not is_decoy and sequence = 'SLHTLFGDELCK'").first()
    mass = lambda r: np.array([x.mass + (x.mod_delta or 0) for x in r.residues])
    peaks = sorted([(float(x), 100.0) for x in by_ions(mass(a), 1)[0]] + [(float(x), 50.0) for x in by_ions(mass(b), 1)[0]])
    sp = spark.createDataFrame([(0, (a.neutral_mass + 2 * PROTON) / 2, 2, peaks)], "spectrum_idx long, precursor_mz double, precursor_charge int, peaks array<struct<mz:double,intensity:float>>")
    found = spark.createDataFrame([(0, 0, (b.neutral_mass + 2 * PROTON) / 2, 2, b.neutral_mass)], chimeric.FOUND)
    primary = cands.where(F.col("cand_idx") == a.cand_idx).select(F.lit(0).cast("long").alias("spectrum_idx"), "cand_idx", "residues")
    out = chimeric.secondaries(sp, found, primary, cands, model.starter_model(), MatchOptions(min_peaks=5, isotopes=(0, 0)), ENZYMES["Trypsin"])
    assert [r.sequence for r in out.collect()] == ["SLHTLFGDELCK"]


def test_chimeric_search_from_mzml(spark, tmp_path):
    """A scan of two peptides whose precursors share an isolation window, from the file to the report."""
    from spectraloom.sources import read_linked
    from tests.test_sources import array, put, scan

    both, cands = S.build_candidates(proteins(spark, BSA))
    rows = {r.sequence: r for r in cands.where("not is_decoy and sequence in ('LVNELTEFAK', 'SLHTLFGDELCK', 'YLYEIAR')").collect()}
    mass = lambda r: np.array([x.mass + (x.mod_delta or 0) for x in r.residues])
    a, b = rows["LVNELTEFAK"], rows["SLHTLFGDELCK"]
    ions = [by_ions(mass(r), 1)[0] for r in (a, b)]
    mz = (a.neutral_mass + 2 * PROTON) / 2
    # the second precursor is put beside the first: its m/z is what the MS1 says, at the charge that gives its mass
    co = (b.neutral_mass + 2 * PROTON) / 2
    env = [1.0, 0.75, 0.32, 0.1]
    ms1 = sorted([(mz + k * 1.00335483 / 2, 1000 * e) for k, e in enumerate(env)] + [(co + k * 1.00335483 / 2, 500 * e) for k, e in enumerate(env)])
    ms2 = sorted([(float(x), 100.0) for x in ions[0]] + [(float(x), 50.0) for x in ions[1]])
    split = lambda peaks: array([m for m, _ in peaks], "MS:1000514") + array([i for _, i in peaks], "MS:1000515")
    wide = scan(1, 2, mz, split(ms2)).replace('value="0.8"', f'value="{abs(co - mz) + 3}"').replace('value="1.2"', f'value="{abs(co - mz) + 3}"')
    path = put(tmp_path, "c.mzML", f"<mzML><run><spectrumList>{scan(0, 1, None, split(ms1))}{wide}</spectrumList></run></mzML>")
    linked = read_linked(spark, path).cache()
    spectra = linked.drop("ms1_peaks")
    plain = S.search(spectra, cands, model.starter_model())
    got = S.search(spectra, cands, model.starter_model(), linked=linked).cache()
    extra = got.where("precursor_mz_override is not null").collect()
    assert [(r.sequence, r.charge, round(r.precursor_mz_override, 4)) for r in extra] == [("SLHTLFGDELCK", 2, round(co, 4))]
    assert got.count() == plain.count() + 1 and extra[0].num_matched > 10 and extra[0].tailor == 1.0
    lines = [r.line.split("\t") for r in S.pin_rows(got, spectra, cands, both).collect()]
    at = {n: i for i, n in enumerate(S.pin_header((2, 5)))}
    line, = [x for x in lines if "SLHTLFGDELC" in x[at["Peptide"]]]
    assert float(line[at["ExpMass"]]) == pytest.approx(co * 2 - 2 * PROTON, rel=1e-5) and abs(float(line[at["dm"]])) < 1e-3
    assert S.tsv_rows(got, spectra, cands, both, "c.mzML", False).where(F.col("Precursor") == f"{co:.4f}").count() == 1
    given = S.trace_given(spectra, 2, f"{b.pre}.SLHTLFGDELC+57.02146K.{b.post}", model.starter_model()).collect()
    assert len(given) == 1 and json.loads(given[0].json)["num_matched"] > 10
    assert S.trace_given(spectra, 2, "no peptide", model.starter_model()).count() == 0


def test_intensity(spark, tmp_path):
    rows = [("b", "A", "K", 3, 2, "unknown", 40, 4.0, 0.8), ("b", "A", "K", 3, 2, "unknown", 10, 1.0, 0.2), ("b", "*", "*", 3, 2, "unknown", 90, 18.0, 4.0), ("y", "A", "K", 3, 2, "unknown", 0, 0.0, 0.0)]
    p = spark.createDataFrame(rows, "ion_type string, flank_n string, flank_c string, pos_bin int, charge int, nce_bin string, count long, sum_log_rel double, sum_log_rel_sq double")
    m = intensity.merged(p)
    assert {(r.flank_n, r["count"], round(r.mean_log_rel, 6)) for r in m.collect()} == {("A", 50, 0.1), ("*", 90, 0.2)}
    intensity.write_model(m, f"file://{tmp_path}/i")
    again = intensity.merged(intensity.read_partial(spark, f"file://{tmp_path}/i"))
    assert {(r.flank_n, round(r.var_log_rel, 9)) for r in again.collect()} == {(r.flank_n, round(r.var_log_rel, 9)) for r in m.collect()}
    held = intensity.IntensityModel.load(spark, f"file://{tmp_path}/i")
    assert held.predict("b", "A", "K", 3, 2, "unknown")[0] == pytest.approx(0.1)
    assert held.predict("b", "C", "K", 3, 2, "unknown")[0] == pytest.approx(0.2)
    assert held.predict("y", "C", "K", 9, 2, "unknown") == (pytest.approx(23 / 140), 1.0)
    want = spark.createDataFrame([("b", "C", "K", 3, 2, "unknown"), ("y", "C", "K", 9, 2, "unknown")], "ion_type string, flank_n string, flank_c string, pos_bin int, charge int, nce_bin string")
    assert sorted(round(r.mean_log_rel, 6) for r in intensity.looked_up(want, m).collect()) == [round(23 / 140, 6), 0.2]


def test_features_of_full_ladder():
    masses = np.array([57.02146, 71.03711, 87.03203, 128.09496, 147.06841])
    mz = np.sort(by_ions(masses, 1)[0])
    f = features(ScoredSpectrum(mz, np.full(len(mz), 10.0), 300.0, 2, model.starter_model()), "GASKF", masses)
    assert f["num_matched"] == 8 and f["mean_error7"] == 0 and f["unique_fraction"] > 0


def test_flat_rows(spark):
    rows = [("PEPK", 2, 300.0, [0, 3], [1.0, 2.0], 10.0, None, [200.0, 100.0], [1.0, 2.0]), ("PXK", 2, 300.0, None, None, None, None, [1.0], [1.0]), ("PEK", 2, 300.0, [7], [1.0], None, None, [1.0], [1.0])]
    df = spark.createDataFrame(rows, "seq string, charge int, prec_mz double, res_mod_pos array<int>, res_mod_delta array<double>, nterm_delta double, cterm_delta double, mz array<float>, intensity array<float>")
    got = train.flat_peptides(df).collect()
    assert [[x.mod_delta for x in r.residues] for r in got] == [[11.0, None, None, 2.0]]
    assert [p.mz for p in got[0].peaks] == [100.0, 200.0]


def test_bounds_and_counts(spark):
    m = spark.createDataFrame([("psm", "12"), ("wall", "NA"), ("rss", "x"), ("ok", "5")], "metric string, value string")
    b = spark.createDataFrame([("psm", 20.0, None, False), ("wall", 1.0, 2.0, True), ("rss", 1.0, 2.0, False), ("ok", 1.0, 9.0, False), ("gone", 1.0, None, False), ("free", None, None, False)], "metric string, min double, max double, optional boolean")
    got = {r.metric: (r.problem, r.failure) for r in fdr.out_of_bounds(m, b).collect()}
    assert got == {"psm": ("outside its bounds", True), "wall": ("missing", False), "rss": ("not a number", True), "gone": ("missing", True)}
    df = spark.createDataFrame([("A", ["p", "q"], False, 0.0), ("A", ["q"], False, 0.005), ("B", ["r"], True, 0.0), ("C", ["s"], False, 0.5)], "sequence string, proteins array<string>, is_decoy boolean, q double")
    assert tuple(fdr.distinct_accepted(df).first()) == (2, 1, 2)


def test_stream_carries_the_last_ms1(spark, tmp_path):
    from spectraloom.streaming.ms1 import linked_stream

    schema = "spec_file string, seq long, ms_level int"
    src = tmp_path / "in"
    for i, rows in enumerate([[("a", 0, 1), ("a", 1, 2), ("b", 0, 2)], [("a", 2, 2), ("a", 3, 1), ("a", 4, 2), ("b", 1, 1), ("b", 2, 2)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src / f"part={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src / "part=*"))
    q = linked_stream(stream).writeStream.format("memory").queryName("linked").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    try:
        q.processAllAvailable()
        got = {(r.spec_file, r.seq): r.ms1_seq for r in spark.table("linked").collect()}
    finally:
        q.stop()
    assert got == {("a", 1): 0, ("b", 0): None, ("a", 2): 0, ("a", 4): 3, ("b", 2): 1}


def test_all_scores_are_those_of_one(spark):
    """Scoring many peptides in one call gives what each gives alone, with edges and at every charge."""
    from dataclasses import replace

    rng = np.random.default_rng(7)
    res = np.array([57.02146, 71.03711, 87.03203, 128.09496, 147.06841, 186.07931])
    peptides = [rng.choice(res, n) for n in (1, 2, 7, 12, 30, 5, 9)] + [np.array([])]
    off = np.concatenate([[0], np.cumsum([len(p) for p in peptides])])
    for m in (model.starter_model(), model.tiny_model(True), replace(model.starter_model(), error_scale=0)):
        for z in (0, 1, 2, 3, 4):
            mz = np.sort(np.concatenate([rng.uniform(60, 1500, 80), *(by_ions(p, 1)[0] for p in peptides[3:5])]))
            s = ScoredSpectrum(mz, rng.uniform(1, 100, len(mz)), 700.0, z, m)
            raw, edge = s.scores(np.concatenate(peptides), off)
            assert raw.tolist() == [s.raw_score(p) for p in peptides] and edge.tolist() == [s.edge_score(p) for p in peptides]


def test_q_values_over_ranges(spark):
    """Any number of ranges gives the rates of one sorted scan; distinct, tied and NaN scores."""
    rng = random.Random(5)
    rows = [(float("nan") if rng.random() < 0.02 else round(rng.gauss(0, 1), rng.choice([1, 8])), rng.random() < 0.3) for _ in range(500)]
    df = spark.createDataFrame(rows, "score double, d boolean")
    value = lambda s: float("-inf") if s != s else s
    seen, rate = [0, 0], {}
    for s in sorted({value(s) for s, _ in rows}, reverse=True):
        seen[1] += sum(d for x, d in rows if value(x) == s)
        seen[0] += sum(not d for x, d in rows if value(x) == s)
        rate[s] = seen[1] / max(seen[0], 1)
    want = {s: min(1.0, *(r for t, r in rate.items() if t <= s)) for s in rate}
    got = fdr.q_values(df, "score", "d")
    assert all(r.q == pytest.approx(want[value(r.score)]) for r in got.collect()) and got.count() == len(rows)
    assert fdr.q_values(df.limit(0), "score", "d").count() == 0
    assert "SinglePartition" not in fdr.q_values(df, "score", "d")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_report_in_ordered_parts(spark, tmp_path):
    rows = spark.createDataFrame([(i, j, f"line {i} {j}") for i in range(50) for j in range(3)], "spectrum_idx long, row_idx int, line string").repartition(7)
    S.write_pin(rows, (2, 3), f"file://{tmp_path}/parts")
    S.joined_text(spark, f"file://{tmp_path}/parts", f"file://{tmp_path}/out.pin")
    lines = (tmp_path / "out.pin").read_text().splitlines()
    assert lines[0].startswith("SpecId\t") and lines[1:] == [f"line {i} {j}" for i in range(50) for j in range(3)] and not (tmp_path / "parts").exists()
