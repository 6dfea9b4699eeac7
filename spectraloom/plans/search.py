"""The search: from spectra and proteins to ranked matches with features, and its reports."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chem import H2O, ISOTOPE, PROTON, RESIDUE_MASS, enzymatic_boundary, internal_boundaries, neutral_mass, nominal
from ..functions.mods import VariantTable
from ..functions.text import parse_peptide, peptide_text, report_number
from ..operators.chimeric import FALLBACK_WINDOW, coisolated, rounds
from ..operators.digest import DigestOptions, candidates
from ..operators.fdr import LEAST_KEYS, LEAST_RESIDUALS, RESIDUAL_CAP, RESIDUAL_PPM, RESIDUAL_Q, best_per_spectrum, q_values, robust_spread, systematic_sample, tightened_ppm
from ..operators.match import MatchOptions, narrowed, precursor_matches, usable, with_charges
from ..operators.model import Model
from ..operators.score import scored, with_features
from ..operators.topn import delta_score, leave_one_out, listwise, merged_top, null_stats, tailor, top_with_ties, with_output_rank
from ..shared import written
from ..sources.fasta import with_decoys


@dataclass(frozen=True)
class SearchOptions:
    digest: DigestOptions = DigestOptions()
    match: MatchOptions = field(default_factory=MatchOptions)
    decoy_prefix: str = "XXX"
    calibration: str = "off"  # auto, on or off
    strong: bool = False
    #: Matches kept for each spectrum before the strong re-ranking.
    strong_retention: int = 25
    #: Stands in for an isolation offset that a spectrum does not tell.
    isolation_half_width: float = FALLBACK_WINDOW


def build_candidates(proteins: DataFrame, table: VariantTable | None = None, options: SearchOptions = SearchOptions()) -> tuple[DataFrame, DataFrame]:
    """(proteins with decoys, candidates), both as tables in the shared folder since every later step reads them."""
    both = written(with_decoys(proteins, options.decoy_prefix), "proteins")
    return both, written(candidates(both, table, options.digest), "candidates")


def search(spectra: DataFrame, cands: DataFrame, model: Model, options: SearchOptions = SearchOptions(), intensity_model=None, linked: DataFrame | None = None) -> DataFrame:
    """Ranked matches with candidate_idxs, scores, features and the values their spectrum shares.

    linked: spectra with ms1_peaks, in which co-isolated precursors are looked for; their matches are rows of their own.
    """
    o = options.match
    keep = max(o.top_n, options.strong_retention) if options.strong else o.top_n
    spectra = usable(spectra, o.min_peaks)
    matches = precursor_matches(spectra, cands, o)
    # read four times below
    all_scored = written(scored(matches, spectra, cands, model, options.digest.enzyme), "scored")
    top = merged_top(all_scored.join(cands.select("cand_idx", "pre", "post", "is_decoy", "protein_index", "neutral_mass"), "cand_idx"), keep)
    psms = written(with_features(written(top, "top"), spectra, model, intensity_model), "features")

    # per spectrum, over all candidates of all charges
    psms = with_shared(psms, all_scored)
    psms = listwise(psms, "spectrum_idx", "rank_score").withColumnsRenamed({"entropy": "rank_entropy", "gap": "score_gap"})
    psms = leave_one_out(psms.withColumn("strong_score", fused()), "spectrum_idx", "strong_score")
    several = F.count("*").over(Window.partitionBy("spectrum_idx")) > 1
    psms = psms.withColumn("strong_score_cal", F.when(several, F.col("loo")).otherwise(null_distance("score"))).drop("loo")
    if options.strong:
        psms = top_with_ties(psms.withColumn("score", F.col("strong_score")).withColumn("rank_score", F.col("strong_score")), ["spectrum_idx"], "rank_score", o.top_n)
    if linked is not None:
        psms = written(psms.withColumn("precursor_mz_override", F.lit(None).cast("double")), "primary")
        psms = psms.unionByName(second_pass(psms, spectra, linked, cands, model, options, intensity_model))
    return with_output_rank(psms)


def with_shared(psms: DataFrame, scored_: DataFrame) -> DataFrame:
    """psms with the values that a spectrum's scored candidates give it: tailor, delta and null statistics."""
    once = scored_.select("spectrum_idx", "charge", "score", "mass_key")
    psms = psms.join(tailor(once, ["spectrum_idx"]).select("spectrum_idx", "tailor"), "spectrum_idx").withColumn("tailor_score", F.col("score") / F.col("tailor"))
    delta = delta_score(once).groupBy("spectrum_idx").agg(F.max("delta").alias("delta_score"))
    null = null_stats(once, ["spectrum_idx"]).select("spectrum_idx", F.col("n").alias("null_n"), F.col("mean").alias("null_mean"), F.col("dev").alias("null_dev"))
    return psms.join(delta, "spectrum_idx").join(null, "spectrum_idx")


def fused():
    return F.col("intensity_signal") + F.col("surprise") + F.col("competition") - F.col("rank_entropy") + F.col("score_gap")


def null_distance(score: str):
    """Distance of a score from the null's mean in its deviations, 0 with fewer than 100 candidates."""
    return F.when(F.col("null_n") >= 100, (F.col(score) - F.col("null_mean")) / F.col("null_dev")).otherwise(0.0)


def second_pass(primary: DataFrame, spectra: DataFrame, linked: DataFrame, cands: DataFrame, model: Model, options: SearchOptions, intensity_model=None) -> DataFrame:
    """Rows like primary's for the co-isolated precursors of linked spectra (with ms1_peaks), beyond the top n."""
    o = options.match
    found = written(coisolated(linked, o.tolerance, o.charges, options.isolation_half_width), "coisolated")
    first = primary.groupBy("spectrum_idx").agg(F.max_by(F.struct("cand_idx", "residues"), F.struct("rank_score", (-F.col("cand_idx")).alias("c"))).alias("m")).select("spectrum_idx", "m.*")
    out = primary.limit(0)
    for some, got, best in rounds(spectra, found, written(first, "first"), cands, model, o, options.digest.enzyme):
        best = best.join(cands.select("cand_idx", "pre", "post", "is_decoy", "protein_index", "neutral_mass"), "cand_idx").withColumn("candidate_idxs", F.array("cand_idx"))
        rows = with_shared(with_features(written(best, "best"), some, model, intensity_model), got)
        spread = listwise(got.select("spectrum_idx", "score"), "spectrum_idx", "score").groupBy("spectrum_idx").agg(F.max("entropy").alias("rank_entropy"), F.max("gap").alias("score_gap"))
        rows = rows.join(spread, "spectrum_idx").withColumn("strong_score", fused()).withColumn("strong_score_cal", null_distance("strong_score"))
        if options.strong:
            rows = rows.withColumn("score", F.col("strong_score")).withColumn("rank_score", F.col("strong_score"))
        out = out.unionByName(rows.select(*primary.columns))
    return out


def calibration(spectra: DataFrame, cands: DataFrame, model: Model, options: SearchOptions) -> tuple[float, float | None]:
    """(shift in ppm, tightened tolerance in ppm or None) learned from every tenth spectrum.

    Nothing is learned from fewer than LEAST_KEYS spectra and charges or
    LEAST_RESIDUALS confident residuals, nor if calibration is off.
    """
    o = options.match
    if options.calibration == "off":
        return 0.0, None
    some = usable(spectra, o.min_peaks)
    if options.calibration == "auto" and with_charges(some.select("precursor_charge"), o.charges).count() < LEAST_KEYS:
        return 0.0, None
    sample = systematic_sample(some, ["spectrum_idx"])
    matches = precursor_matches(sample, cands, replace(o, isotopes=(0, 0)))
    best = best_per_spectrum(scored(matches, sample, cands, model, options.digest.enzyme).join(cands.select("cand_idx", "is_decoy"), "cand_idx"))
    good = q_values(best.where("rank_score >= 0"), "rank_score", "is_decoy").where(f"not is_decoy and q <= {RESIDUAL_Q} and abs(mass_error_ppm) <= {RESIDUAL_PPM}")
    # observed minus theoretical
    residuals = good.orderBy(F.desc("rank_score"), "spectrum_idx").limit(RESIDUAL_CAP).select((-F.col("mass_error_ppm")).alias("ppm"))
    if residuals.count() < LEAST_RESIDUALS:
        return 0.0, None
    left = o.tolerance.left
    row = robust_spread(residuals, "ppm").select("median", tightened_ppm(left.value if left.is_ppm else RESIDUAL_PPM, F.col("sigma")).alias("tight")).first()
    return float(row.median), float(row.tight)


def calibrated_search(spectra: DataFrame, cands: DataFrame, model: Model, options: SearchOptions = SearchOptions(), intensity_model=None, linked: DataFrame | None = None) -> DataFrame:
    """search() after the calibration it asks for."""
    shift, tight = calibration(spectra, cands, model, options)
    o = options.match
    if tight is not None:
        o = replace(o, shift_ppm=shift, tolerance=narrowed(o.tolerance, tight))
    return search(spectra, cands, model, replace(options, match=o), intensity_model, linked)


def accessions(psms: DataFrame, cands: DataFrame, proteins: DataFrame) -> DataFrame:
    """psms with the accessions of all their candidates, in candidate order."""
    one = psms.select("spectrum_idx", "charge", "cand_idx", F.posexplode("candidate_idxs").alias("nth", "c"))
    one = one.join(cands.select(F.col("cand_idx").alias("c"), "protein_index"), "c").join(proteins.select("protein_index", "accession"), "protein_index", "left")
    name = F.coalesce("accession", F.concat(F.lit("PROT_"), F.col("protein_index").cast("string")))
    got = one.groupBy("spectrum_idx", "charge", "cand_idx").agg(F.array_sort(F.collect_list(F.struct("nth", name.alias("name")))).alias("a"))
    return psms.join(got.select("spectrum_idx", "charge", "cand_idx", F.transform("a", lambda x: x["name"]).alias("proteins")), ["spectrum_idx", "charge", "cand_idx"])


# Columns of the PIN report.
PIN_HEAD = ("SpecId", "Label", "ScanNr", "ExpMass", "CalcMass", "mass", "RawScore", "isotope_error", "peplen", "dm", "absdm")
PIN_TAIL = (
    "enzN", "enzC", "enzInt", "NumMatchedMainIons", "longest_b", "longest_y", "longest_y_pct", "ExplainedIonCurrentRatio", "NTermIonCurrentRatio", "CTermIonCurrentRatio", "MS2IonCurrent", "IsolationWindowEfficiency",
    "MeanErrorTop7", "StdevErrorTop7", "MeanRelErrorTop7", "StdevRelErrorTop7", "matchedIonRatio", "EdgeScore", "PrecursorIsotopeKL", "PrecursorSNR", "DeltaRawScore", "TailorScore", "PpmGaussianScore", "NeutralLossIonCount",
    "LongestComplementaryLadder", "MeanMatchedIntensityRank", "DoublyChargedMatchedIonCount", "UniqueMatchFraction", "ChanceMatchSurprise", "IntensitySignal", "MassCompetitionEvidence", "CandidateRankEntropy", "ListwiseScoreGap",
    "StrongScore", "StrongScoreCal", "Peptide", "Proteins",
)


def pin_header(charges: tuple[int, int]) -> list[str]:
    return [*PIN_HEAD, *(f"charge{z}" for z in range(charges[0], charges[1] + 1)), *PIN_TAIL]


def pin_rows(psms: DataFrame, spectra: DataFrame, cands: DataFrame, proteins: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """(spectrum_idx, row_idx, line) of the PIN report, tab-separated."""
    e, o = options.digest.enzyme, options.match
    override = F.col("precursor_mz_override") if "precursor_mz_override" in psms.columns else F.lit(None).cast("double")
    df = accessions(psms, cands, proteins).join(spectra.select("spectrum_idx", "title", "scan", "precursor_mz"), "spectrum_idx")
    mz, z = F.coalesce(override, "precursor_mz"), F.col("charge")
    exp, calc = mz * z - z * PROTON, F.col("neutral_mass")
    dm = mz - ISOTOPE * F.col("isotope_offset") / z - (calc / z + PROTON)
    scan = F.coalesce("scan", F.lit(0))
    n = F.length("sequence")
    text, num = (lambda c: c.cast("string")), (lambda c: report_number(F.col(c).cast("double") if isinstance(c, str) else c))
    spec_id = F.concat_ws("_", "title", text(scan), text(F.col("rank")), F.when(F.col("multi_row"), text(F.col("row_idx"))))
    cols = [spec_id, F.when(F.col("is_decoy"), "-1").otherwise("1"), text(scan), num(exp), num(calc), num(exp), text(F.round("score").cast("int")), text(F.col("isotope_offset")), text(n + 2), num(dm), num(F.abs(dm))]
    cols += [F.when(z == c, "1").otherwise("0") for c in range(o.charges[0], o.charges[1] + 1)]
    flag = lambda c: F.when(c, "1").otherwise("0")
    cols += [flag(enzymatic_boundary(F.col("pre"), F.substring("sequence", 1, 1), e)), flag(enzymatic_boundary(F.substring("sequence", n, F.lit(1)), F.col("post"), e)), text(internal_boundaries(F.col("sequence"), e))]
    cols += [text(F.col("num_matched")), text(F.col("longest_b")), text(F.col("longest_y")), F.format_string("%.6f", F.col("longest_y_pct").cast("double"))]
    cols += [num(c) for c in ("explained_ratio", "n_term_ratio", "c_term_ratio", "ms2_current", "isolation_efficiency", "mean_error7", "stdev_error7", "mean_rel_error7", "stdev_rel_error7", "matched_ion_ratio")]
    cols += [text(F.col("edge_score")), num("precursor_kl"), num("precursor_snr"), num(F.when(F.col("rank") == 1, F.col("delta_score").cast("double")).otherwise(0.0)), num("tailor_score"), num("ppm_gaussian")]
    cols += [text(F.col("neutral_losses")), text(F.col("ladder")), num("mean_rank"), text(F.col("doubly_charged"))]
    cols += [num(c) for c in ("unique_fraction", "surprise", "intensity_signal", "competition", "rank_entropy", "score_gap", "strong_score", "strong_score_cal")]
    cols += [peptide_text(F.col("pre"), F.col("residues"), F.col("post")), F.array_join("proteins", "\t")]
    return df.select("spectrum_idx", "row_idx", F.concat_ws("\t", *cols).alias("line"))


def write_pin(rows: DataFrame, charges: tuple[int, int], path: str) -> None:
    """The report as a folder of text parts whose names are in order; the first begins with the header.  joined_text makes one file of them."""
    head = rows.sparkSession.createDataFrame([(-1, 0, "\t".join(pin_header(charges)))], "spectrum_idx long, row_idx int, line string")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(F.col("spectrum_idx").cast("long"), F.col("row_idx").cast("int"), "line").unionByName(head)
    rows.repartitionByRange(n, "spectrum_idx", "row_idx").sortWithinPartitions("spectrum_idx", "row_idx").select("line").write.text(path)


def joined_text(spark, folder: str, path: str) -> None:
    """One file of a folder's parts in the order of their names; the bytes stream through, none are held.  The folder goes."""
    jvm = spark.sparkContext._jvm
    conf, hadoop = spark.sparkContext._jsc.hadoopConfiguration(), jvm.org.apache.hadoop
    source, target = hadoop.fs.Path(folder), hadoop.fs.Path(path)
    fs = source.getFileSystem(conf)
    out = target.getFileSystem(conf).create(target, True)
    try:
        for part in sorted(s.getPath().toString() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-")):
            one = fs.open(hadoop.fs.Path(part))
            hadoop.io.IOUtils.copyBytes(one, out, conf, False)
            one.close()
    finally:
        out.close()
    fs.delete(source, True)


def tsv_rows(psms: DataFrame, spectra: DataFrame, cands: DataFrame, proteins: DataFrame, spec_file: str, mgf: bool, ppm: bool = True) -> DataFrame:
    """The TSV report: columns under their names, in output order."""
    override = F.col("precursor_mz_override") if "precursor_mz_override" in psms.columns else F.lit(None).cast("double")
    df = accessions(psms, cands, proteins).join(spectra.select("spectrum_idx", "title", "scan", "precursor_mz", "activation"), "spectrum_idx")
    mz = F.coalesce(override, "precursor_mz")
    error = F.col("mass_error_ppm") if ppm else F.col("mass_error_ppm") * 1e-6 * mz
    out = df.orderBy("spectrum_idx", "row_idx").select(
        F.lit(spec_file).alias("#SpecFile"),
        F.col("title").alias("SpecID"),
        F.coalesce("scan", F.lit(0)).alias("ScanNum"),
        F.col("title").alias("Title"),
        F.coalesce("activation", F.lit("UNKNOWN")).alias("FragMethod"),
        F.format_string("%.4f", mz).alias("Precursor"),
        F.col("isotope_offset").alias("IsotopeError"),
        F.format_string("%.4f", error).alias(f"PrecursorError({'ppm' if ppm else 'Da'})"),
        F.col("charge").alias("Charge"),
        peptide_text(F.col("pre"), F.col("residues"), F.col("post")).alias("Peptide"),
        F.get("proteins", 0).alias("Protein"),
        F.round("score").cast("int").alias("RawScore"),
    )
    return out if mgf else out.drop("Title")


def trace(psms: DataFrame, spectra: DataFrame, scan: int) -> DataFrame:
    """JSON of each match of one scan with its scores and features."""
    some = spectra.where(F.col("scan") == scan).select("spectrum_idx", "scan", "title", "precursor_mz")
    row = psms.join(F.broadcast(some), "spectrum_idx")
    return row.select(F.to_json(F.struct(*[c for c in row.columns])).alias("json"))


def trace_given(spectra: DataFrame, scan: int, peptide: str, model: Model, options: SearchOptions = SearchOptions()) -> DataFrame:
    """JSON of a given peptide (pre.SEQUENCE.post, with deltas) against one scan at each of its charges, whatever its mass."""
    mass = F.create_map(*[F.lit(x) for r, m in RESIDUE_MASS.items() for x in (r, m)])
    one = spectra.sparkSession.createDataFrame([(peptide,)], "text string").select(parse_peptide(F.col("text")).alias("p")).where("p is not null").select("p.*")
    residue = lambda r: F.struct(r["residue"].alias("residue"), F.element_at(mass, r["residue"]).alias("mass"), r["mod_delta"].alias("mod_delta"), F.lit(False).alias("mod_fixed"))
    one = one.withColumn("residues", F.transform("residues", residue)).withColumn("sequence", F.array_join(F.transform("residues", lambda r: r["residue"]), ""))
    whole = F.aggregate("residues", F.lit(0.0), lambda a, r: a + (r["mass"] + F.coalesce(r["mod_delta"], F.lit(0.0))))
    one = one.withColumn("residue_mass", whole).select(F.lit(-1).cast("long").alias("cand_idx"), "sequence", "residues", "pre", "post", (F.col("residue_mass") + H2O).alias("neutral_mass"), nominal(F.col("residue_mass")).alias("nominal_residue_mass"))
    some = spectra.where(F.col("scan") == scan)
    keys = with_charges(some, options.match.charges).select("spectrum_idx", F.col("charge").cast("int").alias("charge"), "precursor_mz").crossJoin(F.broadcast(one.select("cand_idx", F.col("neutral_mass").alias("_m"))))
    observed = neutral_mass(F.col("precursor_mz"), F.col("charge"))
    matches = keys.select("spectrum_idx", "charge", "cand_idx", F.lit(0).alias("isotope_offset"), (F.col("_m") - observed).alias("mass_error_da"), ((F.col("_m") - observed) / observed * 1e6).alias("mass_error_ppm"))
    rows = with_features(written(scored(matches, some, one, model, options.digest.enzyme), "given"), some, model)
    return rows.select(F.to_json(F.struct(*[c for c in rows.columns])).alias("json"))


def yields(spectra: DataFrame, psms: DataFrame, min_peaks: int) -> DataFrame:
    """(spectra, skipped, with matches, matches)."""
    a = spectra.agg(F.count("*").alias("spectra"), F.count(F.when(F.size("peaks") < min_peaks, 1)).alias("skipped"))
    b = psms.agg(F.count_distinct("spectrum_idx").alias("matched"), F.count("*").alias("matches"))
    return a.crossJoin(b)
