"""Commands: search, train, train-rows, train-intensity, update and trace."""

from __future__ import annotations

import argparse
from datetime import date

from .functions.chem import PrecursorTolerance, Tolerance
from .functions.mods import DEFAULT_MODS, DEFAULTS, VariantTable, parse_mods, parse_num_mods
from .functions.names import parse_activation, parse_calibration, parse_enzyme, parse_instrument, parse_protocol, parse_specificity
from .operators.chimeric import FALLBACK_WINDOW
from .operators.digest import DigestOptions
from .operators.match import MatchOptions
from .plans.search import SearchOptions


def _pair(text: str) -> tuple[int, int]:
    a, _, b = text.partition(",")
    return int(a), int(b or a)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spectraloom")
    sub = p.add_subparsers(dest="command", required=True)
    s, t, i, r, u, c = (sub.add_parser(n) for n in ("search", "train", "train-intensity", "train-rows", "update", "trace"))
    for x in (s, t, u, c):
        x.add_argument("--spectrum", action="append", required=x in (s, t, c), default=None if x in (s, t, c) else [])
        x.add_argument("--database", required=x in (s, t))
        x.add_argument("--mods")
        x.add_argument("--enzyme", type=parse_enzyme, default=parse_enzyme("Trypsin"))
        x.add_argument("--specificity", type=parse_specificity, default=2)
        x.add_argument("--missed", type=int, default=1)
        x.add_argument("--length", type=_pair, default=(6, 40))
        x.add_argument("--charge", type=_pair, default=(2, 5))
        x.add_argument("--isotope", type=_pair, default=(-1, 2))
        x.add_argument("--tolerance", default="20ppm")
        x.add_argument("--min-peaks", type=int, default=10)
        x.add_argument("--decoy-prefix", default="XXX")
        x.add_argument("--store", required=x is u)
        x.add_argument("--model", help="the id of a model of the store, instead of a choice")
        x.add_argument("--fragmentation", type=parse_activation, default=None)
        x.add_argument("--instrument", type=parse_instrument, default=None)
        x.add_argument("--protocol", type=parse_protocol, default="Automatic")
    s.add_argument("--top", type=int, default=10)
    s.add_argument("--precursor-cal", type=parse_calibration, default="off")
    s.add_argument("--score", choices=["raw", "strong"], default="raw")
    s.add_argument("--intensity-model")
    s.add_argument("--max-spectra", type=int)
    s.add_argument("--chimeric", action="store_true", help="look for co-isolated peptides too; needs mzML with MS1 scans")
    s.add_argument("--isolation-half-width", type=float, default=FALLBACK_WINDOW)
    s.add_argument("--output-pin", required=True)
    s.add_argument("--output-tsv")
    for x in (t, r):
        x.add_argument("--source-id", required=True)
        x.add_argument("--date", default="")
        x.add_argument("--dataset", default="")
        x.add_argument("--experiment-class", default="")
    for x in (t, r, u):
        x.add_argument("--model-id", required=True)
    for x in (t, u):
        x.add_argument("--fdr", type=float, default=0.01)
    r.add_argument("--input", action="append", required=True, help="Parquet with labelled rows")
    r.add_argument("--store", required=True)
    r.add_argument("--model", help="the id of the model whose structure is taken")
    r.add_argument("--prior", help="the id of a model that sparse tables are drawn to")
    r.add_argument("--fragmentation", type=parse_activation, default=None)
    r.add_argument("--instrument", type=parse_instrument, default=None)
    r.add_argument("--protocol", type=parse_protocol, default=None)
    change = u.add_mutually_exclusive_group(required=True)
    change.add_argument("--remove", metavar="SOURCE")
    change.add_argument("--reweight", metavar="SOURCE=WEIGHT")
    change.add_argument("--decay", type=float, metavar="HALF_LIFE_DAYS")
    change.add_argument("--add", metavar="MODEL/SOURCE", help="a source of another model of the store")
    u.add_argument("--today", default=date.today().isoformat())
    u.add_argument("--force", action="store_true", help="commit even if fewer targets are found on --spectrum")
    c.add_argument("--scan", type=int, required=True)
    c.add_argument("--peptide", required=True, help="pre.SEQUENCE.post, deltas after their residues")
    i.add_argument("--input", action="append", required=True)
    i.add_argument("--output", required=True)
    return p


def options_of(a: argparse.Namespace, num_mods: int) -> SearchOptions:
    left, _, right = a.tolerance.partition(",")
    tol = PrecursorTolerance(Tolerance.parse(left), Tolerance.parse(right or left))
    digest = DigestOptions(a.enzyme, a.missed, *a.length, a.specificity, num_mods)
    return SearchOptions(digest, MatchOptions(tol, a.charge, a.isotope, a.min_peaks, top_n=getattr(a, "top", 1)), a.decoy_prefix, getattr(a, "precursor_cal", "off"), getattr(a, "score", "raw") == "strong", isolation_half_width=getattr(a, "isolation_half_width", FALLBACK_WINDOW))


def main(args: list[str] | None = None) -> None:
    """One command; the tables that it needed on the way go."""
    from .session import session
    from .shared import remove_tables

    spark = session()
    try:
        run(spark, parser().parse_args(args))
    finally:
        remove_tables(spark)


def run(spark, a: argparse.Namespace) -> None:
    from .operators import intensity
    from .operators.model import instrument_family, select_model, selection_key, starter_model
    from .operators.store import Store, load_model, manifest
    from .plans import search as S
    from .plans import training
    from .shared import written
    from .sources import read_fasta, read_linked, read_spectra, spectrum_format
    from .sources.mzml import detect

    if a.command == "train-intensity":
        intensity.write_model(intensity.merged(intensity.read_partial(spark, *a.input)), a.output)
        return
    store = Store(spark, a.store) if a.store else None
    if a.command == "train-rows":
        rows = spark.read.parquet(*a.input)
        seed = load_model(store.read(), a.model) if a.model else starter_model()
        chosen = {k: v for k, v in (("activation", a.fragmentation), ("instrument", a.instrument), ("protocol", a.protocol)) if v}
        prior = load_model(store.read(), a.prior) if a.prior else None
        training.train_from_rows(store, a.model_id, rows, seed, _source(a), chosen, prior)
        return
    text = "\n".join(r.value for r in spark.read.text(a.mods).collect()) if a.mods else ""
    table = VariantTable(parse_mods(text) if a.mods else DEFAULTS)
    options = options_of(a, (parse_num_mods(text) if a.mods else None) or DEFAULT_MODS)
    both = cands = spectra = linked = None
    if a.database:
        both, cands = S.build_candidates(read_fasta(spark, a.database), table, options)
    if a.spectrum:
        limit = getattr(a, "max_spectra", None)
        if getattr(a, "chimeric", False):
            linked = written(read_linked(spark, *a.spectrum, limit=limit), "linked")
            spectra = linked.drop("ms1_peaks")
        else:
            spectra = written(read_spectra(spark, *a.spectrum, limit=limit), "spectra")
    if a.command == "update":
        if bool(a.database) != bool(a.spectrum):
            raise SystemExit("--spectrum and --database go together")
        done = training.update(store, a.model_id, _change(store, a), spectra, cands, options, a.fdr, a.force)
        print("committed" if done else "not committed: the candidate finds fewer targets")
        return
    activation, instrument = a.fragmentation, a.instrument
    first = a.spectrum[0]
    if spectrum_format(first) == "mzml" and (activation is None or instrument is None):
        seen = detect(spark, first)
        activation, instrument = activation or seen[0], instrument or seen[1]
    model = starter_model()
    if store:
        activation, instrument, enzyme, keep = selection_key(activation, instrument, a.protocol, a.enzyme.name)
        classes = {a.protocol.lower()} - {"automatic", "standard"} if keep else set()
        found = a.model or select_model(manifest(store.read()), activation, instrument, enzyme, classes, instrument_family(instrument))
        if found is not None:
            model = load_model(store.read(), found)
    if a.command == "trace":
        for r in S.trace_given(spectra, a.scan, a.peptide, model, options).toLocalIterator():
            print(r.json)
        return
    if a.command == "train":
        training.train(store, a.model_id, spectra, cands, model, _source(a), options, a.fdr)
        return
    signal = intensity.IntensityModel.load(spark, a.intensity_model) if a.intensity_model else None
    psms = written(S.calibrated_search(spectra, cands, model, options, signal, linked), "psms")
    S.write_pin(S.pin_rows(psms, spectra, cands, both, options), a.charge, a.output_pin + ".parts")
    S.joined_text(spark, a.output_pin + ".parts", a.output_pin)
    if a.output_tsv and not a.max_spectra:
        S.tsv_rows(psms, spectra, cands, both, first, spectrum_format(first) == "mgf", options.match.tolerance.left.is_ppm).write.option("sep", "\t").option("header", True).csv(a.output_tsv)
    print(" ".join(f"{k}={v}" for k, v in S.yields(spectra, psms, options.match.min_peaks).first().asDict().items()))


def _source(a: argparse.Namespace) -> dict:
    return {"source_id": a.source_id, "date": a.date, "dataset": a.dataset, "experiment_class": a.experiment_class}


def _change(store, a: argparse.Namespace) -> list[dict]:
    """The ledger of a model after the change that the arguments name."""
    from .operators import store as L

    ledger = L.ledger(store, a.model_id)
    if a.remove:
        return L.without_source(ledger, a.remove)
    if a.reweight:
        source, _, weight = a.reweight.rpartition("=")
        return L.with_weight(ledger, source, float(weight))
    if a.add:
        other, _, source = a.add.partition("/")
        return L.with_source(ledger, [r | {"model_id": a.model_id} for r in L.ledger(store, other) if r["source_id"] == source])
    return L.with_decay(store, a.model_id, ledger, a.decay, a.today)


if __name__ == "__main__":
    main()
