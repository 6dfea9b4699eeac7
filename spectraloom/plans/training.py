"""Training runs: from spectra or labelled rows to a stored model, and gated updates."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fdr import best_per_spectrum, q_values
from ..operators.match import precursor_matches
from ..operators.model import Model
from ..operators.score import scored
from ..operators.store import Store, load_model, model_rows, rebuilt, source_rows
from ..operators.train import EstimateOptions, accept, counted, estimate, flat_peptides, labelled
from ..shared import written
from .search import SearchOptions


def best_matches(spectra: DataFrame, cands: DataFrame, model: Model, options: SearchOptions) -> DataFrame:
    """The best match of each spectrum, with residues and is_decoy."""
    matches = precursor_matches(spectra, cands, options.match)
    got = scored(matches, spectra, cands, model, options.digest.enzyme)
    return best_per_spectrum(got.join(cands.select("cand_idx", "is_decoy"), "cand_idx"))


def accepted(spectra: DataFrame, cands: DataFrame, model: Model, options: SearchOptions, fdr: float) -> int:
    """Targets that a model finds at a false discovery rate."""
    q = q_values(best_matches(spectra, cands, model, options), "rank_score", "is_decoy")
    return q.where(~F.col("is_decoy") & (F.col("q") <= fdr)).count()


def train(store: Store, model_id: str, spectra: DataFrame, cands: DataFrame, seed: Model, source: dict, options: SearchOptions = SearchOptions(), fdr: float = 0.01, estimates: EstimateOptions = EstimateOptions()) -> Model:
    """Label spectra with a seed model, estimate a new one and put it into the store with its source.

    source: source_id, dataset, date, instrument and experiment_class.
    """
    good = written(labelled(best_matches(spectra, cands, seed, options), fdr), "labelled")
    counts = written(counted(good, spectra, seed), "counts")
    return _put(store, model_id, counts, good.count(), seed, source, fdr, estimates)


def train_from_rows(store: Store, model_id: str, rows: DataFrame, seed: Model, source: dict, selection: dict | None = None, prior: Model | None = None, estimates: EstimateOptions = EstimateOptions()) -> Model:
    """Estimate from labelled rows; selection replaces activation, instrument, enzyme and protocol of the seed."""
    good = written(flat_peptides(rows).select("spectrum_idx", "charge", "residues", "precursor_mz", "peaks"), "labelled")
    counts = written(counted(good, good.select("spectrum_idx", "precursor_mz", "peaks"), seed), "counts")
    return _put(store, model_id, counts, good.count(), replace(seed, **(selection or {})), source, 0.0, estimates, prior)


def _put(store: Store, model_id: str, counts: DataFrame, n: int, seed: Model, source: dict, fdr: float, estimates: EstimateOptions, prior: Model | None = None) -> Model:
    model = estimate(counts, seed, estimates, prior)
    ledger = source_rows(model_id, source["source_id"], source.get("dataset", ""), n, source.get("date", ""), fdr, source.get("instrument", model.instrument), source.get("experiment_class", ""), counts)
    store.put(model_id, model_rows(model_id, model, source.get("experiment_class", "")) + ledger)
    return model


def gated(store: Store, model_id: str, candidate: Model, rows: list[dict], spectra: DataFrame | None, cands: DataFrame | None, options: SearchOptions = SearchOptions(), fdr: float = 0.01, force: bool = False) -> bool:
    """Put a candidate into the store if it finds at least as many targets as the model there; without spectra it always goes in."""
    validate = spectra is not None
    old = accepted(spectra, cands, load_model(store.read(), model_id), options, fdr) if validate else 0
    new = accepted(spectra, cands, candidate, options, fdr) if validate else 0
    if accept(old, new, force, validate):
        store.put(model_id, model_rows(model_id, candidate) + rows)
        return True
    return False


def update(store: Store, model_id: str, changed: list[dict], spectra: DataFrame | None = None, cands: DataFrame | None = None, options: SearchOptions = SearchOptions(), fdr: float = 0.01, force: bool = False, estimates: EstimateOptions = EstimateOptions()) -> bool:
    """Estimate a model again from a changed ledger and put it into the store, with spectra only if it finds as many targets there (or force)."""
    return gated(store, model_id, rebuilt(store, model_id, changed, estimates), changed, spectra, cands, options, fdr, force)
