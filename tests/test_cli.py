"""Commands from files to files."""

import pytest

from spectraloom import cli
from spectraloom.operators import store
from spectraloom.operators.model import starter_model
from tests.test_search import BSA
from tests.test_sources import array, put, scan


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """A database and an mzML of a few of its peptides, with an MS1 scan."""
    from spectraloom.functions.chem import PROTON
    from spectraloom.operators.spectrum import by_ions
    from spectraloom.plans import search as S
    from spectraloom.sources import read_fasta
    import numpy as np

    tmp = tmp_path_factory.mktemp("cli")
    fasta = put(tmp, "db.fasta", f">P1 one\n{BSA}\n")
    _, cands = S.build_candidates(read_fasta(spark, fasta))
    body = scan(0, 1, None, array([300.0, 400.0], "MS:1000514") + array([1.0, 2.0], "MS:1000515"))
    for i, r in enumerate(cands.where("not is_decoy and length(sequence) > 8").orderBy("cand_idx").limit(6).collect()):
        mz = np.sort(by_ions(np.array([x.mass + (x.mod_delta or 0) for x in r.residues]), 1)[0])
        body += scan(i + 1, 2, (r.neutral_mass + 2 * PROTON) / 2, array(mz.tolist(), "MS:1000514") + array([10.0] * len(mz), "MS:1000515"))
    return tmp, fasta, put(tmp, "run.mzML", f"<mzML><run><spectrumList>{body}</spectrumList></run></mzML>")


def test_search_command(spark, files):
    tmp, fasta, run = files
    out = f"file://{tmp}/out"
    cli.main(["search", "--spectrum", run, "--database", fasta, "--chimeric", "--output-pin", f"{out}.pin", "--output-tsv", f"{out}.tsv"])
    lines = (tmp / "out.pin").read_text().splitlines()
    assert lines[0].split("\t")[0] == "SpecId" and len(lines) > 6
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{out}.tsv").count() == len(lines) - 1


def test_store_commands(spark, files, capsys):
    tmp, fasta, run = files
    path = f"file://{tmp}/store"
    common = ["--spectrum", run, "--database", fasta, "--store", path]
    cli.main(["train", *common, "--model-id", "m", "--source-id", "one", "--date", "2024-01-01", "--fdr", "0.9"])
    st = store.Store(spark, path)
    flat = spark.createDataFrame([("PEPTIDEK", 2, 464.7, None, None, None, None, [100.0, 200.0], [1.0, 2.0])], "seq string, charge int, prec_mz double, res_mod_pos array<int>, res_mod_delta array<double>, nterm_delta double, cterm_delta double, mz array<float>, intensity array<float>")
    flat.write.parquet(f"file://{tmp}/rows")
    cli.main(["train-rows", "--input", f"file://{tmp}/rows", "--store", path, "--model-id", "r", "--source-id", "two", "--date", "2020-01-01", "--instrument", "TOF", "--prior", "m"])
    assert store.load_model(st.read(), "r").instrument == "TOF"
    ids = lambda m: sorted(r.source_id for r in store.sources(st.read(), m).collect())
    cli.main(["update", "--store", path, "--model-id", "m", "--add", "r/two"])
    assert ids("m") == ["one", "two"] and ids("r") == ["two"]
    cli.main(["update", "--store", path, "--model-id", "m", "--reweight", "two=0.5"])
    cli.main(["update", "--store", path, "--model-id", "m", "--decay", "365", "--today", "2025-01-01"])
    weights = {r.source_id: r.weight for r in store.sources(st.read(), "m").collect()}
    assert weights["one"] == pytest.approx(2 ** (-366 / 365), rel=1e-3) and weights["two"] < 0.02
    capsys.readouterr()
    cli.main(["update", *common, "--model-id", "m", "--remove", "two", "--force"])
    assert ids("m") == ["one"] and "committed" in capsys.readouterr().out
    with pytest.raises(KeyError):
        cli.main(["update", "--store", path, "--model-id", "m", "--remove", "none"])
    with pytest.raises(SystemExit):
        cli.main(["update", "--store", path, "--model-id", "m", "--remove", "one", "--spectrum", run])
    cli.main(["trace", "--spectrum", run, "--store", path, "--model", "m", "--scan", "2", "--peptide", "K.DTHKSEIAHR.F"])
    assert '"num_matched"' in capsys.readouterr().out


def test_detection_reaches_the_choice(spark, files, monkeypatch):
    """What the file says of its activation is asked of the store."""
    tmp, fasta, run = files
    asked = []
    monkeypatch.setattr("spectraloom.operators.model.select_model", lambda manifest, *key: asked.append(key))
    st = store.Store(spark, f"file://{tmp}/store2")
    st.put("x", store.model_rows("x", starter_model()))
    cli.main(["trace", "--spectrum", run, "--store", f"file://{tmp}/store2", "--scan", "2", "--peptide", "K.AAAAAA.R"])
    assert asked and asked[0][0] == "HCD"
