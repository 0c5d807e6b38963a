"""Matches in three formats."""

import pytest

from tessera.sources import matches, parsers

MATCHES = [(False, ["P1"]), (False, ["P1", "P2"]), (True, ["REV__P3"]), (False, ["CON__K"]), (False, [])]


def table(path):
    path.write_text("spectrum_id\tis_decoy\tprotein_list\n" + "".join(f"{i}\t{d}\t{p if p else ''}\n" for i, (d, p) in enumerate(MATCHES)))


def mztab(path):
    rows = [f"PSM\tSEQ\t{i}\t{p}\t{int(d)}" for i, (d, names) in enumerate(MATCHES) for p in names or ["null"]]
    path.write_text("\n".join(["MTD\tmzTab-version\t1.0.0", "", "PRH\taccession", "PRT\tP1", "PSH\tsequence\tPSM_ID\taccession\topt_global_cv_MS:1002217_decoy_peptide", *rows]) + "\n")


def mzid(path):
    names = sorted({p for _, ps in MATCHES for p in ps})
    sequences = "".join(f'<DBSequence id="db{n}" accession="{p}" searchDatabase_ref="x"/>\n' for n, p in enumerate(names))
    evidence = "".join(f'<PeptideEvidence id="e{i}_{k}" dBSequence_ref="db{names.index(p)}" isDecoy="{str(d).lower()}"/>\n' for i, (d, ps) in enumerate(MATCHES) for k, p in enumerate(ps))
    items = "".join(f'<SpectrumIdentificationResult id="r{i}"><SpectrumIdentificationItem id="s{i}" rank="1">' + "".join(f'<PeptideEvidenceRef peptideEvidence_ref="e{i}_{k}"/>' for k in range(len(ps))) + '<cvParam name="score"/></SpectrumIdentificationItem></SpectrumIdentificationResult>\n' for i, (_, ps) in enumerate(MATCHES))
    path.write_text(f'<?xml version="1.0"?>\n<MzIdentML id="m" version="1.1.0">\n<SequenceCollection>\n{sequences}{evidence}</SequenceCollection>\n<DataCollection>{items}</DataCollection>\n</MzIdentML>\n')


def test_three_formats_give_one_table(spark, tmp_path):
    for make, name in ((table, "a.dat"), (mztab, "b.dat"), (mzid, "c.dat")):  # the names say nothing
        make(tmp_path / name)
    found = [(r.run, r.is_decoy, sorted(r.proteins)) for r in matches.read_matches(spark, str(tmp_path)).collect()]
    for run in "abc":
        assert sorted((d, p) for r, d, p in found if r == run) == sorted(MATCHES), run
    counts = {tuple(r) for r in parsers.spectrum_counts(matches.read_matches(spark, str(tmp_path))).collect()}
    assert counts == {(run, p, n) for run in "abc" for p, n in (("P1", 2), ("P2", 1))}


@pytest.mark.parametrize("text", ["", "something else\n1\n", "<html></html>", "a\tis_decoy\n1\t0\n"])
def test_wrong_files_raise(spark, tmp_path, text):
    (tmp_path / "x.mzid").write_text(text)
    with pytest.raises(ValueError, match="neither mzIdentML"):
        matches.read_matches(spark, str(tmp_path))


def test_missing_files_and_headers_raise(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        matches.read_matches(spark, str(tmp_path / "none"))
    (tmp_path / "x.mztab").write_text("MTD\tmzTab-version\t1.0.0\nPSM\tSEQ\t1\tP1\n")
    with pytest.raises(Exception, match="no header of matches"):
        matches.read_matches(spark, str(tmp_path)).collect()
