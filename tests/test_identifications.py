"""Identifications in XML give the targets of their table."""

import pytest

from ionlake.operators import candidates
from ionlake.sources import readers

PSMS = [
    # sequence with modified prolines by place, protein, q, decoy
    ("AGLPGEVGAK", (4,), "sp|P1|X", 0.001, False),
    ("AGLPGEVGAK", (), "sp|P1|X", 0.004, False),
    ("DEFGHIPSTWK", (), "tr|Q2|Y", 0.5, False),
    ("GVVGLPGPR", (6, 8), "contam x", 0.002, False),
    ("MKPEPTIDEK", (), "DECOY_sp|P9|Z", 0.001, True),
    ("SAVEDGNWLLK", (), "sp|P4|W", None, False),
]


def tsv(folder):
    form = lambda s, places: "".join(c + ("[+15.9949]" if i + 1 in places else "") for i, c in enumerate(s))
    lines = [f"{form(s, m)}\t{p}\t{'' if q is None else q}\t{d}" for s, m, p, q, d in PSMS]
    path = folder / "a.tsv"
    path.write_text("\n".join(["peptidoform\tprotein_list\tqvalue\tis_decoy", *lines]) + "\n")
    return str(path)


def mzid(folder):
    proteins = {p: f"DB{i}" for i, p in enumerate(dict.fromkeys(x[2] for x in PSMS))}
    seq = "".join(f'<DBSequence id="{i}" accession="{p}" searchDatabase_ref="S"/>\n' for p, i in proteins.items())
    pep = ev = items = ""
    for k, (s, mods, p, q, d) in enumerate(PSMS):
        m = "".join(f'<Modification location="{x}" monoisotopicMassDelta="15.994915" residues="P"><cvParam accession="UNIMOD:35" name="Oxidation" cvRef="U"/></Modification>' for x in mods)
        m += '<Modification location="1" monoisotopicMassDelta="15.994915" residues="M"/>' if s[0] == "M" else ""
        pep += f'<Peptide id="P{k}"><PeptideSequence>{s}</PeptideSequence>{m}</Peptide>\n'
        ev += f'<PeptideEvidence id="E{k}" dBSequence_ref="{proteins[p]}" peptide_ref="P{k}" isDecoy="{str(d).lower()}" start="1" end="2"/>\n'
        also = '<PeptideEvidenceRef peptideEvidence_ref="E4"/>' if k == 0 else ""  # a shared peptide: its first protein counts
        value = f'<cvParam accession="MS:1002354" name="PSM-level q-value" cvRef="M" value="{q}"/>' if q is not None else ""
        items += f'<SpectrumIdentificationResult id="R{k}" spectrumID="index={k}"><SpectrumIdentificationItem id="I{k}" rank="1" peptide_ref="P{k}" passThreshold="true"><PeptideEvidenceRef peptideEvidence_ref="E{k}"/>{also}<cvParam accession="MS:1002252" name="score" cvRef="M" value="3.1"/>{value}</SpectrumIdentificationItem></SpectrumIdentificationResult>\n'
    path = folder / "a.mzid"
    path.write_text(f'<?xml version="1.0"?>\n<MzIdentML xmlns="http://psidev.info/psi/pi/mzIdentML/1.1"><SequenceCollection>{seq}{pep}{ev}</SequenceCollection><DataCollection><AnalysisData><SpectrumIdentificationList id="L">{items}</SpectrumIdentificationList></AnalysisData></DataCollection></MzIdentML>')
    return str(path)


def pepxml(folder):
    hits = ""
    for k, (s, mods, p, q, _) in enumerate(PSMS):
        m = "".join(f'<mod_aminoacid_mass position="{x}" mass="113.0476"/>' for x in mods)
        info = f"<modification_info>{m}</modification_info>" if m else ""
        value = f'<search_score name="q-value" value="{q}"/>' if q is not None else ""
        hits += f'<spectrum_query spectrum="s{k}" index="{k}"><search_result><search_hit hit_rank="1" peptide="{s}" protein="{p}">{info}<search_score name="expect" value="1e-5"/>{value}</search_hit></search_result></spectrum_query>\n'
    path = folder / "a.pep.xml"
    path.write_text(f'<?xml version="1.0"?>\n<msms_pipeline_analysis xmlns="http://regis-web.systemsbiology.net/pepXML"><msms_run_summary>{hits}</msms_run_summary></msms_pipeline_analysis>')
    return str(path)


def idxml(folder):
    proteins = {p: f"PH_{i}" for i, p in enumerate(dict.fromkeys(x[2] for x in PSMS))}
    form = lambda s, places: "".join(c + ("(Oxidation)" if i + 1 in places else "") for i, c in enumerate(s))
    own = "".join(f'<ProteinHit id="{i}" accession="{p}" score="0"/>\n' for p, i in proteins.items())
    hits = "".join(f'<PeptideIdentification score_type="hyperscore"><PeptideHit score="1" sequence="{form(s, m)}" charge="2" protein_refs="{proteins[p]}"><UserParam type="string" name="target_decoy" value="{"decoy" if d else "target"}"/>{f"""<UserParam type="float" name="q-value" value="{q}"/>""" if q is not None else ""}</PeptideHit></PeptideIdentification>\n' for s, m, p, q, d in PSMS)
    path = folder / "a.idXML"
    path.write_text(f'<?xml version="1.0"?>\n<IdXML><IdentificationRun><ProteinIdentification>{own}</ProteinIdentification>{hits}</IdentificationRun></IdXML>')
    return str(path)


@pytest.mark.parametrize("write", [mzid, pepxml, idxml])
def test_targets_are_those_of_the_table(spark, tmp_path, write):
    key = lambda df: sorted(map(str, candidates.targets(df).select("peptide", "protein", "mass", "mh_mz", "hyp_base").collect()))
    table, other = readers.read_psms(spark, tsv(tmp_path)), readers.read_psms(spark, write(tmp_path))
    assert other.schema.simpleString().replace("n_hyp:int", "") == table.schema.simpleString().replace("n_hyp:int", "")
    plain = lambda df: sorted(map(str, df.select("sequence", "protein", "q", "n_hyp").collect()))
    assert plain(other) == plain(table) and other.count() == 5
    assert key(other) == key(table)
    assert [r.sequence for r in other.orderBy("psm_idx").collect()][:2] == ["AGLPGEVGAK", "AGLPGEVGAK"]


def test_more_tables(spark, tmp_path):
    (tmp_path / "m.txt").write_text("Sequence\tModified sequence\tProteins\tReverse\nAGLPGEVGAK\t_AGLP(Oxidation (P))GEVGAK_\tsp|P1|X;sp|P2|Y\t\nDEFK\t_DEFK_\tREV__P3\t+\n")
    assert [tuple(r) for r in readers.read_psms(spark, f"{tmp_path}/m.txt").select("sequence", "protein", "q", "n_hyp").collect()] == [("AGLPGEVGAK", "P1", None, 1)]
    (tmp_path / "p.tsv").write_text("PSMId\tscore\tq-value\tposterior_error_prob\tpeptide\tproteinIds\na\t1\t0.01\t0.1\tK.AGLP[15.9949]GEVGAK.R\tP1\n")
    assert [tuple(r) for r in readers.read_psms(spark, f"{tmp_path}/p.tsv").select("sequence", "protein", "q", "n_hyp").collect()] == [("AGLPGEVGAK", "P1", 0.01, 1)]
    with pytest.raises(ValueError, match="no reader"):
        readers.read_psms(spark, f"{tmp_path}/p.tsv", "unknown")
