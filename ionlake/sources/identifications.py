"""Identifications in XML: their row elements are read by Spark's XML source, references between them
(item to evidence to sequence) are resolved by joins, modifications come from nested arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chem

# Terms and names under which files give a q-value, the most specific first, and prefixes of decoy proteins.
Q_TERMS = ("MS:1002354", "MS:1001491", "MS:1002054", "MS:1001868")
Q_NAMES = ("q-value", "qvalue", "percolator_qvalue", "percolator q-value")
DECOY_PREFIXES = ("DECOY_", "decoy_", "rev_", "REV_", "reverse_")
HYDROXYL, TOLERANCE = 15.9949, 0.01


def _rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def _letter(sequence: Column, place: Column) -> Column:
    return F.substring(sequence, place, F.lit(1))


def _first_value(found: Column, key: str, names: tuple[str, ...]) -> Column:
    """The value of the first of ``names`` that an array of (key, _value) has, as a number."""
    of = lambda name: F.get(F.filter(found, lambda x: F.lower(x[key]) == name.lower()), F.lit(0))["_value"]
    return F.coalesce(*(of(name).try_cast("double") for name in names))


def _finished(rows: DataFrame) -> DataFrame:
    """As tables of identifications are read: targets with a sequence, NaN as null."""
    q = F.when(~F.isnan("q"), F.col("q"))
    found = rows.select("psm_idx", F.upper("sequence").alias("sequence"), chem.accession(F.col("protein")).alias("protein"), q.alias("q"), F.coalesce("n_hyp", F.lit(0)).alias("n_hyp"), F.coalesce("is_decoy", F.lit(False)).alias("is_decoy"))
    return found.where("sequence is not null and sequence <> '' and not is_decoy")


def read_mzid(spark: SparkSession, path: str) -> DataFrame:
    """psm_idx, sequence, protein, q, n_hyp and is_decoy of an mzIdentML file. An item is a decoy if all
    its evidence is; its protein is that of its first evidence."""
    items = _rows(spark, path, "SpectrumIdentificationItem", "_peptide_ref string, PeptideEvidenceRef array<struct<_peptideEvidence_ref string>>, cvParam array<struct<_accession string, _value string>>")
    items = items.withColumn("psm_idx", F.monotonically_increasing_id())  # file order
    peptides = _rows(spark, path, "Peptide", "_id string, PeptideSequence string, Modification array<struct<_location int, _monoisotopicMassDelta double, _residues string>>")
    evidence = _rows(spark, path, "PeptideEvidence", "_id string, _dBSequence_ref string, _peptide_ref string, _isDecoy boolean")
    proteins = _rows(spark, path, "DBSequence", "_id string, _accession string")
    named = evidence.join(proteins.withColumnRenamed("_id", "_dBSequence_ref"), "_dBSequence_ref", "left").select(F.col("_id").alias("ref"), "_accession", F.coalesce("_isDecoy", F.lit(False)).alias("decoy"))
    refs = items.select("psm_idx", F.posexplode("PeptideEvidenceRef._peptideEvidence_ref").alias("at", "ref")).join(named, "ref")
    of_item = refs.groupBy("psm_idx").agg(F.min_by("_accession", "at").alias("protein"), F.min("decoy").alias("is_decoy"))
    sequence = F.col("PeptideSequence")
    on_proline = lambda m: _letter(sequence, m["_location"]) == "P"
    hyp = F.size(F.filter("Modification", lambda m: on_proline(m) & (F.abs(m["_monoisotopicMassDelta"] - HYDROXYL) < TOLERANCE)))
    forms = peptides.select(F.col("_id").alias("_peptide_ref"), sequence.alias("sequence"), F.when(F.col("Modification").isNotNull(), hyp).otherwise(0).alias("n_hyp"))
    rows = items.select("psm_idx", "_peptide_ref", _first_value(F.col("cvParam"), "_accession", Q_TERMS).alias("q"))
    return _finished(rows.join(forms, "_peptide_ref").join(of_item, "psm_idx", "left"))


def read_pepxml(spark: SparkSession, path: str) -> DataFrame:
    """The same of a pepXML file. Masses of modified residues are whole, so that a residue's own is taken
    off; decoys are told by their protein's prefix."""
    schema = "_peptide string, _protein string, modification_info struct<mod_aminoacid_mass array<struct<_position int, _mass double>>>, search_score array<struct<_name string, _value string>>"
    hits = _rows(spark, path, "search_hit", schema).withColumn("psm_idx", F.monotonically_increasing_id())
    masses = F.col("modification_info.mod_aminoacid_mass")
    hyp = F.size(F.filter(masses, lambda m: (_letter(F.col("_peptide"), m["_position"]) == "P") & (F.abs(m["_mass"] - chem.RESIDUES["P"] - HYDROXYL) < TOLERANCE)))
    decoy = F.lit(False)
    for prefix in DECOY_PREFIXES:
        decoy = decoy | F.startswith(F.col("_protein"), F.lit(prefix))
    return _finished(hits.select("psm_idx", F.col("_peptide").alias("sequence"), F.col("_protein").alias("protein"), _first_value(F.col("search_score"), "_name", Q_NAMES).alias("q"), F.when(masses.isNotNull(), hyp).otherwise(0).alias("n_hyp"), decoy.alias("is_decoy")))


def read_idxml(spark: SparkSession, path: str) -> DataFrame:
    """The same of an idXML file. Sequences hold their modifications by name or mass; a hit's first protein
    counts, and a hit is a decoy if its target_decoy says so."""
    hits = _rows(spark, path, "PeptideHit", "_score double, _sequence string, _protein_refs string, UserParam array<struct<_name string, _value string>>").withColumn("psm_idx", F.monotonically_increasing_id())
    proteins = _rows(spark, path, "ProteinHit", "_id string, _accession string").select(F.col("_id").alias("ref"), F.col("_accession").alias("protein")).dropDuplicates(["ref"])
    scored = _rows(spark, path, "PeptideIdentification", "_score_type string").agg(F.max(F.lower("_score_type").isin(*Q_NAMES)).alias("__by_q"))
    form = F.regexp_replace("_sequence", r"\((Oxidation|Hydroxylation)\)", "[Oxidation]")
    label = F.lower(F.get(F.filter("UserParam", lambda x: x["_name"] == "target_decoy"), F.lit(0))["_value"])
    named = _first_value(F.col("UserParam"), "_name", Q_NAMES)
    rows = hits.join(F.broadcast(scored)).withColumn("ref", F.get(F.split(F.trim("_protein_refs"), r"\s+"), F.lit(0)))  # one row
    rows = rows.join(proteins, "ref", "left")
    return _finished(rows.select("psm_idx", chem.bare(F.regexp_replace(form, r"\([^)]*\)", "")).alias("sequence"), "protein", F.coalesce(named, F.when(F.col("__by_q"), F.col("_score"))).alias("q"), chem.hydroxylations(form).alias("n_hyp"), (label == "decoy").alias("is_decoy")))


#: Readers of XML, with the ends of file names by which they are known.
XML_READERS = {"mzid": (read_mzid, (".mzid", ".mzidentml")), "pepxml": (read_pepxml, (".pepxml", ".pep.xml")), "idxml": (read_idxml, (".idxml",))}


def xml_reader(path: str, reader: str):
    """The reader of a name, or of a file's name if the reader is to be inferred; None for tables."""
    if reader in XML_READERS:
        return XML_READERS[reader][0]
    name = path.lower().removesuffix(".gz")
    return next((read for read, ends in XML_READERS.values() if name.endswith(ends)), None) if reader == "infer" else None
