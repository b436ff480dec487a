"""Inputs of a run as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chem
from . import imaging
from .identifications import xml_reader

#: Column names of identification tables by reader; "infer" finds the first that fits the header.
READERS = {
    "tsv": {"sequence": "peptidoform", "protein": "protein_list", "q": "qvalue", "decoy": "is_decoy"},
    "fragpipe": {"sequence": "Modified Peptide", "bare": "Peptide", "protein": "Protein", "q": "Qvalue", "decoy": None},
    "sage": {"sequence": "peptide", "protein": "proteins", "q": "spectrum_q", "decoy": "label"},
    "maxquant": {"sequence": "Modified sequence", "bare": "Sequence", "protein": "Proteins", "q": "q-value", "decoy": "Reverse"},
    "percolator": {"sequence": "peptide", "protein": "proteinIds", "q": "q-value", "decoy": None},
    "plain": {"sequence": "sequence", "protein": "protein", "q": "q", "decoy": "is_decoy"},
}


def read_psms(spark: SparkSession, path: str, reader: str = "infer") -> DataFrame:
    """psm_idx, sequence, protein, q, n_hyp and is_decoy of a tab-separated identification table, or of a
    file of mzIdentML, pepXML or idXML."""
    if read := xml_reader(path, reader):
        return read(spark, path)
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    if reader == "infer":
        reader = next((name for name, c in READERS.items() if {c["sequence"], c["protein"]} <= set(raw.columns)), "")
    if reader not in READERS:
        raise ValueError(f"no reader for the columns {raw.columns}")
    c = READERS[reader]
    form = F.col(f"`{c['sequence']}`")
    if "bare" in c and c["bare"] in raw.columns:
        form = F.coalesce(F.when(form == "", None).otherwise(form), F.col(f"`{c['bare']}`"))
    # flanking residues (K.PEPTIDE.R), and modifications in nested brackets
    form = F.regexp_replace(F.regexp_replace(form, r"^[A-Z-]\.|\.[A-Z-]$", ""), r"\((Oxidation|Hydroxylation) \(P\)\)", "[Oxidation]")
    text = lambda key: F.col(f"`{c[key]}`") if c[key] in raw.columns else F.lit(None).cast("string")
    decoy = F.lower(text("decoy")).isin("true", "1", "-1", "decoy", "+") if c["decoy"] else F.lit(False)
    q = F.expr(f"try_cast(`{c['q']}` as double)") if c["q"] in raw.columns else F.lit(None).cast("double")
    rows = raw.select(
        F.monotonically_increasing_id().alias("psm_idx"),  # file order
        F.when(form.isNotNull(), chem.bare(form)).alias("sequence"),
        chem.accession(F.split(F.translate(text("protein"), "[]'\"", ""), r"[;,]").getItem(0)).alias("protein"),
        F.when(~F.isnan(q), q).alias("q"),
        F.when(form.isNotNull(), chem.hydroxylations(F.regexp_replace(form, r"P\(([^)]*)\)", r"P[$1]"))).otherwise(0).alias("n_hyp"),
        F.coalesce(decoy, F.lit(False)).alias("is_decoy"),
    )
    return rows.where("sequence is not null and not is_decoy")


def read_events(spark: SparkSession, path: str, mz_range: tuple[float, float] | None = None) -> DataFrame:
    """frame, mz and inten (scan and tof where there are any) from Parquet or an imaging file. A range
    reaches the scan as a pushed filter."""
    rows = imaging.read(spark, path).select("frame", "mz", "inten") if imaging.is_imaging(path) else spark.read.parquet(path)
    return rows.where(F.col("mz").between(*mz_range)) if mz_range else rows


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """frame, x, y and tic from Parquet or an imaging file."""
    return imaging.read(spark, path, "frames") if imaging.is_imaging(path) else spark.read.parquet(path)


def read_frames_sqlite(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[float, float]]:
    """Frame metadata and the acquired m/z range of an acquisition's SQLite file, which is small and
    local to the driver."""
    import sqlite3

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        rows = db.execute("select m.Frame, m.XIndexPos, m.YIndexPos, f.SummedIntensities from MaldiFrameInfo m left join Frames f on f.Id = m.Frame order by m.Frame").fetchall()
        bounds = dict(db.execute("select Key, Value from GlobalMetadata where Key in ('MzAcqRangeLower', 'MzAcqRangeUpper')").fetchall())
    frames = spark.createDataFrame([(int(f), int(x), int(y), None if t is None else float(t)) for f, x, y, t in rows], "frame int, x int, y int, tic double")
    return frames, (float(bounds["MzAcqRangeLower"]), float(bounds["MzAcqRangeUpper"]))


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    """pix and is_on of a Boolean array in a .npy file."""
    import numpy as np

    mask = np.load(path).ravel().astype(bool)
    return spark.createDataFrame([(i, bool(on)) for i, on in enumerate(mask)], "pix int, is_on boolean")


def known_peptides(lines: DataFrame) -> DataFrame:
    """peptide: candidates' names of a list of known ones (column value). Lines whose only
    modifications are oxidised prolines become ``sequence+h<n>``; other modified lines are left out."""
    line = F.replace(F.trim("value"), F.lit("[16]"), F.lit("[Oxidation]"))
    rows = lines.select(line.alias("x")).where("x <> ''")
    n = F.regexp_count("x", F.lit(r"P\[Oxidation\]"))
    marks = F.regexp_count("x", F.lit(r"\["))
    named = F.when(marks == 0, F.col("x")).when(marks == n, chem.modified_name(F.replace("x", F.lit("[Oxidation]"), F.lit("")), n))
    return rows.select(named.alias("peptide")).where("peptide is not null").distinct()


def read_known_peptides(spark: SparkSession, path: str) -> DataFrame:
    return known_peptides(spark.read.text(path))


def read_results(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a finished run."""
    tsv = lambda name: spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(f"{folder}/{name}")
    return {"rows": spark.read.parquet(f"{folder}/rows.parquet"), "evidence": spark.read.parquet(f"{folder}/evidence.parquet"), "peptides": tsv("peptides.tsv"), "proteins": tsv("proteins.tsv"), "run": spark.read.option("multiLine", True).json(f"{folder}/run.json")}
