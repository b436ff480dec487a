"""Targets, decoys by residue substitution, and the candidate set of a run."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chem
from .draws import ALPHABET, Drawing, Hashed, Seeded, best_of_rows
from .lineage import cut

# Decoy methods with their keys in priority order and variants for each target.
METHODS = {"d1c_raw": (("arom", "pro", "acid", "basic"), 100), "d1b": (("arom",), 30)}
FDR, EXCLUDE_PPM = 0.01, 20.0
ISOTOPE_STEPS, OXYGEN_STEPS = (0, 1, -1, 2, -2), (0, 1, -1, 2, -2, 3, -3)


def targets(psms: DataFrame) -> DataFrame:
    """peptide, protein, mass, mh_mz, hyp_base and row_order of the targets of identifications
    (psm_idx, sequence, protein, q, n_hyp, is_decoy).

    If any q is present, peptides need one at or below FDR and modified forms come from such rows
    alone. The protein is that of the row of least q, ties by psm_idx."""
    rows = psms.where("not is_decoy and sequence is not null")
    rows = rows.join(F.broadcast(rows.agg(F.coalesce(F.max(F.col("q").isNotNull()), F.lit(False)).alias("__any"))))  # one row
    rows = rows.withColumn("__ok", ~F.col("__any") | F.coalesce(F.col("q") <= FDR, F.lit(False)))
    base = rows.groupBy("sequence").agg(F.max("__ok").alias("__ok"), F.min_by("protein", F.struct(F.col("q").isNull(), "q", "psm_idx")).alias("protein")).where("__ok")
    mass = chem.peptide_mass(F.col("sequence"))
    base = base.select(F.col("sequence").alias("peptide"), "protein", mass.alias("mass")).withColumn("mh_mz", chem.protonated(F.col("mass")))
    forms = rows.where("__ok and n_hyp > 0").select(F.col("sequence").alias("hyp_base"), F.col("n_hyp").cast("int").alias("n")).distinct()
    forms = forms.join(base, F.col("hyp_base") == F.col("peptide")).select(
        chem.modified_name(F.col("hyp_base"), F.col("n")).alias("peptide"),
        "protein",
        (F.col("mass") + F.col("n") * chem.OXYGEN).alias("mass"),
        (F.col("mh_mz") + F.col("n") * chem.OXYGEN).alias("mh_mz"),
        "hyp_base",
        F.struct(F.lit(1).alias("form"), F.col("n").alias("n"), F.col("hyp_base").alias("name")).alias("row_order"),
    )
    return base.select("peptide", "protein", "mass", "mh_mz", F.lit(None).cast("string").alias("hyp_base"), F.struct(F.lit(0).alias("form"), F.lit(0).alias("n"), F.col("peptide").alias("name")).alias("row_order")).unionByName(forms)


def residue_frequency(base: DataFrame) -> DataFrame:
    """residue, n and share of ALPHABET's letters over the sequences of ``base``."""
    counts = base.select(F.explode(F.split("peptide", "")).alias("residue")).where(F.col("residue").isin(*ALPHABET)).groupBy("residue").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("__all")))).select("residue", "n", (F.col("n") / F.col("__all")).alias("share"))


def varied(src: Column, i: Column, a: Column, j: Column, b: Column) -> Column:
    """``src`` with the letters of codes ``a`` and ``b`` at places ``i`` and ``j`` (from 1)."""
    put = lambda text, at, code: F.concat(F.substring(text, F.lit(1), at - 1), F.char(code), F.substring(text, at + 1, F.length(text)))
    return put(put(src, i, a), j, b)


def _with_variant(draws: DataFrame) -> DataFrame:
    return draws.withColumn("variant", varied(F.col("src"), F.col("i"), F.col("a"), F.col("j"), F.col("b")))


def seeded_draws(base: DataFrame, seed: int, variants: int, some: DataFrame | None = None) -> DataFrame:
    """src, draw, i, a, j, b and variant: random substitutions of two interior residues that aren't K,
    R, C or M, each by another of ALPHABET with its frequency in ``base``. A peptide's generator is
    seeded by ``seed`` and the MD5 of its sequence, so that a variant doesn't depend on where it is
    drawn. ``some``: the peptides that are asked for, if not all of ``base``."""
    return _with_variant(Seeded(base, seed, variants)(base if some is None else some))


def hashed_draws(base: DataFrame, seed: int, variants: int, some: DataFrame | None = None) -> DataFrame:
    """Like ``seeded_draws``, but places and residues come from an MD5, each residue of ALPHABET being
    as likely as any. For checks in SQL."""
    return _with_variant(Hashed(base, seed, variants)(base if some is None else some))


def best_variants(draw: Callable[[DataFrame], DataFrame], base: DataFrame, keys: Sequence[str] = METHODS["d1c_raw"][0], floor_da: float | None = None) -> DataFrame:
    """src, variant and mass: each target's variant that is closest in residue classes (in the order
    of ``keys``), then in mass-defect residual, then by draw. Variants that are targets or move the
    mass by less than the floor are left out. ``draw`` gives the draws of those peptides of ``base``
    that it is given.

    A draw is compared by what its two substitutions change: whole numbers of classes and of mass
    units, so that ties are ties. A Drawing finds the least where it draws; of other draws it is found by
    a pre-aggregated minimum. The few peptides whose best variant is a target are asked again, and only
    of these all variants are held against the targets. ``base`` is read several times."""
    known = base.select(F.col("peptide").alias("variant"))
    asked = base.select("peptide")
    best = cut(_with_variant(draw.best(asked, keys, floor_da) if isinstance(draw, Drawing) else best_of_rows(draw(asked), keys, floor_da)))
    taken = cut(best.join(known, "variant", "left_semi").select("src"))
    again = _with_variant(draw(taken.select(F.col("src").alias("peptide")))).join(known, "variant", "left_anti")
    rest = _with_variant(best_of_rows(again, keys, floor_da))
    columns = ["src", "variant", chem.daltons(F.col("units")).alias("mass")]
    return best.join(taken, "src", "left_anti").select(columns).unionByName(rest.select(columns))


def unique_variants(best: DataFrame) -> DataFrame:
    """Of targets that share a variant the one that sorts first keeps it; the others have none."""
    return best.groupBy("variant").agg(F.min(F.struct("src", "mass")).alias("b")).select("b.src", "variant", "b.mass")


def decoys(found: DataFrame, seed: int, method: str = "d1c_raw", floor_da: float | None = None, drawing: type[Drawing] = Seeded) -> DataFrame:
    """Decoys of one seed for ``targets``' rows, modified forms by their base's decoy: peptide,
    protein, mass, mh_mz, parent_peptide and row_order."""
    keys, variants = METHODS[method]
    base = cut(found.where("hyp_base is null").select("peptide"))
    chosen = unique_variants(best_variants(drawing(base, seed, variants), base, keys, floor_da))
    rows = found.withColumn("src", F.coalesce("hyp_base", "peptide")).select("src", F.col("peptide").alias("parent_peptide"), "protein", "hyp_base", "row_order").join(chosen, "src")
    n = F.when(F.col("hyp_base").isNotNull(), F.regexp_extract("parent_peptide", r"\+h([0-9]+)$", 1).cast("int")).otherwise(0)
    return rows.select(
        F.when(F.col("hyp_base").isNull(), F.col("variant")).otherwise(chem.modified_name(F.col("variant"), n)).alias("peptide"),
        F.concat(F.lit("DECOY_"), "protein").alias("protein"),
        (F.col("mass") + n * chem.OXYGEN).alias("mass"),
        (chem.protonated(F.col("mass")) + n * chem.OXYGEN).alias("mh_mz"),
        "parent_peptide",
        "row_order",
    )


def in_parent_family(mh_mz: Column, parent_mz: Column, ppm: float = EXCLUDE_PPM) -> Column:
    """Whether an ion lies within ``ppm`` of its parent's isotopes or oxidised forms; not without parent."""
    shifts = F.array(*(F.lit(n * chem.NEUTRON + k * chem.OXYGEN) for n in ISOTOPE_STEPS for k in OXYGEN_STEPS))
    return F.coalesce(F.exists(shifts, lambda x: F.abs(mh_mz - parent_mz - x) <= mh_mz * (ppm * 1e-6)), F.lit(False))


def without_parent_family(candidates: DataFrame, all_targets: DataFrame, ppm: float = EXCLUDE_PPM) -> DataFrame:
    """Drops decoys in their parent's family; parents are looked up among all targets, in range or not."""
    parents = all_targets.groupBy(F.col("peptide").alias("parent_peptide")).agg(F.first("mh_mz").alias("__parent"))
    joined = candidates.join(parents, "parent_peptide", "left")
    return joined.where(~(F.col("is_decoy") & in_parent_family(F.col("mh_mz"), F.col("__parent"), ppm))).select(*candidates.columns)


def first_of_seeds(rows: DataFrame, order: str = "row_id") -> DataFrame:
    """A decoy whose name occurred in an earlier row, target or decoy, goes; targets stay."""
    first = F.min(order).over(Window.partitionBy("peptide"))
    return rows.withColumn("__first", first).where(~F.col("is_decoy") | (F.col(order) == F.col("__first"))).drop("__first")


def candidate_set(found: DataFrame, seeds: Sequence[int], method: str = "d1c_raw", floor_da: float | None = None, mz_range: tuple[float, float] | None = None, drawing: type[Drawing] = Seeded) -> DataFrame:
    """All candidates of a run with feature_mz, seed, is_decoy, parent_peptide and row_id. row_id is a
    struct that sorts as targets first, then the seeds' decoys, each by feature_mz, mh_mz and order;
    no global sort is needed for it."""
    columns = ["peptide", "protein", "mass", "mh_mz", "hyp_base", "parent_peptide", "is_decoy", "seed", "__part", "row_order"]
    parts = found.withColumns({"parent_peptide": F.lit(None).cast("string"), "is_decoy": F.lit(False), "seed": F.lit(seeds[0]), "__part": F.lit(0)}).select(columns)
    for i, seed in enumerate(seeds):
        own = decoys(found, seed, method, floor_da, drawing).withColumns({"hyp_base": F.lit(None).cast("string"), "is_decoy": F.lit(True), "seed": F.lit(seed), "__part": F.lit(i + 1)})
        parts = parts.unionByName(own.select(columns))
    rows = parts.withColumn("feature_mz", chem.query_mz(F.col("mh_mz")))
    if mz_range is not None:
        rows = rows.where(F.col("feature_mz").between(*mz_range))
    rows = rows.withColumn("row_id", F.struct("__part", "feature_mz", "mh_mz", "row_order")).drop("__part", "row_order")
    return without_parent_family(first_of_seeds(rows), found)
