"""Peptide chemistry as Column expressions: everything stays in generated code, no Python per row."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PROTON, NEUTRON, OXYGEN = 1.007276, 1.003355, 15.994915
FLOOR_PROTON = 1.00728  # of the least mass shift of a decoy
WATER = 18.0105646863
#: Monoisotopic residue masses.
RESIDUES = {
    "G": 57.02146372, "A": 71.03711379, "S": 87.03202841, "P": 97.05276385, "V": 99.06841391,
    "T": 101.04767847, "C": 103.00918448, "L": 113.08406398, "I": 113.08406398, "N": 114.04292745,
    "D": 115.02694303, "Q": 128.05857751, "K": 128.09496302, "E": 129.04259309, "M": 131.04048461,
    "H": 137.05891186, "F": 147.06841391, "R": 156.10111103, "Y": 163.06332853, "W": 186.07931295,
}
#: Atoms of averagine for each dalton.
AVERAGINE = {"C": 0.04443, "H": 0.06981, "N": 0.01221, "O": 0.01329, "S": 0.00037}
ATOM_MASS = {"C": 12.0, "H": 1.00782503207, "N": 14.0030740048, "O": 15.99491461956}
#: Abundance of the isotope one neutron heavier relative to the lightest, and of oxygen-18.
HEAVIER = {"C": 0.0107 / 0.9893, "H": 0.000115 / 0.999885, "N": 0.00364 / 0.99636, "O": 0.00038 / 0.99757}
OXYGEN_18 = 0.00205 / 0.99757
#: Abundances of isotopes by neutrons above the lightest.
ABUNDANCES = {
    "C": (0.9893, 0.0107), "H": (0.999885, 0.000115), "N": (0.99636, 0.00364),
    "O": (0.99757, 0.00038, 0.00205), "S": (0.9499, 0.0075, 0.0425, 0.0, 0.0001),
}
CLASSES = {"arom": "[FWYH]", "pro": "P", "acid": "[DE]", "basic": "H"}
LEAST = 1e-10


#: Masses are summed as whole numbers of this many to a dalton, so that they don't depend on the order
#: of summing and equal compositions are equal: residues have 8 decimals, atoms 11.
UNITS = 10**11


def as_units(mass: float) -> int:
    return int(Decimal(str(mass)) * UNITS)


def _by_letter(values: dict[str, int]) -> Column:
    return F.array(*(F.lit(values.get(chr(65 + i), 0)) for i in range(26)))


def residue_units(letter: Column) -> Column:
    """Mass of the residue whose letter has this code, in UNITS; 0 for others."""
    return F.coalesce(F.get(_by_letter({r: as_units(m) for r, m in RESIDUES.items()}), letter - 65), F.lit(0)).cast("long")


def peptide_units(peptide: Column) -> Column:
    """Monoisotopic mass of a sequence of the twenty residues in UNITS; others weigh nothing. One pass
    over the letters, so that the generated code stays short enough to be compiled."""
    return F.aggregate(F.split(peptide, ""), F.lit(as_units(WATER)).cast("long"), lambda m, c: m + residue_units(F.ascii(c)))


def daltons(units: Column) -> Column:
    return units.cast("double") / F.lit(float(UNITS))


def peptide_mass(peptide: Column) -> Column:
    return daltons(peptide_units(peptide))


def residual_units(units: Column) -> Column:
    """``mass_defect_residual`` in UNITS, exact but for the rounding of averagine's counts."""
    counts = averagine(daltons(units))
    other = reduce(lambda a, b: a + b, [counts[atom].cast("long") * F.lit(as_units(m)) for atom, m in ATOM_MASS.items()])
    return F.pmod(units, F.lit(UNITS)) - F.pmod(other, F.lit(UNITS))


def protonated(mass: Column) -> Column:
    return mass + F.lit(PROTON)


def query_mz(mh_mz: Column) -> Column:
    """m/z of a query, to a millionth, half to even."""
    return F.bround(mh_mz, 6)


def mz_key(mz: Column) -> Column:
    """A whole number by which query m/z are joined, not a fraction."""
    return F.bround(mz * 1e6, 0).cast("long")


def modified_name(base: Column, n: Column) -> Column:
    return F.concat(base, F.lit("+h"), n.cast("string"))


def hydroxylations(peptidoform: Column) -> Column:
    """Prolines that carry a modification within 0.01 of an oxygen's mass."""
    masses = F.transform(F.regexp_extract_all(peptidoform, F.lit(r"P\[\+?(-?[0-9]+\.?[0-9]*)\]"), F.lit(1)), lambda m: m.cast("double"))
    named = F.size(F.regexp_extract_all(peptidoform, F.lit(r"P\[Oxidation\]"), F.lit(0)))
    return F.size(F.filter(masses, lambda m: F.abs(m - 15.9949) < 0.01)) + named


def bare(peptidoform: Column) -> Column:
    """The sequence of a peptidoform, without modifications, charge and termini."""
    return F.regexp_replace(F.regexp_replace(peptidoform, r"\[[^\]]*\]|/.*$", ""), "[^A-Z]", "")


def accession(text: Column) -> Column:
    """``>sp|P1|NAME text`` gives P1; anything else its first word."""
    name = F.ltrim(F.trim(text), F.lit(">"))
    parts = F.split(name, r"\|")
    known = (F.size(parts) >= 2) & F.get(parts, F.lit(0)).isin("sp", "tr", "ref")
    return F.when(known, F.get(parts, F.lit(1))).otherwise(F.regexp_extract(name, r"^\S*", 0))


def averagine(mass: Column) -> dict[str, Column]:
    return {atom: F.rint(mass * F.lit(k)) for atom, k in AVERAGINE.items()}  # half to even


def mass_defect_residual(mass: Column) -> Column:
    """Mass defect less that of averagine (sulfur left out) of the same mass."""
    counts = averagine(mass)
    other = reduce(lambda a, b: a + b, [counts[atom] * F.lit(m) for atom, m in ATOM_MASS.items()])
    return (mass - F.floor(mass)) - (other - F.floor(other))


def isotopes(c: Column, h: Column, n: Column, o: Column) -> list[Column]:
    """M, M+1 and M+2 of a composition, summing to one: elementary symmetric sums of the relative
    abundances, no convolution."""
    counts = {"C": c, "H": h, "N": n, "O": o}
    one = reduce(lambda a, b: a + b, [counts[a] * F.lit(r) for a, r in HEAVIER.items()])
    squares = reduce(lambda a, b: a + b, [counts[a] * F.lit(r * r) for a, r in HEAVIER.items()])
    two = (one * one - squares) / 2 + o * F.lit(OXYGEN_18)
    total = F.lit(1.0) + one + two
    return [F.lit(1.0) / total, one / total, two / total]


def power_sums(abundances: tuple[float, ...], peaks: int) -> list[float]:
    """k times the k-th coefficient of the logarithm of an element's isotope polynomial, for k from 1:
    what an atom adds to Newton's identities. Plain numbers, since abundances are fixed."""
    a = [x / abundances[0] for x in abundances] + [0.0] * peaks
    out: list[float] = []
    for k in range(1, peaks):
        out.append(k * a[k] - sum(out[j - 1] * a[k - j] for j in range(1, k)))
    return out


def isotope_envelope(counts: dict[str, Column], peaks: int) -> Column:
    """The first ``peaks`` isotope peaks of a composition as an array that sums to one. The logarithm of a
    product is a sum, so that elements' power sums are added, and the peaks follow one from the other
    by Newton's identities, k e_k = p_1 e_(k-1) + ... + p_k e_0: no polynomial is multiplied."""
    sums = {atom: power_sums(ABUNDANCES[atom], peaks) for atom in counts}
    p = F.array(*(reduce(lambda a, b: a + b, [n * F.lit(sums[atom][k]) for atom, n in counts.items()]) for k in range(peaks - 1)))

    def grow(e: Column, k: Column) -> Column:
        terms = F.zip_with(F.slice(p, F.lit(1), k), F.reverse(e), lambda x, y: x * y)
        return F.concat(e, F.array(F.aggregate(terms, F.lit(0.0), lambda t, x: t + x) / k))

    peaks_of = F.aggregate(F.sequence(F.lit(1), F.lit(peaks - 1)), F.array(F.lit(1.0)), grow) if peaks > 1 else F.array(F.lit(1.0))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda t, x: t + x)
    return F.element_at(F.transform(F.array(peaks_of), lambda e: F.transform(e, lambda x: x / total(e))), 1)


def averagine_envelope(mz: Column, peaks: int, sulphur: bool = True) -> Column:
    """``isotope_envelope`` of averagine at a protonated m/z."""
    counts = averagine(mz - F.lit(PROTON))
    return isotope_envelope({a: n for a, n in counts.items() if sulphur or a != "S"}, peaks)


def averagine_isotopes(mz: Column) -> list[Column]:
    a = averagine(mz - F.lit(PROTON))
    return isotopes(a["C"], a["H"], a["N"], a["O"])


def envelope_kl(mz: Column, envelope: list[Column]) -> Column:
    """Kullback-Leibler divergence of an observed envelope from averagine's; 0 without signal."""
    total = reduce(lambda a, b: a + b, envelope)
    terms = []
    for seen, expected in zip(envelope, averagine_isotopes(mz), strict=True):
        o = F.greatest(F.try_divide(seen, total), F.lit(LEAST))
        terms.append(o * F.ln(o / F.greatest(expected, F.lit(LEAST))))
    return F.when(total > 0, reduce(lambda a, b: a + b, terms)).otherwise(F.lit(0.0))


def class_count(peptide: Column, name: str) -> Column:
    return F.regexp_count(peptide, F.lit(CLASSES[name]))


def ppm_bin(mz: Column, query: Column, half: int = 25) -> Column:
    """Bin of a parts-per-million profile, 0 for -half; truncated toward zero before the shift."""
    return ((mz / query - 1) * 1e6 + 40 + 0.5).cast("int") - (40 - half)
