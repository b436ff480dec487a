"""Random substitutions of peptides, and the best one of each peptide, a batch of peptides at a time.

A drawing is called with peptides and gives a row for each draw; ``best`` gives a row for each peptide
instead, so that draws never leave the task that makes them. Both come from the same numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chem

try:  # half the time of the one in hashlib for a short text
    from _md5 import md5
except ImportError:
    from hashlib import md5

#: Substitutes (no cleavage site, no sulfur), and what isn't substituted.
ALPHABET, FIXED = "ADEFGHILNPQSTVWY", "KRCM"
FLOOR_PPM = 10.0
#: Bits of a residual's difference (of two fractions of a dalton, in units) and of a draw's number.
RESIDUAL_BITS, DRAW_BITS = 38, 10
#: Peptides whose draws are made at once.
AT_ONCE = 250
#: Letters have their places in tables of so many; any other character has the last one.
CODES = 128
PLACES = "i int, a int, j int, b int"

_MASS = np.zeros(CODES, np.int64)
_MASS[[ord(r) for r in chem.RESIDUES]] = [chem.as_units(m) for m in chem.RESIDUES.values()]
_RANK = np.full(CODES, -1)
_RANK[[ord(r) for r in ALPHABET]] = range(len(ALPHABET))
_FREE = np.ones(CODES, bool)
_FREE[[ord(r) for r in FIXED]] = False


@dataclass(frozen=True)
class Letters:
    """The codes of some peptides one after the other; peptide p has those from start[p] on."""

    codes: np.ndarray
    start: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, peptides: Sequence[str]) -> Letters:
        length = np.fromiter(map(len, peptides), np.int64, len(peptides))
        codes = np.frombuffer("".join(peptides).encode("utf-32-le", "surrogatepass"), np.uint32)
        return cls(np.minimum(codes, CODES - 1), np.cumsum(length) - length, length)

    def units(self) -> np.ndarray:
        """``chem.peptide_units`` of each peptide."""
        return np.diff(np.concatenate([[0], np.cumsum(_MASS[self.codes])])[np.append(self.start, len(self.codes))]) + chem.as_units(chem.WATER)

    def at(self, peptide: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The codes at some places, from 1."""
        return self.codes[self.start[peptide] + place - 1]


@dataclass(frozen=True)
class Draws:
    """Row by row: peptide (its number in the batch), draw, and codes a and b for places i and j."""

    peptide: np.ndarray
    draw: np.ndarray
    i: np.ndarray
    a: np.ndarray
    j: np.ndarray
    b: np.ndarray

    def columns(self) -> list[pa.Array]:
        return [pa.array(x.astype(np.int32)) for x in (self.draw, self.i, self.a, self.j, self.b)]


def _residual(units: np.ndarray) -> np.ndarray:
    """``chem.residual_units``."""
    daltons = units / float(chem.UNITS)
    other = sum(np.rint(daltons * chem.AVERAGINE[atom]).astype(np.int64) * chem.as_units(m) for atom, m in chem.ATOM_MASS.items())
    return units % chem.UNITS - other % chem.UNITS


def ordered(letters: Letters, draws: Draws, keys: Sequence[str], floor_da: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a draw moves the mass enough, its place in the order of its peptide's draws (one number:
    RESIDUAL_BITS for the residual, DRAW_BITS for the draw, two bits for each class above them), and
    the variant's mass in units."""
    old = [letters.at(draws.peptide, draws.i), letters.at(draws.peptide, draws.j)]
    new = [draws.a, draws.b]
    m0 = letters.units()
    change = sum(_MASS[n] - _MASS[o] for n, o in zip(new, old, strict=True))
    least = np.full(len(m0), floor_da) if floor_da is not None else (m0 / float(chem.UNITS) + chem.FLOOR_PROTON) * (FLOOR_PPM / 1e6)
    away = np.zeros(len(change), np.int64)
    for key in keys:
        member = np.zeros(CODES, np.int64)
        member[[ord(r) for r in chem.CLASSES[key].strip("[]")]] = 1
        away = away * 4 + np.abs(sum(member[n] - member[o] for n, o in zip(new, old, strict=True)))
    units = m0[draws.peptide] + change
    residual = np.abs(_residual(units) - _residual(m0)[draws.peptide])
    order = (away << (RESIDUAL_BITS + DRAW_BITS)) + (residual << DRAW_BITS) + draws.draw
    return np.abs(change) / float(chem.UNITS) >= least[draws.peptide], order, units


class Drawing:
    """``base``: the peptides of which targets are made; ``variants``: draws of each."""

    def __init__(self, base: DataFrame, seed: int, variants: int):
        self.base, self.seed, self.variants = base, seed, variants

    def drawer(self):
        """A function that draws for a list of peptides: Draws, by peptide and draw."""
        raise NotImplementedError

    def __call__(self, some: DataFrame) -> DataFrame:
        """src, draw, i, a, j and b: a row for each draw of the peptides of ``some``."""
        drawn = self.drawer()

        def run(peptides: list[str]) -> pa.RecordBatch:
            found = drawn(peptides)
            return pa.RecordBatch.from_arrays([pa.array(peptides).take(pa.array(found.peptide)), *found.columns()], ["src", "draw", "i", "a", "j", "b"])

        return self._mapped(some, run, f"src string, draw int, {PLACES}")

    def best(self, some: DataFrame, keys: Sequence[str], floor_da: float | None) -> DataFrame:
        """src, i, a, j, b and units of the draw of each peptide of ``some`` that is first in order."""
        drawn = self.drawer()

        def run(peptides: list[str]) -> pa.RecordBatch:
            found, letters = drawn(peptides), Letters.of(peptides)
            enough, order, units = ordered(letters, found, keys, floor_da)
            rows = np.nonzero(enough)[0]
            rows = rows[np.lexsort((order[rows], found.peptide[rows]))]
            rows = rows[np.unique(found.peptide[rows], return_index=True)[1]]
            places = [pa.array(x[rows].astype(np.int32)) for x in (found.i, found.a, found.j, found.b)]
            return pa.RecordBatch.from_arrays([pa.array(peptides, pa.string()).take(pa.array(found.peptide[rows])), *places, pa.array(units[rows])], ["src", "i", "a", "j", "b", "units"])

        return self._mapped(some, run, f"src string, {PLACES}, units long")

    def _mapped(self, some: DataFrame, run, schema: str) -> DataFrame:
        def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in found:
                peptides = batch.column(0).to_pylist()
                for at in range(0, len(peptides), AT_ONCE):
                    yield run(peptides[at : at + AT_ONCE])

        context = some.sparkSession.sparkContext
        tasks = max(4 * context.defaultParallelism, int(some.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few rows, but each has many draws
        asked = some.select("peptide").where("peptide is not null").repartition(tasks, "peptide").distinct()
        return asked.mapInArrow(batches, schema)


class Hashed(Drawing):
    """Places and residues come from an MD5 of seed, sequence and draw; any of ALPHABET is as likely."""

    def drawer(self):
        seed, variants = self.seed, self.variants

        def drawn(peptides: list[str]) -> Draws:
            letters = Letters.of(peptides)
            asked = np.nonzero(letters.length >= 4)[0]
            ends = [str(n).encode() for n in range(variants)]
            starts = [f"{seed}|{peptides[p]}|".encode() for p in asked.tolist()]
            bytes_of = np.frombuffer(b"".join([md5(s + e).digest() for s in starts for e in ends]), np.uint8).reshape(-1, 16).astype(np.int64)
            number = lambda k: (bytes_of[:, k] << 16) + (bytes_of[:, k + 1] << 8) + bytes_of[:, k + 2]
            alphabet = np.array(list(map(ord, ALPHABET)))
            peptide, draw = np.repeat(asked, variants), np.tile(np.arange(variants), len(asked))
            interior = letters.length[peptide] - 2
            i, j = number(0) % interior + 2, number(6) % interior + 2
            kept = (i != j) & _FREE[letters.at(peptide, i)] & _FREE[letters.at(peptide, j)]
            rows = (peptide, draw, i, alphabet[number(3) % len(ALPHABET)], j, alphabet[number(9) % len(ALPHABET)])
            return Draws(*(x[kept] for x in rows))

        return drawn


class Seeded(Drawing):
    """Two different places, and for each a residue by its frequency in ``base``, as numpy's generator
    (PCG64, seeded by ``seed`` and the MD5 of the sequence) draws them by ``choice(places, 2,
    replace=False)`` and two ``random()``. The generator gives its 64-bit words at once; the draws of a
    batch are made of them together. A peptide whose words numpy might refuse (one in some 10^6) is
    drawn by numpy itself."""

    def __init__(self, base: DataFrame, seed: int, variants: int):
        super().__init__(base, seed, variants)
        from .candidates import residue_frequency

        shares = {r["residue"]: r["share"] for r in residue_frequency(base).collect()}  # at most as many as ALPHABET
        self.others, self.edges = np.zeros((len(ALPHABET), len(ALPHABET) - 1), np.int64), np.zeros((len(ALPHABET), len(ALPHABET) - 1))
        for k, residue in enumerate(ALPHABET):
            others = [a for a in ALPHABET if a != residue]
            p = np.array([shares.get(a, 0.0) for a in others])
            p = p / p.sum() if p.sum() else np.full(len(others), 1 / len(others))
            edges = p.cumsum()
            self.others[k], self.edges[k] = list(map(ord, others)), edges / edges[-1]

    def drawer(self):
        seed, variants, others, edges = self.seed, self.variants, self.others, self.edges

        def generator_of(peptide: str) -> np.random.PCG64:
            return np.random.PCG64([seed, int.from_bytes(hashlib.md5(peptide.encode()).digest()[:8], "little")])

        def plain(peptide: str, n: int) -> np.ndarray:
            """Rows of two positions among ``n`` places and two fractions."""
            generator = np.random.default_rng(generator_of(peptide))
            return np.array([[*generator.choice(n, 2, replace=False), generator.random(), generator.random()] for _ in range(variants)])

        def pairs(peptides: list[str], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Two positions among the ``n`` places of each peptide and two fractions, for each draw."""
            words = np.stack([generator_of(p).random_raw(7 * (variants + 1) // 2) for p in peptides])
            few = n == 2
            even, odd = np.arange(0, variants, 2), np.arange(1, variants, 2)
            base = np.empty(variants, np.int64)  # of three 32-bit numbers two draws share the middle word
            base[even], base[odd] = even // 2 * 7, odd // 2 * 7 + 4
            low, high = words & np.uint64(0xFFFFFFFF), words >> np.uint64(32)
            first, second, third = (np.empty((len(peptides), variants), np.uint64) for _ in range(3))
            first[:, even], second[:, even], third[:, even] = low[:, base[even]], high[:, base[even]], low[:, base[even] + 1]
            first[:, odd], second[:, odd], third[:, odd] = high[:, base[odd] - 3], low[:, base[odd]], high[:, base[odd]]
            at = np.where(np.arange(variants) % 2, base + 1, base + 2)
            fraction = lambda k: (words[:, k] >> np.uint64(11)) * 2.0**-53
            x, y = fraction(at), fraction(at + 1)
            if few.any():  # the first position needs no number, so that a draw has three words of its own
                own = 3 * np.arange(variants)
                second[few], third[few] = low[few][:, own], high[few][:, own]
                x[few], y[few] = fraction(own + 1)[few], fraction(own + 2)[few]
            size = n.astype(np.uint64)[:, None]
            one, two = first * (size - np.uint64(1)), second * size  # Floyd's choice of two, each by a product's upper half
            refused = (~few & (((one & np.uint64(0xFFFFFFFF)) < size).any(axis=1))) | ((two & np.uint64(0xFFFFFFFF)) < size).any(axis=1)
            one = np.where(few[:, None], 0, one >> np.uint64(32)).astype(np.int64)
            two = (two >> np.uint64(32)).astype(np.int64)
            two = np.where(two == one, n[:, None] - 1, two)
            swapped = third < np.uint64(1 << 31)
            one, two = np.where(swapped, two, one), np.where(swapped, one, two)
            for p in np.nonzero(refused)[0].tolist():
                again = plain(peptides[p], int(n[p]))
                one[p], two[p], x[p], y[p] = again[:, 0], again[:, 1], again[:, 2], again[:, 3]
            return one, two, x, y

        def drawn(peptides: list[str]) -> Draws:
            letters = Letters.of(peptides)
            owner = np.repeat(np.arange(len(peptides)), letters.length)
            place = np.arange(len(letters.codes)) - letters.start[owner]
            inner = (place > 0) & (place < letters.length[owner] - 1) & _FREE[letters.codes]
            n = np.bincount(owner[inner], minlength=len(peptides))
            strange = np.bincount(owner[inner], _RANK[letters.codes[inner]] < 0, minlength=len(peptides)) > 0
            asked = np.nonzero((n >= 2) & ~strange)[0]
            if not len(asked):
                return Draws(*(np.zeros(0, np.int64) for _ in range(6)))
            places, begin = place[inner] + 1, np.cumsum(n) - n  # from 1
            one, two, x, y = (v.ravel() for v in pairs([peptides[p] for p in asked.tolist()], n[asked]))
            peptide, draw = np.repeat(asked, variants), np.tile(np.arange(variants), len(asked))
            i, j = places[begin[peptide] + one], places[begin[peptide] + two]

            def new(at: np.ndarray, fraction: np.ndarray) -> np.ndarray:
                rank = _RANK[letters.at(peptide, at)]
                found = np.zeros(len(rank), np.int64)
                for k in range(edges.shape[1]):
                    found += edges[:, k][rank] <= fraction
                return others[rank, found]

            return Draws(peptide, draw, i, new(i, x), j, new(j, y))

        return drawn


def best_of_rows(draws: DataFrame, keys: Sequence[str], floor_da: float | None) -> DataFrame:
    """``Drawing.best`` of rows (src, draw, i, a, j, b), some of which may have been left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = Letters.of(batch.column(0).to_pylist())
            columns = [np.asarray(batch.column(k)).astype(np.int64) for k in range(1, 6)]
            enough, order, units = ordered(letters, Draws(np.arange(batch.num_rows), *columns), keys, floor_da)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 2, 3, 4, 5)), pa.array(units), pa.array(order)], ["src", "i", "a", "j", "b", "units", "order"]).filter(pa.array(enough))

    rows = draws.select("src", "draw", "i", "a", "j", "b").mapInArrow(run, f"src string, {PLACES}, units long, order long")
    return rows.groupBy("src").agg(*(F.min_by(c, "order").alias(c) for c in ("i", "a", "j", "b", "units")))
