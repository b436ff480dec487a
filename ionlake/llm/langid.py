"""Language identification by words first, then ever shorter character n-grams.

A known word scores its log frequency in each language. An unseen word falls back to its n-grams,
word ends included: of the longest order of which the model knows any, the mean log frequency.
The sums over the words of a whole text decide; the score is the posterior of the winning language
when the evidence of n words counts as that of the square root of n (words aren't independent).

The model is fitted on a bounded sample of labelled rows, at most about PER_LANGUAGE documents for
each language, whole texts. Its tables are counted by Spark and hold every word and n-gram of the
sample, by 64-bit hashes and only for the languages that have them (some 5 MB a language).

Nulls and ties: a null text, or one without a letter, is UNDETERMINED with score 0. Rows without
text or label teach nothing. Without any labelled row every text is UNDETERMINED. A tie goes to the
language whose name sorts first. A null doc_id is carried through, repeated rows each get their
row. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_share, memory, per_batch, small_batches

UNDETERMINED = "und"
#: Bound of the labelled documents of a language, of which the classifier is fitted.
PER_LANGUAGE = 3_000
ORDERS = (4, 3, 2, 1)
SMOOTHING = 0.5
#: Scores that a Python worker remembers, one for each word and language, and the longest word that it does.
MEMORY, LONGEST = 4_000_000, 64
SEED = 7

#: Letters and the marks that belong to them, as the vowel signs of Indic scripts do.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*+")
ASCII_WORD = re.compile("[A-Za-z]+")


def words_of(text: str) -> list[str]:
    return (ASCII_WORD if text.isascii() else WORD).findall(text)


def grams(word: str, order: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


def keys_of(items: Sequence[tuple[int, str]]) -> np.ndarray:
    """Hashes of (kind, item): kind is 0 for words, else the n-gram's order."""
    return np.fromiter((xxhash.xxh64_intdigest(item.encode("utf-8"), kind) for kind, item in items), np.uint64, len(items))


@dataclass
class Model:
    """Log frequencies. ``keys`` ascend; item i has ``gains[first[i]:first[i + 1]]`` over ``unseen``
    (its kind's log frequency of what a language hasn't) in the languages at the same places of
    ``lang``."""

    languages: list[str]
    keys: np.ndarray
    first: np.ndarray
    lang: np.ndarray
    gains: np.ndarray
    unseen: np.ndarray

    def lookup(self, items: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
        """Whether each item is known, and a row of scores for each known one."""
        if not items or not len(self.keys):
            return np.zeros(len(items), bool), np.zeros((0, len(self.languages)))
        wanted = keys_of(items)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        known = self.keys[at] == wanted
        at = at[known]
        rows = self.unseen[np.fromiter((k for k, _ in items), np.int64, len(items))[known]]
        n = self.first[at + 1] - self.first[at]
        flat = np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        rows[np.repeat(np.arange(len(at)), n), self.lang[flat]] += self.gains[flat]
        return known, rows


def model_of(languages: list[str], kinds: np.ndarray, keys: np.ndarray, lang: np.ndarray, n: np.ndarray) -> Model:
    """A model of counts ``n`` of items (kind, key) in languages (by number), each pair once."""
    order = np.lexsort((lang, keys))
    kinds, keys, lang, n = kinds[order], keys[order], lang[order], n[order]
    distinct, first = np.unique(keys, return_index=True)
    whole = np.zeros((max(ORDERS) + 1, len(languages)))
    np.add.at(whole, (kinds, lang), n)
    sizes = np.bincount(kinds[first], minlength=len(whole))
    unseen = np.log(SMOOTHING) - np.log(whole + SMOOTHING * np.maximum(1, sizes)[:, None])
    return Model(languages, distinct, np.append(first, len(keys)).astype(np.int64), lang.astype(np.int16), (np.log(n + SMOOTHING) - np.log(SMOOTHING)).astype(np.float32), unseen)


def _counted(train: DataFrame, languages: list[str]) -> DataFrame:
    """kind, key, lang (its number) and n over the texts of ``train``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[int, Counter[str]] = {}
        number = {x: i for i, x in enumerate(languages)}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen.setdefault(number[lang], Counter()).update(words_of(text.lower()))
        total: Counter[tuple[int, int, str]] = Counter()
        for lang, words in seen.items():
            for word, n in words.items():
                total[lang, 0, word] = n
                for order in ORDERS:
                    for g in grams(word, order):
                        total[lang, order, g] += n
        pairs = list(total)
        columns = [pa.array([k for _, k, _ in pairs], pa.int32()), pa.array(keys_of([p[1:] for p in pairs]).view(np.int64)), pa.array([x for x, _, _ in pairs], pa.int32()), pa.array(list(total.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["kind", "key", "lang", "n"])

    rows = small_batches(train.select("text", "lang")).mapInArrow(per_batch(run), "kind int, key long, lang int, n long")
    return rows.groupBy("kind", "key", "lang").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model of the rows of ``labelled`` (text, lang; and doc_id, by whose hash they are sampled;
    rows without doc_id by their text's)."""
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    shares: dict[float, list[str]] = {}
    for lang, n in sizes.items():
        shares.setdefault(min(1.0, per_language / n), []).append(lang)
    sampled = F.lit(True)
    for share, some in shares.items():
        if share < 1:  # the others' rows are all taken
            sampled = sampled & (~F.col("lang").isin(some) | hash_share(key, share, SEED))
    table = _counted(rows.where(sampled), languages).toArrow()  # of the bounded sample
    column = lambda c, kind: np.asarray(table.column(c), kind)
    return model_of(languages, column("kind", np.int64), column("key", np.int64).view(np.uint64), column("lang", np.int64), column("n", np.float64))


class Scorer:
    """Scores texts, and remembers words; what it remembers doesn't change results."""

    def __init__(self, model: Model):
        self.model = model
        self.words = max(1, MEMORY // max(1, len(model.languages)))
        self.table = np.zeros((self.words, len(model.languages)))
        self.rows: dict[str, int] = {}

    def scored(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word: its own, or the mean of its longest known n-grams, or 0."""
        out = np.zeros((len(words), len(self.model.languages)))
        known, rows = self.model.lookup([(0, w) for w in words])
        out[known] = rows
        left = np.nonzero(~known)[0]
        for order in ORDERS:
            own = [grams(words[i], order) for i in left.tolist()]
            owner = np.repeat(np.arange(len(left)), [len(g) for g in own])
            known, rows = self.model.lookup([(order, g) for gs in own for g in gs])
            n, total = np.bincount(owner[known], minlength=len(left)), np.zeros((len(left), out.shape[1]))
            np.add.at(total, owner[known], rows)
            out[left[n > 0]] = total[n > 0] / n[n > 0, None]
            left = left[n == 0]
        return out

    def learn(self, words: set[str]) -> None:
        new = list(words.difference(self.rows))
        if len(self.rows) + len(new) > self.words:
            self.rows, new = {}, list(words)
        start = len(self.rows)
        self.table[start : start + len(new)] = self.scored(new)
        self.rows.update(zip(new, range(start, start + len(new)), strict=True))

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = words_of((text or "").lower())
        if not self.model.languages or not any(c.isalpha() for w in words for c in w):
            return UNDETERMINED, 0.0
        total = np.zeros(len(self.model.languages))
        long, words_of_text = [w for w in words if len(w) > LONGEST], len(words)
        for w in long:
            total += self.scored([w])[0]
        if long:
            words = [w for w in words if len(w) <= LONGEST]
        for at in range(0, len(words), self.words):
            part = words[at : at + self.words]
            self.learn(set(part))
            total += self.table[list(map(self.rows.__getitem__, part))].sum(axis=0)
        best = int(total.argmax())
        return self.model.languages[best], float(1 / np.exp((total - total[best]) / words_of_text ** 0.5).sum())


_remembered: dict[str, Scorer] = memory()


def scorer_of(shared, named: str) -> Scorer:
    """One memory for all tasks that a Python worker runs under a broadcast model."""
    if named not in _remembered:
        _remembered.clear()
        _remembered[named] = Scorer(shared.value)
    return _remembered[named]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of each document, from its text alone."""
    shared, named = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # bounded by the sample

    def run(batches):
        score = scorer_of(shared, named)
        for batch in batches:
            found = [score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return small_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def filtered(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows that are UNDETERMINED or whose language has a score below ``least``;
    under a model without languages, without the rows that have no letter."""
    shared, named = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    names, schema = docs.columns, docs.schema

    def run(batches):
        score = scorer_of(shared, named)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if shared.value.languages:
                keep = [lang != UNDETERMINED and x >= least for lang, x in map(score, texts)]
            else:
                keep = [any(map(str.isalpha, t or "")) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_())).select(names)

    return small_batches(docs).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """Whether a document is kept from the classifier: by the CRC-32 of its id as text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))
