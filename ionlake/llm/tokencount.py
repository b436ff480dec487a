"""Token counts of a unigram tokenizer without building the tokens: a count-only Viterbi.

An Aho-Corasick automaton of the vocabulary lists the pieces that end at each character, the
longest first. Dynamic programming carries the best score and its number of tokens to each
position. Ties are the tokenizer's: a later start replaces the best path to a position only with a
strictly better score, so the longest of equal pieces wins; a character that is no piece itself
costs the least score of the vocabulary less 10; with byte fallback it counts as its UTF-8 bytes,
else a run of such characters is one token.

The vocabulary is a parameter: pieces and scores of a SentencePiece file. Counts are those of that
file's own encoder if it is a unigram model. A BPE file's scores are merge ranks, with which the
counts are those of a unigram model of the same pieces and scores, not those of the file's encoder.

No piece of such vocabularies has a space mark after another character, so that a text's best path
is that of its words one after the other, and a task remembers words. (With scores that aren't
whole numbers the sums of long texts are rounded in another order than the tokenizer's.)

Nulls and ties: a null or empty text has no tokens and score 0. A null doc_id is carried through
and repeated rows each get their row. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose counts a task remembers, and the longest of them.
MEMORY, LONGEST = 400_000, 64
SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def vocabulary(model_file: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece model file, without those that no text matches: control
    marks, the unknown piece, unused ones and bytes (which only stand in for unknown characters)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    silent = (model.is_control, model.is_unknown, model.is_unused, model.is_byte)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not any(of(i) for of in silent)]


@dataclass
class Counter:
    """Counts the tokens of texts under ``pieces``, with or without byte fallback."""

    pieces: list[tuple[str, float]]
    byte_fallback: bool = True

    def __post_init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in self.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in self.pieces) - UNKNOWN_PENALTY
        self.singles = {p for p, _ in self.pieces if len(p) == 1}
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p, _ in self.pieces)
        self.memory: dict[str, int] = {}
        self.counts, self.scores = np.zeros(MEMORY, np.int64), np.zeros(MEMORY)

    def viterbi(self, text: str) -> tuple[int, float]:
        """Tokens and score of the best path over ``text``, whose spaces are marks."""
        n = len(text)
        score: list[float | None] = [0.0, *[None] * n]
        count, unknown = [0] * (n + 1), [False] * (n + 1)
        matches = self.automaton.iter(text)
        at, found = next(matches, (n, None))
        for i, c in enumerate(text):
            best, tokens = None, 0
            while at == i and found:
                length, gain = found
                before = i + 1 - length
                if best is None or score[before] + gain > best:
                    best, tokens = score[before] + gain, count[before] + 1
                at, found = next(matches, (n, None))
            if c not in self.singles and (best is None or score[i] + self.unknown > best):
                best = score[i] + self.unknown
                tokens = count[i] + (len(c.encode("utf-8")) if self.byte_fallback else not unknown[i])
                unknown[i + 1] = True
            score[i + 1], count[i + 1] = best, tokens
        return count[n], score[n] or 0.0

    def __call__(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        marked = SPACE + text.replace(" ", SPACE)
        if not self.by_word:
            return self.viterbi(marked)
        words = SEGMENT.findall(marked)
        tokens, score = 0, 0.0
        for first in range(0, len(words), MEMORY):
            part = words[first : first + MEMORY]
            for word in (w for w in part if len(w) > LONGEST):
                n, gain = self.viterbi(word)
                tokens, score = tokens + n, score + gain
            part = [w for w in part if len(w) <= LONGEST]
            new = set(part).difference(self.memory)
            if len(self.memory) + len(new) > MEMORY:
                self.memory.clear()
                new = set(part)
            for word in new:
                k = self.memory[word] = len(self.memory)
                self.counts[k], self.scores[k] = self.viterbi(word)
            rows = list(map(self.memory.__getitem__, part))
            tokens += int(self.counts[rows].sum())
            score += float(self.scores[rows].sum())
        return tokens, score


def token_counts(docs: DataFrame, model_file: str, byte_fallback: bool = True) -> DataFrame:
    """doc_id, n_tokens and score (of the best path) of each document. ``model_file`` is a path
    that every executor can open: a vocabulary that is installed."""

    def run(batches):
        counter = Counter(vocabulary(model_file), byte_fallback)
        for batch in batches:
            found = [counter(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "n_tokens", "score"])

    return small_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, n_tokens long, score double")
