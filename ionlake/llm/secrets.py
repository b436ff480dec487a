"""Secret scans: fixed patterns, and sliding-window Shannon entropy for each character class.

Candidates of the entropy scan are runs of base64 characters, over which a window slides. Its counts
(of characters, of classes, of turns), and the sum of ``c * log2(c)`` over the characters' counts,
change by the character that enters and the one that leaves. The classes in a window say which
entropy it has to reach, so that a prefix or a suffix of other characters doesn't change what is
asked of the rest. A turn is a change of class between two neighbours, but not a capital before a
small letter: words, paths, dates and identifiers have few. Windows that pass are merged to spans.
The allow-list suppresses windows that lie in, hold or largely overlap what it matches; it never
suppresses a pattern's span.

Nulls and ties: a null text is empty and has no spans. Spans are ordered by start, then kind in the
order of KINDS, then end. A null doc_id is carried through and repeated rows each get their row.
Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, small_batches

KINDS = ("assign", "access", "hex", "entropy")

# Patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

WINDOW = 20
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
DIGIT, SMALL, CAPITAL, JOINER = range(4)
_CLASS = {c: k for k, chars in enumerate(("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "+/_=-")) for c in chars}
_HEX = frozenset("0123456789abcdefABCDEF")
#: Entropy in bits and turns that a window has to reach: of hexadecimal digits alone, with digits and
#: letters of one case, with digits and both cases, and with both cases but no digit.
HEX_WINDOW, ONE_CASE, BOTH_CASES, NO_DIGIT = (2.9, 2), (3.6, 2), (3.9, 2), (4.0, 3)
#: What isn't a secret although it is random: UUIDs, placeholders, runs of the alphabet, named digests.
ALLOWED = (
    r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    r"(?i)example|placeholder|changeme|dummy|xxxx|0000000",
    r"(?i)abcdefgh|12345678|87654321",
    r"(?<![A-Za-z0-9])(?:sha1|sha224|sha256|sha384|sha512|md5)[-=_][A-Za-z0-9+/=_-]+",
)
#: What, just before a candidate, says that it is public.
ALLOWED_BEFORE = re.compile(r"(?i)(?:commit|revision|checksum|digest|etag|md5|sha-?1|sha-?256|sha-?512|integrity)\W{1,4}$")

_WEIGHT = [0.0, *(c * log2(c) for c in range(1, WINDOW + 2))]  # for a moment a window has one more


def _asked(digits: int, small: int, capital: int, other: int) -> tuple[float, int] | None:
    """What a window with so many characters of each class (``other``: not hexadecimal) has to reach."""
    if digits and (small or capital):
        return HEX_WINDOW if not other else BOTH_CASES if small and capital else ONE_CASE
    return NO_DIGIT if small and capital else None


def _turn(a: int, b: int) -> bool:
    return a != b and JOINER not in (a, b) and (a, b) != (CAPITAL, SMALL)


def entropy_spans(run: str, allowed: Sequence[re.Pattern[str]] = ()) -> list[tuple[int, int]]:
    """Merged spans of the windows of ``run`` that are as random as their classes ask for."""
    kinds = [_CLASS[c] for c in run]
    counts: dict[str, int] = {}
    classes = [0, 0, 0, 0]
    total, other, turns = 0.0, 0, 0
    spans: list[tuple[int, int]] = []
    known: list[tuple[int, int]] | None = None
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _WEIGHT[n + 1] - _WEIGHT[n]
        classes[kinds[i]] += 1
        other += c not in _HEX
        turns += i > 0 and _turn(kinds[i - 1], kinds[i])
        if i >= WINDOW:
            out = i - WINDOW
            old = run[out]
            n = counts[old]
            counts[old] = n - 1
            total += _WEIGHT[n - 1] - _WEIGHT[n]
            classes[kinds[out]] -= 1
            other -= old not in _HEX
            turns -= _turn(kinds[out], kinds[out + 1])
        if i < WINDOW - 1 or not (asked := _asked(*classes[:JOINER], other)):
            continue
        if turns < asked[1] or log2(WINDOW) - total / WINDOW < asked[0] - 1e-9:
            continue
        start, end = i - WINDOW + 1, i + 1
        if known is None:
            known = [m.span() for p in allowed for m in p.finditer(run)]
        if any(min(b, end) - max(a, start) >= min(b - a, WINDOW // 2) > 0 for a, b in known):
            continue
        if spans and start <= spans[-1][1]:
            spans[-1] = (spans[-1][0], end)
        else:
            spans.append((start, end))
    return spans


def scan(text: str | None, allowed: Sequence[re.Pattern[str]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans of a text, in order."""
    text = text or ""
    found: list[tuple[str, int, int]] = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [("hex", *m.span()) for m in LONG_HEX.finditer(text)]
    base = list(found)
    for m in CANDIDATE.finditer(text):
        if ALLOWED_BEFORE.search(text, max(0, m.start() - 24), m.start()):
            continue
        for a, b in entropy_spans(m[0], allowed):
            a, b = a + m.start(), b + m.start()
            if not any(x <= a and b <= y for _, x, y in base):
                found.append(("entropy", a, b))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def secrets(docs: DataFrame, allow: Sequence[str] = ALLOWED) -> DataFrame:
    """doc_id and spans (kind, start and end in code points, end exclusive) of each document.
    ``allow``: patterns of what the entropy scan leaves alone within a candidate."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        patterns = [re.compile(p) for p in allow]
        spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in scan(t, patterns)] for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(SPAN))], ["doc_id", "spans"])

    return small_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(per_batch(run), "doc_id long, spans array<struct<kind: string, start: int, end: int>>")
