"""Order MinHash fingerprints, by DataFrame functions alone.

A text becomes tokens: a word of up to LONGEST characters between white space, else single
characters, as in scripts that are written without spaces and in longer runs. Its k-mers are two
consecutive tokens, the first token being one with what stands before the text. Each is numbered by
how often it has occurred before, so that repeats are different elements, and hashed.

TUPLES hash functions each select their two least elements of the whole text; these keep the order
they have in the text when they are hashed together. So a tuple changes when one of its k-mers is
edited and also when they change places. A fingerprint is the list of its tuples' hashes; the
likeness of two is the share of equal ones. Function j takes an element's hash with its leading bits
XORed by j: each is a permutation of the hashes of its own, and for all of them the least two lie
among the first two of the hashes in order under each value of the leading bits, so that one sort
serves all functions.

Everything is done inside a row with arrays of longs; no row is exploded for it.

``edited`` compares neighbours in the order of descending doc_id, then of the text's MD5. Rows are
put into cells by quantiles of doc_id, and inside a cell into ranges by that cell's own quantiles; a
doc_id with more rows than a range is dealt to several by the MD5. A window over each range finds the
next row, and the last of a range takes the first of the next range that has rows, by a window over
the ranges of a cell and one over the cells.

Nulls and ties: a null text is empty. Texts without tokens have an empty fingerprint; two of them
are alike (1.0), one and another text aren't (0.0). Rows without doc_id come last, rows of one
doc_id in the order of their text's MD5; identical rows are each other's neighbours. With one row
the next document is the row itself. Other columns are ignored. An empty table gives no rows. Texts
may be as long as Spark's strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Scripts that are written without spaces, and the longest word that is one token.
UNSPACED = "".join(rf"\p{{Is{x}}}" for x in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan"))
LONGEST = 24
TOKEN = rf"(?<!\S)[^\s{UNSPACED}]{{1,{LONGEST}}}(?!\S)|\S"
#: Tuples of a fingerprint, each of two k-mers; a power of two.
TUPLES = 32
#: Bits of a position in the text; the 32 above them are a k-mer's hash.
POSITION_BITS = 31
#: Rows that a range should have, and most cells and ranges of a cell. Beyond, ranges grow.
ROWS, CELLS = 400, 448

_POSITION = (1 << POSITION_BITS) - 1
_HASH = (1 << 63) - 1 - _POSITION
_BIN_SHIFT = 63 - (TUPLES - 1).bit_length()


def _own(x: Column) -> Column:
    return F.shiftright(x, POSITION_BITS)


def _numbered(ordered: Column) -> Column:
    """Hash and position of each occurrence-numbered k-mer of the sorted k-mers."""

    def packed(x: Column, i: Column) -> Column:
        same = lambda back: (i >= back) & (_own(F.get(ordered, i - back)) == _own(x))
        # how many equal ones stand before: by trial where they are few, else by halving steps
        steps = F.transform(F.sequence(F.floor(F.log2(F.size(ordered).cast("double"))).cast("int"), F.lit(0), F.lit(-1)), lambda b: F.pow(F.lit(2.0), b).cast("int"))
        walked = F.aggregate(steps, F.lit(0), lambda back, step: F.when(same(back + step), back + step).otherwise(back))
        occurrence = F.when(~same(F.lit(2)), 1).when(~same(F.lit(3)), 2).when(~same(F.lit(4)), 3).otherwise(walked)
        again = F.xxhash64(_own(x), occurrence).bitwiseAND(F.lit(_HASH)).bitwiseOR(x.bitwiseAND(F.lit(_POSITION)))
        return F.when(same(F.lit(1)), again).otherwise(x)

    return F.transform(ordered, packed)


def with_signature(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with column ``out``: the fingerprint of column ``text`` as an array of TUPLES longs of 32
    bits, or none for a text without tokens."""
    # Each step's array is referred to more than once, so that the optimizer computes it once a row.
    w, a, b, c = (f"__{out}_{x}" for x in "wabc")
    none = F.array().cast("array<bigint>")
    df = df.withColumn(w, F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))
    kmer = lambda x, i: F.xxhash64(F.get(F.col(w), i - 1), x).bitwiseAND(F.lit(_HASH)).bitwiseOR(i.cast("long"))
    df = df.withColumn(a, F.when(F.size(w) > 0, F.sort_array(F.transform(w, kmer))).otherwise(none))
    df = df.withColumn(b, F.when(F.size(a) > 0, F.sort_array(_numbered(F.col(a)))).otherwise(F.col(a)))
    bin_of = lambda x: F.shiftright(x, _BIN_SHIFT)
    firsts = F.filter(F.col(b), lambda x, i: (i < 2) | (bin_of(x) != bin_of(F.get(F.col(b), i - 2))))
    df = df.withColumn(c, F.when(F.size(b) > 0, firsts).otherwise(F.col(b)))

    def hashed(x: Column, y: Column) -> Column:
        at = lambda z: z.bitwiseAND(F.lit(_POSITION))
        pair = F.when(y.isNull(), F.xxhash64(_own(x))).when(at(x) <= at(y), F.xxhash64(_own(x), _own(y))).otherwise(F.xxhash64(_own(y), _own(x)))
        return pair.bitwiseAND(F.lit((1 << 32) - 1))

    functions = F.sequence(F.lit(0), F.lit(TUPLES - 1))
    each = F.transform(functions, lambda j: hashed(F.get(F.col(c), 2 * j).bitwiseXOR(j * F.lit(1 << _BIN_SHIFT)), F.get(F.col(c), 2 * j + 1).bitwiseXOR(j * F.lit(1 << _BIN_SHIFT))))
    permuted = lambda j: F.slice(F.sort_array(F.transform(F.col(c), lambda x: x.bitwiseXOR(j * F.lit(1 << _BIN_SHIFT)))), 1, 2)
    least = F.transform(F.transform(functions, permuted), lambda two: hashed(F.get(two, F.lit(0)), F.get(two, F.lit(1))))
    signature = F.when(F.size(c) == 2 * TUPLES, each).when(F.size(c) > 0, least).otherwise(F.col(c))
    return df.withColumn(out, signature).drop(w, a, b, c)


def fingerprint(signature: str) -> Column:
    """A signature as text, eight hexadecimal digits a tuple."""
    return F.array_join(F.transform(F.col(signature), lambda t: F.lower(F.lpad(F.hex(t), 8, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """Share of equal tuples."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(equal / F.lit(TUPLES))


def _place(x: Column, share: Column, edges: Column) -> tuple[Column, Column]:
    """How many of ``edges`` (ascending) a value reaches. A value that several edges equal is dealt to
    as many places by its ``share`` (0 to 1, the larger the lower the place); and the share inside."""
    below, upto = F.size(F.filter(edges, lambda e: e < x)), F.size(F.filter(edges, lambda e: e <= x))
    several = F.when(upto - below > 1, upto - below).otherwise(F.lit(1))
    part = F.least(F.floor(share * several).cast("int"), several - 1)
    return upto - part, share * several - part


def _ranged(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text) with cell and range, which ascend in the order of neighbours."""
    total = rows.count()
    cells = max(1, min(CELLS, round((total / ROWS) ** 0.5)))
    fractions = [i / cells for i in range(1, cells)]
    x = F.coalesce("doc_id", F.lit(-(1 << 63)))  # the long itself: a double would make one of many ids
    rows = rows.withColumns({"__x": x, "__share": F.conv(F.substring(F.md5("text"), 1, 12), 16, 10).cast("double") / float(1 << 48)})
    if cells == 1:
        return rows.select("doc_id", "text", F.lit(0).alias("cell"), F.lit(0).alias("range"))
    bounds = F.array(*map(F.lit, rows.agg(F.percentile_approx("__x", fractions, 4 * cells)).first()[0]))
    cell, share = _place(F.col("__x"), F.col("__share"), bounds)
    rows = rows.withColumns({"__up": cell, "__share": share})
    inner = rows.groupBy("__up").agg(F.percentile_approx("__x", fractions, 8 * cells).alias("__edges"))
    rows = rows.join(F.broadcast(cut(inner)), "__up")  # at most CELLS * CELLS numbers
    place, _ = _place(F.col("__x"), F.col("__share"), F.col("__edges"))
    return rows.select("doc_id", "text", (F.lit(cells) - F.col("__up")).alias("cell"), (F.lit(cells) - place).alias("range"))


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, text, signature, next_text and next_signature of each row of ``docs``; the next
    document is the one of the next smaller doc_id, after the smallest the largest."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = _ranged(rows)
    order = [F.desc_nulls_last("doc_id"), F.md5("text")]
    # The first row of each range; its keys are found before its text is moved.
    keys = ranged.groupBy("cell", "range").agg(F.max("doc_id").alias("__largest"), F.min_by(F.md5("text"), F.struct(F.col("doc_id").isNull(), F.bitwise_not("doc_id"), F.md5("text"))).alias("__md5"))
    heads = ranged.join(F.broadcast(cut(keys)), ["cell", "range"]).where(F.col("doc_id").eqNullSafe(F.col("__largest")) & (F.md5("text") == F.col("__md5")))  # CELLS * CELLS rows
    heads = heads.dropDuplicates(["cell", "range"]).select("cell", "range", F.col("text").alias("head"))
    heads = cut(with_signature(heads, "head", "head_signature"))
    first = heads.groupBy("cell").agg(F.min_by(F.struct("head", "head_signature"), "range").alias("__first"))
    by_cell = Window.orderBy("cell")  # of at most CELLS rows
    ends = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = first.select("cell", F.coalesce(F.lead("__first").over(by_cell), F.first("__first").over(ends)).alias("__beyond"))
    ahead = heads.withColumn("__lead", F.lead(F.struct("head", "head_signature")).over(Window.partitionBy("cell").orderBy("range")))
    ahead = ahead.join(following, "cell").select("cell", "range", F.coalesce("__lead", "__beyond").alias("__ahead"))
    within = Window.partitionBy("cell", "range").orderBy(*order)
    signed = with_signature(ranged, "text", "signature")
    led = signed.withColumns({f"__next_{c}": F.lead(c).over(within) for c in ("text", "signature")}).join(ahead, ["cell", "range"], "left")
    pick = lambda c, head: F.coalesce(F.col(f"__next_{c}"), F.col(f"__ahead.{head}"))
    return led.select("doc_id", "text", "signature", pick("text", "head").alias("next_text"), pick("signature", "head_signature").alias("next_signature"))


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last third (of code points, rounded
    down) is replaced by as many from the start of the next document, or all that it has: doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next."""
    rows = neighbours(docs)
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third)))
    rows = with_signature(rows, "edited", "edited_signature")
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint("signature").alias("fingerprint"),
        fingerprint("edited_signature").alias("edited_fingerprint"),
        likeness("signature", "edited_signature").alias("near_edited"),
        likeness("signature", "next_signature").alias("near_next"),
    )
