"""I-Match document fingerprints, with DataFrame functions only.

Terms (lower-cased runs of letters and digits) are hashed to 64 bits.  The document frequency of each
is counted over the distinct texts of the whole corpus (copies, told by
a 64-bit hash of the text, count once, however many there are).  The lexicon is the set of terms within the chosen band of inverse
document frequency. As each of them is in LEAST_SHARE of all texts at least, they are no more than a text's mean number of terms
divided by LEAST_SHARE (a few millions), at any size of corpus. The set is a Bloom bitmap, two places a term and BITS bits for each: a
term outside the band passes with a probability under 0.5 %, always or never, so equal texts still have equal marks. A bitmap of up to MOST_BITS
is sent with the plan; a larger one stays a table, which the distinct terms of the texts meet in joins, with the same marks.
The distinct terms of a document within
the band are sorted and hashed once for each of several randomised subsets of the
lexicon: DRAWS random orders of the terms, and of each the fractions 1/2 to 1/256,
so that some subsets hold a few terms of a short document and others a few of a long one.

A fingerprint is one 16-digit hexadecimal hash for each subset; a subset without
a term of the document is left blank ("-").  Likeness: of the subsets that hold a term of
either document, the fraction whose hashes are equal; 1 if no subset holds any and the
fingerprints are equal.

Defined cases: a null text counts as empty; a text without a term in the band gets
the hash of its whole text as its only mark, so unlike ones differ and equal ones agree; a
single document is its own next one; rows with one doc_id follow each other in order of
their text; an empty table gives an empty result; columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.frames import block_of, constant, fresh, partitions, range_bounds, table, written

#: Bits of the lexicon's bitmap for each term (rounded up to a power of two), the fewest that it has, and the most that are sent; beyond, texts meet it in joins.
BITS, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 25
#: The band: a term's share of distinct texts. Commoner terms say little, rarer ones change with any edit.
LEAST_SHARE, MOST_SHARE = 0.0002, 0.05
#: A term has to be in so many distinct texts at least to be in the lexicon of a small corpus.
LEAST_DOCS = 2
DRAWS = 4
FRACTIONS = tuple(range(1, 9))


def terms(text: Column) -> Column:
    """The distinct hashed terms of a text."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w)))


def band(docs: DataFrame) -> DataFrame:
    """term, df of the terms (hashed) within the band."""
    text = F.coalesce("text", F.lit(""))
    copies = docs.select(F.xxhash64(text).alias("copy"), terms(text).alias("terms")).groupBy("copy").agg(F.first("terms").alias("terms"))
    n = docs.select(F.xxhash64(text).alias("copy")).distinct().count()
    counted = copies.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counted.filter(F.col("df").between(max(LEAST_DOCS, LEAST_SHARE * n), max(LEAST_DOCS, MOST_SHARE * n)))


def _places(term: Column, bits: int) -> tuple[Column, Column]:
    """Two places of a term in the bitmap."""
    return term.bitwiseAND(bits - 1).cast("int"), F.shiftrightunsigned(term, 36).bitwiseAND(bits - 1).cast("int")


@dataclass
class Lexicon:
    """The terms within the band as a bitmap: how many bits, its 64-bit words other than 0 (w, bits), and the words as a constant array if they are few."""

    bits: int
    words: DataFrame
    bitmap: Column | None


def lexicon(docs: DataFrame) -> Lexicon:
    found = written(band(docs).select("term"), "band")
    bits = min(1 << 31, max(LEAST_BITS, 1 << (BITS * found.count() - 1).bit_length()))
    place = found.select(F.explode(F.array(*_places(F.col("term"), bits))).alias("place"))
    words = written(place.groupBy(F.shiftright("place", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, place & 63))").alias("bits")), "bitmap")
    if bits > MOST_BITS:
        return Lexicon(bits, words, None)
    held = dict(words.collect())  # at most bits / 64 rows
    return Lexicon(bits, words, constant([held.get(i, 0) for i in range(bits // 64)]))


def with_chosen(rows: DataFrame, text: str, of: Lexicon) -> DataFrame:
    """rows with chosen: the sorted distinct hashed terms of the text column that are in the lexicon."""
    if of.bitmap is not None:
        return rows.withColumn("chosen", in_band(F.col(text), of.bitmap))
    row = fresh(rows, "row")
    numbered = written(rows.withColumn(row, F.monotonically_increasing_id()), "texts")
    each = numbered.select(row, F.explode(terms(F.col(text))).alias("term"))
    known = each.select("term").distinct()
    for place in _places(F.col("term"), of.bits):
        held = known.withColumns({"w": F.shiftright(place, 6), "bit": place.bitwiseAND(63)}).join(of.words, "w")
        known = held.filter(F.call_function("getbit", "bits", "bit") == 1).select("term")
    chosen = each.join(known, "term", "left_semi").groupBy(row).agg(F.array_sort(F.collect_list("term")).alias("chosen"))
    return numbered.join(chosen, row, "left").withColumn("chosen", F.coalesce("chosen", F.array().cast("array<bigint>"))).drop(row)


def in_band(text: Column, bitmap: Column) -> Column:
    """The sorted distinct hashed terms of a text that are in the lexicon."""
    bits = F.size(bitmap) * 64
    set_at = lambda p: F.call_function("getbit", F.get(bitmap, F.shiftright(p, 6)), p.bitwiseAND(63)) == 1
    low, high = (lambda h: h.bitwiseAND(bits - 1).cast("int")), (lambda h: F.shiftrightunsigned(h, 36).bitwiseAND(bits - 1).cast("int"))
    return F.array_sort(F.filter(terms(text), lambda h: set_at(low(h)) & set_at(high(h))))


def _clear(mask: int) -> Callable[[Column], Column]:
    return lambda h: h.bitwiseAND(F.lit(mask)) == 0


def marks(chosen: Column, text: Column) -> Column:
    """The fingerprint as an array, from the sorted terms in the band."""
    out = []
    for draw in range(DRAWS):
        for fraction in FRACTIONS:
            mask = ((1 << fraction) - 1) << (11 * draw)
            part = F.filter(chosen, _clear(mask))
            out.append(F.when(F.size(part) > 0, F.xxhash64(F.lit(draw), F.lit(fraction), part)))
    whole = F.when(F.size(chosen) == 0, F.xxhash64(text))
    return F.array(*out, whole)


def likeness(a: Column, b: Column) -> Column:
    """Of the marks that either has, the share that agree; both without any mark: 1."""
    pairs = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), F.lit(None)).otherwise(x.eqNullSafe(y)))
    some = F.filter(pairs, lambda p: p.isNotNull())
    return F.when(F.size(some) == 0, F.lit(1.0)).otherwise(F.size(F.filter(some, lambda p: p)) / F.size(some))


def written_out(marks: Column) -> Column:
    """A fingerprint as text."""
    return F.array_join(F.transform(marks, lambda m: F.coalesce(F.lpad(F.lower(F.hex(m)), 16, "0"), F.lit("-"))), "")


def fingerprint(docs: DataFrame, of: Lexicon | None = None) -> DataFrame:
    """doc_id, text (null: empty), marks of each row of docs."""
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return with_chosen(read, "text", lexicon(docs) if of is None else of).select("doc_id", "text", marks(F.col("chosen"), F.col("text")).alias("marks"))


def with_next(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, ...) with next, a struct of the following row's text and marks in order of doc_id; after the last: the first.

    Rows are dealt into runs of doc_id, each sorted by itself; the first row of each run also goes to the run
    before it, and that of the first run to the last, to be the next of the last row there.
    """
    bounds = range_bounds(rows.select("doc_id"), "doc_id", 4 * partitions(rows.sparkSession))
    least = rows.select(F.min(F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"))).alias("m")).first().m
    last = len(bounds)
    block = block_of("doc_id", bounds)
    starts = F.col("doc_id").eqNullSafe(F.lit(None if least is None else least.doc_id).cast("bigint"))
    edge = F.get(constant(bounds), F.col("block") - 1) if bounds else F.lit(None).cast("bigint")
    guard = F.when(starts, F.lit(last)).when(F.col("doc_id") == edge, F.col("block") - 1)
    own = F.struct(F.col("block").alias("block"), F.lit(0).alias("guard"))
    dealt = rows.withColumn("block", block).withColumn("to", F.explode(F.when(guard.isNotNull(), F.array(own, F.struct(guard.cast("int").alias("block"), F.lit(1).alias("guard")))).otherwise(F.array(own)))).drop("block").select("*", "to.*").drop("to")
    order = W.partitionBy("block").orderBy("guard", F.asc_nulls_first("doc_id"), "text")
    return dealt.withColumn("next", F.lead(F.struct("text", "marks")).over(order)).filter("guard = 0").drop("guard", "block")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    of = lexicon(docs)
    rows = with_next(fingerprint(docs, of))
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - k), F.substr("next.text", F.lit(1), k))
    made = rows.select("doc_id", n.cast("long").alias("n_chars"), "marks", F.col("next.marks").alias("next_marks"), edited.alias("edited"))
    marked = with_chosen(made, "edited", of).withColumn("edited_marks", marks(F.col("chosen"), F.col("edited")))
    return marked.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written_out(F.col("marks")).alias("fingerprint"), written_out(F.col("edited_marks")).alias("edited_fingerprint"), likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"), likeness(F.col("marks"), F.col("next_marks")).alias("near_next"))
