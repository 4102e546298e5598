"""Merkle-tree fingerprints over sections, paragraphs and blocks of words, in DataFrame functions only.

A text is split into sections (at blank lines), paragraphs (at line breaks) and blocks of ``BLOCK`` space-separated
words from the paragraph's start.  A block's digest is the head of its SHA-256; a paragraph's digest is taken over its
blocks' digests, a section's over its paragraphs', and the root over the sections'.  Equal texts have equal trees and
(but for collisions) unequal texts have unequal roots.  Where two trees differ, only branches under a differing node can
hold the edit, which ``differences`` lists down to paragraphs.

The fingerprint is one string: ``root;section,section,...;block block ...|block ...|...`` - the blocks of each paragraph
in order - so the likeness of two texts can be taken from two fingerprints alone: twice the number of shared distinct
block digests over the number of both.

``next_document`` pairs each row with its successor in descending id order in one shuffle of the texts: ids are cut into
ranges of equal width by arithmetic on their minimum, maximum and number, each range is one window group, and the first
row of a range is also sent to the range before it.  The list of first rows has at most ``MAX_RANGES`` entries, which
bounds the only broadcast.

Defined results: null is the empty text; rows with a null id come last; rows with one id are ordered by text (null
first), so repeated rows follow one another; a table of one row is its own successor; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import fresh

BLOCK = 16
DIGEST = 16  # hex digits kept of a block's digest; inner nodes keep 32, the root all 64
ROWS_PER_RANGE = 2_000
MAX_RANGES = 65_536


def _blocks(paragraph: Column) -> Column:
    words = F.split(paragraph, " ")
    starts = F.sequence(F.lit(1), F.size(words), F.lit(BLOCK))
    return F.transform(starts, lambda i: F.substring(F.sha2(F.array_join(F.slice(words, i, BLOCK), " "), 256), 1, DIGEST))


def blocks(text: Column) -> Column:
    """``array<array<array<string>>>``: block digests by section and paragraph."""
    sections = F.split(F.coalesce(text, F.lit("")), "\n\n")
    return F.transform(sections, lambda s: F.transform(F.split(s, "\n"), _blocks))


def tree(leaves: Column) -> Column:
    """``struct<root, sections, paragraphs>`` over the block digests: inner digests by level."""
    paragraphs = F.transform(leaves, lambda s: F.transform(s, lambda p: F.substring(F.sha2(F.array_join(p, " "), 256), 1, 32)))
    return F.transform(F.array(paragraphs), lambda ps: F.transform(
        F.array(F.transform(ps, lambda p: F.substring(F.sha2(F.array_join(p, "|"), 256), 1, 32))),
        lambda ss: F.struct(F.sha2(F.array_join(ss, ","), 256).alias("root"), ss.alias("sections"), ps.alias("paragraphs")),
    ).getItem(0)).getItem(0)


def rendered(leaves: Column) -> Column:
    """The fingerprint string of a tree given by its block digests."""
    node = tree(leaves)
    body = F.array_join(F.transform(leaves, lambda s: F.array_join(F.transform(s, lambda p: F.array_join(p, " ")), "|")), "\n")
    return F.concat_ws(";", node["root"], F.array_join(node["sections"], ","), body)


def fingerprint(text: Column) -> Column:
    return rendered(blocks(text))


def _set(leaves: Column) -> Column:
    return F.array_distinct(F.flatten(F.flatten(leaves)))


def likeness(a: Column, b: Column) -> Column:
    """Twice the shared distinct block digests over those of both, from 0 to 1; ``a`` and ``b`` are distinct digests."""
    return 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def differences(a: Column, b: Column) -> Column:
    """Where two trees part: ``array<struct<section, paragraph>>`` (from 0) of paragraphs that differ or stand in one only.

    Branches with equal section digests are not entered; equal roots give an empty list.
    """
    ta, tb = tree(blocks(a)), tree(blocks(b))
    most = F.greatest(F.size(ta["sections"]), F.size(tb["sections"]))

    def inner(s: Column) -> Column:
        pa, pb = F.get(ta["paragraphs"], s), F.get(tb["paragraphs"], s)
        n = F.greatest(F.coalesce(F.size(pa), F.lit(0)), F.coalesce(F.size(pb), F.lit(0)))
        rows = F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.struct(
            s.alias("section"), p.alias("paragraph"), F.get(pa, p).eqNullSafe(F.get(pb, p)).alias("same")))
        return F.transform(F.filter(rows, lambda r: ~r["same"]), lambda r: F.struct(r["section"], r["paragraph"]))

    parts = F.filter(F.sequence(F.lit(0), most - 1), lambda s: ~F.get(ta["sections"], s).eqNullSafe(F.get(tb["sections"], s)))
    none = F.array().cast("array<struct<section:int,paragraph:int>>")
    return F.when(ta["root"] == tb["root"], none).otherwise(F.flatten(F.transform(parts, inner)))


def next_document(docs: DataFrame, *, doc_id: str = "doc_id", carry: Column, rows_per_range: int = ROWS_PER_RANGE) -> tuple[DataFrame, str]:
    """``docs`` with one struct column: ``carry`` of the successor in descending order of ``doc_id`` (last: the first's).

    ``doc_id`` is an integer column.
    """
    out = fresh("next", docs.columns)
    lowest = -(1 << 63)  # null ids stand at the end
    ids = docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(lowest)).alias("k"))
    low, high, n = ids.agg(F.coalesce(F.min(F.when(F.col("k") > lowest, F.col("k"))), F.lit(0)), F.max("k"), F.count("*")).first()
    if not n:
        return docs.withColumn(out, carry), out
    ranges = min(max(1, n // rows_per_range), MAX_RANGES)
    width = max(1.0, (float(high) - float(low) + 1) / ranges)

    def place(k: str) -> Column:  # rounding keeps the order, so a range holds neighbours whatever the ids
        return F.floor((F.greatest(F.col(k), F.lit(low)).cast("double") - F.lit(float(low))) / F.lit(width)).cast("bigint")

    heads = ids.groupBy(place("k").alias("g")).agg(F.max("k").alias("top"))
    # the first row of each range also goes behind the last row of the next higher one; the very first behind the lowest
    line, everything = Window.orderBy(F.desc("g")), Window.partitionBy(F.lit(0))
    heads = heads.select("top", F.coalesce(F.lag("g").over(line), F.min("g").over(everything)).alias("to"))
    send = F.broadcast(heads)  # at most MAX_RANGES + 1 rows of two integers
    rows = docs.select(F.struct(*docs.columns).alias("row"), carry.alias("carry"), F.coalesce(F.col(doc_id).cast("bigint"), F.lit(lowest)).alias("key"))
    rows = rows.join(send, F.col("key") == F.col("top"), "left")
    here, there = F.struct(place("key").alias("g"), F.lit(0).alias("turn")), F.struct(F.col("to").alias("g"), F.lit(1).alias("turn"))
    rows = rows.select("row", "carry", "key", F.inline(F.when(F.col("to").isNull(), F.array(here)).otherwise(F.array(here, there))))
    along = Window.partitionBy("g").orderBy("turn", F.col("key").desc(), "carry")
    return rows.withColumn("next", F.lead("carry").over(along)).where("turn = 0").select("row.*", F.col("next").alias(out)), out


def edited_text(text: Column, other: Column) -> Column:
    """The text with its last ``floor(n / 2)`` code points replaced by the first as many (or all) of ``other``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def compare_with_next(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows, nxt = next_document(rows, carry=F.col("text"))
    rows = rows.withColumn("edited", edited_text(F.col("text"), F.col(nxt)))
    rows = rows.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        blocks(F.col("text")).alias("a"), blocks(F.col("edited")).alias("b"), _set(blocks(F.col(nxt))).alias("c"),
    )
    rows = rows.withColumns({"sa": _set(F.col("a")), "sb": _set(F.col("b"))})
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", rendered(F.col("a")).alias("fingerprint"), rendered(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("sa"), F.col("sb")).alias("near_edited"), likeness(F.col("sa"), F.col("c")).alias("near_next"),
    )
