"""Document fingerprints: a Merkle tree over the paragraphs and sections of a text.

A paragraph is a piece of text up to and with its sentence ends or line feeds,
or 255 code points of one that has none; together the pieces are the text. A
leaf is a paragraph's SHA-256 with its length. A section ends after a leaf whose
digest ends in 0, so its borders depend on content alone and fall in line again
after an edit; its node is the SHA-256 of its leaves, and the root that of its
sections. The root tests equality; below it, sections and then leaves that
differ locate an edit, without the texts.

The fingerprint is ``root|section=leaf leaf ...|section=...`` with the root
whole, 16 digits of a section's digest and 8 of a leaf's, each leaf with its
length: what ``likeness`` and ``first_difference`` work from.

Everything is built from DataFrame functions. A null text counts as empty; an
empty text has the root of no sections. A repeated id is ordered by the hash of
its text, null ids come first; each row of the input gives one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import texts
from .ranges import Ranges

PARAGRAPH = r"[^.!?\n]{1,255}[.!?\n]{0,32}|[.!?\n]{1,255}"
LEAF = "[0-9a-f]{8}:[0-9]+"
#: Documents of a range block: one task orders a few blocks with their texts.
BLOCK = 2048


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text; equal texts have equal ones."""
    pieces = F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))
    leaves = F.array_join(F.transform(pieces, lambda p: F.concat(F.sha2(p, 256), F.lit(":"), F.length(p))), " ")
    sections = F.filter(F.split(F.regexp_replace(leaves, "(0:[0-9]+) ", "$1|"), r"\|"), lambda s: s != "")
    nodes = F.transform(sections, lambda s: F.concat(F.sha2(s, 256), F.lit("="),
                                                     F.regexp_replace(s, "([0-9a-f]{8})[0-9a-f]{56}", "$1")))
    return let(nodes, lambda n: F.concat(
        F.sha2(F.array_join(F.transform(n, lambda s: F.substring(s, 1, 64)), ""), 256), F.lit("|"),
        F.array_join(F.transform(n, lambda s: F.concat(F.substring(s, 1, 16), F.substring(s, 65, 1 << 30))), "|")))


def root(print_: Column) -> Column:
    return F.substring(print_, 1, 64)


def leaves_of(print_: Column) -> Column:
    return F.regexp_extract_all(F.substring(print_, 66, 1 << 30), F.lit(LEAF), F.lit(0))


def chars(leaves: Column) -> Column:
    """Code points of the given leaves together."""
    return F.aggregate(leaves, F.lit(0).cast("bigint"),
                       lambda n, leaf: n + F.substring(leaf, 10, 20).cast("bigint"))


def likeness(a: Column, b: Column) -> Column:
    """Twice the code points in leaves of both over those in the leaves of each,
    equal leaves of one text counted once: 1 for equal roots, 0 to 1."""
    def of(x: Column, y: Column) -> Column:
        return let(chars(x) + chars(y), lambda total: F.when(total == 0, 0.0).otherwise(
            2.0 * chars(F.array_intersect(x, y)) / total))
    return F.when(root(a) == root(b), 1.0).otherwise(
        let(F.array_distinct(leaves_of(a)), lambda x: let(F.array_distinct(leaves_of(b)), lambda y: of(x, y))))


def first_difference(a: Column, b: Column) -> Column:
    """Code points of the first text before its first paragraph that differs from
    the other's; null where the roots agree. Equal sections at the start are
    passed over whole; only the first that differs is opened."""
    def same(u: Column, v: Column) -> Column:
        """Units at the start that agree."""
        return let(F.arrays_zip(u.alias("u"), v.alias("v")), lambda pairs: F.aggregate(
            pairs, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
            lambda at, p: F.struct(
                (at["n"] + F.when(at["on"] & p["u"].eqNullSafe(p["v"]), 1).otherwise(0)).alias("n"),
                (at["on"] & p["u"].eqNullSafe(p["v"])).alias("on")))["n"])

    def opened(section: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(section, F.lit("")), F.lit(LEAF), F.lit(0))

    def within(u: Column, v: Column) -> Column:
        return let(u, lambda x: let(v, lambda y: chars(F.slice(x, 1, same(x, y)))))

    def sections(print_: Column) -> Column:
        return F.split(F.substring(print_, 66, 1 << 30), r"\|")

    return F.when(root(a) != root(b), let(sections(a), lambda x: let(sections(b), lambda y: let(
        same(x, y), lambda n: chars(opened(F.array_join(F.slice(x, 1, n), " ")))
        + within(opened(F.get(x, n)), opened(F.get(y, n)))))))


def edits(docs: DataFrame) -> DataFrame:
    """Each document with its fingerprint, its next one's, and its edited text: the
    last quarter of its code points replaced by the first as many of the next
    document, the last one's next being the first (columns ``next``, ``edited``).

    The order is cut into range blocks; a block's first row also goes, as a
    guard, to the block before, so that no row looks beyond its own block."""
    keyed = texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("_tie", F.xxhash64("text"))
    ranges = Ranges(keyed, ["doc_id", "_tie"], BLOCK)
    at = F.col("_block")
    before = F.when(at > 0, at - 1).otherwise(ranges.last)
    rows = (keyed.withColumn("fingerprint", fingerprint(F.col("text"))).withColumn("_block", ranges.of)
            .withColumn("_to", F.explode(F.when(ranges.first(at), F.array(
                F.struct(at.alias("block"), F.lit(False).alias("guard")),
                F.struct(before.alias("block"), F.lit(True).alias("guard"))))
                .otherwise(F.array(F.struct(at.alias("block"), F.lit(False).alias("guard"))))))
            .select("doc_id", "text", "fingerprint", "_tie", "_to.block", "_to.guard"))
    order = Window.partitionBy("block").orderBy("guard", "doc_id", "_tie")
    n = F.length("text").cast("bigint")
    k = F.floor(F.col("n_chars") / 4).cast("int")
    return (rows.withColumns({"next": F.lead("text").over(order), "next_fingerprint": F.lead("fingerprint").over(order)})
            .where("not guard").withColumn("n_chars", n)
            .withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - k).cast("int")),
                                           F.substring("next", F.lit(1), k))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, edit_from``: likeness of a text's fingerprint to that
    of its edited text and of the next document, and the code point from which
    the two trees of a text and its edit differ (null: nowhere)."""
    a = F.col("fingerprint")
    found = let(fingerprint(F.col("edited")), lambda b: F.struct(
        b.alias("edited_fingerprint"), likeness(a, b).alias("near_edited"),
        likeness(a, F.col("next_fingerprint")).alias("near_next"), first_difference(a, b).alias("edit_from")))
    return edits(docs).select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
                              found.alias("_found")).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "_found.*")
