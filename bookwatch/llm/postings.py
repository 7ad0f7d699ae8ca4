"""Benchmark decontamination with a positional inverted index.

Postings (term, document row, position) of the terms that the benchmark uses
are stored over all training documents, sorted by term in every shard, with one
header posting per document for its length. A phrase is then found by
intersecting posting lists whose positions are shifted by the term's offset in
the phrase: the rarest term of a window opens candidate diagonals, the second
rarest cuts them, and the lists of the other terms confirm what is left. Where
the two rarest terms stand a few words nearer or farther than in the item, the
same intersection gives a proximity match.

Only DataFrame functions are used. Shuffles carry numbers, never texts; a side
is broadcast only when a count has shown it small, otherwise the same join runs
shuffled and adaptive execution splits hot terms.

Defined results: null texts have no words and are not contaminated; rows that
repeat a doc_id are judged one by one; an item without words has no window;
each text of a repeated item_id is an item of its own and the id is listed once;
an item without an id makes hits but is in no list or count of items; empty
tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts, written

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Rows of a side that may be broadcast (two or three numbers or one word each).
SMALL = 500_000
#: Words by which the two rarest terms of a window may be nearer or farther in a proximity match.
SLOP = 3
HEADER = ""


def words_col(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, GAPS), "")


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if a count proves it small."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def item_terms(items: DataFrame) -> DataFrame:
    """``item, item_id, ipos, word, n``: the words of each item in order, stored.
    ``item`` numbers the different (item_id, text) pairs."""
    d = items.select("item_id", words_col(F.col("text")).alias("w")).distinct().select(
        F.monotonically_increasing_id().alias("item"), "item_id", "w")
    return written(d.select("item", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("ipos", "word")), "terms")


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings ``word, row, pos`` of the words in ``vocabulary(word)``, stored.
    The header posting of a row has the empty word, the row's length as position
    and its ``doc_id``. Shards are document-wise, so nothing is shuffled."""
    d = texts(docs).select("doc_id", F.monotonically_increasing_id().alias("row"),
                           F.concat(words_col(F.col("text")), F.array(F.lit(HEADER))).alias("w"))
    p = d.select("doc_id", "row", F.posexplode("w").alias("pos", "word"))
    known = vocabulary.select("word").union(vocabulary.sparkSession.sql("select '' word")).distinct()
    p = p.join(small(written(known, "vocabulary")), "word")
    return written(p.select("word", "row", "pos", F.when(F.col("word") == HEADER, F.col("doc_id")).alias("doc_id"))
                   .sortWithinPartitions("word", "row", "pos"), "postings")


def plan_windows(terms: DataFrame, index: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each window its two rarest terms: ``item, n, a, word_a, b, word_b``
    with ``a`` and ``b`` places in the item. Frequencies are exact over the index;
    a window with a term that never occurs cannot occur and is dropped."""
    freq = index.where(F.col("word") != HEADER).groupBy("word").agg(F.count("*").alias("freq"))
    t = terms.join(freq, "word", "left").select(
        "item", "n", F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "ipos", "word").alias("t"))
    lists = t.groupBy("item", "n").agg(F.sort_array(F.collect_list(
        F.struct(F.col("t.ipos").alias("ipos"), F.col("t").alias("t")))).alias("l"))
    spans = lists.select("item", "n", F.transform("l", lambda x: x["t"]).alias("l")).select(
        "item", "n", F.explode(F.transform(
            F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0))),
            lambda s: F.sort_array(F.slice(F.col("l"), s + 1, window)))).alias("s"))
    first, second = F.col("s")[0], F.get("s", F.lit(1))
    return spans.where(first["freq"] > 0).select(
        "item", "n", first["ipos"].alias("a"), first["word"].alias("word_a"),
        F.coalesce(second["ipos"], first["ipos"]).alias("b"),
        F.coalesce(second["word"], first["word"]).alias("word_b")).distinct()


def candidates(index: DataFrame, plan: DataFrame, slop: int = 0) -> DataFrame:
    """Diagonals on which the two rarest terms of a window meet:
    ``row, item, n, a, diag, drift``; ``slop`` words of drift between them allowed."""
    def lists(side: str) -> DataFrame:
        wanted = plan.select(F.col(f"word_{side}").alias("word")).distinct()
        return index.where(F.col("word") != HEADER).join(small(wanted), "word", "left_semi").select("word", "row", "pos")

    opened = lists("a").join(small(plan.withColumnRenamed("word_a", "word")), "word").select(
        "row", "item", "n", "a", "b", "word_b", (F.col("pos") - F.col("a")).alias("diag"))
    drift = F.explode(F.sequence(F.lit(-slop), F.lit(slop))) if slop else F.lit(0)
    opened = opened.withColumn("drift", drift).withColumn("at", F.col("diag") + F.col("b") + F.col("drift"))
    second = lists("b").select(F.col("word").alias("word_b"), "row", F.col("pos").alias("at"))
    return opened.where("at >= 0").join(second, ["row", "word_b", "at"]).select(
        "row", "item", "n", "a", "diag", "drift").distinct()


def phrase_matches(index: DataFrame, terms: DataFrame, found: DataFrame, window: int = WINDOW) -> DataFrame:
    """Exact matches ``row, item, start, length`` of item windows among the
    candidates: ``start`` is the place of the window's first word in the document."""
    found = found.where("drift = 0")
    rows = small(found.select("row").distinct())
    near = index.where(F.col("word") != HEADER).join(rows, "row", "left_semi").select("row", "pos", "word")
    cells = found.select("row", "item", "n", "diag", F.explode(F.sequence(
        F.greatest(F.col("a") - (window - 1), F.lit(0)),
        F.least(F.col("a") + (window - 1), F.col("n") - 1))).alias("ipos")).distinct()
    cells = cells.join(small(terms.select("item", "ipos", "word")), ["item", "ipos"]).withColumn(
        "pos", F.col("diag") + F.col("ipos"))
    full = F.least(F.lit(window), F.col("n"))
    runs = cells.join(near, ["row", "pos", "word"]).groupBy("row", "item", "n", "diag").agg(
        F.sort_array(F.collect_set("ipos")).alias("p"))
    starts = F.filter("p", lambda x, i: F.get("p", i + full - 1) - x == full - 1)
    return runs.select("row", "item", full.alias("length"), "diag", F.explode(starts).alias("s")).select(
        "row", "item", (F.col("diag") + F.col("s")).alias("start"), "length")


def searched(docs: DataFrame, items: DataFrame, slop: int = SLOP, window: int = WINDOW) -> tuple:
    """The stored index, item terms and candidate diagonals."""
    terms = item_terms(items.where("text is not null"))
    index = build_index(docs, terms)
    plan = written(plan_windows(terms, index, window), "windows")
    return index, terms, written(candidates(index, plan, slop), "candidates")


def named(matches: DataFrame, terms: DataFrame) -> DataFrame:
    """``matches`` with the ``item_id`` of each item."""
    return matches.join(small(written(terms.select("item", "item_id").distinct(), "items")), "item")


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = SLOP, window: int = WINDOW) -> DataFrame:
    """``doc_id, item_id, near_pos``: places where the two rarest terms of an item
    window stand at most ``slop`` words away from their distance in the item."""
    index, terms, found = searched(docs, items, slop, window)
    heads = index.where(F.col("word") == HEADER).select("row", "doc_id")
    return named(found, terms).join(heads, "row").select(
        "doc_id", "item_id", (F.col("diag") + F.col("a")).alias("near_pos")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """One row per document with its hit words and the items that occur in it, by
    exact phrases; and with the number of places and of items of its proximity
    matches (``n_near``, ``n_near_items``), which do not count as contamination."""
    index, terms, found = searched(docs, items, slop, window)
    matches = written(phrase_matches(index, terms, found, window), "matches")
    hit = matches.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos")
                         ).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    which = named(matches, terms).groupBy("row").agg(
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    near = named(found.select("row", "item", (F.col("diag") + F.col("a")).alias("pos")).distinct(), terms).groupBy("row").agg(
        F.count_distinct("pos").alias("n_near"), F.count_distinct("item_id").alias("n_near_items"))
    heads = index.where(F.col("word") == HEADER).select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    return heads.join(hit, "row", "left").join(which, "row", "left").join(near, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.coalesce((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")), F.lit(False)).alias("contaminated"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_near", "n_near_items")])
