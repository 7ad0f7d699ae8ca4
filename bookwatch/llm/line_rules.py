"""Quality rules, line first.

A text is cut at line feeds. Each line with a word is put to three groups of
rules and removed when one applies:

* punctuation: it holds no sentence mark, or more than a tenth of its
  characters are symbols;
* navigation: three or more bars, angle marks or bullets separate its items;
* boilerplate: it is short and holds a licence, copyright, cookie or script notice.

A document is rejected when it fails the base rules (too few words, too many
words in repeated windows), or when the removed lines, with lines that repeat
an earlier one, hold more than half of its word characters.

Only DataFrame functions are used. Defined results: a null or empty text has
counts of 0, fails the base rules and is not kept; repeated rows are judged
one by one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, texts

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PCT = 20
MAX_LOST_PCT = 50
MAX_SYMBOL_PCT = 10

# A sentence mark anywhere in the line, marks of other scripts included.
SENTENCE = r"[.!?…:;。！？؟]"
SEPARATORS = "|»›•·"
MAX_SEPARATORS = 2
#: Notices are short lines; a phrase inside a longer paragraph is prose about one.
NOTICE_CHARS = 200
BOILERPLATE = ("licensed under", "public license", "all rights reserved", "copyright (c)", "©",
               "cookie policy", "privacy policy", "terms of use", "terms of service",
               "enable javascript", "lorem ipsum")


def let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``; inside a lambda a plain column
    expression would be evaluated again for every element."""
    return F.transform(F.array(value), body)[0]


def without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words_col(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def word_chars(text: Column) -> Column:
    return F.length(F.array_join(F.split(text, SPACES), ""))


def line_fails(line: Column) -> Column:
    """Whether a rule removes the line."""
    def notice(low: Column) -> Column:
        hit = low.contains(BOILERPLATE[0])
        for phrase in BOILERPLATE[1:]:
            hit |= low.contains(phrase)
        return hit

    separators = F.length(line) - F.length(without(line, SEPARATORS))
    return (~line.rlike(SENTENCE) | (separators > MAX_SEPARATORS)
            | (F.length(line) - F.length(without(line, SYMBOLS)) > F.length(line) * MAX_SYMBOL_PCT / 100)
            | F.when(F.length(line) <= NOTICE_CHARS, let(F.lower(line), notice)).otherwise(False))


def window_hashes(words: Column) -> Column:
    """64-bit hashes of the 5-word windows, from hashes of 1, 2 and 4 words."""
    def tail(a: Column, k: int) -> Column:
        return F.slice(a, k + 1, F.greatest(F.size(a) - k, F.lit(0)))

    def joined(a: Column, k: int, b: Column) -> Column:
        # the shorter side ends the pairs: zip_with pads it with nulls, cut off below
        return F.slice(F.zip_with(a, tail(b, k), lambda x, y: F.xxhash64(x, y)), 1,
                       F.greatest(F.size(b) - k, F.lit(0)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h1: let(
        joined(h1, 1, h1), lambda h2: let(joined(h2, 2, h2), lambda h4: joined(h4, 4, h1))))


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """Words inside a 5-word window that occurs twice or more.

    Windows are 64-bit hashes. Where all are distinct, the count is 0 at once;
    otherwise (hash, start) pairs are sorted, the starts of equal neighbours
    taken in order, and each adds 5 words less what it shares with the next.
    No step is worse than n log n in the words of one text."""
    zero = F.lit(0).cast("bigint")

    def starts(s: Column) -> Column:
        same = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(n), F.coalesce(F.get(p, i + 1) - x, F.lit(n)))),
                           zero, lambda a, x: a + x)

    return let(window_hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(
        let(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), starts), covered)))


def judge(docs: DataFrame) -> DataFrame:
    """Per document the base counts, what the line rules remove, the cleaned
    text and the verdict."""
    d = texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    d = d.withColumn("words", words_col(F.col("text"))).withColumn(
        "lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = (d.withColumn("first_lines", F.array_distinct("lines"))
         .withColumn("clean_lines", F.filter("first_lines", lambda x: ~line_fails(x))))
    d = d.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size("first_lines")).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("first_lines") - F.size("clean_lines")).cast("long").alias("n_failed_lines"),
        word_chars(F.array_join("clean_lines", "\n")).cast("long").alias("clean_word_chars"),
        F.array_join("clean_lines", "\n").alias("clean_text"))
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                     | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))
    lost = F.col("word_chars") - F.col("clean_word_chars")
    return d.withColumn("kept", ~F.col("base_failed") & (100 * lost <= MAX_LOST_PCT * F.col("word_chars")))
