"""Duplicate lines, paragraphs or passages across documents.

A text is cut into units (lines, or paragraphs between blank lines). A unit of
``min_words`` words or more is normalised (lower case, single spaces) and
digested to 96 bits; of all units with the same digest the one with the
smallest (doc_id, start) stays and the others are removed. Offsets are code
points of the original text.

Passages are units whose borders depend on content alone: a border stands before
a word where the hash of the word and the next is the smallest within ``REACH``
places to both sides. A unit runs from each border to the first border at least
``PASSAGE`` words on, so units overlap, line breaks do not matter, and the inside
of a repeated passage gives equal digests wherever it stands. Its first and last
few words, up to the outermost borders inside it, are not found. Kind ``all`` is
lines and passages together; spans that overlap are reported as one.

The first 64 bits of the digests are counted with map-side sums, and repeated
ones set a bit in a table of bounded size that travels to the tasks. Units whose
bit is not set are unique and go no further; the others are compared on all bits
by an equi-join. The first occurrences of the very frequent digests travel to
the tasks instead, so none gathers in one task. The
table only saves work: when it is full, every unit is compared.

Defined results: a null or empty text has no units; each row of the input is one
row of the report, with its own spans; equal units at the same place of rows
that repeat a doc_id are one occurrence; a null id ranks first and its row is
reported like the others; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, spread_join, texts, written

MIN_WORDS = 5
LINES = re.compile(r"[^\n]+")
#: Least words of a passage unit; places to both sides that a border's hash is compared with.
PASSAGE, REACH = 30, 2
#: Words of 64 bits in the table of repeated digests (16 MB as rows at most).
SLOTS = 1 << 20
WORDS = re.compile(r"\S+")
PARAGRAPHS = re.compile(r"[^\n]+(?:\n(?![^\S\n]*\n)[^\n]+)*")


def borders(h: np.ndarray) -> np.ndarray:
    """Places of the borders in a text of these word hashes, its ends included.
    Equal hashes within reach all count, so that a word or two said over and
    over have borders too."""
    n = len(h)
    g = h * np.uint64(0x9E3779B97F4A7C15)
    g[:-1] += h[1:]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    wide = np.full(n + 2 * REACH, np.iinfo(np.uint64).max)
    wide[REACH:n + REACH] = g
    least = np.ones(n, bool)
    for k in range(REACH):
        least &= (g <= wide[k:n + k]) & (g <= wide[REACH + 1 + k:REACH + 1 + k + n])
    least[0] = True
    return np.append(np.flatnonzero(least), n)


Unit = tuple[int, int, bytes, bool]


def passages(text: str) -> list[Unit]:
    """Start, end and digest of each passage unit, and that it is long."""
    import xxhash
    found = list(WORDS.finditer(text))
    if len(found) < PASSAGE:
        return []
    h = np.array([xxhash.xxh3_64_intdigest(m[0].lower()) for m in found], np.uint64)
    at = borders(h)
    upto = np.searchsorted(at, at + PASSAGE)
    raw, out = h.tobytes(), []
    for i, k in zip(at.tolist(), upto.tolist()):
        if k == len(at):
            break
        j = int(at[k])
        out.append((found[i].start(), found[j - 1].end(),
                    hashlib.blake2b(raw[8 * i:8 * j], digest_size=12, person=b"passage").digest(), True))
    return out


def cut(text: str, kind: str = "line", min_words: int = MIN_WORDS) -> list[Unit]:
    """Start, end and digest of each unit with enough words, and whether it has
    as many as a passage."""
    if kind == "all":
        return cut(text, "line", min_words) + passages(text)
    if kind == "passage":
        return passages(text)
    out = []
    for m in (LINES if kind == "line" else PARAGRAPHS).finditer(text):
        words = m[0].lower().split()
        if len(words) >= min_words:
            out.append((m.start(), m.end(), hashlib.blake2b(" ".join(words).encode(), digest_size=12).digest(),
                        len(words) >= PASSAGE))
    return out


def units(rows_: DataFrame, kind: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per unit of ``row, doc_id, text``, and one per row with the start -1
    and the number of its units in ``end``. ``k`` and ``v`` are the digest."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in slices(b.text.str.len().fillna(0).astype(int), 1_000_000):
                found = [cut(t or "", kind, min_words) for t in b.text.iloc[part]]
                head, n = b[["row", "doc_id"]].iloc[part].reset_index(drop=True), np.array([len(f) for f in found])
                yield head.assign(start=-1, end=n, k=0, v=0, long=False)
                if n.sum():
                    start, end, digest, long = zip(*(u for f in found for u in f))
                    key = np.frombuffer(b"".join(digest), [("k", "<i8"), ("v", "<i4")])
                    yield head.loc[head.index.repeat(n)].reset_index(drop=True).assign(
                        start=start, end=end, k=key["k"], v=key["v"], long=long)

    id_type = rows_.schema["doc_id"].dataType.simpleString()
    return rows_.mapInPandas(rows, f"row long, doc_id {id_type}, start int, end int, k long, v int, long boolean")


def duplicates(found: DataFrame) -> DataFrame:
    """``row, start, end, long`` of the units to remove."""
    slot, bit = F.pmod("k", F.lit(SLOTS)).cast("int").alias("slot"), "cast(pmod(shiftright(k, 20), 64) as int)"
    u = found.where("start >= 0")
    repeated = u.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select(slot, F.expr(bit).alias("bit"))
    table = repeated.groupBy("slot").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    u = (u.select("*", slot).join(F.broadcast(table), "slot").where(f"getbit(bits, {bit}) = 1")
         .select("k", "v", "row", "doc_id", "start", "end", "long"))
    first = written(u.groupBy("k", "v").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n"))
                    .where("n > 1"), "firsts")
    at = F.struct("doc_id", "start")
    both = spread_join(u, first, ["k", "v"], first.agg(F.sum("n")).first()[0] or 0)
    return both.where(~at.eqNullSafe(F.col("first"))).select("row", "start", "end", "long").distinct()


def reported(rows_: DataFrame, kind: str, min_words: int) -> DataFrame:
    found = written(units(rows_, kind, min_words), "units")
    heads = found.where("start < 0").select("row", "doc_id", F.col("end").cast("long").alias("n_units"))
    gone = duplicates(found).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("at"), F.count_if("long").alias("n_long"))
    out = heads.join(gone, "row", "left").select(
        "row", "doc_id", "n_units", F.coalesce("n_long", F.lit(0)).alias("n_removed"),
        (F.coalesce(F.size("at"), F.lit(0)) - F.coalesce("n_long", F.lit(0))).cast("long").alias("n_lines"),
        F.col("at.start").alias("lo"), F.col("at.end").alias("hi"))

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans = [union(lo, hi) if lo is not None else [] for lo, hi in zip(b.lo, b.hi)]
            yield b[["row", "doc_id", "n_units", "n_removed", "n_lines"]].assign(
                removed_chars=[sum(z - a for a, z in s) for s in spans],
                spans=[",".join(f"{a}:{z}" for a, z in s) for s in spans])

    id_type = rows_.schema["doc_id"].dataType.simpleString()
    return out.mapInPandas(merged, f"row long, doc_id {id_type}, n_units long, n_removed long, n_lines long, "
                                   "removed_chars long, spans string")


def numbered(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("row", F.monotonically_increasing_id())


def report(docs: DataFrame, kind: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """Per row the number of units, of removed ones with as many words as a
    passage (``n_removed``) and of shorter removed lines (``n_lines``), the removed
    characters, and all removed spans in order."""
    return reported(numbered(docs), kind, min_words).drop("row")


def union(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Sorted spans, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, z in zip(lo.tolist(), hi.tolist()):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def remove(docs: DataFrame, kind: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, text`` with each row's own repeated units cut out, and the removed
    spans."""
    rows_ = written(numbered(docs), "rows")
    d = rows_.join(reported(rows_, kind, min_words).select("row", "spans"), "row").select("doc_id", "text", "spans")

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            clean = []
            for text, at in zip(b.text, b.spans):
                if text is not None:
                    for part in reversed(at.split(",") if at else []):
                        lo, hi = map(int, part.split(":"))
                        whole = lo == 0 or text[lo - 1] == "\n"
                        text = text[:lo] + text[hi + (whole and text[hi:hi + 1] == "\n"):]
                clean.append(text)
            yield b.assign(text=clean)

    return d.mapInPandas(cut_out, d.schema)
