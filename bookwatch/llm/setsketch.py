"""Near-duplicates with SetSketch registers.

A text's set is its distinct five-word shingles. Each of ``M`` registers holds
``floor(1 - log_b x)`` of the smallest ``x`` among exponentially distributed
values drawn per shingle and register: minima on an exponential scale, truncated
to 16 bits. Registers of a union are the larger of two, so sketches merge, and
equal registers are as likely as shingles are shared, so bands of registers
serve as hash keys.

The steps: equal sets collapse to one representative; a band key shared by
several representatives links each to the smallest (a star, never all pairs);
the joint likelihood of the registers, given both set sizes, drops pairs far
below the threshold; what is left is confirmed on full shingle sets. Components
of the confirmed links follow. Then documents whose band keys still hold several
components are compared across components, in blocks of bounded size, so that a
link is missed only if no band joins its two documents: with 36 bands of 4
registers less than twice in a million at similarity 0.75.

Defined results: a null or empty text has an empty set, links with nothing and
is kept; a null id cannot be linked and has no component; rows that repeat an
id are one document for linking when their sets are equal, else the id links
through each of its texts; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, slices, texts, words_of, worker_memory, written

SHINGLE = 5
NUM, DEN = 75, 100
ROWS, BANDS = 4, 36
M = ROWS * BANDS
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: Pairs whose most likely similarity is lower are not confirmed: five standard errors.
LEAST = NUM / DEN - 5 * (NUM / DEN * (1 - NUM / DEN) / M) ** 0.5
BLOCK = 256
SMALL = 1_000_000
_rng = np.random.default_rng(7)
MIX = _rng.integers(1 << 62, 1 << 63, M, dtype=np.uint64) | np.uint64(1)
SALT = _rng.integers(0, 1 << 63, M, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    import xxhash
    w = words_of(text) if text else []
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = max(1, len(h) - SHINGLE + 1)
    out = np.full(n, len(h) if len(h) < SHINGLE else SHINGLE, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out = (out ^ h[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out * np.uint64(0xD6E8FEB86659FD93))


def sketch(s: np.ndarray) -> np.ndarray:
    """Registers of a non-empty set."""
    least = np.full(M, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(s), 512):
        part = (s[lo:lo + 512, None] ^ SALT) * MIX
        np.minimum(least, part.min(axis=0), out=least)
    u = (least >> np.uint64(11)).astype(float) + 0.5
    x = -np.log1p(-u / (1 << 53)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype("<u2")


def band_keys(registers: np.ndarray) -> np.ndarray:
    r = registers.reshape(-1, BANDS, ROWS).astype(np.uint64)
    out = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        out = (out ^ r[:, :, k]) * np.uint64(0xC2B2AE3D27D4EB4F)
        out = out ^ out >> np.uint64(31)
    return out.view(np.int64)


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Most likely similarity of pairs from their registers and set sizes.

    With shares ``u`` and ``v`` of the sizes, a register of the first set is
    larger with probability ``p(u - v J)``, of the second with ``p(v - u J)``,
    where ``p(x) = -log_b(1 - x (b - 1) / b)``."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = na / (na + nb)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 101)[None, :] * top[:, None]

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)

    pu, pv = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    tiny = 1e-12
    score = (more[:, None] * np.log(pu + tiny) + less[:, None] * np.log(pv + tiny)
             + same[:, None] * np.log(np.maximum(1 - pu - pv, 0) + tiny))
    return grid[np.arange(len(grid)), score.argmax(axis=1)]


def maybe(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Pairs that sizes and sketches leave possible."""
    ok = DEN * np.minimum(na, nb) >= NUM * np.maximum(na, nb)
    ok[ok] = likely(a[ok], b[ok], na[ok].astype(float), nb[ok].astype(float)) >= LEAST
    return ok


def matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(len(column), M)


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, n, same, registers``: set size, digest of the set, registers
    (null for the empty set), one row per document."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_memory()
        for b in batches:
            out = []
            for t in b.text:
                s = shingles(t)
                out.append((len(s), blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None,
                            sketch(s).tobytes() if len(s) else None))
            f = pd.DataFrame(out, columns=["n", "same", "registers"])
            f.insert(0, "doc_id", b.doc_id.to_numpy())
            yield f

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return written(texts(docs).mapInPandas(rows, f"doc_id {id_type}, n long, same binary, registers binary"), "sketches")


def banded(reps: DataFrame) -> DataFrame:
    """``band, doc_id``: the band keys of every representative."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in slices([BANDS] * len(b), 200_000):
                part = b.iloc[s]
                keys = band_keys(matrix(part.registers))
                yield pd.DataFrame({"band": keys.ravel(), "doc_id": np.repeat(part.doc_id.to_numpy(), BANDS)})

    id_type = reps.schema["doc_id"].dataType.simpleString()
    return reps.select("doc_id", "registers").mapInPandas(rows, f"band long, doc_id {id_type}")


def possible(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that the likelihood leaves, with their set sizes."""
    r = reps.select("doc_id", "n", "registers")
    both = (pairs.join(r.toDF("a", "na", "ra"), "a").join(r.toDF("b", "nb", "rb"), "b")
            .where(DEN * F.least("na", "nb") >= NUM * F.greatest("na", "nb")))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b[maybe(matrix(b.ra), matrix(b.rb), b.na.to_numpy(), b.nb.to_numpy())][["a", "b", "na", "nb"]]

    id_type = reps.schema["doc_id"].dataType.simpleString()
    return both.mapInPandas(rows, f"a {id_type}, b {id_type}, na long, nb long")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, s``: shingle sets of the documents in ``wanted(doc_id)`` only."""
    wanted = written(wanted.distinct(), "wanted")
    if wanted.count() <= SMALL:
        wanted = F.broadcast(wanted)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in slices([len(t) for t in b.text], 4_000_000):
                part = b.iloc[s]
                yield pd.DataFrame({"doc_id": part.doc_id.to_numpy(),
                                    "s": [shingles(t).view(np.int64) for t in part.text]})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return written(texts(docs).where("text is not null").join(wanted, "doc_id", "left_semi")
                   .mapInPandas(rows, f"doc_id {id_type}, s array<bigint>").where("size(s) > 0"), "sets")


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Links ``a, b`` whose full shingle sets are similar enough."""
    pairs = written(pairs, "pairs")
    sets = full_sets(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")))
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return (pairs.select("a", "b").join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a")
            .where(DEN * common >= NUM * union).select("a", "b").distinct())


def common_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets, by products of
    incidence matrices over a bounded number of shingles at a time."""
    values, at = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    row = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in [*x, *y]])
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out = np.zeros((len(x), len(y)), np.float32)
    for lo in range(0, len(values), 8192):
        i, j = np.searchsorted(at, [lo, lo + 8192])
        m = np.zeros((len(x) + len(y), 8192), np.float32)
        m[row[i:j], at[i:j] - lo] = 1
        out += m[:len(x)] @ m[len(x):].T
    return out


def links_between(g: pd.DataFrame) -> list[tuple[int, int]]:
    """Row pairs of two blocks that are linked, in different components and not
    joined yet by a pair before them: at most one per row."""
    n, c, i = g.n.to_numpy(), g.component.to_numpy(), g.i.to_numpy()
    left, right = np.flatnonzero(i == g.x.iloc[0]), np.flatnonzero(i == g.y.iloc[0])
    r = matrix(g.registers)
    pairs = []
    for k in range(0, len(left), 16):  # 16 rows against a block at once
        p = left[k:k + 16]
        apart = (c[p][:, None] != c[right]) & (
            DEN * np.minimum(n[p][:, None], n[right]) >= NUM * np.maximum(n[p][:, None], n[right]))
        equal = (r[p][:, None, :] == r[right][None, :, :]).sum(axis=2)
        a, b = np.nonzero(apart & (equal >= (LEAST - 0.1) * M))
        if len(a):
            a, b = p[a], right[b]
            ok = maybe(r[a], r[b], n[a], n[b])
            pairs.append(np.stack([a[ok], b[ok]]))
    a, b = np.concatenate(pairs, axis=1) if pairs else np.empty((2, 0), np.int64)
    if not len(a):
        return []
    xs, ys = np.unique(a), np.unique(b)
    sets = g.s.to_list()
    both = common_counts([sets[k] for k in xs], [sets[k] for k in ys])[
        np.searchsorted(xs, a), np.searchsorted(ys, b)]
    linked = DEN * both >= NUM * (n[a] + n[b] - both)
    root: dict = {}

    def find(v):
        while (up := root.get(v, v)) != v:
            v = up
        return v

    out = []
    for p, q in zip(a[linked].tolist(), b[linked].tolist()):
        u, v = find(c[p]), find(c[q])
        if u != v:
            root[u] = v
            out.append((p, q))
    return out


def across(bands: DataFrame, reps: DataFrame, parts: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between components that share band keys.

    Documents that such keys connect form a cluster. Its members are dealt into
    blocks; a task takes two blocks, filters the pairs of different components by
    their sketches, confirms the rest on full sets and returns a forest, so the
    output is bounded by the members, not by their pairs."""
    members = bands.join(parts, F.col("doc_id") == F.col("id"), "left").select(
        "band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = members.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                        F.min("doc_id").alias("first")).where("lo < hi")
    touched = written(members.join(mixed.select("band", "first"), "band").select(
        "first", "doc_id", "component").distinct(), "mixed")
    clusters = components(touched.select(F.col("first").alias("a"), F.col("doc_id").alias("b")))
    m = (touched.select("doc_id", "component").distinct()
         .join(clusters.select(F.col("id").alias("doc_id"), F.col("component").alias("cluster")), "doc_id"))
    sizes = m.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    m = written(m.join(sizes, "cluster").withColumn("i", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")),
                "members")
    full = (m.join(reps.select("doc_id", "n", "registers"), "doc_id")
            .join(full_sets(docs, m.select("doc_id")), "doc_id").where(F.size("s") == F.col("n")))
    full = full.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cluster", "doc_id", "component", "n", "registers", "s", "i",
        F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"))
    id_type = reps.schema["doc_id"].dataType.simpleString()

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("doc_id", kind="stable").reset_index(drop=True)
        found, d = links_between(g), g.doc_id.to_numpy()
        return pd.DataFrame({"a": [d[p] for p, _ in found], "b": [d[q] for _, q in found]}, dtype=d.dtype)

    return full.groupBy("cluster", "x", "y").applyInPandas(compare, f"a {id_type}, b {id_type}").distinct()


def link(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document."""
    every = sketches(docs)
    named = every.where("doc_id is not null and n > 0")
    classes = written(named.groupBy("same").agg(F.min("doc_id").alias("rep")), "classes")
    reps = written(named.join(classes, "same").where("doc_id = rep").select("doc_id", "n", "registers")
                   .dropDuplicates(["doc_id", "registers"]), "reps")
    bands = written(banded(reps), "bands")
    shared = bands.groupBy("band").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z")
    star = bands.join(shared, "band").where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    links = written(confirmed(possible(star, reps), docs), "links")
    rest = across(bands, reps, components(links), docs)
    same = named.join(classes, "same").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    parts = components(links.union(rest).union(same.distinct()))
    return every.join(parts, every["doc_id"] == parts["id"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"))
