"""Toxicity by FTRL-proximal logistic regression over hashed word features.

Features of a text are its words, pairs of neighbours and pairs with one word
between (skip-grams), hashed to ``2 ** BITS`` slots and taken once each. The
proximal update keeps a rate for each coordinate and an L1 threshold, so that
most weights stay exactly zero; what is broadcast is the few that are not.

The classifier is fitted on at most about ``FIT_ROWS`` labelled rows (a hash of
the id decides which, a documented bound); every text is scored, whole.

Defined results: a null or empty text scores the intercept alone; with no
labelled row the score is 0 everywhere; a null label or id is not learned from;
labels given twice for an id are both used; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, slices, texts

BITS = 22
FIT_ROWS = 12_000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 10.0, 1.0, 10
MIN_DOCS = 8
#: Toxic rows weigh (clean / toxic) to this power: 0 as they come, 1 balanced.
BALANCE = 0.3
THRESHOLD = 0.7
PUNCTUATION = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)


def words(text: str) -> list[bytes]:
    return text.encode().lower().translate(PUNCTUATION).split()


def word_ids(batch: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a batch, and each text's number of words."""
    import xxhash
    sizes, out = [], []
    for t in batch:
        w = words(t) if t else []
        sizes.append(len(w))
        out.append(np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w)))
    return np.concatenate(out) if out else np.empty(0, np.uint64), np.array(sizes, np.int64)


def features(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot and text number of every word, pair and skip pair."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    shift = np.uint64(64 - BITS)
    a, b, c = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
    slots, docs = [(ids * a) >> shift], [doc]
    for gap, m in ((1, b), (2, c)):
        same = doc[gap:] == doc[:-gap] if len(doc) > gap else np.empty(0, bool)
        x = ids[:-gap][same] * m
        x ^= x >> np.uint64(29)
        slots.append(((x + ids[gap:][same]) * a) >> shift)
        docs.append(doc[gap:][same] if len(doc) > gap else np.empty(0, np.int64))
    return np.concatenate(slots).astype(np.int64), np.concatenate(docs)


def fit(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Slots, weights and intercept from ``doc_id, text, label``; None without rows.
    Rows become feature lists where they lie; one task then reads the bounded
    sample in a fixed order."""
    rows = labelled.where("label is not null and text is not null")
    n = rows.count()
    if not n:
        return None
    share = F.xxhash64(F.col("doc_id").cast("string")).bitwiseAND(F.lit((1 << 32) - 1))
    sample = rows.where(share < int(min(1.0, FIT_ROWS / n) * 2 ** 32))

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b.text:
                slots, _ = features(*word_ids([t]))
                out.append(np.unique(slots).astype("<u4").tobytes())
            yield pd.DataFrame({"doc_id": b.doc_id.astype(str), "label": b.label.astype("int32"), "slots": out})

    def learn(g: pd.DataFrame) -> pd.DataFrame:
        from hashlib import md5
        g = g.assign(key=[md5(x.encode()).digest() for x in g.doc_id]).sort_values(["key", "label"], kind="stable")
        docs = [np.frombuffer(x, "<u4") for x in g.slots]
        often = np.zeros(1 << BITS, np.int32)
        for d in docs:
            often[d] += 1
        docs = [d[often[d] >= MIN_DOCS] for d in docs]
        z, sq = np.zeros(1 << BITS), np.zeros(1 << BITS)
        zb = nb = 0.0
        toxic = int(g.label.sum())
        base = np.log((toxic + 1) / (len(g) - toxic + 1))
        heavy = max(1.0, (len(g) - toxic) / max(1, toxic)) ** BALANCE
        for _ in range(EPOCHS):
            for d, y in zip(docs, g.label.tolist()):
                zd, root = z[d], np.sqrt(sq[d])
                w = -np.sign(zd) * np.maximum(np.abs(zd) - L1, 0) / ((BETA + root) / ALPHA + L2)
                wb = -zb / ((BETA + nb ** 0.5) / ALPHA)
                grad = 1 / (1 + np.exp(-np.clip(base + wb + w.sum(), -35, 35))) - y
                grad *= heavy if y else 1.0
                new = np.sqrt(sq[d] + grad * grad)
                z[d] = zd + grad - (new - root) / ALPHA * w
                sq[d] += grad * grad
                rate = (nb + grad * grad) ** 0.5
                zb += grad - (rate - nb ** 0.5) / ALPHA * wb
                nb += grad * grad
        w = -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(sq)) / ALPHA + L2)
        at = np.flatnonzero(w)
        wb = base - zb / ((BETA + nb ** 0.5) / ALPHA)
        return pd.DataFrame({"slot": np.r_[-1, at], "weight": np.r_[wb, w[at]]})

    found = (sample.select("doc_id", "text", "label").mapInPandas(listed, "doc_id string, label int, slots binary")
             .groupBy(F.lit(0).alias("one")).applyInPandas(learn, "slot long, weight double").collect())
    slots = np.array([r["slot"] for r in found], np.int64)
    weights = np.array([r["weight"] for r in found])
    return slots[slots >= 0], weights[slots >= 0], float(weights[slots < 0].sum())


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float] | None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id,
    text, held_out)``. At most ``2 ** BITS`` weights travel with the tasks."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = np.zeros(1 << BITS, np.float32)
        if model:
            w[model[0]] = model[1]
        for b in batches:
            for s in slices(b.text.str.len().fillna(0).tolist(), 2_000_000):
                part = b.iloc[s]
                total = np.full(len(part), model[2] if model else -np.inf)
                if model:
                    slots, doc = features(*word_ids(part.text.tolist()))
                    hit = np.flatnonzero(w[slots])
                    pairs = np.unique(doc[hit] << BITS | slots[hit])
                    total += np.bincount(pairs >> BITS, w[pairs & (1 << BITS) - 1], len(part))
                p = 1 / (1 + np.exp(-np.clip(total, -700, 700))) if model else np.zeros(len(part))
                yield pd.DataFrame({"doc_id": part.doc_id.to_numpy(), "held_out": part.held_out.to_numpy(),
                                    "score": p, "predicted": (p >= THRESHOLD).astype("int32")})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "held_out").mapInPandas(
        rows, f"doc_id {id_type}, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labelled documents outside the held-out third, score all."""
    d = texts(docs).withColumn("held_out", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)))
    marks = labels.select("doc_id", F.col("toxic").alias("label")).where("doc_id is not null and toxic is not null")
    return score(d, fit(d.where("not held_out").join(marks, "doc_id")))
