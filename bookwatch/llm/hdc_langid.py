"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1/-1 (seeded by its code point). A
3-gram is the product (binding) of its letters' vectors, each rotated
(permuted) by its place; a document is the weighted sum (bundle) of its
3-grams; a language prototype bundles its documents. A
document takes the language whose prototype has the largest cosine.

Defined results: a null text, or one without a letter, is ``und`` with score
0; so is every text when nothing can be learned. Null languages and null ids
are never learned from. Repeated rows are scored one by one. Ties go to the
language that sorts first. Columns beside doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, slices, texts, worker_memory

DIM = 1024
SEED = 20_25
#: Prototypes are held by the driver; more languages than this are refused.
MAX_LANGS = 4096
UND = "und"


class Encoder:
    """Document vectors; caches letter and 3-gram vectors up to a bound."""

    def __init__(self, dim: int = DIM, keep: int = 20_000):
        self.dim, self.keep = dim, keep
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, np.ndarray] = {}
        self.alpha = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)

    def letter(self, c: int) -> np.ndarray:
        v = self.letters.get(c)
        if v is None:
            v = (np.random.default_rng([SEED, c]).integers(0, 2, self.dim, dtype=np.int8) * 2 - 1).astype(np.int8)
            self.letters[c] = v
        return v

    def gram(self, code: int) -> np.ndarray:
        v = self.rows.get(code)
        if v is None:
            a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
            v = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
            if len(self.rows) >= self.keep:
                self.rows.clear()
                self.letters.clear()
            self.rows[code] = v
        return v

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct 3-grams over letters and word ends, and their counts."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        if not text:
            return none
        u = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le"), np.uint32).astype(np.int64)
        ok = self.alpha[u]
        if not ok.any():
            return none
        u = np.where(ok, u, 32)
        u = u[np.r_[True, ok[1:] | ok[:-1]]]  # runs of other characters become one space
        return np.unique(u[:-2] << 42 | u[1:-1] << 21 | u[2:], return_counts=True)

    def vectors(self, batch: list[str | None]) -> np.ndarray:
        """Unit vectors, zero rows for texts without a letter."""
        out = np.zeros((len(batch), self.dim), np.float32)
        found = [self.grams(t) for t in batch]
        for s in slices([len(f[0]) for f in found], 60_000):
            part = found[s]
            codes, at = np.unique(np.concatenate([f[0] for f in part]), return_inverse=True)
            if not len(codes):
                continue
            doc = np.repeat(np.arange(len(part)), [len(f[0]) for f in part])
            weight = np.log1p(np.concatenate([f[1] for f in part])).astype(np.float32)
            for lo in range(0, len(codes), 8192):  # bounded matrices for texts of many alphabets
                hv = np.stack([self.gram(c) for c in codes[lo:lo + 8192].tolist()]).astype(np.float32)
                m = (at >= lo) & (at < lo + 8192)
                c = np.zeros((len(part), len(hv)), np.float32)
                c[doc[m], at[m] - lo] = weight[m]
                out[s] += c @ hv
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def fit_prototypes(docs: DataFrame, dim: int = DIM) -> dict[str, np.ndarray]:
    """Prototype of each non-null ``lang`` over all rows of ``docs``.

    The sum of documents is linear in their 3-gram weights, so a partition adds
    up weights per (language, 3-gram) and encodes those once; a document's
    weights are divided by their Euclidean norm, which is its vector's expected
    norm up to a constant. The partial vectors meet per (lang, dimension), so no
    language, however common, gathers in one task. The driver gets langs x dim
    numbers."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_memory()
        enc = Encoder(dim)
        weights: dict[str, dict[int, float]] = {}
        total: dict[str, np.ndarray] = {}

        def bundle(lang: str) -> None:
            w = weights.pop(lang)
            codes = list(w)
            for lo in range(0, len(codes), 8192):
                hv = np.stack([enc.gram(c) for c in codes[lo:lo + 8192]]).astype(np.float32)
                total[lang] = total.get(lang, 0) + np.array([w[c] for c in codes[lo:lo + 8192]]) @ hv

        for b in batches:
            for lang, part in b.groupby("lang"):
                for s in slices(part.text.str.len().tolist(), 500_000):
                    found = [enc.grams(t) for t in part.text.iloc[s]]
                    unit = [(w := np.log1p(n)) / max(np.sqrt(w @ w), 1e-9) for _, n in found]
                    codes, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                    sums = np.bincount(at, np.concatenate(unit), len(codes))
                    w = weights.setdefault(lang, {})
                    for c, x in zip(codes.tolist(), sums.tolist()):
                        w[c] = w.get(c, 0.0) + x
                    if len(w) > 50_000:
                        bundle(lang)
        for lang in list(weights):
            bundle(lang)
        for lang, t in total.items():
            yield pd.DataFrame({"lang": lang, "dim": np.arange(dim, dtype=np.int32), "value": t})

    parts = (docs.where("lang is not null and text is not null").select("text", "lang")
             .mapInPandas(sums, "lang string, dim int, value double"))
    rows = parts.groupBy("lang", "dim").agg(F.sum("value").alias("value")).limit(MAX_LANGS * dim + 1).collect()
    if len(rows) > MAX_LANGS * dim:
        raise ValueError(f"more than {MAX_LANGS} languages")
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["lang"], np.zeros(dim))[r["dim"]] = r["value"]
    return {k: (v / n).astype(np.float32) for k, v in sorted(out.items()) if (n := np.linalg.norm(v)) > 0}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dim: int = DIM) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of
    ``docs(doc_id, text, held_out)``; the score is the cosine, 0 if negative."""
    names = sorted(prototypes)
    matrix = np.stack([prototypes[n] for n in names]) if names else np.zeros((0, dim), np.float32)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_memory()
        enc = Encoder(dim)
        for b in batches:
            for s in slices(b.text.str.len().fillna(0).tolist(), 2_000_000):
                part = b.iloc[s]
                v = enc.vectors(part.text.tolist())
                known = v.any(axis=1) & bool(names)
                cos = v @ matrix.T if names else np.zeros((len(v), 1))
                best = cos.argmax(axis=1)
                yield pd.DataFrame({
                    "doc_id": part.doc_id.to_numpy(), "held_out": part.held_out.to_numpy(),
                    "lang_pred": [names[i] if k else UND for i, k in zip(best, known)],
                    "score": np.where(known, np.clip(cos.max(axis=1), 0, 1), 0).astype(float)})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "held_out").mapInPandas(
        score, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, dim: int = DIM) -> DataFrame:
    """Learn from documents outside the held-out quarter, predict all."""
    d = texts(docs, "lang").withColumn("held_out", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)))
    return predict(d, fit_prototypes(d.where("doc_id is not null and not held_out"), dim), dim)
