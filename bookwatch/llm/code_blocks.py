"""Vector codes: product quantisation in whole numbers over Hilbert-sorted blocks.

Components become ``floor(1024 * x)``; a vector is cut into equal parts, each
with a codebook of at most 256 entries that a few rounds of exact k-means move.
The parts of all vectors are written once as flat blocks: sorted along a Hilbert
curve, so that a block's parts are near each other, each block with the smallest
box around its parts, their sums and their number. A round never visits a part
whose block is settled: the squared distances of each entry to the nearest and
the farthest point of the box leave a shortlist, and only entries on it can be
nearest to a part of the block. A shortlist of one takes the stored sums; any
other is evaluated part by part, in whole numbers.

Rows whose vector is null or holds null or non-finite components are dropped.
Shorter vectors are padded with zeros to the longest, and to a multiple of the
number of parts. Components beyond 2 ** 24 either way are set to that bound, so
that distances fit 64 bits. Null ids are coded like others and come last among
the starting entries; rows that repeat an id are coded each, in the order of
their components. An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, BOUND = 1024, 2 ** 24
ENTRIES, ROUNDS, PARTS = 256, 4, 4
#: Parts of a block, and the bits of a coordinate on the curve's grid.
BLOCK, BITS = 128, 4
#: Labels up to which their sums are sent to all tasks.
FEW = 20_000
#: Products of whole numbers add up exactly in doubles below this.
EXACT = 2 ** 53


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Places on the Hilbert curve through a grid of ``2 ** bits`` cells a side,
    as byte strings in its order; one row of ``cells`` a point. Each step of the
    curve goes to a neighbouring cell."""
    x = cells.T.astype(np.uint32).copy()
    top = 1 << (bits - 1)
    bit = top
    while bit > 1:  # undo the turns and mirrors of each level
        low = np.uint32(bit - 1)
        for k in range(len(x)):
            on = (x[k] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(on, low, swap)
            if k:
                x[k] ^= swap
        bit >>= 1
    for k in range(1, len(x)):  # Gray code across the coordinates
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    bit = top
    while bit > 1:
        turn ^= np.where(x[-1] & bit, np.uint32(bit - 1), np.uint32(0))
        bit >>= 1
    x ^= turn
    planes = (x[None] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)[:, None, None]) & 1
    packed = np.packbits(planes.reshape(-1, x.shape[1]).astype(np.uint8), axis=0)
    return [p.tobytes() for p in np.ascontiguousarray(packed.T)]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of whole numbers as rows of ``dims``, padded with zeros."""
    flat, ends = np.asarray(column.flatten()), np.asarray(column.value_lengths())
    if (ends == dims).all():
        return flat.reshape(len(ends), dims)
    out = np.zeros((len(ends), dims), np.int64)
    out[np.arange(dims) < ends[:, None]] = flat
    return out


def kept(vectors: DataFrame, column: str, label: str, key: str) -> DataFrame:
    """``row, vec_id, label, v``: rows with whole vectors, in whole numbers."""
    x = F.col(column)
    whole = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double"))
                                      | (F.abs(c.cast("double")) == float("inf")))
    number = F.transform(x, lambda c: F.floor(F.least(F.greatest(
        c.cast("double") * SCALE, F.lit(-float(BOUND))), F.lit(float(BOUND)))).cast("bigint"))
    return written(vectors.where(F.coalesce(whole, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("vec_id"), F.col(label).alias("label"),
        number.alias("v")), "vectors")


def blocks_of(rows: DataFrame, books: np.ndarray, dims: int) -> DataFrame:
    """Flat blocks of all parts: ``part, n, rows, v, lo, hi, sums``, the arrays as
    bytes of 64-bit numbers. The curve's grid spans the starting entries of a
    part; what lies beyond them is in the outer cells."""
    parts, _, width = books.shape
    lo, hi = books.min(1), books.max(1)
    cell = np.maximum(-(-(hi - lo + 1) // 2 ** BITS), 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), dims).reshape(-1, parts, width)
            for p in range(parts):
                at = np.clip((v[:, p] - lo[p]) // cell[p], 0, 2 ** BITS - 1)
                part = np.ascontiguousarray(v[:, p]).astype("<i4")
                yield pa.record_batch({
                    "part": pa.array(np.full(len(v), p, np.int32)), "curve": pa.array(hilbert_keys(at, BITS), pa.binary()),
                    "row": batch.column("row"), "v": pa.array([x.tobytes() for x in part], pa.binary())})

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= 64 * BLOCK:
                yield from pack(pa.Table.from_batches(held))
                held = []
        if held:
            yield from pack(pa.Table.from_batches(held))

    def pack(table: pa.Table) -> Iterator[pa.RecordBatch]:
        part = table.column("part").to_numpy()
        row = table.column("row").to_numpy()
        v = np.frombuffer(b"".join(table.column("v").to_pylist()), "<i4").reshape(len(part), width).astype(np.int64)
        found = []
        for p in np.unique(part):
            mine = np.flatnonzero(part == p)
            for k in range(0, len(mine), BLOCK):
                at = mine[k:k + BLOCK]
                x = v[at]
                found.append({"part": int(p), "n": len(at), "rows": row[at].tobytes(), "v": x.tobytes(),
                              "lo": x.min(0).tobytes(), "hi": x.max(0).tobytes(), "sums": x.sum(0).tobytes()})
        yield from pa.Table.from_pylist(found).to_batches()

    points = rows.select("row", "v").mapInArrow(cut, "part int, curve binary, row long, v binary")
    sorted_ = points.repartitionByRange("part", "curve", "row").sortWithinPartitions("part", "curve", "row")
    return written(sorted_.mapInArrow(
        flat, "part long, n long, rows binary, v binary, lo binary, hi binary, sums binary"), "blocks")


def shortlist(lo: np.ndarray, hi: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Indexes, ascending, of the entries that can be nearest to a point of the
    box: no other entry is nearer to all of the box than they are to any of it."""
    near = np.maximum(np.maximum(lo - book, book - hi), 0)
    far = np.maximum(np.abs(book - lo), np.abs(book - hi))
    near, far = (near * near).sum(1), (far * far).sum(1)
    return np.flatnonzero(near <= far.min())


def nearest(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``v`` its nearest entry, the first of equal ones, and the
    squared distance. Exact: products go through doubles only where all sums
    stay below 2 ** 53."""
    most = max(np.abs(v).max(initial=0), np.abs(book).max(initial=0))
    if 4 * int(most) ** 2 * v.shape[1] < EXACT:
        product = (v.astype(np.float64) @ book.T.astype(np.float64)).astype(np.int64)
    else:
        product = v @ book.T
    far = (v * v).sum(1)[:, None] + (book * book).sum(1)[None] - 2 * product
    best = far.argmin(1)
    return best, far[np.arange(len(v)), best]


def walk(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple]:
    """``(part, block, shortlist)`` of each block, a block as a dict of arrays."""
    width = books.shape[2]
    for batch in batches:
        for b in batch.to_pylist():
            block = {k: np.frombuffer(b[k], np.int64) for k in ("rows", "v", "lo", "hi", "sums")}
            block["v"] = block["v"].reshape(-1, width)
            yield b["part"], block, shortlist(block["lo"], block["hi"], books[b["part"]])


def moved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: each entry the floor of its parts' mean."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        total = np.zeros((parts, entries, width + 1), np.int64)
        for p, block, short in walk(batches, books):
            if len(short) == 1:
                total[p, short[0], :width] += block["sums"]
                total[p, short[0], width] += len(block["rows"])
                continue
            best = short[nearest(block["v"], books[p][short])[0]]
            np.add.at(total[p, :, :width], best, block["v"])
            total[p, :, width] += np.bincount(best, minlength=entries)
        p, e = np.nonzero(total[:, :, width])
        yield pa.record_batch({"part": pa.array(np.repeat(p, width + 1).astype(np.int32)),
                               "entry": pa.array(np.repeat(e, width + 1).astype(np.int32)),
                               "at": pa.array(np.tile(np.arange(width + 1, dtype=np.int32), len(p))),
                               "total": pa.array(total[p, e].reshape(-1))})

    sums = blocks.mapInArrow(add, "part int, entry int, at int, total long")
    found = sums.groupBy("part", "entry", "at").agg(F.sum("total").alias("total")).collect()
    width = books.shape[2]
    total = np.zeros((*books.shape[:2], width + 1), np.int64)
    for r in found:
        total[r["part"], r["entry"], r["at"]] = r["total"]
    n = total[:, :, width:]
    return np.where(n > 0, total[:, :, :width] // np.maximum(n, 1), books)


def assigned(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """``row, code, error``: a row's codes, 8 bits a part, the first part highest,
    and its squared distance."""
    parts = books.shape[0]

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, block, short in walk(batches, books):
            best, error = nearest(block["v"], books[p][short])
            yield pa.record_batch({"row": pa.array(block["rows"]),
                                   "code": pa.array(short[best].astype(np.int64) << 8 * (parts - 1 - p)),
                                   "error": pa.array(error)})

    return blocks.mapInArrow(give, "row long, code long, error long").groupBy("row").agg(
        F.sum("code").alias("code"), F.sum("error").alias("error"))


def train(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS,
          parts: int = PARTS) -> tuple[DataFrame, np.ndarray] | None:
    """The blocks and the final codebooks ``[part, entry, component]``; None for
    an empty table."""
    if not 1 <= entries <= 256 or not 1 <= parts <= 7:
        raise ValueError("codes take a byte a part and a long together: up to 256 entries, up to 7 parts")
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None
    dims = max(1, -(-longest // parts)) * parts
    first = [r["v"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()]
    start = np.array([v + [0] * (dims - len(v)) for v in first], np.int64)
    books = np.ascontiguousarray(start.reshape(len(first), parts, -1).transpose(1, 0, 2))
    blocks = blocks_of(rows, books, dims)
    for _ in range(rounds):
        new = moved(blocks, books)
        if (new == books).all():  # every later round would leave it as it is
            break
        books = new
    return blocks, books


def codes(vectors: DataFrame, column: str = "embedding", label: str = "label", key: str = "vec_id",
          entries: int = ENTRIES, rounds: int = ROUNDS, parts: int = PARTS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every kept row."""
    rows = kept(vectors, column, label, key)
    found = train(rows, entries, rounds, parts)
    if found is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                           F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    blocks, books = found
    seal = sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    coded = written(assigned(blocks, books).join(rows.select("row", "vec_id", "label"), "row"), "codes")
    sums = written(coded.groupBy(F.col("label").alias("_label")).agg(
        F.sum(F.col("error").cast("decimal(38, 0)")).cast("long").alias("label_error")), "labels")
    sums = F.broadcast(sums) if sums.count() <= FEW else sums
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", F.lower(F.lpad(F.hex("code"), 2 * parts, "0")).alias("code"), "error", "label_error",
        F.lit(seal).alias("codebooks_sha256"))
