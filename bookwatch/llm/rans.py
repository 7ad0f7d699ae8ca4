"""Token ids in a range asymmetric numeral system.

One frequency table, counted over all documents, serves every block. A block
holds the ids of consecutive whole documents in ascending doc_id order, coded in
interleaved lanes (id ``k`` in lane ``k % lanes``), so that a step codes one id
of each lane at once. Blocks do not depend on each other, and inside a block
checkpoints (the states of all lanes and the place in the word stream) let
decoding start anywhere, in parallel. A checksum guards each block.

Block layout, little endian::

    magic "RNS1", ids, documents, lanes, checkpoints, words     6 x u32
    document lengths                                            documents x u32
    place in the words of each checkpoint                       checkpoints x u32
    states of each checkpoint                                   checkpoints x lanes x u64
    words                                                       words x u32
    crc32 of all before                                         u32

Checkpoint ``c`` stands before step ``c * STEPS``; checkpoint 0 is the start.

A file is a folder (in any store that Spark reads) of two tables. ``blocks`` has
the blocks as a binary column, beside the part and block number, the place of
the block's first id in its part, and its document ids; ``frequencies`` has the
shared table as (id, share) rows. Nothing else is needed to decode it. Reading
decodes each block from checkpoint to checkpoint, so a very long document takes
no more memory than the ids between two of them.

Defined results: a null or empty text is its end id; documents with the same id
are stored one after the other; null ids come first; an empty table gives an
empty file; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import texts, written
from .tokens import Ids

END = 1
SCALE = 20  # bits of the frequency total
LANES = 1024
STEPS = 256  # steps between checkpoints
BLOCK = 1 << 20  # ids after which a block is closed
POINTS = 4  # checkpoints whose ids are decoded together
MAGIC = 0x31534E52
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)


def frequencies(ids: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Counts scaled to a total of ``2 ** SCALE``, at least 1 for ids that occur."""
    total = 1 << SCALE
    if len(ids) > total // 2:
        raise ValueError(f"{len(ids)} ids do not fit a table of {total}")
    out = np.zeros(size, np.uint64)
    if not len(ids):
        return out
    share = np.maximum(1, np.floor(counts * (total / counts.sum()))).astype(np.int64)
    over = int(share.sum()) - total
    for k in np.argsort(-share, kind="stable"):  # the frequent ids bear the rounding
        if over <= 0:
            share[k] -= over
            break
        cut = min(over, int(share[k]) // 2)
        share[k] -= cut
        over -= cut
    out[ids] = share
    return out


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.low = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.most = self.freq << np.uint64(63 - SCALE)
        self.symbol: np.ndarray | None = None

    def encode(self, ids: np.ndarray, lengths: np.ndarray) -> bytes:
        n, s = len(ids), np.uint64(SCALE)
        steps = -(-n // LANES)
        state = np.full(LANES, LOW, np.uint64)
        words: list[np.ndarray] = []
        saved: list[np.ndarray] = []
        emitted = np.zeros(steps + 1, np.int64)
        for t in range(steps - 1, -1, -1):
            sym = ids[t * LANES:(t + 1) * LANES]
            x, f = state[:len(sym)], self.freq[sym]
            full = x >= self.most[sym]
            w = x[full]
            words.append(w.astype(np.uint32))
            emitted[t + 1] = len(w)
            x[full] = w >> WORD
            q = x // f
            state[:len(sym)] = (q << s) + (x - q * f) + self.low[sym]
            if t % STEPS == 0:
                saved.append(state.copy())
        stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
        place = np.cumsum(emitted)[:steps:STEPS].astype("<u4")
        body = b"".join([
            struct.pack("<6I", MAGIC, n, len(lengths), LANES, len(saved), len(stream)),
            lengths.astype("<u4").tobytes(), place.tobytes(),
            b"".join(x.astype("<u8").tobytes() for x in saved[::-1]), stream.astype("<u4").tobytes()])
        return body + struct.pack("<I", zlib.crc32(body))

    def read(self, block: bytes) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
            raise ValueError("block checksum does not match")
        magic, n, docs, lanes, points, words = struct.unpack_from("<6I", block)
        if magic != MAGIC:
            raise ValueError("not a block")
        at = 24
        lengths = np.frombuffer(block, "<u4", docs, at)
        place = np.frombuffer(block, "<u4", points, at + 4 * docs)
        at += 4 * (docs + points)
        states = np.frombuffer(block, "<u8", points * lanes, at).reshape(points, lanes)
        stream = np.frombuffer(block, "<u4", words, at + 8 * points * lanes)
        return n, lanes, lengths, place, states, stream

    def decode(self, block: bytes, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Document lengths of the block, and its ids between two checkpoints
        (all by default)."""
        read = self.read(block)
        return read[2], self.between(read, first, last)

    def parts(self, block: bytes, points: int) -> tuple[np.ndarray, Iterator[np.ndarray]]:
        """Document lengths of the block, and its ids by ``points`` checkpoints."""
        read = self.read(block)
        return read[2], (self.between(read, k, min(k + points, len(read[4]))) for k in range(0, len(read[4]), points))

    def between(self, read: tuple, first: int, last: int | None) -> np.ndarray:
        if self.symbol is None:
            self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        n, lanes, _, place, states, stream = read
        begin = first * STEPS
        end = min(-(-n // lanes), begin + STEPS * ((len(states) if last is None else last) - first))
        out = np.empty(max(0, min(n, end * lanes) - begin * lanes), np.uint32)
        if not len(out):
            return out
        state, at = states[first].astype(np.uint64), int(place[first])
        stop = int(place[last]) if last is not None and last < len(place) else len(stream)
        wide, at, s, mask = stream[at:stop].astype(np.uint64), 0, np.uint64(SCALE), np.uint64((1 << SCALE) - 1)
        for t in range(begin, end):
            k = min(lanes, n - t * lanes)
            x = state[:k]
            slot = x & mask
            sym = self.symbol[slot]
            out[(t - begin) * lanes:(t - begin) * lanes + k] = sym
            x = self.freq[sym] * (x >> s) + slot - self.low[sym]
            need = np.flatnonzero(x < LOW)
            x[need] = x[need] << WORD | wide[at:at + len(need)]
            at += len(need)
            state[:k] = x
        return out


def document_crcs(lengths: np.ndarray, parts: Iterator[np.ndarray]) -> list[int]:
    """crc32 of the ids of each document, from the parts of a block in order."""
    ends = np.cumsum(lengths, dtype=np.int64)
    begins, out, k, at, running = ends - lengths, [], 0, 0, 0
    for ids in parts:
        data, base, at = ids.astype("<u4").tobytes(), at, at + len(ids)
        while k < len(ends) and ends[k] <= at:
            out.append(zlib.crc32(data[4 * (max(begins[k], base) - base):4 * (ends[k] - base)], running))
            k, running = k + 1, 0
        if k < len(ends) and begins[k] < at:
            running = zlib.crc32(data[4 * (max(begins[k], base) - base):], running)
    return out


def token_table(docs: DataFrame, path: str, kind: str = "word", end: int = END) -> DataFrame:
    """``doc_id``, its number of ids and the ids as 16-bit numbers."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = Ids(path, kind, 2)
        tail = np.array([end], ids.dtype).tobytes()
        for b in batches:
            data = [ids.of(t) + tail for t in b.text]
            yield pd.DataFrame({"doc_id": b.doc_id.to_numpy(), "n": [len(d) // 2 for d in data], "ids": data})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return written(texts(docs).mapInPandas(encode, f"doc_id {id_type}, n long, ids binary"), "ids")


def count_ids(tokens: DataFrame) -> np.ndarray:
    """The frequency table over every id stored. The driver gets a row for each
    id of the vocabulary at most."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.ids), "<u2"), minlength=1 << 16)
        k = np.flatnonzero(total)
        yield pd.DataFrame({"id": k, "c": total[k]})

    rows = tokens.select("ids").mapInPandas(counts, "id int, c long").groupBy("id").agg(
        F.sum("c").alias("c")).orderBy("id").collect()
    return frequencies(np.array([r["id"] for r in rows], np.int64), np.array([r["c"] for r in rows], np.float64), 1 << 16)


def write_file(tokens: DataFrame, path: str) -> None:
    """Write the file to the folder ``path``: blocks of documents in ascending id
    order. Range partitions keep the order between parts; a tie-break splits an
    id that is very common."""
    freq = count_ids(tokens)
    spark = tokens.sparkSession
    at = np.flatnonzero(freq)  # a row for each id of the vocabulary at most
    spark.createDataFrame([(int(k), int(freq[k])) for k in at], "id int, share long").coalesce(1).write.parquet(
        f"{path}/frequencies")
    id_type = tokens.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, part = Coder(freq), TaskContext.get().partitionId()
        ids, docs, sizes, n, start, block = [], [], [], 0, 0, 0

        def close() -> pd.DataFrame:
            nonlocal ids, docs, sizes, n, start, block
            row = pd.DataFrame({"part": [part], "block": [block], "start": [start], "n_ids": [n], "doc_ids": [docs],
                                "payload": [coder.encode(np.frombuffer(b"".join(ids), "<u2"), np.array(sizes))]})
            ids, docs, sizes, n, start, block = [], [], [], 0, start + n, block + 1
            return row

        for b in batches:
            for doc, size, data in zip(b.doc_id, b.n, b.ids):
                ids.append(data)
                docs.append(None if pd.isna(doc) else doc)
                sizes.append(size)
                n += size
                if n >= BLOCK:
                    yield close()
        if sizes:
            yield close()

    ordered = (tokens.withColumn("__row", F.monotonically_increasing_id())
               .repartitionByRange("doc_id", "__row").sortWithinPartitions("doc_id", "__row").drop("__row"))
    ordered.mapInPandas(
        encode, f"part int, block int, start long, n_ids long, doc_ids array<{id_type}>, payload binary"
    ).write.parquet(f"{path}/blocks")


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """Decode the file: ``doc_id, start, n_tokens, ids_crc32`` per document. The
    driver gets one number for each part of the file, and the frequency table."""
    blocks, freq = spark.read.parquet(f"{path}/blocks"), np.zeros(1 << 16, np.uint64)
    for r in spark.read.parquet(f"{path}/frequencies").collect():
        freq[r["id"]] = r["share"]
    base, at = {}, 0
    for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        base[r["part"]] = at
        at += r["n"]
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(freq)
        for b in batches:
            for part, start, docs, payload in zip(b.part, b.start, b.doc_ids, b.payload):
                lengths, parts = coder.parts(payload, POINTS)
                n = lengths.astype(np.int64)
                yield pd.DataFrame({"doc_id": list(docs), "start": base[part] + start + np.cumsum(n) - n, "n_tokens": n,
                                    "ids_crc32": document_crcs(n, parts)})

    return blocks.select("part", "start", "doc_ids", "payload").mapInPandas(
        decode, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def roundtrip(docs: DataFrame, path: str, kind: str = "word", end: int = END) -> DataFrame:
    """Write the token file of ``docs`` to the shared folder and read it back."""
    spark = docs.sparkSession
    file = f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-file-{uuid.uuid4().hex}"
    write_file(token_table(docs, path, kind, end), file)
    return read_file(spark, file)
