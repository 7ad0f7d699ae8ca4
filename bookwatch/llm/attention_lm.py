"""Language-model scores from a small causal self-attention model in numpy.

Texts become subword ids of a public vocabulary. Three experts, counted over
every training id, give the probability of an id: the id alone, after the id
before it, and after the two before it; what a longer context leaves over goes
to the shorter one, so each is a distribution. How far each is trusted at a
place is up to a causal self-attention head over the classes of the ids before
it, together with how often the contexts were seen: the model's output is the
mixture. In training, a place's own occurrence is taken out of the counts.

The head is trained data-parallel: the training documents are dealt over the
rounds, so that each window is learned from once; each partition runs Adam over
its windows of a round, and the weights are averaged after it.

A text is scored in windows of ``WINDOW`` ids that advance by ``STEP``; each id
is scored once, in the window where it has the most context.

Counts of pairs and triples of ids are exact, whatever their number: texts are
dealt into parts of bounded size, the distinct keys of a part go to the tasks that
sum them over all parts, by context, and each part gets back the counts of its own
keys, which are written beside its texts. What a context was followed by once only is
no evidence of what follows: that mass is left over to the shorter context.

The base score beside it is a smoothed word unigram over the training words.
Frequent words are scored from a bounded table that travels to the tasks; the
others are joined with their counts. Words are known by 64-bit hashes.

Defined results: a null or empty text is its end token; rows that repeat an id
are scored one by one; a null id is a training row; with nothing to learn from,
counts are 0 and the model is its initial state; other columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder, slices, texts, words_of, worker_memory, written
from .tokens import Ids

END_ID = 50256
IDS = END_ID + 1
CLASSES, DIM, WINDOW, STEP = 64, 8, 32, 28
#: Rounds of averaging, windows of a training step, learning rate.
ROUNDS, BATCH, RATE = 2, 256, 2e-2
#: Experts, and steps of the logarithm by which the counts of contexts are told apart.
EXPERTS, STEPS = 3, 16
#: Bits of the slots of tables of pairs and of triples that are held in memory.
PAIR_BITS, TRIPLE_BITS = 20, 22
#: Ids of a part (a longer text is one), ids for which there is one bucket of keys, and buckets at most.
PART, BUCKET, BUCKETS = 1_000_000, 4_000_000, 1 << 16
#: Bits of a key below its bucket, and what stands for the id after the last.
KEY_BITS, NONE = 47, IDS
#: Bytes of the rows that go to Python together, about.
BATCH_BYTES, PART_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 25
#: Whether what a query has shuffled goes when it ends: scratch tables are read from their files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Ids that the experts look at together: arrays of them stay in a core's cache.
NEAR = 100_000
#: Words whose counts travel to every task.
HEAD = 200_000
#: Counts that a task gathers before it gives them up, and words that it remembers the ids of.
FLUSH, KEEP = 400_000, 400_000
SMOOTH = 0.1
#: How hard the ids of a part are compressed.
LEVEL = 6


def digests(words: list[bytes]) -> np.ndarray:
    import xxhash
    return np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64).view(np.int64)


def count_words(train: DataFrame) -> DataFrame:
    """``h, c``: tokens of the training rows by hash, the end token included
    (the empty word). Partitions count first, and give up their counts whenever
    the table of a task reaches its bound."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()

        def out() -> pd.DataFrame:
            f = pd.DataFrame({"h": digests(list(c)), "c": np.fromiter(c.values(), np.int64, len(c))})
            c.clear()
            return f

        for b in batches:
            for t in b.text:
                c.update(words_of(t) if t else ())
                c[b""] += 1
                if len(c) > FLUSH:
                    yield out()
        if c:
            yield out()

    return written(train.select("text").mapInPandas(counts, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")),
                   "words", "zstd")


class Words(dict):
    """Number of each word met, and by number its subword ids, its hash and the
    log of its smoothed count (NaN unless it is a frequent word)."""

    def __init__(self, subwords: Ids, head: dict[int, int]):
        import xxhash
        super().__init__()
        self.subwords, self.head, self.digest = subwords, head, xxhash.xxh3_64_intdigest
        self.ids, self.hashes, self.logs = [], array("Q"), array("d")

    @classmethod
    def held(cls, subwords: Ids, head: dict[int, int]) -> Words:
        """Those that the worker's last task of the same stage has left, or none."""
        known = subwords.mine.get("words")
        if known is None or known.head is not head:
            known = subwords.mine["words"] = cls(subwords, head)
        return known

    def forget(self) -> None:
        """Keep the frequent words only."""
        stay = [(w, at) for w, at in self.items() if not math.isnan(self.logs[at])]
        at = [a for _, a in stay]
        self.clear()
        self.update((w, k) for k, (w, _) in enumerate(stay))
        self.ids = [self.ids[a] for a in at]
        self.hashes, self.logs = array("Q", [self.hashes[a] for a in at]), array("d", [self.logs[a] for a in at])

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self.ids)
        h = self.digest(word)
        count = self.head.get(h - (1 << 64) if h >> 63 else h)
        self.ids.append(self.subwords.chunk(" " + word.decode()))
        self.hashes.append(h)
        self.logs.append(math.nan if count is None else math.log10(count + SMOOTH))
        return at

    def look_up(self, at: list[int]) -> tuple[np.ndarray, np.ndarray]:
        if not at:
            return np.empty(0), np.empty(0, np.int64)
        return np.frombuffer(self.logs)[at], np.frombuffer(self.hashes, np.int64)[at]


def encode(docs: DataFrame, path: str, head: dict[int, int]) -> DataFrame:
    """Per row its subword ids, number of tokens, sums over the frequent words,
    and the hashes of its other words. ``head``: counts by hash. Rows that follow
    each other make a ``part`` of ``PART`` ids at most, named by its first row."""
    sc = docs.sparkSession.sparkContext
    table = sc.broadcast(head)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Words.held(Ids(path, "byte", 2), table.value)
        end = np.array([END_ID], "<u2").tobytes()
        name, size = None, 0
        for batch in batches:
            for part in slices(batch.text.str.len().fillna(0).astype(int), 4_000_000):
                b, out = batch.iloc[part], []
                for t, row in zip(b.text, b.row):
                    w = words_of(t) if t else []
                    if len(known) > KEEP:
                        known.forget()
                    at = list(map(known.__getitem__, w))
                    logs, hashes = known.look_up(at)
                    other = np.isnan(logs)
                    ids = b"".join(map(known.ids.__getitem__, at)) + end
                    size += len(ids) // 2
                    if name is None or size > PART:
                        name, size = row, len(ids) // 2
                    out.append((ids, name, len(w) + 1, hashes[other], float(logs[~other].sum()),
                                int(len(w) - other.sum())))
                f = pd.DataFrame(out, columns=["ids", "part", "n_tokens", "other", "head_log", "head_known"])
                yield pd.concat([b[["doc_id", "held_out", "row"]].reset_index(drop=True), f], axis=1)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return written(docs.mapInPandas(rows, f"doc_id {id_type}, held_out boolean, row long, ids binary, part long, "
                                          "n_tokens long, other array<bigint>, head_log double, head_known long"), "coded", "zstd")


def largest(counts: DataFrame, most: int) -> DataFrame:
    """The rows of ``k, c`` with the largest counts: those above the least count
    that keeps them ``most`` or fewer."""
    tally = counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c"))
    least, total = 0, 0
    for r in tally.toLocalIterator():
        total += r["n"]
        if total > most:
            least = r["c"]
            break
    return counts.where(F.col("c") > least)


def packed(values: np.ndarray) -> bytes:
    """The numbers byte by byte, first bytes first, compressed: the high ones are mostly 0."""
    by_byte = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return pa.compress(by_byte.tobytes(), "zstd", asbytes=True) if len(values) else b""


def unpacked(data: bytes, kind: type, n: int) -> np.ndarray:
    """The ``n`` numbers of this kind that ``packed`` was given."""
    if not n:
        return np.empty(0, kind)
    width = np.dtype(kind).itemsize
    plain = pa.decompress(data, n * width, "zstd", asbytes=True)
    return np.frombuffer(plain, np.uint8).reshape(width, n).T.copy().view(kind).ravel()


def compressed(data: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=LEVEL).compress(data, asbytes=True) if data else b""


def expanded(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, "zstd", asbytes=True) if size else b""


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct whole numbers in ascending order: sorting them takes a tenth of
    the time of ``np.unique``, which hashes them."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def keys_of(ids: np.ndarray, lengths: np.ndarray, buckets: int) -> np.ndarray:
    """By place the number of the pair that ends there and of the id after it, or
    ``NONE``; in the high bits the bucket, which is up to the pair."""
    pair = previous(ids, lengths)[0] * IDS + ids
    after = np.empty_like(ids)
    after[:-1] = ids[1:]
    after[(np.cumsum(lengths) - 1)[lengths > 0]] = NONE
    x = pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    bucket = ((x >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)
    return (bucket.astype(np.int64) << KEY_BITS) + pair * (IDS + 1) + after


def pairs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of ascending keys, and for each key the position of its own."""
    pair = (keys & ((1 << KEY_BITS) - 1)) // (IDS + 1)
    new = np.diff(pair, prepend=-1) != 0
    return pair[new], np.cumsum(new) - 1


def part_keys(coded: DataFrame, buckets: int) -> DataFrame:
    """``bucket, part, n, keys, counts``: the distinct keys of each part in
    ascending order (as differences) and how often they stand in its training rows."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_memory()
        held: list[pd.DataFrame] = []

        def out() -> pd.DataFrame:
            f = pd.concat(held)
            held.clear()
            tested = f.held_out.to_numpy(bool)
            learn, seen = np.unique(keys_of(*joined(f.ids[~tested]), buckets), return_counts=True)
            keys = distinct(np.concatenate([learn, keys_of(*joined(f.ids[tested]), buckets)]))
            counts = np.zeros(len(keys), np.uint32)
            counts[np.searchsorted(keys, learn)] = seen
            found, begin = np.unique(keys >> KEY_BITS, return_index=True)
            cut = [slice(*x) for x in zip(begin, [*begin[1:], len(keys)])]
            return pd.DataFrame({"bucket": found, "part": f.part.iloc[0], "n": [c.stop - c.start for c in cut],
                                 "keys": [packed(np.diff(keys[c], prepend=0)) for c in cut],
                                 "counts": [packed(counts[c]) for c in cut]})

        for b in batches:
            for _, f in b.groupby("part", sort=False):
                if held and held[0].part.iloc[0] != f.part.iloc[0]:
                    yield out()
                held.append(f)
        if held:
            yield out()

    return coded.select("part", "held_out", "ids").mapInPandas(
        rows, "bucket long, part long, n long, keys binary, counts binary")


def part_texts(coded: DataFrame) -> DataFrame:
    """The rows of a part that one task has read, as one row: their names, whether
    they are held out, their lengths and ids. Ids are compressed together, so that
    what texts of a part repeat is kept, shuffled and written once."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_memory()
        held: list[pd.DataFrame] = []

        def out() -> pd.DataFrame:
            f = pd.concat(held).sort_values("row")
            held.clear()
            ids = b"".join(f.ids)
            return pd.DataFrame({
                "part": f.part.iloc[:1], "first": f.row.iloc[:1], "n": len(f), "size": len(ids),
                "rows": packed(np.diff(f.row.to_numpy(np.int64), prepend=0)),
                "held": packed(f.held_out.to_numpy(np.uint8)),
                "lengths": packed(f.ids.str.len().to_numpy(np.int64)), "ids": compressed(ids)})

        for b in batches:
            for _, f in b.groupby("part", sort=False):
                if held and held[0].part.iloc[0] != f.part.iloc[0]:
                    yield out()
                held.append(f)
        if held:
            yield out()

    return coded.select("row", "part", "held_out", "ids").mapInPandas(
        rows, "part long, first long, n long, size long, rows binary, held binary, lengths binary, ids binary")


def bucket_counts(b: pd.DataFrame) -> pd.DataFrame:
    """``part, bucket, n, triples, m, pairs, left``: for each part how often its
    ``n`` keys of the bucket stand in all parts (0 unless twice, and for a pair
    that ends a text), how often their ``m`` pairs do, and how much of that is no
    such triple. A part below 0 has the sums by id of the bucket's pairs: of those
    that end with it, and of those seen twice that begin with it."""
    worker_memory()
    keys = [np.cumsum(unpacked(x, np.int64, n)) for x, n in zip(b["keys"], b.n)]
    counts = [unpacked(x, np.uint32, n) for x, n in zip(b.counts, b.n)]
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)
    often = np.where((count > 1) & ((key & ((1 << KEY_BITS) - 1)) % (IDS + 1) != NONE), count, 0)
    pair, of = pairs_of(key)
    total = np.bincount(of, count).astype(np.int64)
    left = total - np.bincount(of, often).astype(np.int64)
    own: dict[int, list[np.ndarray]] = {}
    for name, where in zip(b.part.tolist(), np.split(at, np.cumsum([len(k) for k in keys])[:-1])):
        own.setdefault(name, []).append(where)
    out = []
    for name, where in own.items():  # a part that two tasks have read has its keys united
        where = where[0] if len(where) == 1 else distinct(np.concatenate(where))
        mine = distinct(of[where])
        out.append((name, len(where), often[where], len(mine), total[mine], left[mine]))
    single = np.bincount(pair % IDS, total, IDS)
    after_one = np.bincount(pair // IDS, np.where(total > 1, total, 0), IDS)
    name = -1 - int(b.bucket.iloc[0])
    out.append((name, 0, total[:0], IDS, single.astype(np.int64), after_one.astype(np.int64)))
    f = pd.DataFrame(out, columns=["part", "n", "triples", "m", "pairs", "left"])
    f.insert(1, "bucket", b.bucket.iloc[0])
    return f.assign(**{c: [packed(x) for x in f[c]] for c in ("triples", "pairs", "left")})


def with_counts(coded: DataFrame) -> tuple[DataFrame, int]:
    """One row a part (``row`` is its name): its texts, and the counts of its keys
    as from ``bucket_counts``; beside them the rows below 0. Also the number of
    buckets. All keys are counted, each in the bucket of its pair."""
    total = coded.agg(F.sum(F.length("ids"))).first()[0] or 0
    buckets = min(BUCKETS, 1 + total // 2 // BUCKET)
    answers = part_keys(coded, buckets).groupBy("bucket").applyInPandas(
        bucket_counts, "part long, bucket long, n long, triples binary, m long, pairs binary, left binary")
    texts_ = part_texts(coded).groupBy("part").agg(
        F.sort_array(F.collect_list(F.struct("first", "n", "size", "rows", "held", "lengths", "ids"))).alias("texts"))
    found = answers.groupBy("part").agg(F.sort_array(F.collect_list(F.struct(
        "bucket", *[c for c in answers.columns if c not in ("bucket", "part")]))).alias("found"))
    return written(texts_.join(found, "part", "full").withColumnRenamed("part", "row"), "counted", "zstd"), buckets


def with_places(texts_: list, found: list, buckets: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """A part's texts, their ids and lengths, and by place how often its pair was
    seen, its pair with the id after it, and such triples of its pair together."""
    f = pd.concat([pd.DataFrame({"row": np.cumsum(unpacked(t["rows"], np.int64, t["n"])),
                                 "held_out": unpacked(t["held"], np.uint8, t["n"]) > 0}) for t in texts_],
                  ignore_index=True)
    lengths = np.concatenate([unpacked(t["lengths"], np.int64, t["n"]) for t in texts_]) // 2
    ids = np.frombuffer(b"".join(expanded(t["ids"], t["size"]) for t in texts_), "<u2").astype(np.int64)
    keys, at = np.unique(keys_of(ids, lengths, buckets), return_inverse=True)
    triples = np.concatenate([unpacked(x["triples"], np.int64, x["n"]) for x in found])
    pairs, left = (np.concatenate([unpacked(x[c], np.int64, x["m"]) for x in found]) for c in ("pairs", "left"))
    of = pairs_of(keys)[1]
    seen = np.stack([pairs[of], triples, (pairs - left)[of]]).astype(np.float32)
    return f, ids, lengths, np.stack([np.take(x, at) for x in seen])


def joined(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the rows, and the rows' lengths."""
    lengths = np.array([len(x) // 2 for x in column], np.int64)
    return np.frombuffer(b"".join(column), "<u2").astype(np.int64), lengths


def previous(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id before each, and the one before that; the end id before a row."""
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    one = np.empty_like(ids)
    one[1:], one[starts] = ids[:-1], END_ID
    two = np.empty_like(ids)
    two[1:], two[starts] = one[:-1], END_ID
    return one, two


class Table:
    """Slots of counted keys: a key has two neighbouring slots to stand in, the
    more frequent keys first, and is known there by 16 bits. Slot ``size`` is that
    of absent keys."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bits: int):
        self.bits, self.size = bits, 1 << bits
        self.mark, self.count = np.zeros(self.size, np.uint16), np.zeros(self.size + 1, np.float32)
        left = np.argsort(-counts, kind="stable")
        self.kept = np.zeros(len(keys), bool)
        slot, mark = self.places(keys)
        for turn in (0, 1):
            at = slot[left] ^ turn
            free = self.mark[at] == 0
            left, at = left[free], at[free]
            at, first = np.unique(at, return_index=True)
            won = left[first]
            self.mark[at], self.count[at], self.kept[won] = mark[won], counts[won], True
            left = np.flatnonzero(~self.kept)
            left = left[np.argsort(-counts[left], kind="stable")]

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return (x >> np.uint64(64 - self.bits)).astype(np.int64), (x >> np.uint64(8)).astype(np.uint16) | np.uint16(1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot, mark = self.places(keys)
        other = slot ^ 1
        return np.where(self.mark[slot] == mark, slot, np.where(self.mark[other] == mark, other, self.size))


class Experts:
    """What the counts say of each place of a text: counts that come with the text
    (``after_one``: the sum over the pairs that begin with an id and were seen
    twice), or those of ``pairs`` and ``triples`` that are held in tables."""

    def __init__(self, single: np.ndarray, pairs: tuple[np.ndarray, np.ndarray] | None = None,
                 triples: tuple[np.ndarray, np.ndarray] | None = None, after_one: np.ndarray | None = None):
        self.single = single.astype(np.float32)
        self.total = float(single.sum())
        if pairs is None:
            self.after_one = after_one.astype(np.float32)
        else:
            self.pairs, self.triples = Table(*pairs, PAIR_BITS), Table(*triples, TRIPLE_BITS)
            keys, counts = pairs[0][self.pairs.kept], pairs[1][self.pairs.kept]
            self.after_one = np.bincount(keys // IDS, counts, IDS).astype(np.float32)
            keys, counts = triples[0][self.triples.kept], triples[1][self.triples.kept]
            self.after_two = np.bincount(self.pairs.find(keys // IDS), counts, self.pairs.size + 1).astype(np.float32)
        rank = np.argsort(-single, kind="stable")
        own, shared = CLASSES - 4, 4
        self.cls = np.zeros(IDS, np.int64)
        self.cls[rank[:own]] = np.arange(own)
        mass = np.cumsum(single[rank[own:]] + SMOOTH)  # the rest in four classes of about equal frequency
        self.cls[rank[own:]] = own + np.minimum((mass / mass[-1] * shared).astype(int), shared - 1)

    def found(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """By place the counts in the tables of its pair, of the pair before it, of
        its triple, and the sum of the triples after that pair."""
        before, two = previous(ids, lengths)
        slot = self.pairs.find(before * IDS + ids)
        context = np.empty_like(slot)
        context[1:] = slot[:-1]
        starts = (np.cumsum(lengths) - lengths)[lengths > 0]
        context[starts] = self.pairs.size  # nothing is known before a row
        count = self.triples.count[self.triples.find((two * IDS + before) * IDS + ids)]
        count[starts] = 0
        return self.pairs.count[slot], self.pairs.count[context], count, self.after_two[context]

    @staticmethod
    def given(lengths: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, ...]:
        """What ``found`` gives, of counts that come with the text."""
        later = np.empty_like(seen)
        later[:, 1:] = seen[:, :-1]
        later[:, (np.cumsum(lengths) - lengths)[lengths > 0]] = 0
        return np.where(seen[0] > 1, seen[0], np.float32(0)), *later

    def by_text(self, ids: np.ndarray, lengths: np.ndarray, own: int,
                seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``at``, for texts of about ``NEAR`` ids at a time."""
        ends = np.cumsum(lengths)
        found = []
        for part in slices(lengths, NEAR):
            n = lengths[part]
            place = slice(ends[part.start] - n[0], ends[part.stop - 1])
            found.append(self.at(ids[place], n, own, seen[:, place]))
        return tuple(map(np.concatenate, zip(*found)))

    def at(self, ids: np.ndarray, lengths: np.ndarray, own: int = 0,
           seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of each place's id by each expert, the number of its cell
        of context counts, and the class of the id before it. ``own`` occurrences,
        the place itself, are taken out of the counts. ``seen``: counts by place."""
        before, _ = previous(ids, lengths)
        first = (self.single[ids] - np.float32(own) + np.float32(SMOOTH)) / np.float32(self.total - own + SMOOTH * IDS)
        pair, context, triple, after_two = self.found(ids, lengths) if seen is None else self.given(lengths, seen)

        def chained(count: np.ndarray, seen: np.ndarray, kept: np.ndarray, shorter: np.ndarray) -> np.ndarray:
            """Share of the count in the context, the rest by the shorter one."""
            known = count > 0
            count, kept, seen = count - own * known, kept - own * known, np.maximum(seen - own, 0)
            out = (count + np.maximum(seen - kept, 0) * shorter) / np.maximum(seen, 1)
            return np.where(seen > 0, out, shorter), seen

        second, n1 = chained(pair, self.single[before], self.after_one[before], first)
        third, n2 = chained(triple, context, after_two, second)
        cell = [np.minimum(np.frexp(n + 1)[1] - 1, STEPS - 1) for n in (n1, n2)]
        return np.stack([first, second, third], axis=1).astype(np.float32), cell[0] * STEPS + cell[1], self.cls[before]


class Model:
    """Weights by name, kept in one flat vector."""

    SHAPES = {"emb": (CLASSES, DIM), "pos": (WINDOW, DIM), "qkv": (DIM, 3 * DIM), "gate": (2 * DIM, EXPERTS),
              "cell": (STEPS * STEPS, EXPERTS)}

    def __init__(self, flat: np.ndarray | None = None):
        n = sum(int(np.prod(s)) for s in self.SHAPES.values())
        self.flat = np.zeros(n, np.float32) if flat is None else flat.astype(np.float32)
        if flat is None:
            rng = np.random.default_rng(11)
            for name, s in self.SHAPES.items():
                self[name][...] = np.arange(EXPERTS) if name == "cell" else rng.normal(
                    0, 0.1 if name in ("emb", "pos") else s[0] ** -0.5, s)

    def __getitem__(self, name: str) -> np.ndarray:
        return self.part(self.flat, name)

    def part(self, flat: np.ndarray, name: str) -> np.ndarray:
        at = 0
        for k, s in self.SHAPES.items():
            n = int(np.prod(s))
            if k == name:
                return flat[at:at + n].reshape(s)
            at += n
        raise KeyError(name)

    def forward(self, x: np.ndarray, cell: np.ndarray, p: np.ndarray) -> tuple:
        """Probability of each place's id, the share of each expert in it, and what
        the gradient needs. ``x``: classes of the ids before, ``cell`` and ``p`` as
        from ``Experts.at``, all by window and place."""
        b, w = x.shape
        e = np.take(self["emb"], x, axis=0)
        e += self["pos"][:w]
        flat = e.reshape(-1, DIM)
        q, k, v = (t.reshape(b, w, DIM) for t in np.split(flat @ self["qkv"], 3, axis=1))
        a = np.matmul(q, np.ascontiguousarray(k.transpose(0, 2, 1)))
        # scores are small: clipped instead of shifted, masked by a product after the exponential
        np.clip(a, -30, 30, out=a)
        np.exp(a, out=a)
        a *= np.tri(w, dtype=np.float32)
        a *= np.float32(1) / (a.reshape(-1, w) @ np.ones((w, 1), np.float32)).reshape(b, w, 1)
        m = np.matmul(a, v)
        z = flat @ self["gate"][:DIM]
        z += m.reshape(-1, DIM) @ self["gate"][DIM:]
        z += np.take(self["cell"], cell.ravel(), axis=0)
        np.clip(z, -30, 30, out=z)
        np.exp(z, out=z)
        z *= np.float32(1) / (z @ np.ones((EXPERTS, 1), np.float32))
        mixed = z * p.reshape(-1, EXPERTS)
        total = mixed @ np.ones(EXPERTS, np.float32)
        return total.reshape(b, w), z, mixed, e, q, k, v, a, m

    def log_probability(self, x: np.ndarray, cell: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(self.forward(x, cell, p)[0], np.float32(1e-35)))

    def gradient(self, x: np.ndarray, cell: np.ndarray, p: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Gradient of the mean negative log probability over unmasked places."""
        total, z, mixed, e, q, k, v, a, m = self.forward(x, cell, p)
        g = np.zeros_like(self.flat)
        at = lambda name: self.part(g, name)
        b, w = x.shape
        flat = lambda t: t.reshape(-1, t.shape[-1])
        dz = z - mixed / np.maximum(total.reshape(-1, 1), np.float32(1e-35))
        dz *= (mask.ravel() / np.float32(max(1, mask.sum()))).astype(np.float32)[:, None]
        at("gate")[:DIM], at("gate")[DIM:] = flat(e).T @ dz, flat(m).T @ dz
        for j in range(EXPERTS):
            at("cell")[:, j] = np.bincount(cell.ravel(), dz[:, j], STEPS * STEPS)
        dm = (dz @ self["gate"][DIM:].T).reshape(b, w, DIM)
        ds = np.matmul(dm, np.ascontiguousarray(v.transpose(0, 2, 1)))
        ds -= (flat(ds * a) @ np.ones((w, 1), np.float32)).reshape(b, w, 1)
        ds *= a
        dqkv = np.concatenate([np.matmul(ds, k), np.matmul(ds.transpose(0, 2, 1), q),
                               np.matmul(a.transpose(0, 2, 1), dm)], axis=2)
        at("qkv")[...] = flat(e).T @ flat(dqkv)
        de = dz @ self["gate"][:DIM].T + flat(dqkv) @ self["qkv"].T
        at("pos")[:w] = de.reshape(b, w, DIM).sum(axis=0)
        for j in range(DIM):
            at("emb")[:, j] = np.bincount(x.ravel(), de[:, j], CLASSES)
        return g


def windows(lengths: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Document and first place of each window over documents of these lengths."""
    n = 1 + np.maximum(0, -(-(lengths - WINDOW) // step))
    doc = np.repeat(np.arange(len(lengths)), n)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return doc, first * step


def gather(lengths: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of windows among the ids of all documents, and their validity."""
    place = first[:, None] + np.arange(WINDOW)
    begin = (np.cumsum(lengths) - lengths)[doc]
    return np.minimum(begin[:, None] + place, lengths.sum() - 1), place < lengths[doc][:, None]


def train(counted: DataFrame, shared, buckets: int) -> Model:
    """Rounds of local training and weighted averaging; ``shared`` holds the
    experts. Windows of training do not overlap, so each id is a target once. The
    driver gets one sum for each weight and round."""

    def local(batches: Iterator[pd.DataFrame], flat: np.ndarray, turn: int) -> Iterator[pd.DataFrame]:
        worker_memory()
        experts, own = shared.value, Model(flat)
        m, s, t, seen = np.zeros_like(own.flat), np.zeros_like(own.flat), 0, 0
        rng = np.random.default_rng(turn)
        for b in batches:
            for texts_, found in zip(b.texts, b.found):
                f, ids, lengths, counts = with_places(texts_, found, buckets)
                learn = ~f.held_out.to_numpy(bool)
                if not learn.any():
                    continue
                of = np.repeat(learn, lengths)
                ids, lengths, counts = ids[of], lengths[learn], counts[:, of]
                p, cell, x = experts.by_text(ids, lengths, 1, counts)
                doc, first = windows(lengths, WINDOW)
                for pick in np.array_split(rng.permutation(len(doc)), max(1, -(-len(doc) // BATCH))):
                    at, ok = gather(lengths, doc[pick], first[pick])
                    g = own.gradient(x[at], cell[at], p[at], ok)
                    t += 1
                    seen += len(pick)
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    own.flat -= RATE / (1 + t / 1000) * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-8)
        if seen:
            yield pd.DataFrame({"i": np.arange(len(own.flat), dtype=np.int32), "w": float(seen),
                                "p": own.flat.astype(float) * seen})

    model = Model()
    for turn in range(ROUNDS):
        learn = counted.where((F.col("row") >= 0) & in_round(turn)).select("texts", "found")
        step = (lambda flat, turn: lambda batches: local(batches, flat, turn))(model.flat, turn)
        sums = learn.mapInPandas(step, "i int, w double, p double").groupBy("i").agg(
            (F.sum("p") / F.sum("w")).alias("v")).collect()
        if sums:
            new = np.zeros(len(model.flat))
            for r in sums:
                new[r["i"]] = r["v"]
            model = Model(new)
    return model


def in_round(turn: int) -> Column:
    """Whether a part, by the row that names it, is learned from in this round: in one of the ``ROUNDS``."""
    return F.pmod("row", F.lit(ROUNDS)) == turn


def score_texts(experts: Experts, model: Model, ids: np.ndarray, lengths: np.ndarray,
                seen: np.ndarray | None = None) -> np.ndarray:
    """Natural log probability of each text."""
    p, cell, x = experts.at(ids, lengths) if seen is None else experts.by_text(ids, lengths, 0, seen)
    doc, first = windows(lengths)
    total = np.zeros(len(lengths))
    for k in range(0, len(doc), BATCH):
        w = slice(k, k + BATCH)
        at, ok = gather(lengths, doc[w], first[w])
        ok[:, :WINDOW - STEP] &= first[w][:, None] == 0  # later windows score their new places
        total += np.bincount(doc[w], (model.log_probability(x[at], cell[at], p[at]) * ok).sum(axis=1), len(lengths))
    return total


def model_scores(counted: DataFrame, shared, model: Model, buckets: int) -> DataFrame:
    """``row, score``: log10 probability of each row's ids."""
    flat = model.flat

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_memory()
        experts, lm = shared.value, Model(flat)
        for b in batches:
            for texts_, found in zip(b.texts, b.found):
                f, ids, lengths, counts = with_places(texts_, found, buckets)
                yield pd.DataFrame({"row": f.row, "score": score_texts(experts, lm, ids, lengths, counts) / np.log(10)})

    return counted.where("row >= 0").select("texts", "found").mapInPandas(rows, "row long, score double")


def learned(counted: DataFrame) -> Experts:
    """The experts. The driver gets two numbers for each id of the vocabulary."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        single, after_one = np.zeros(IDS, np.int64), np.zeros(IDS, np.int64)
        for b in batches:
            for found in b.found:
                single += unpacked(found[0]["pairs"], np.int64, IDS)
                after_one += unpacked(found[0]["left"], np.int64, IDS)
        k = np.flatnonzero(single)  # an id that begins a pair ends one, or stands before a text and ends it
        yield pd.DataFrame({"k": k, "single": single[k], "after_one": after_one[k]})

    found = counted.where("row < 0").select("found").mapInPandas(
        sums, "k int, single long, after_one long").groupBy("k").agg(
        F.sum("single").alias("single"), F.sum("after_one").alias("after_one")).toArrow()
    single, after_one = np.zeros(IDS), np.zeros(IDS)
    k = found.column("k").to_numpy()
    single[k], after_one[k] = found.column("single").to_numpy(), found.column("after_one").to_numpy()
    return Experts(single, after_one=after_one)


def lm_scores(docs: DataFrame, path: str) -> DataFrame:
    """Base and model scores of every document; learns from documents whose
    crc32 of the id is not 0 modulo 10."""
    docs.sparkSession.conf.set(BATCH_BYTES, str(PART_BYTES))  # a part is one row, and a batch need not hold many
    docs.sparkSession.conf.set(CLEANUP, "true")
    d = texts(docs).withColumn("held_out", F.coalesce(remainder("doc_id", 10) == 0, F.lit(False))).withColumn(
        "row", F.monotonically_increasing_id())
    counts = count_words(d.where("not held_out"))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    head = largest(counts.withColumnRenamed("h", "k"), HEAD).toArrow()
    coded = encode(d, path, dict(zip(head.column("k").to_pylist(), head.column("c").to_pylist())))
    counted, buckets = with_counts(coded)
    shared = docs.sparkSession.sparkContext.broadcast(learned(counted))
    scores = model_scores(counted, shared, train(counted, shared, buckets), buckets)
    end = counts.where(F.col("h") == int(digests([b""])[0])).first()
    c_end = end["c"] if end else 0
    tail = coded.select("row", F.explode("other").alias("h")).join(counts, "h", "left").groupBy("row").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("tail_log"), F.count("c").alias("tail_known"))
    below = float(np.log10(total["n"] + SMOOTH * (total["v"] + 1)))
    base = (F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) + float(np.log10(c_end + SMOOTH))
            - F.col("n_tokens") * below)
    return (coded.drop("ids", "part", "other").join(tail, "row", "left").join(scores, "row").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0)) + int(c_end > 0)).cast("long").alias("n_known"),
        F.lit(total["n"]).cast("long").alias("train_tokens"), base.alias("base_score"), "score"))
