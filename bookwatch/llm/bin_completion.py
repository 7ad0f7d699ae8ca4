"""Sequence packing by bin completion.

Documents become token ids with an end id; one longer than a sequence is cut
into full pieces, of which the first may be shorter. Full pieces are sequences
already. The rest is dealt into groups of bounded size, and each group is
packed by branch and bound: the largest piece left opens a sequence, the
undominated fillings of the room around it are the branches, branches whose
waste cannot beat the best packing known are cut, and best-fit decreasing gives
the first packing to beat. Sequences that stay badly filled are opened and
their pieces packed again together until one group is left, or until most of
them stay as they are.

Every piece is packed whatever the limits; they bound the search alone, which
backs up from the last sequences first, so the result is proven best only where
it meets the lower bound (``Packing.bound``).

Defined results: a null or empty text is its end id; repeated rows are packed
one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, written
from .tokens import Ids

SEQUENCE = 2048
END = 0
#: Pieces of a group, dives of a group, fillings tried at a sequence.
GROUP, NODES, WIDTH = 4096, 400, 4
#: Steps of the search for fillings, and sizes tried at a step.
TRIES, WIDE = 200, 6
#: A sequence with more room than this share is packed once more.
LOOSE = 0.01


def pieces(docs: DataFrame, path: str, kind: str = "byte", size: int = SEQUENCE, end: int = END) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``, one row per piece."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = Ids(path, kind)
        tail = np.array([end], ids.dtype).tobytes()
        for b in batches:
            out = []
            for doc, text in zip(b.doc_id, b.text):
                data = ids.of(text) + tail
                n = len(data) // 4
                first = (n - 1) % size + 1
                edges = [0, *range(first, n + 1, size)]
                out += [(doc, k, lo, hi - lo, zlib.crc32(data[4 * lo:4 * hi]))
                        for k, (lo, hi) in enumerate(zip(edges, edges[1:]))]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInPandas(cut, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


class Packing:
    """Pieces of one group by length, packed into sequences of ``size``."""

    def __init__(self, lengths: list[int], size: int = SEQUENCE):
        self.size = size
        self.lengths = lengths
        self.sizes = sorted(set(lengths))
        self.count = dict.fromkeys(self.sizes, 0)
        for n in lengths:
            self.count[n] += 1

    def bound(self) -> int:
        """No packing has fewer sequences: total length, and for each threshold
        ``t`` the pieces over ``size - t`` stand apart from those over half."""
        best = ceil(sum(self.lengths) / self.size)
        n = np.sort(np.array(self.lengths))
        total = np.concatenate([[0], np.cumsum(n)])
        half = np.searchsorted(n, self.size // 2, "right")
        for t in np.unique(n[n <= self.size // 2]).tolist():
            alone = np.searchsorted(n, self.size - t, "right")
            low = np.searchsorted(n, t, "left")
            big = len(n) - half
            room = (alone - half) * self.size - (total[alone] - total[half])
            best = max(best, big + max(0, ceil((total[half] - total[low] - room) / self.size)))
        return max(best, int(len(n) - half))

    def best_fit(self) -> list[list[int]]:
        """Best fit, longest first: the fullest sequence with room takes the piece."""
        by_room: list[list[int]] = [[] for _ in range(self.size + 1)]
        rooms: list[int] = []  # rooms with an open sequence, ascending
        bins: list[list[int]] = []
        for n in sorted(self.lengths, reverse=True):
            k = bisect_right(rooms, n - 1)
            if k == len(rooms):
                b, room = len(bins), self.size
                bins.append([])
            else:
                room = rooms[k]
                b = by_room[room].pop()
                if not by_room[room]:
                    rooms.pop(k)
            bins[b].append(n)
            left = room - n
            if left:
                if not by_room[left]:
                    rooms.insert(bisect_right(rooms, left), left)
                by_room[left].append(b)
        return bins

    def largest(self, room: int, below: int) -> int | None:
        """Index of the largest size left that is at most ``room``, at most ``below``."""
        k = min(bisect_right(self.sizes, room, 0, below + 1) - 1, below)
        while k >= 0 and not self.count[self.sizes[k]]:
            k -= 1
        return k if k >= 0 else None

    def fillings(self, room: int) -> list[list[int]]:
        """Fillings of ``room``, the fullest first; at least one.

        Every filling is maximal (nothing left fits beside it). Sizes are taken
        in falling order, a run of equal ones in one step: as many as fit, or one
        fewer, or none. A filling from which a piece could be exchanged for a
        larger one that is left over would be dominated; trying larger sizes
        first finds those that are not before those that are. The search is
        bounded (``TRIES`` steps, ``WIDE`` sizes at a step): when it ends early,
        each open branch is completed by the largest pieces that fit, so the list
        is never empty, but may lack fillings that are not dominated. An exact
        filling ends the search."""
        found: list[tuple[int, list[int]]] = []
        budget = TRIES

        def extend(room: int, below: int, taken: list[int]) -> bool:
            nonlocal budget
            k = self.largest(room, below)
            if k is None:
                found.append((room, taken))
                return room == 0
            tried = 0
            while k is not None and tried < WIDE:
                n = self.sizes[k]
                if tried and (budget <= 0 or n * 2 <= min(f[0] for f in found)):
                    break
                most = min(self.count[n], room // n)
                # out of budget, the fullest run alone is followed
                for run in (most, most - 1) if most > 1 and budget > 0 else (most,):
                    budget -= 1
                    self.count[n] -= run
                    done = extend(room - run * n, k - 1, taken + [n] * run)
                    self.count[n] += run
                    if done:
                        return True
                tried += 1
                k = self.largest(room, k - 1) if k else None
            return False

        extend(room, len(self.sizes) - 1, [])
        out, seen = [], set()
        for waste, f in sorted(found, key=lambda x: (x[0], len(x[1]))):
            if tuple(f) not in seen:
                seen.add(tuple(f))
                out.append(f)
        return out[:WIDTH]

    def solve(self, nodes: int = NODES) -> list[list[int]]:
        """The best packing found; proven best when it meets the bound."""
        best = self.best_fit()
        least = self.bound()
        if len(best) <= least or not self.lengths:
            return best
        allowed = (len(best) - 1) * self.size - sum(self.lengths)  # waste of a packing that is better
        waste, bins, left = 0, [], len(self.lengths)
        stack: list[tuple[list[list[int]], int]] = []
        while nodes > 0 and len(best) > least:
            # dive: open the largest piece left, take the fullest filling
            while left:
                top = self.largest(self.size, len(self.sizes) - 1)
                n = self.sizes[top]
                self.count[n] -= 1
                options = [[n, *f] for f in self.fillings(self.size - n)]
                self.count[n] += 1
                stack.append((options[::-1], waste))
                if not (step := self.advance(stack, bins, allowed)):
                    break
                waste += self.size - sum(step)
                left -= len(step)
            nodes -= 1
            if not left and len(bins) < len(best):
                best = [list(b) for b in bins]
                allowed = (len(best) - 1) * self.size - sum(self.lengths)
            # back up to the deepest sequence with another filling
            while stack:
                if len(bins) == len(stack):
                    b = bins.pop()
                    left += len(b)
                    for n in b:
                        self.count[n] += 1
                waste = stack[-1][1]
                if step := self.advance(stack, bins, allowed):
                    waste += self.size - sum(step)
                    left -= len(step)
                    break
                stack.pop()
            if not stack:
                break
        return best

    def advance(self, stack: list, bins: list[list[int]], allowed: int) -> list[int] | None:
        """Take the next filling on top of the stack whose waste is within bounds."""
        options, waste = stack[-1]
        while options:
            step = options.pop()
            if waste + self.size - sum(step) <= allowed:
                for n in step:
                    self.count[n] -= 1
                bins.append(step)
                return step
        return None


def place(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece of a group."""
    at: dict[int, list[int]] = {}
    for k in np.argsort(-lengths, kind="stable").tolist():
        at.setdefault(int(lengths[k]), []).append(k)
    seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, content in enumerate(Packing(lengths.tolist(), size).solve()):
        o = 0
        for n in content:
            k = at[n].pop()
            seq[k], off[k] = b, o
            o += n
    return seq, off


def pack(cut: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """``sequence_id`` and ``offset`` for each row of ``cut``, a stored table of
    pieces. Groups hold a bounded number of rows however large the table is."""
    cols = cut.columns
    full = cut.where(F.col("length") == size).withColumn(
        "sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    todo, done, turn = cut.where(F.col("length") < size), [full], 0
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + \
        ", sequence_id long, offset long, fill long"

    def solver(turn: int):
        def solve(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
            seq, off = place(g["length"].to_numpy(), size)
            fill = np.bincount(seq, g["length"].to_numpy()).astype(np.int64)
            return g[cols].assign(sequence_id=(turn << 56) + (int(key[0]) << 24) + seq, offset=off, fill=fill[seq])
        return solve

    while n := todo.count():
        groups = ceil(n / GROUP)
        packed = written(todo.withColumn("__group", F.monotonically_increasing_id() % groups)
                         .groupBy("__group").applyInPandas(solver(turn), schema), "packed")
        if groups == 1:
            done.append(packed.drop("fill"))
            break
        loose = F.col("fill") < size * (1 - LOOSE)
        done.append(packed.where(~loose).drop("fill"))
        again = packed.where(loose).select(*cols)
        if again.count() * 2 > n:  # most stay loose: large pieces without small ones, nothing to gain
            done.append(packed.where(loose).drop("fill"))
            break
        todo, turn = again, turn + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, path: str, kind: str = "byte", size: int = SEQUENCE, end: int = END) -> DataFrame:
    return pack(written(pieces(docs, path, kind, size, end), "pieces"), size)
