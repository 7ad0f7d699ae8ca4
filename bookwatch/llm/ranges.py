"""A global order without one task that holds it: range blocks that begin at
rows of the table, and dense numbers in that order.

The borders are keys of sampled rows, at most ``MOST`` of them, so that a
block's first row is known before anything is sorted. They decide which task
orders a row and nothing else: results are the same for any borders."""

from __future__ import annotations

import json
from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, blocks at most, and sampled keys a block.
ROWS, MOST, SAMPLED = 8192, 4096, 16


class Ranges:
    """Blocks of ``df`` in the order of the columns ``by`` (nulls first, strings
    bytewise). ``of`` is a row's block, ``first`` says whether its key is the one
    its block begins with; ``last`` is the number of the last block, -1 where the
    table is empty."""

    def __init__(self, df: DataFrame, by: Sequence[str], rows: int = ROWS, most: int = MOST):
        keys = df.select(*by)
        found = keys.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*by)).alias("least")).first()
        self.by, self.rows = list(by), found["n"]
        blocks = min(most, ceil(self.rows / rows))
        starts = [tuple(found["least"])] if self.rows else []
        if blocks > 1:
            part = min(1.0, 1.2 * blocks * SAMPLED / self.rows)
            picked = [tuple(r) for r in keys.sample(part, seed=1).orderBy(*by).collect()]
            for k in range(1, blocks):
                key = picked[k * len(picked) // blocks] if picked else starts[-1]
                if key != starts[-1]:
                    starts.append(key)
        self.last = len(starts) - 1
        schema = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in keys.schema)
        # Parsed once, when the plan is made: a literal array of the blocks' first keys.
        self.starts = F.from_json(F.lit(json.dumps([dict(zip(by, s)) for s in starts])), f"array<struct<{schema}>>")
        steps = [1 << k for k in reversed(range(max(1, len(starts)).bit_length()))]
        key = F.struct(*by)
        self.of: Column = F.aggregate(
            F.array(*map(F.lit, steps)), F.lit(-1),
            lambda at, step: F.when(F.get(self.starts, at + step) <= key, at + step).otherwise(at))

    def first(self, block: Column) -> Column:
        return F.get(self.starts, block).eqNullSafe(F.struct(*self.by))


def numbered(df: DataFrame, by: Sequence[str], name: str = "at") -> DataFrame:
    """``df`` with the 0-based place of each row in the order of ``by``, as a
    long. Rows equal in ``by`` are numbered in any order: write the result before
    using it twice."""
    ranges = Ranges(df, by)
    placed = df.withColumn("_block", ranges.of)
    sizes = {r["_block"]: r["count"] for r in placed.groupBy("_block").count().collect()}
    begins, total = [], 0
    for block in range(ranges.last + 1):
        begins.append(total)
        total += sizes.get(block, 0)
    begin = F.from_json(F.lit(json.dumps(begins)), "array<bigint>")
    within = F.row_number().over(Window.partitionBy("_block").orderBy(*by))
    return placed.withColumn(name, F.get(begin, F.col("_block")) + within - 1).drop("_block")
