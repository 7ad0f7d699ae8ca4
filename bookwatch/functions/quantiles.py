"""Exact statistics of numeric columns from the counts of their values.

Columns are unpivoted and counted by (column, value) once, with map-side
combining, so a value that fills half a table is one row for each map task. The
counts are cut into range blocks along (column, value); block totals tell which
block holds a rank, and only those blocks are summed row by row. No list of a
column's values exists anywhere, however many are distinct, and the result does
not depend on the partitioning.

Nulls and NaN are missing, as in a data frame. Rank ``q * (n - 1)`` between two
values is interpolated linearly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import BLOCK_ROWS, RangeBlocks


class ValueCounts:
    """Counts of the distinct values of named numeric expressions over ``df``,
    separately for each value of ``by`` (a key of few values, null is left out)
    where it is given. ``df`` is evaluated once."""

    def __init__(self, df: DataFrame, exprs: Mapping[str, Column] | Sequence[str], by: Column | None = None,
                 rows: int = BLOCK_ROWS):
        if not isinstance(exprs, Mapping):
            exprs = {c: F.col(c) for c in exprs}
        self.names = list(exprs)
        key = F.lit(0) if by is None else by
        x = [e.cast("double") for e in exprs.values()]
        long = df.where(key.isNotNull()).select(key.alias("__by"), F.inline(F.array(*[
            F.struct(F.lit(k).alias("__col"), F.nanvl(v, F.lit(None).cast("double")).alias("__x"))
            for k, v in enumerate(x)]))).where("__x is not null")
        # -0.0 and 0.0 are one value
        counts = long.groupBy("__by", "__col", (F.col("__x") + 0.0).alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
        self.blocks = RangeBlocks(counts, [F.col("__by"), F.col("__col"), F.col("__x")], rows)
        self.keys = ["__by", "__col"]

    def moments(self) -> dict[tuple, dict]:
        """Count, mean, sample variance, minimum, maximum and sum by (key, column);
        the squares are summed around the mean."""
        t = self.blocks.placed
        x, n = F.col("__x"), F.col("__n")
        first = {(r["__by"], r["__col"]): r for r in t.groupBy(*self.keys).agg(
            F.sum(n).alias("n"), F.sum(x * n).alias("s"), F.min(x).alias("lo"), F.max(x).alias("hi")).collect()}
        if not first:
            return {}
        means = F.broadcast(t.sparkSession.createDataFrame(
            [(*k, r["s"] / r["n"]) for k, r in first.items()], t.select(*self.keys).withColumn("__m", F.lit(0.0)).schema))
        d = x - F.col("__m")
        squares = {(r["__by"], r["__col"]): r["q"] for r in t.join(means, self.keys).groupBy(*self.keys)
                   .agg(F.sum(n * d * d).alias("q")).collect()}
        return {(by, self.names[c]): {
            "count": r["n"], "sum": r["s"], "mean": r["s"] / r["n"], "min": r["lo"], "max": r["hi"],
            "var": squares[by, c] / (r["n"] - 1) if r["n"] > 1 else None} for (by, c), r in first.items()}

    def quantiles(self, probs: Sequence[float]) -> dict[tuple, list[float]]:
        """The quantiles at ``probs`` by (key, column); columns without a value
        are absent. The driver holds a few numbers for each."""
        off = self.blocks.offsets(["__n"], self.keys)
        sizes = {(r["__by"], r["__col"]): r["n"] for r in off.groupBy(*self.keys)
                 .agg(F.max("total___n").alias("n")).collect()}
        self.sizes = {(by, self.names[c]): n for (by, c), n in sizes.items()}
        if not sizes:
            return {}
        places = {k: [q * (n - 1) for q in probs] for k, n in sizes.items()}
        ranks = [(*k, r) for k, ps in places.items() for r in sorted({f(p) for p in ps for f in (floor, ceil)})]
        spark = off.sparkSession
        wanted = F.broadcast(spark.createDataFrame(
            ranks, self.blocks.placed.select(*self.keys).withColumn("__k", F.lit(0).cast("long")).schema))
        begin = F.col("__n__o")
        held = off.join(wanted, self.keys).where((begin <= F.col("__k")) & (F.col("__k") < begin + F.col("__n__t")))
        # at most one block for each rank wanted
        held = F.broadcast(held.select("__blk", *self.keys, "__k", (F.col("__k") - begin).alias("__rest")))
        needed = F.broadcast(held.select("__blk", *self.keys).distinct())
        w = (Window.partitionBy("__blk", *self.keys).orderBy("__x")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        sums = self.blocks.placed.join(needed, ["__blk", *self.keys]).withColumn("__c", F.sum("__n").over(w))
        hit = (F.col("__rest") < F.col("__c")) & (F.col("__rest") >= F.col("__c") - F.col("__n"))
        at = {(r["__by"], r["__col"], r["__k"]): r["__x"]
              for r in sums.join(held, ["__blk", *self.keys]).where(hit).select(*self.keys, "__k", "__x").collect()}

        def value(key: tuple, p: float) -> float:
            lo, hi = at[(*key, floor(p))], at[(*key, ceil(p))]
            return lo if lo == hi else lo + (hi - lo) * (p - floor(p))

        return {(by, self.names[c]): [value((by, c), p) for p in ps] for (by, c), ps in places.items()}


def quantiles(df: DataFrame, exprs: Mapping[str, Column] | Sequence[str], probs: Sequence[float],
              rows: int = BLOCK_ROWS, sizes: dict[str, int] | None = None) -> dict[str, list[float | None]]:
    """Exact quantiles of each named expression; ``None`` for one without values.
    ``sizes`` is given the number of each one's values."""
    counts = ValueCounts(df, exprs, rows=rows)
    found = counts.quantiles(probs)
    if sizes is not None:
        sizes.update({c: counts.sizes.get((0, c), 0) for c in counts.names})
    return {c: found.get((0, c), [None] * len(probs)) for c in counts.names}
