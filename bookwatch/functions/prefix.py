"""Running sums that do not funnel a hot key into one task.

A plain ``sum() over (partition by k order by t)`` sends every row of key
``k`` to one task. When one key holds a third of the table that task holds a
third of the table. The helpers here split the ordering into blocks first:

1. totals per (key, block) with a map-side combined ``groupBy`` (one row per
   block, so a hot key becomes as many small rows as it has blocks);
2. a window over those block totals gives each block its starting offset;
3. the rows are joined back to their block and summed inside the block, so the
   row-level window is partitioned by (key, block) and a hot key spreads over
   as many tasks as it has blocks.

The result is exact and does not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def exclusive_running_sums(df: DataFrame, keys: Sequence[str], block: Sequence[str],
                           within: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Add, for each ``name -> expr`` in ``values``, the sum of ``expr`` over all
    earlier rows of the same ``keys`` in the order ``block + within``.

    ``block`` must be the leading part of the ordering (for example the order
    date when rows are ordered by date, then id). Rows tie-broken by
    ``within`` must be unique inside a key for the result to be deterministic.
    """
    keys, block, within = list(keys), list(block), list(within)
    tmp = {name: f"__v_{i}" for i, name in enumerate(values)}
    # one struct column identifies a block: struct equality treats null
    # fields as equal (a null key or date is a group of its own, as in a
    # window), and the row window below partitions by the same column the
    # join is partitioned by, so there is no extra exchange
    staged = df.withColumns({**{tmp[n]: e for n, e in values.items()},
                             "__blk": F.struct(*[F.col(c) for c in [*keys, *block]]),
                             "__key": F.struct(*[F.col(c) for c in keys])})

    block_tot = staged.groupBy("__blk").agg(
        F.first("__key").alias("__key"), *[F.first(c).alias(f"__o_{c}") for c in block],
        *[F.sum(tmp[n]).alias(tmp[n] + "_blk") for n in values])
    w_blocks = (Window.partitionBy("__key").orderBy(*[f"__o_{c}" for c in block])
                .rowsBetween(Window.unboundedPreceding, -1))
    offsets = block_tot.select(
        "__blk",
        *[F.coalesce(F.sum(tmp[n] + "_blk").over(w_blocks), F.lit(0)).alias(tmp[n] + "_off")
          for n in values])

    w_rows = (Window.partitionBy("__blk").orderBy(*within)
              .rowsBetween(Window.unboundedPreceding, -1))
    joined = staged.join(offsets, on="__blk", how="inner")
    out = joined.withColumns({
        n: F.col(tmp[n] + "_off") + F.coalesce(F.sum(tmp[n]).over(w_rows), F.lit(0))
        for n in values})
    return out.drop("__blk", "__key", *tmp.values(), *[tmp[n] + "_off" for n in values])


#: Rows of a range block, about, and blocks of a group of the second level.
BLOCK_ROWS, GROUP_BLOCKS = 65_536, 1024
#: Blocks up to which their offsets are sent to all tasks.
FEW_BLOCKS = 10_000


class RangeBlocks:
    """``df``, evaluated once and written, cut along ``order`` into blocks of
    about ``rows`` rows: as many blocks as the row count asks for.

    ``order`` holds column expressions that tell all rows apart (aggregate ties
    first). The number of a row's block is in ``__blk``, ascending along
    ``order``. Borders come from a sample that Spark takes of the written table;
    they decide where a row is summed, not what comes out."""

    def __init__(self, df: DataFrame, order: Sequence[Column], rows: int = BLOCK_ROWS, least: int = 1):
        src = written(df, "scan")
        self.rows = src.count()
        self.blocks = max(least, -(-self.rows // rows))
        if self.blocks == 1:
            self.placed = src.withColumn("__blk", F.lit(0))
        else:
            self.placed = written(src.repartitionByRange(self.blocks, *order)
                                  .withColumn("__blk", F.spark_partition_id()), "scan")

    def offsets(self, values: Sequence[str], keys: Sequence[str] = (),
                group: int = GROUP_BLOCKS) -> DataFrame:
        """``__blk``, the keys, and for each value its sum in the block
        (``<v>__t``), over the key's earlier blocks (``<v>__o``) and over the whole
        key (``total_<v>``). Two levels: blocks are summed within groups of
        ``group`` blocks, groups among each other, so that no window holds more
        than a group of blocks or the table of groups of a key."""
        values, keys = list(values), list(keys)
        tot = self.placed.groupBy("__blk", *keys).agg(*[F.sum(v).alias(v + "__t") for v in values])
        if self.blocks == 1:  # nothing comes before
            return tot.select("*", *[F.col(v + "__t").alias("total_" + v) for v in values],
                              *[F.lit(0).alias(v + "__o") for v in values])
        tot = tot.withColumn("__grp", F.floor(F.col("__blk") / group).cast("int"))
        before = Window.partitionBy(*keys).orderBy("__grp").rowsBetween(Window.unboundedPreceding, -1)
        within = Window.partitionBy(*keys, "__grp").orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)

        def earlier(col: str, window) -> Column:
            return F.coalesce(F.sum(col).over(window), F.lit(0))

        groups = (tot.groupBy("__grp", *keys).agg(*[F.sum(v + "__t").alias(v + "__g") for v in values])
                  .select("__grp", *keys, *[earlier(v + "__g", before).alias(v + "__b") for v in values],
                          *[F.sum(v + "__g").over(Window.partitionBy(*keys)).alias("total_" + v) for v in values]))
        return tot.join(groups, ["__grp", *keys]).select(
            "__blk", *keys, *[v + "__t" for v in values], *["total_" + v for v in values],
            *[(F.col(v + "__b") + earlier(v + "__t", within)).alias(v + "__o") for v in values])

    def sent(self, offsets: DataFrame) -> DataFrame:
        return F.broadcast(offsets) if self.blocks <= FEW_BLOCKS else offsets


def running_sums(df: DataFrame, order: Sequence[Column], values: Sequence[str], keys: Sequence[str] = (),
                 inclusive: bool = True, rows: int = BLOCK_ROWS, least: int = 1) -> DataFrame:
    """``df`` with ``cum_<v>``, the running sum of each value along ``order`` within
    its keys, and ``total_<v>``, its sum over the keys. ``order`` begins with the
    keys and tells all rows apart; keys are not null.

    ``df`` is evaluated once; the rest works on written range blocks, and each
    row-level window holds one block, however many rows share a key."""
    values, keys = list(values), list(keys)
    blocks = RangeBlocks(df, order, rows, least)
    off = blocks.sent(blocks.offsets(values, keys).drop(*[v + "__t" for v in values]))
    w = (Window.partitionBy("__blk", *keys).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    out = blocks.placed.join(off, ["__blk", *keys]).withColumns({
        "cum_" + v: F.col(v + "__o") + F.coalesce(F.sum(v).over(w), F.lit(0)) for v in values})
    return out.drop("__blk", *[v + "__o" for v in values])


def global_running_sums(df: DataFrame, order_col: str, values: Sequence[str], n_blocks: int = 1,
                        descending: bool = False, inclusive: bool = True) -> DataFrame:
    """``running_sums`` over the whole frame along one column whose values are
    unique, in ``n_blocks`` blocks at least."""
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    return running_sums(df, [order], values, inclusive=inclusive, least=n_blocks)
