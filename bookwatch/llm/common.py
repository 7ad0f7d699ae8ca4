"""Helpers shared by the text operators: scratch tables on the shared folder,
document frames with defined nulls, hash splits and connected components."""

from __future__ import annotations

import gc
import sys
import types
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Characters that separate words: space, tab, line feed, vertical tab, form feed, return.
SPACES = r"[\x20\x09-\x0D]+"


def worker_memory(owner: tuple = ()) -> dict:
    """A dict that outlives a task, for one owner at a time: what another owner
    left in the worker process is given up, so stages that follow each other in
    a long job do not add up (one that keeps nothing calls this for that alone).
    Owners bound what they keep."""
    held = sys.modules.setdefault("_worker_memory", types.ModuleType("_worker_memory")).__dict__
    if held.get("owner") != owner:
        left = held.get("mine")
        held["owner"], held["mine"] = owner, {}
        if left:
            left.clear()
            gc.collect()  # what is kept may refer to its keeper
    return held["mine"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that go to Python together at most: texts can be long, and a worker holds a batch several times over.
BATCH_ROWS = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` and the named columns only, so that whatever other
    columns the input carries cannot clash with an operator's own names. Lowers
    the session's limit for rows of a batch to ``BATCH_ROWS``."""
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        conf.set(BATCH_SETTING, str(BATCH_ROWS))
    return docs.select("doc_id", "text", *more)


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to a fresh folder of the shared checkpoint location and read
    it back: cuts the lineage, and a lost executor costs no recomputation. ``codec``:
    how the files are compressed, unless by the session's setting."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (null for a null id)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % n


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space of the text with A-Z lower-cased; the
    bytes methods touch ASCII only, as the word definition asks."""
    return text.encode().lower().split()


def slices(sizes: Iterable[int], most: int) -> Iterator[slice]:
    """Consecutive row ranges of at most ``most`` total size, one row at least."""
    begin = total = 0
    k = -1
    for k, n in enumerate(sizes):
        if k > begin and total + n > most:
            yield slice(begin, k)
            begin, total = k, 0
        total += n
    if k >= begin:
        yield slice(begin, k + 1)


#: Keys that are joined by sending their rows of the smaller side to all tasks, at most.
HOT = 1000


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], total: float, n: str = "n") -> DataFrame:
    """Inner equi-join on ``keys``, which are unique in ``one``; ``n`` there is the
    number of the key's rows in ``many``, ``total`` that of all. Keys with more than
    the ``HOT``-th part of the rows, of which there are fewer than ``HOT``, are
    joined where the rows are, so that none gathers in one task."""
    often = total / HOT
    hot = F.broadcast(one.where(F.col(n) > often).drop(n))
    return many.join(hot, keys).unionByName(
        many.join(hot.select(*keys), keys, "left_anti").join(one.where(F.col(n) <= often).drop(n), keys))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges ``(a, b)`` as ``(id, component)``
    with the smallest id reachable.

    Large-star / small-star alternation: every node's larger neighbours are
    hooked to its smallest one, then the rest. Each round is a grouped minimum
    and an equi-join, both of which pre-aggregate or split a hot node; nothing
    is collected but the count of changed edges. Rounds are logarithmic in
    practice; the loop ends when the edge set is a set of stars: every leaf hangs
    on one centre, and no centre is itself a leaf."""
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .distinct(), "edges")
    for _ in range(rounds):
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
                 .union(low.select("a", F.col("m").alias("b"))).distinct())
        new = written(small, "edges")
        two = new.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo < hi")
        below = new.select("b").distinct().join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        if not two.take(1) and not below.take(1):
            e = new
            break
        e = new
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
