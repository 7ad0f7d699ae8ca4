"""Merkle manifest of a dataset, proved by octopus multiproofs.

Each row is a leaf; the leaves of a language, by id, make a binary tree, and the
languages' subroots make the tree above them. A lone node at the end of a level
is hashed alone. Nodes are named by coordinates (tree, level, place): tree 0, 1,
... in the order of the languages, tree -1 above them.

The trees grow ``STEP`` levels a round from groups of ``2 ** STEP`` nodes. For
the proofs, each leaf partition (as many leaves that stand together) computes
the union of the coordinates its leaves' proofs need and its own leaves cannot
give, fetches these nodes once with one join, derives the interiors its leaves
share, and expands the single proofs from that. A partition of any subset of
the leaves works alike: ``prove`` takes whatever rows are to be proved.

Null ids come first in a tree, a null language is a language of its own, rows
that repeat an id are ordered by their digest; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .ranges import numbered

#: Levels of a round; a partition has 2 ** STEP leaves at most.
STEP = 12
#: Languages up to which their table is sent to all tasks.
FEW = 20_000
ABOVE = -1


def digest(*hexes: str) -> str:
    return sha256("".join(hexes).encode()).hexdigest()


def heights(size: int) -> list[int]:
    """Nodes by level, from the leaves to the root."""
    sizes = [size]
    while sizes[-1] > 1:
        sizes.append((sizes[-1] + 1) // 2)
    return sizes


def combine(nodes: list[str]) -> list[str]:
    """The level above nodes of which the first has an even place."""
    return [digest(*nodes[k:k + 2]) for k in range(0, len(nodes), 2)]


def leaf(n_chars: Column) -> Column:
    def field(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s), F.lit(":"), s), F.lit("-"))
    return F.sha2(F.concat(*map(field, (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")))), 256)


def leaves_of(docs: DataFrame) -> DataFrame:
    """``doc_id, tree, place, size, leaf, altered``: each row's leaf, where it
    stands among how many, and the leaf of its tampered row where that differs."""
    more = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0,
                  F.col("n_chars").cast("decimal(20, 0)") + 1)
    rows = written(docs.select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"),
                               F.when(more.isNotNull(), leaf(more)).alias("altered")), "leaves")
    at = written(numbered(rows, ["lang", "doc_id", "leaf"]), "leaves")
    langs = at.groupBy("lang").agg(F.min("at").alias("begin"), F.count("*").alias("size"))
    langs = written(numbered(langs, ["lang"], "tree").withColumnRenamed("lang", "_lang"), "langs")
    few = F.broadcast(langs) if langs.count() <= FEW else langs
    return at.join(few, F.col("lang").eqNullSafe(F.col("_lang"))).select(
        "doc_id", "tree", (F.col("at") - F.col("begin")).alias("place"), "size", "leaf", "altered")


def grow(leaves: DataFrame, size: int) -> list[DataFrame]:
    """All nodes of trees with the given leaves ``(tree, place, size, node)``, as
    tables ``(tree, level, place, size, node)`` with the number of nodes of a
    level as its size; ``size`` is that of the largest tree."""
    schema = "tree long, level int, place long, size long, node string"
    step = STEP

    def raised(level: int):
        def fn(group: pa.Table) -> pa.Table:
            group = group.sort_by("place")
            tree, size, first = (group.column(c)[0].as_py() for c in ("tree", "size", "place"))
            nodes, at, up = group.column("node").to_pylist(), level, []
            while size > 1 and at < level + step:
                nodes, size, first, at = combine(nodes), (size + 1) // 2, first // 2, at + 1
                up += [(tree, at, first + k, size, node) for k, node in enumerate(nodes)]
            return pa.Table.from_pylist([dict(zip(("tree", "level", "place", "size", "node"), u)) for u in up],
                                        pa.schema([("tree", pa.int64()), ("level", pa.int32()), ("place", pa.int64()),
                                                   ("size", pa.int64()), ("node", pa.string())]))
        return fn

    tables = [leaves.select("tree", F.lit(0).alias("level"), "place", "size", "node")]
    for level in range(0, max(1, (size - 1).bit_length()), STEP):
        low = tables[-1].where((F.col("level") == level) & (F.col("size") > 1))
        tables.append(written(low.groupBy("tree", F.shiftright("place", STEP).alias("part"))
                              .applyInArrow(raised(level), schema), "nodes"))
    return tables


def plant(leaves: DataFrame) -> tuple[DataFrame, int, str]:
    """All nodes over ``leaves``, the number of languages and the root."""
    trees, largest = leaves.agg(F.max("tree"), F.max("size")).first()
    own = grow(leaves.select("tree", "place", "size", F.col("leaf").alias("node")), largest or 0)
    nodes = own[0]
    for t in own[1:]:
        nodes = nodes.union(t)
    tops = nodes.where("size = 1")
    langs = 0 if trees is None else trees + 1
    above = grow(tops.select(F.lit(ABOVE).cast("long").alias("tree"), F.col("tree").alias("place"),
                             F.lit(langs).cast("long").alias("size"), "node"), langs)
    above[0] = written(above[0], "subroots")
    for t in above:
        nodes = nodes.union(t)
    roots = [r["node"] for t in above for r in t.where("size = 1").collect()]
    return nodes, langs, roots[0] if roots else ""


def missing(places: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Coordinates (level, place) beside the paths from ``places`` to the root
    that these leaves cannot give themselves."""
    known = np.unique(places)
    for level, n in enumerate(heights(size)[:-1]):
        beside = known ^ 1
        for place in np.setdiff1d(beside[beside < n], known):
            yield level, int(place)
        known = np.unique(known >> 1)


def interiors(known: dict[int, str], size: int, fetched: dict) -> list[dict[int, str]]:
    """Nodes by place, level by level: fetched ones, and those derived from the
    level below. The last level holds the root."""
    levels = [known]
    for level, n in enumerate(heights(size)[:-1]):
        here = levels[-1] | fetched.get(level, {})
        levels[-1] = here
        levels.append({p: digest(here[2 * p], *([here[2 * p + 1]] if 2 * p + 1 < n else []))
                       for p in sorted({q >> 1 for q in levels[-1]})
                       if 2 * p in here and (2 * p + 1 >= n or 2 * p + 1 in here)})
    return levels


def siblings(place: int, levels: list[dict[int, str]], sizes: list[int]) -> list[str | None]:
    """The node beside the path at each level below the root, None for a lone one."""
    return [levels[k][(place >> k) ^ 1] if (place >> k) ^ 1 < n else None for k, n in enumerate(sizes[:-1])]


def fold(node: str, place: int, beside: list[str | None]) -> str:
    for other in beside:
        node = digest(node) if other is None else digest(other, node) if place & 1 else digest(node, other)
        place >>= 1
    return node


def prove(leaves: DataFrame, nodes: DataFrame, langs: int, root: str) -> DataFrame:
    """One row per given leaf: ``doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified``. The root is folded from the altered leaf, where
    there is one, and the siblings of the untampered tree."""
    part = F.shiftright("place", STEP).alias("part")

    def want(group: pa.Table) -> pa.Table:
        tree, part_, size = (group.column(c)[0].as_py() for c in ("tree", "part", "size"))
        asked = [(tree, *m) for m in missing(group.column("place").to_numpy(), size)]
        asked += [(ABOVE, *m) for m in missing(np.array([tree]), langs)]
        return pa.table({"tree": pa.array([tree] * len(asked), pa.int64()),
                         "part": pa.array([part_] * len(asked), pa.int64()),
                         "of": pa.array([a[0] for a in asked], pa.int64()),
                         "level": pa.array([a[1] for a in asked], pa.int32()),
                         "at": pa.array([a[2] for a in asked], pa.int64())})

    def expand(mine: pa.Table, got: pa.Table) -> pa.Table:
        tree, size = (mine.column(c)[0].as_py() for c in ("tree", "size"))
        fetched: dict = {}
        for of, level, at, node in zip(*(got.column(c).to_pylist() for c in ("of", "level", "at", "node"))):
            fetched.setdefault(of, {}).setdefault(level, {})[at] = node
        places, own = mine.column("place").to_pylist(), mine.column("leaf").to_pylist()
        sizes, over = heights(size), heights(langs)
        levels = interiors(dict(zip(places, own)), size, fetched.get(tree, {}))
        subroot = levels[-1][0]
        above = interiors({tree: subroot}, langs, fetched.get(ABOVE, {}))
        last = siblings(tree, above, over)
        proofs, folded = [], []
        for place, altered in zip(places, mine.column("altered").to_pylist()):
            beside = siblings(place, levels, sizes)
            proofs.append(digest(*[b for b in beside + last if b is not None]))
            folded.append(above[-1][0] if altered is None else fold(fold(altered, place, beside), tree, last))
        n = len(places)
        return pa.table({"doc_id": mine.column("doc_id"), "leaf": mine.column("leaf"),
                         "subroot": pa.array([subroot] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
                         "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()),
                         "verified": pa.array([f == root for f in folded], pa.bool_())})

    id_type = leaves.schema["doc_id"].dataType.simpleString()
    parted = leaves.select("*", part)
    wanted = parted.select("tree", "part", "size", "place").groupBy("tree", "part").applyInArrow(
        want, "tree long, part long, of long, level int, at long")
    got = wanted.join(nodes.select(F.col("tree").alias("of"), "level", F.col("place").alias("at"), "node"),
                      ["of", "level", "at"])
    got = written(got.select("tree", "part", "of", "level", "at", "node"), "fetched")
    return parted.groupBy("tree", "part").cogroup(got.groupBy("tree", "part")).applyInArrow(
        expand, f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, "
                "folded_root string, verified boolean")


def manifest(docs: DataFrame) -> DataFrame:
    """Proof and check of every row of ``docs``."""
    leaves = written(leaves_of(docs), "leaves")
    return prove(leaves, *plant(leaves))
