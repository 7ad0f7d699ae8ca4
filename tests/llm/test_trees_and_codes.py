"""Vector codes, paragraph trees and dataset proofs against brute force, and on
edge tables: nulls, empty and long values, ties, repeated rows, clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookwatch.llm import code_blocks, octopus, paragraph_tree, ranges
from bookwatch.llm.queries import QUERIES

from ..conftest import SF_SMALL

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, place long, level int, tree string, "
        "block string, fingerprint string, at long")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --------------------------------------------------------------------------- global order
@pytest.mark.parametrize("rows", [3, 50, 8192])
def test_numbers_follow_the_order(spark, rows, monkeypatch):
    monkeypatch.setattr(ranges, "ROWS", rows)
    rng = random.Random(1)
    data = [(rng.choice([None, "a", "é", "zz"]), rng.choice([None, *range(40)]), i) for i in range(400)]
    df = spark.createDataFrame(data, "g string, k long, i long").repartition(5)
    blocks = ranges.Ranges(df, ["g", "k", "i"], rows)
    assert rows == 8192 or blocks.last > 3
    got = ranges.numbered(df, ["g", "k", "i"]).collect()
    want = sorted(data, key=lambda r: tuple((x is not None, x.encode() if isinstance(x, str) else x) if x is not None
                                            else (False,) for x in r))
    assert [(r["g"], r["k"], r["i"]) for r in sorted(got, key=lambda r: r["at"])] == want
    assert ranges.numbered(df.limit(0), ["g", "k", "i"]).count() == 0


# --------------------------------------------------------------------------- op11
@pytest.mark.parametrize(("dims", "bits"), [(1, 3), (2, 3), (3, 2), (5, 1), (4, 2)])
def test_the_curve_goes_from_cell_to_neighbour(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    order = sorted(range(len(cells)), key=code_blocks.hilbert_keys(cells, bits).__getitem__)
    assert len(set(code_blocks.hilbert_keys(cells, bits))) == len(cells)
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_shortlists_lose_no_nearest_entry():
    rng = np.random.default_rng(5)
    for _ in range(50):
        v = rng.integers(-40, 40, 6) + rng.integers(-6, 7, (20, 6))
        book = rng.integers(-60, 60, (30, 6))
        short = code_blocks.shortlist(v.min(0), v.max(0), book)
        far = ((v[:, None] - book) ** 2).sum(2)
        best, error = code_blocks.nearest(v, book[short])
        assert (short[best] == far.argmin(1)).all() and (error == far.min(1)).all()
    same = np.zeros((3, 6), np.int64)  # equal entries all stay, the first wins
    assert code_blocks.shortlist(same[0], same[0], same).tolist() == [0, 1, 2]


def test_big_numbers_are_exact():
    v = np.array([[2 ** 24, -2 ** 24, 3]] * 2)
    book = np.array([[-2 ** 24, 2 ** 24, 0], [2 ** 24, -2 ** 24 + 1, 3]])
    assert code_blocks.nearest(v, book)[1].tolist() == [1, 1]


def plain_codes(rows, entries=256, rounds=4, parts=4):
    """``rows``: (id, label, vector); the contract, one vector at a time."""
    keep = [(i, lab, [math.floor(1024 * x) for x in v]) for i, lab, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not keep:
        return []
    dims = -(-max(len(v) for *_, v in keep) // parts) * parts
    keep = [(i, lab, v + [0] * (dims - len(v))) for i, lab, v in keep]
    w = dims // parts
    cut = lambda v, p: tuple(v[p * w:(p + 1) * w])
    first = sorted(keep, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(v, p) for *_, v in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, p: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for *_, v in keep:
                mine.setdefault(near(cut(v, p), p), []).append(cut(v, p))
            for e, xs in mine.items():
                books[p][e] = tuple(sum(c) // len(xs) for c in zip(*xs))
    seal = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for i, lab, v in keep:
        code = [near(cut(v, p), p) for p in range(parts)]
        out.append((i, lab, "".join(f"{c:02x}" for c in code), sum(far(cut(v, p), books[p][c]) for p, c in enumerate(code))))
    sums = {}
    for _, lab, _, e in out:
        sums[lab] = sums.get(lab, 0) + e
    return sorted(((i, c, e, sums[lab], seal) for i, lab, c, e in out), key=str)


VECTORS = "vec_id long, embedding array<double>, label int, part string, row string, code string, v string"


@pytest.mark.parametrize("block", [1, 7, 128])
def test_codes_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(code_blocks, "BLOCK", block)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (i * 7) % 5 if i % 11 else None, (centres[i % 6] + rng.normal(0, 0.05, 8)).tolist()) for i in range(300)]
    rows += [(3, 1, rows[3][2]), (3, 1, rows[9][2]), (None, 2, rows[5][2]), (901, None, None), (902, 1, [0.1] * 7 + [None]),
             (903, 1, [0.1] * 7 + [float("inf")]), (904, 1, [float("nan")] * 8), (905, 0, [1.5, -2.0, 0.25]), (906, 0, [])]
    rows += [(1000 + i, 4, rows[0][2]) for i in range(150)]  # a third of all rows is one vector
    df = spark.createDataFrame([(i, v, lab, "p", "r", "c", "v") for i, lab, v in rows], VECTORS).repartition(6)
    for entries in (20, 256):
        got = [tuple(r) for r in code_blocks.codes(df, entries=entries).collect()]
        assert sorted(got, key=str) == plain_codes(rows, entries)


def test_codes_of_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1e30, -1e30, 0.0, 0.0], 1, "", "", "", "")], VECTORS)
    row = code_blocks.codes(df).first()
    assert (row["code"], row["error"]) == ("00000000", 0)  # beyond the bound: set to it
    assert code_blocks.codes(df.limit(0)).count() == 0
    assert code_blocks.codes(df.limit(0)).columns == code_blocks.codes(df).columns
    with pytest.raises(ValueError):
        code_blocks.codes(df, entries=300)


# --------------------------------------------------------------------------- op12
def plain_print(text):
    leaves = [(sha(p), len(p)) for p in re.findall(r"[^.!?\n]{1,255}[.!?\n]{0,32}|[.!?\n]{1,255}", text)]
    sections, now = [], []
    for h, n in leaves:
        now.append((h, n))
        if h.endswith("0"):
            sections.append(now)
            now = []
    if now:
        sections.append(now)
    nodes = [sha(" ".join(f"{h}:{n}" for h, n in s)) for s in sections]
    shown = [f"{x[:16]}=" + " ".join(f"{h[:8]}:{n}" for h, n in s) for x, s in zip(nodes, sections)]
    return sha("".join(nodes)) + "|" + "|".join(shown), leaves


def plain_likeness(a, b):
    if plain_print(a)[0] == plain_print(b)[0]:
        return 1.0
    x, y = ({(h[:8], n) for h, n in plain_print(t)[1]} for t in (a, b))
    total = sum(n for _, n in x) + sum(n for _, n in y)
    return 2 * sum(n for _, n in x & y) / total if total else 0.0


def plain_fingerprints(rows):
    """``rows``: (id, text), of which no two agree in the id alone."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        edited = t[:len(t) - len(t) // 4] + nxt[:len(t) // 4]
        before = None
        if plain_print(t)[0] != plain_print(edited)[0]:
            before, u, v = 0, plain_print(t)[1], plain_print(edited)[1]
            for k2 in range(len(u)):
                if k2 >= len(v) or u[k2] != v[k2]:
                    break
                before += u[k2][1]
        out.append((i, len(t), sha(edited), plain_print(t)[0], plain_print(edited)[0], plain_likeness(t, edited),
                    plain_likeness(t, nxt), before))
    return sorted(out, key=str)


TEXTS = [(1, "One line. Two lines!\n\nA new section? Yes.\n" * 9), (2, None), (3, ""), (None, "No id here. But a text."),
         (4, "x" * 70_000), (5, "naïve É 😀😀😀. ŻÓŁĆ ́! " * 40), (6, "...!!!\n\n\n" * 100), (7, "abc"), (8, "abc"), (9, "ab"),
         (10, " ".join(f"Sentence number {i}." for i in range(4000))), (11, "tail of all $1 \\ | = : end|")]


@pytest.mark.parametrize("block", [2, 2048])
def test_fingerprints_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(paragraph_tree, "BLOCK", block)
    df = spark.createDataFrame([(i, t, "en", None, 1, 1, 1, "t", "b", "f", 2) for i, t in TEXTS], DOCS).repartition(4)
    got = [tuple(r) for r in paragraph_tree.fingerprints(df).collect()]
    assert sorted(got, key=str) == plain_fingerprints(TEXTS)


def test_fingerprints_of_repeated_rows_and_ids(spark):
    df = spark.createDataFrame([(1, "a b c d."), (1, "a b c d."), (1, "z z z z. y"), (2, "q")], "doc_id long, text string")
    rows = paragraph_tree.fingerprints(df).collect()
    assert sorted(r["doc_id"] for r in rows) == [1, 1, 1, 2]
    assert {r["fingerprint"][:64] for r in rows if r["n_chars"] == 8} == {plain_print("a b c d.")[0][:64]}
    one = paragraph_tree.fingerprints(df.where("doc_id = 2")).first()  # its own next
    assert (one["near_edited"], one["near_next"], one["edit_from"]) == (1.0, 1.0, None)
    assert paragraph_tree.fingerprints(df.limit(0)).count() == 0


def test_an_inserted_sentence_is_located(spark):
    base = "".join(f"Sentence {i} of the text. " for i in range(500))
    at = base.index("Sentence 300 ")
    changed = base[:at] + "Something new here. " + base[at:]
    df = spark.createDataFrame([(base, changed)], "a string, b string").select(
        paragraph_tree.fingerprint(F.col("a")).alias("a"), paragraph_tree.fingerprint(F.col("b")).alias("b"))
    near, where = df.select(paragraph_tree.likeness(F.col("a"), F.col("b")),
                            paragraph_tree.first_difference(F.col("a"), F.col("b"))).first()
    assert near > 0.99 and at - 30 <= where <= at


def test_fingerprints_run_no_python(spark):
    plan = QUERIES["op12_fingerprints"](spark, SF_SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --------------------------------------------------------------------------- op13
def plain_manifest(rows):
    """``rows``: (doc_id, source, lang, n_chars, text)."""
    def leaf(*values):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def raised(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k:k + 2])) for k in range(0, len(levels[-1]), 2)])
        return levels

    def beside(levels, k):
        out = []
        for nodes in levels[:-1]:
            out.append((nodes[k ^ 1] if k ^ 1 < len(nodes) else None, k & 1))
            k >>= 1
        return out

    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0], leaf(*r), r))
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        by[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = raised([x[1] for x in by[g]])
    top = raised([trees[g][-1][0] for g in langs])
    out = []
    for j, g in enumerate(langs):
        for k, (i, h, r) in enumerate(by[g]):
            path = beside(trees[g], k) + beside(top, j)
            node = h
            if i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and r[3] is not None:
                node = leaf(r[0], r[1], r[2], r[3] + 1, r[4])
            for other, right in path:
                node = sha(node) if other is None else sha(other + node) if right else sha(node + other)
            out.append((i, h, trees[g][-1][0], top[-1][0], sha("".join(o for o, _ in path if o)), node, node == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("step", [1, 3, 12])
def test_proofs_equal_brute_force(spark, step, monkeypatch):
    monkeypatch.setattr(octopus, "STEP", step)
    monkeypatch.setattr(ranges, "ROWS", 40)
    rows = [(i, f"s{i % 3}" if i % 5 else None, ["en", "de", None, "żż", "one"][0 if i % 3 else i % 4], i if i % 6 else None,
             f"text é {i}" if i % 4 else None) for i in range(1, 230)]
    rows += [(5, "s", "en", 1, "other"), (5, "s", "en", 1, "other"), (None, None, None, None, None), (9000, "", "one", 0, "")]
    df = spark.createDataFrame([(i, t, g, s, n, 1, 1, "t", "b", "f", 2) for i, s, g, n, t in rows], DOCS).repartition(3)
    got = [tuple(r) for r in octopus.manifest(df).collect()]
    assert sorted(got, key=str) == plain_manifest(rows)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_manifest_of_few_and_no_rows(spark, n):
    rows = [(k, "s", "g" if k else None, 3, "t") for k in range(n)]
    df = spark.createDataFrame([(i, t, g, s, c, 1, 1, "t", "b", "f", 2) for i, s, g, c, t in rows], DOCS)
    assert sorted([tuple(r) for r in octopus.manifest(df).collect()], key=str) == plain_manifest(rows)
    assert octopus.manifest(df.limit(0)).count() == 0


def test_a_partition_fetches_what_it_cannot_derive():
    for size in (1, 2, 5, 64, 77):
        for places in ([0], [size - 1], list(range(size)), list(range(0, size, 3))):
            known, want = set(places), []
            for level, n in enumerate(octopus.heights(size)[:-1]):
                want += [(level, p ^ 1) for p in sorted(known) if p ^ 1 < n and p ^ 1 not in known]
                known = {p >> 1 for p in known}
            got = list(octopus.missing(np.array(places), size))
            assert sorted(got) == sorted(want) and len(set(got)) == len(got)
    assert list(octopus.missing(np.arange(64), 64)) == []


def test_subsets_are_proved_alike(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    leaves = octopus.leaves_of(docs).cache()
    planted = octopus.plant(leaves)
    every = {r["doc_id"]: r for r in octopus.prove(leaves, *planted).collect()}
    some = octopus.prove(leaves.where("doc_id % 13 = 5"), *planted).collect()
    assert some and all(r == every[r["doc_id"]] for r in some)
    tampered = {i for i in every if zlib.crc32(str(i).encode()) % 7 == 0}
    assert tampered and {i for i, r in every.items() if not r["verified"]} == tampered
