"""Registered text queries: SQL oracles on the smallest tables, and the pipeline
stage by stage against brute-force versions of its decisions."""

import pytest

import __spark_entry__ as E
import corpus_pipeline
from bookwatch.llm import bin_completion
from bookwatch.llm.queries import ORACLE, QUERIES
from tools.compare import compare

from ..conftest import SF_SMALL


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    r = compare(spark, con, name, QUERIES[name], ORACLE[name], SF_SMALL)
    assert r["cols_ok"] and r["vals_ok"] and r["types_ok"], r


def brute_near(rows):
    """Ids that near-duplicate removal drops: shingle sets compared pair by pair."""
    sets = {}
    for d, t in rows:
        w = t.encode().lower().split()
        sets[d] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    by = {}
    for d, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(d)
    for a, b in {(a, b) for ds in by.values() for a in ds for b in ds if a < b}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d for d in sets if find(d) != d}


def brute_contaminated(rows, items):
    import re
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for t in items:
        w = words(t)
        windows |= {tuple(w[k:k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    sizes = {len(x) for x in windows}
    out = set()
    for d, t in rows:
        w, hit = words(t), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
        if hit and 20 * len(hit) >= len(w):
            out.add(d)
    return out


def brute_secret(rows):
    import re
    kinds = [r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"""
             r"""[aA][pP][iI]_?[kK][eE][yY])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", "(AKIA[A-Z0-9]+)", "([0-9a-f]+)"]
    return {d for d, t in rows if any(len(m[1]) >= least for p, least in zip(kinds, (8, 16, 32)) for m in re.finditer(p, t))}


def test_pipeline_stages(spark):
    """Language against the rule of its rejections, the next three stages against brute force."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    gone = {
        "language": lambda rows: {d for d, t in rows if not any(c.isalpha() for c in t or "")},
        "near_duplicates": brute_near,
        "contamination": lambda rows: brute_contaminated(rows, items),
        "secrets": brute_secret,
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF_SMALL)
        assert kept.columns == docs.columns
        dropped = gone[name](list(left.items()))
        left = {d: t for d, t in left.items() if d not in dropped}
        assert {r["doc_id"] for r in kept.collect()} == set(left), name
        docs = kept
    packed = corpus_pipeline.run(spark, SF_SMALL)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(left)
    fills = [r["n"] for r in packed.groupBy("sequence_id").agg({"length": "sum"}).toDF("s", "n").collect()]
    assert max(fills) <= bin_completion.SEQUENCE


def test_each_row_is_judged_by_itself(spark):
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").first()["text"]
    plain = "A clean text of some plain words, number"
    rows = [(1, f"{plain} one alpha beta gamma"), (1, "my password = abcdefgh12 stands here among words"), (1, bench),
            (None, f"{plain} two delta epsilon zeta eta"), (None, "token: abcdefgh12345 is not to be kept"), (None, bench),
            (7, "other words altogether in this one text"), (7, "other words altogether in this one text"), (9, "seven")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_SMALL)
    assert sorted(r["text"] for r in docs.collect()) == sorted([rows[0][1], rows[3][1], rows[6][1], rows[8][1]])
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).count() == 4


def test_pipeline_edges(spark):
    docs = spark.createDataFrame(
        [(1, "A text of some plain words.", "en", "s", 1, "x"), (1, "A text of some plain words.", "en", "s", 1, "x"),
         (2, None, None, None, None, None), (3, "", "en", "s", 0, "x"), (4, "token = abcdefghijk rest of it", "en", "s", 1, "x")],
        "doc_id long, text string, lang string, source string, n_chars long, component string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_SMALL)
        assert docs.columns[-1] == "component"
    assert [r["doc_id"] for r in docs.collect()] == [1]
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF_SMALL).count() == 0
