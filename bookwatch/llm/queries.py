"""Registered queries of the text operators and their SQL, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from . import (attention_lm, bin_completion, code_blocks, ftrl, hdc_langid, line_rules, octopus, paragraph_tree,
               postings, rans, secret_scan, setsketch, unit_dedup)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.link(table(spark, sf_dir, "documents"))


ORACLE["op1_near_dedup"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id a, y.doc_id b, count(*) k FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
r(doc_id, o) AS (SELECT a, b FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.o = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT n_shingles, least(d.doc_id, coalesce(min(r.o), d.doc_id)) component_id,
       d.doc_id <= coalesce(min(r.o), d.doc_id) kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id, n.n
"""


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(table(spark, sf_dir, "documents")).drop("clean_text")


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op4_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) k, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') p
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) s FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') p
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) s FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, s, k FROM dw JOIN iw USING (k, p)),
h AS (SELECT doc_id, count(DISTINCT q) n FROM (SELECT doc_id, unnest(range(s, s + k)) q FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) n, string_agg(x, ',' ORDER BY x) l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR x FROM m) GROUP BY doc_id),
fr AS (SELECT x word, count(*) f FROM (SELECT unnest(w) x FROM d) GROUP BY 1),
bi AS (SELECT row_number() OVER () item, item_id, w FROM (SELECT DISTINCT item_id, w FROM b WHERE len(w) > 0)),
bt AS (SELECT item, unnest(w) word, unnest(range(len(w))) ipos FROM bi),
bs AS (SELECT item, unnest(range(0, greatest(len(w) - 13, 0) + 1)) s FROM bi),
bw AS (SELECT item, s, list_sort(list({'f': coalesce(f, 0), 'ipos': ipos, 'word': word})) l
       FROM bt LEFT JOIN fr USING (word) JOIN bs USING (item) WHERE ipos >= s AND ipos < s + 13 GROUP BY item, s),
pl AS (SELECT DISTINCT item, l[1].ipos a, l[1].word wa, coalesce(l[2].ipos, l[1].ipos) b, coalesce(l[2].word, l[1].word) wb
       FROM bw WHERE l[1].f > 0),
dp AS (SELECT doc_id, word, pos FROM (SELECT doc_id, unnest(w) word, unnest(range(len(w))) pos FROM d)
       WHERE word IN (SELECT wa FROM pl UNION SELECT wb FROM pl)),
nr AS (SELECT x.doc_id, count(DISTINCT x.pos) n_near, count(DISTINCT bi.item_id) n_near_items FROM pl JOIN dp x ON x.word = pl.wa
       JOIN dp y ON y.doc_id = x.doc_id AND y.word = pl.wb AND y.pos BETWEEN x.pos + pl.b - pl.a - 3 AND x.pos + pl.b - pl.a + 3
       JOIN bi ON bi.item = pl.item GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT n_words, coalesce(h.n, 0)::BIGINT n_hit, coalesce(i.n, 0)::BIGINT n_items,
       sha256(coalesce(l, '')) items_sha256, coalesce(h.n > 0 AND 20 * h.n >= len(w), false) contaminated,
       coalesce(n_near, 0)::BIGINT n_near, coalesce(n_near_items, 0)::BIGINT n_near_items
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN nr USING (doc_id)
"""


@query
def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.lm_scores(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hdc_langid.identify(table(spark, sf_dir, "documents"))


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_completion.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query
def op8_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_dedup.report(table(spark, sf_dir, "documents"), "all")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ftrl.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.roundtrip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_blocks.codes(table(spark, sf_dir, "embeddings"))


def _codebook_rounds(rounds: int) -> str:
    """Rounds 1 to ``rounds`` of the codebooks ``b0`` over the parts ``p``, and the last assignment ``a``."""
    near = """(SELECT q, r, arg_min(e, (inner_ + cc - 2 * list_inner_product(x, c)) * 256 + e) e,
              min(inner_ + cc - 2 * list_inner_product(x, c)) error
              FROM (SELECT *, list_inner_product(x, x) inner_ FROM p) JOIN
                   (SELECT *, list_inner_product(c, c) cc FROM b{0}) USING (q) GROUP BY q, r)"""
    steps = [f"""a{k} AS {near.format(k)},
m{k} AS (SELECT q, e, list(v ORDER BY i) c FROM (SELECT q, e, i, floor(sum(y) / count(*)) v
         FROM (SELECT q, e, unnest(x) y, unnest(range(len(x))) i FROM a{k} JOIN p USING (q, r)) GROUP BY q, e, i) GROUP BY q, e),
b{k + 1} AS (SELECT q, e, coalesce(m{k}.c, b{k}.c) c FROM b{k} LEFT JOIN m{k} USING (q, e))""" for k in range(rounds)]
    return ",\n".join([*steps, f"a AS {near.format(rounds)}"])


ORACLE["op11_vector_codes"] = rf"""
WITH k AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) r, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) v
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, q, v[q * len(v) // 4 + 1:(q + 1) * len(v) // 4] x FROM (SELECT r, v, unnest(range(4)) q FROM k)),
b0 AS (SELECT q, r - 1 e, x c FROM p WHERE r <= 256),
{_codebook_rounds(4)},
s AS (SELECT sha256(string_agg(t, ',' ORDER BY q, e)) h
      FROM (SELECT q, e, array_to_string(list_transform(c, lambda y: y::BIGINT::VARCHAR), ',') t FROM b4)),
o AS (SELECT r, string_agg(lower(printf('%02x', e)), '' ORDER BY q) code, sum(error)::BIGINT error FROM a GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT label_error, h codebooks_sha256
FROM k JOIN o USING (r) CROSS JOIN s
"""


@query
def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_tree.fingerprints(table(spark, sf_dir, "documents"))


ORACLE["op12_fingerprints"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, row_number() OVER (ORDER BY doc_id) - 1 r, count(*) OVER () m FROM documents),
n AS (SELECT d.doc_id, d.r, length(d.t) n, d.t, z.t nx, z.r nr FROM d JOIN d z ON z.r = (d.r + 1) % d.m),
x AS (SELECT r, false e, t FROM n UNION ALL SELECT r, true, left(t, n - n // 4) || left(nx, n // 4) FROM n),
l AS (SELECT r, e, t, list_transform(regexp_extract_all(t, '[^.!?\n]{1,255}[.!?\n]{0,32}|[.!?\n]{1,255}'),
                                     lambda p: sha256(p) || ':' || length(p)) v FROM x),
s AS (SELECT r, e, t, list_transform(v, lambda y: left(y, 8) || substr(y, 65)) v, list_filter(string_split(
      regexp_replace(array_to_string(v, ' '), '(0:[0-9]+) ', '\1|', 'g'), '|'), lambda y: y <> '') s FROM l),
f AS (SELECT r, e, t, v, list_distinct(v) u, sha256(array_to_string(list_transform(s, lambda y: sha256(y)), '')) root,
      array_to_string(list_transform(s, lambda y: left(sha256(y), 16) || '=' ||
                      regexp_replace(y, '([0-9a-f]{8})[0-9a-f]{56}', '\1', 'g')), '|') b FROM s),
w AS (SELECT *, root || '|' || b f, coalesce(list_sum(list_transform(u, lambda y: substr(y, 10)::BIGINT)), 0) w FROM f),
j AS (SELECT n.doc_id, n.n, a.f, a.v, a.root, a.w, a.u, g.t gt, g.f gf, g.root groot, g.v gv, g.u gu, g.w gw,
      z.root zroot, z.u zu, z.w zw FROM n JOIN w a ON a.r = n.r AND NOT a.e JOIN w g ON g.r = n.r AND g.e
      JOIN w z ON z.r = n.nr AND NOT z.e)
SELECT doc_id, n n_chars, sha256(gt) edited_sha256, f fingerprint, gf edited_fingerprint,
       CASE WHEN root = groot THEN 1.0 WHEN w + gw = 0 THEN 0.0 ELSE 2.0::DOUBLE * coalesce(list_sum(list_transform(
            list_intersect(u, gu), lambda y: substr(y, 10)::BIGINT)), 0) / (w + gw) END::DOUBLE near_edited,
       CASE WHEN root = zroot THEN 1.0 WHEN w + zw = 0 THEN 0.0 ELSE 2.0::DOUBLE * coalesce(list_sum(list_transform(
            list_intersect(u, zu), lambda y: substr(y, 10)::BIGINT)), 0) / (w + zw) END::DOUBLE near_next,
       CASE WHEN root <> groot THEN coalesce(list_sum(list_transform(v[1:list_filter(range(1, len(v) + 2),
            lambda i: v[i] IS DISTINCT FROM gv[i])[1] - 1], lambda y: substr(y, 10)::BIGINT)), 0) END::BIGINT edit_from
FROM j
"""


@query
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return octopus.manifest(table(spark, sf_dir, "documents"))


ORACLE["op13_manifest"] = r"""
WITH RECURSIVE c AS (SELECT *, doc_id::VARCHAR i, 4294967295::BIGINT f FROM documents),
h AS (SELECT doc_id, lang, n_chars, coalesce(strlen(i) || ':' || i, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') pre, coalesce(strlen(text) || ':' || text, '-') post,
      xor(f, list_reduce(list_prepend(f, flatten(list_transform(string_split(i, ''),
          lambda y: [ascii(y)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
          lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384))) % 7 = 0 AND n_chars IS NOT NULL tampered FROM c),
l0 AS (SELECT doc_id, lang, tampered, sha256(pre || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || post) leaf,
       sha256(pre || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || post) altered FROM h),
l AS (SELECT *, row_number() OVER () id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 tree, count(*) OVER (PARTITION BY lang) size,
      row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 place FROM l0),
n(tree, level, place, size, node) AS (
  SELECT tree, 0, place, size, leaf FROM l UNION ALL
  SELECT tree, level + 1, place // 2, (size + 1) // 2, sha256(string_agg(node, '' ORDER BY place))
  FROM n WHERE size > 1 GROUP BY tree, level, place // 2, size),
t(level, place, size, node) AS (
  SELECT 0, tree, (SELECT count(DISTINCT tree) FROM l), node FROM n WHERE size = 1 UNION ALL
  SELECT level + 1, place // 2, (size + 1) // 2, sha256(string_agg(node, '' ORDER BY place))
  FROM t WHERE size > 1 GROUP BY level, place // 2, size),
b AS (SELECT id, false top, n.level, l.place >> n.level place, n.node FROM l JOIN n ON n.tree = l.tree AND n.place = xor(l.place >> n.level, 1)
      UNION ALL SELECT id, true, t.level, l.tree >> t.level, t.node FROM l JOIN t ON t.place = xor(l.tree >> t.level, 1)),
p AS (SELECT id, string_agg(node, '' ORDER BY top, level) s FROM b GROUP BY id),
f(id, level, place, size, node) AS (
  SELECT id, 0, place, size, CASE WHEN tampered THEN altered ELSE leaf END FROM l UNION ALL
  SELECT f.id, f.level + 1, f.place >> 1, (f.size + 1) // 2, sha256(CASE WHEN b.node IS NULL THEN f.node
         WHEN f.place % 2 = 1 THEN b.node || f.node ELSE f.node || b.node END)
  FROM f LEFT JOIN b ON b.id = f.id AND NOT b.top AND b.level = f.level WHERE f.size > 1),
g(id, level, place, size, node) AS (
  SELECT f.id, 0, l.tree, (SELECT count(DISTINCT tree) FROM l), f.node FROM f JOIN l USING (id) WHERE f.size = 1 UNION ALL
  SELECT g.id, g.level + 1, g.place >> 1, (g.size + 1) // 2, sha256(CASE WHEN b.node IS NULL THEN g.node
         WHEN g.place % 2 = 1 THEN b.node || g.node ELSE g.node || b.node END)
  FROM g LEFT JOIN b ON b.id = g.id AND b.top AND b.level = g.level WHERE g.size > 1)
SELECT l.doc_id, l.leaf, n.node subroot, t.node root, sha256(coalesce(p.s, '')) proof_sha256, g.node folded_root,
       g.node = t.node verified
FROM l JOIN n ON n.tree = l.tree AND n.size = 1 JOIN t ON t.size = 1 LEFT JOIN p ON p.id = l.id JOIN g ON g.id = l.id AND g.size = 1
"""
