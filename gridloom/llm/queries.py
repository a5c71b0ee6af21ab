"""The subpackage's queries by name, each over its whole table, and the SQL that gives the same rows where there is some."""

from __future__ import annotations

from gridloom.llm import fill_middle, hard_negatives, language, line_templates, minhash, mixing, mpeg_audio, ngram_join, outliers, personal, pieces, suffix_dedup, training_order
from gridloom.llm.common import documents


def op2_ngram_join(spark, sf_dir):
    return ngram_join.jaccard_components(spark, documents(spark, sf_dir))


def op1_training_order(spark, sf_dir):
    return training_order.records(training_order.write_shards(spark, documents(spark, sf_dir)))


def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup.removed(spark, documents(spark, sf_dir))


def op4_language(spark, sf_dir):
    return language.predicted(spark, documents(spark, sf_dir))


def op5_line_templates(spark, sf_dir):
    return line_templates.digests(spark, documents(spark, sf_dir))


def op6_outliers(spark, sf_dir):
    return outliers.judged(spark, documents(spark, sf_dir))


def op7_mixing(spark, sf_dir):
    return mixing.shares(spark, documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_personal(spark, sf_dir):
    return personal.digests(spark, documents(spark, sf_dir))


def op9_mpeg_audio(spark, sf_dir):
    return mpeg_audio.stored_texts(documents(spark, sf_dir))


def op10_pieces(spark, sf_dir):
    return pieces.digests(documents(spark, sf_dir))


def op11_hard_negatives(spark, sf_dir):
    return hard_negatives.mined(spark, hard_negatives.relabelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op12_minhash(spark, sf_dir):
    return minhash.near_duplicates(spark, documents(spark, sf_dir))


def op13_fill_middle(spark, sf_dir):
    return fill_middle.digests(documents(spark, sf_dir))


QUERIES = {
    "op1_training_order": op1_training_order,
    "op2_ngram_join": op2_ngram_join,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_language": op4_language,
    "op5_line_templates": op5_line_templates,
    "op6_outliers": op6_outliers,
    "op7_mixing": op7_mixing,
    "op8_personal": op8_personal,
    "op9_mpeg_audio": op9_mpeg_audio,
    "op10_pieces": op10_pieces,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_minhash": op12_minhash,
    "op13_fill_middle": op13_fill_middle,
}

ORACLES = {
    "op2_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i+4], ' ') for i in range(1, len(ws) - 3)]) END sh FROM w),
t AS (SELECT doc_id, len(sh) n, unnest(sh) x FROM s),
p AS (
  SELECT a.doc_id a, b.doc_id b FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id node, doc_id root FROM s UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) n_shingles, min(r.root) component_id
FROM s JOIN r ON r.node = s.doc_id GROUP BY s.doc_id, sh
""",
    "op7_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') t FROM documents),
z AS (
  SELECT doc_id, source, CAST(len([x for x in string_split_regex(t, '[\x20\x09-\x0D]+') if x <> '']) AS BIGINT) size,
    CAST(length(translate(t, '0123456789#*$%&|<>!=_{}[]^~@/+\', '')) AS DOUBLE) / greatest(length(t), 1) share,
    (CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(t)), 1, 12) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE) / 281474976710656::DOUBLE u FROM d),
k AS (SELECT *, -ln(u) / greatest(0.05::DOUBLE, share * share) key FROM z),
s AS (SELECT source, CAST(sum(size) AS BIGINT) source_size FROM z GROUP BY source),
w AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] weight FROM s),
v AS (
  SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER o, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS DOUBLE) level FROM w
  WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, coalesce(max(CASE WHEN 3 * source_size >= level * weight THEN level END) OVER (), 'infinity'::DOUBLE) * weight) target FROM v),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / CAST(source_size AS DOUBLE) + 1e-9::DOUBLE) AS BIGINT) ELSE 0 END epochs FROM g),
r AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size rest,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN rest > 0.5 AND before < rest AND 2 * (rest - before) >= size THEN 1 ELSE 0 END) AS BIGINT) taken FROM r
""",
    "op11_hard_negatives": r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END label,
    [floor(256::DOUBLE * CAST(x AS DOUBLE)) for x in embedding] e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
a AS (SELECT * FROM v WHERE vec_id % 100 = 0),
s AS (
  SELECT a.vec_id anchor_id, b.vec_id, a.label = b.label same, CAST(list_dot_product(a.e, b.e) AS BIGINT) score
  FROM a JOIN v b ON a.vec_id IS DISTINCT FROM b.vec_id AND len(a.e) = len(b.e)),
p AS (
  SELECT anchor_id, vec_id positive_id, score positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id negative_id, s.score negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INT) rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
""",
    "op12_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct([z[1] || ' ' || z[2] for z in list_zip(ws[:-2], ws[2:])]) END sh FROM w),
t AS (SELECT doc_id, len(sh) n, unnest(sh) x FROM s),
p AS (
  SELECT a.doc_id a, b.doc_id b FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id node, doc_id root FROM s UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) n_shingles, min(r.root) component_id, s.doc_id = min(r.root) kept
FROM s JOIN r ON r.node = s.doc_id GROUP BY s.doc_id, sh
""",
    "op13_fill_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') u FROM documents),
g AS (
  SELECT *, CAST(len(u) AS BIGINT) n, CAST('0x' || h[1:8] AS BIGINT) h1, CAST('0x' || h[9:16] AS BIGINT) h2, CAST('0x' || h[17:24] AS BIGINT) h3, CAST('0x' || h[25:32] AS BIGINT) h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END form FROM g),
x AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') p, coalesce(array_to_string(u[a+1:b], ''), '') m, coalesce(array_to_string(u[b+1:], ''), '') s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) output_sha256,
  sha256(t) restored_sha256 FROM x
""",
}
