"""The registered query of each operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, common, importance, lines, lm, minhash, mixing, negatives, ngram_join, pii, tokens, toxicity, warc, winnow


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    counted = tokens.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), budget=tokens.LIMIT)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > tokens.LIMIT).alias("over_limit"), "budget_chars")


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score_corpus(docs).select("doc_id", "n_words", F.round("log_prob", 4).alias("log_prob"), F.round("mean_log_prob", 6).alias("mean_log_prob"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"), toxicity.fold() != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (F.coalesce(toxicity.fold(), F.lit(1)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "rejected")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (common.table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    found = winnow.contamination(docs.select("doc_id", "text"), items)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    return mixing.rates(docs.select("doc_id", "text", "lang"), labels)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = common.cut(warc.write_archives(common.table(spark, sf_dir, "pages")))
    return warc.read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.components(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(common.table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(common.table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, label)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (common.table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return importance.resample(docs.select("doc_id", "text"), items)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_lm_scores, op3_toxicity, op4_line_dedup, op5_decontamination, op6_mixing, op7_pii, op8_warc, op9_minhash, op10_ann, op11_ngram_join, op12_hard_negatives, op13_importance)}

ORACLES = {
    "op4_line_dedup": r"""
WITH l AS (
  SELECT doc_id, u.i AS i, string_split(coalesce(text, ''), chr(10))[u.i] AS line, len(string_split(coalesce(text, ''), chr(10))) AS n
  FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS u(i)
), k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), j AS (
  SELECT k.doc_id, k.i, k.line, k.n, (r.key IS NOT NULL AND k.doc_id <> r.last) AS gone FROM k LEFT JOIN r ON k.key = r.key
)
SELECT doc_id, CAST(max(n) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
    "op5_decontamination": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[u.p:u.p + least(len(w), 10) - 1], ' ') AS win
  FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(p) WHERE len(w) > 0
), sizes AS (
  SELECT DISTINCT n FROM iw
), dw AS (
  SELECT doc_id, u.p AS p, sizes.n AS n, array_to_string(w[u.p:u.p + sizes.n - 1], ' ') AS win
  FROM d, sizes, unnest(range(1, len(w) - sizes.n + 2)) AS u(p)
), m AS (
  SELECT dw.doc_id, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n
), c AS (
  SELECT doc_id, count(DISTINCT x.q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) x GROUP BY doc_id
), k AS (
  SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM m GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(k.items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(k.items, ','), '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op9_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM w
), u AS (
  SELECT doc_id, len(sh) AS n, hash(unnest(sh)) AS h FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (max(a.n) + max(b.n) - count(*))
), e AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), r AS (
  SELECT doc_id AS node, doc_id AS root FROM s UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a
), c AS (
  SELECT node, min(root) AS component_id FROM r GROUP BY node
)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON s.doc_id = c.node""",
    "op8_warc": """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f""",
    "op11_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS sh FROM w
), u AS (
  SELECT doc_id, len(sh) AS n, hash(unnest(sh)) AS h FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (max(a.n) + max(b.n) - count(*))
), e AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), r AS (
  SELECT doc_id AS node, doc_id AS root FROM s UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a
), c AS (
  SELECT node, min(root) AS component_id FROM r GROUP BY node
)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id FROM s JOIN c ON s.doc_id = c.node""",
    "op12_hard_negatives": """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS anchor_id, a.label = b.label AS same, b.id AS id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.id % 100 = 0 AND a.id <> b.id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT p.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    "op13_importance": r"""
WITH tab AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), d AS (
  SELECT 0 AS side, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 1, NULL, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark
), e AS (
  SELECT side, doc_id, unnest(w) AS a, unnest(w[2:] || [NULL]) AS b, unnest(w[3:] || [NULL, NULL]) AS c FROM d WHERE len(w) > 0
), f AS (
  SELECT side, doc_id, a, b, c, count(*) AS n FROM e GROUP BY ALL
), words AS (
  SELECT w, list_transform(range(length(hex(encode(w))) // 2), lambda k: ('0x' || substr(hex(encode(w)), 2 * k + 1, 2))::BIGINT) AS bytes FROM (SELECT DISTINCT a AS w FROM f)
), one AS (
  SELECT w, bytes, list_reduce(list_prepend(4294967295, bytes), lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1])) AS s FROM words, tab
), two AS (
  SELECT a, b, list_reduce(list_prepend(o.s, list_prepend(32, words.bytes)), lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1])) AS s
  FROM (SELECT DISTINCT a, b FROM f WHERE b IS NOT NULL) p JOIN one o ON o.w = p.a JOIN words ON words.w = p.b, tab
), three AS (
  SELECT a, b, c, list_reduce(list_prepend(two.s, list_prepend(32, words.bytes)), lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1])) AS s
  FROM (SELECT DISTINCT a, b, c FROM f WHERE c IS NOT NULL) p JOIN two USING (a, b) JOIN words ON words.w = p.c, tab
), k AS (
  SELECT side, doc_id, n, xor(s, 4294967295) % 10000 AS bucket FROM f JOIN one ON one.w = f.a
  UNION ALL SELECT side, doc_id, n, xor(s, 4294967295) % 10000 FROM f JOIN two USING (a, b)
  UNION ALL SELECT side, doc_id, n, xor(s, 4294967295) % 10000 FROM f JOIN three USING (a, b, c)
), g AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0)::DOUBLE AS t FROM k GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM g) + 10000) / ((s + 1) * ((SELECT sum(t) FROM g) + 10000))))::BIGINT AS gain FROM g
), v AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM k JOIN gain USING (bucket) WHERE side = 0 GROUP BY doc_id
), x AS (
  SELECT d.doc_id, len(w) >= 20 AS enough, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN v USING (doc_id) WHERE side = 0
), y AS (
  SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id) AS r FROM x
)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND r <= (SELECT 5 * count(*) // 100 FROM x WHERE enough) THEN r END AS rank FROM y""",
}
