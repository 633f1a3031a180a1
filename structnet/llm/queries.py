"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structnet.llm import (chat_format, decontaminate, divergence, exact_dedup, hard_negatives, license_scan, line_dedup, packing, quality, secret_scan, simhash_dedup,
                            token_counts, token_files)
from structnet.llm.common import read


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits that follow from its length and source."""
    docs = read(spark, sf_dir, "documents")
    n = F.length("text")
    place = lambda part: F.floor(n * part).cast("long")
    one = lambda start, deleted, inserted: F.struct(start.alias("start"), F.lit(deleted).cast("long").alias("deleted"), inserted.alias("inserted"))
    counted = token_counts.count_tokens(docs)
    edits = F.array(one(place(0.25), 7, F.lit("")), one(place(0.5), 0, F.lit(" revised")), one(place(0.75), 3, F.concat(F.lit(" "), F.col("doc_id").cast("string"), F.lit(" "))))
    edited = token_counts.apply_edits(counted.withColumn("edits", edits))
    return edited.select("doc_id", "tokens_before", F.expr("tree[1]").alias("tokens_after"), "n_edits", F.size("leaf_chars").cast("long").alias("n_leaves"), "leaves_encoded", "chars_encoded", F.length("text").cast("long").alias("n_chars"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and masked completions of every conversation against one with another last reply."""
    pairs = chat_format.swapped_replies(read(spark, sf_dir, "conversations"))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    out = chat_format.preference_pairs(pairs, "conv_id")
    return out.withColumns({c: spans(c) for c in ("chosen_mask", "rejected_mask")})


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document with its class of equal lines and the links of that class."""
    return line_dedup.line_classes(read(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_model")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_dedup.near_groups(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items it leaks."""
    found = decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.filter(F.col("leaks.item_id"), lambda i: i.isNotNull())))
    return found.select(
        "doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("long").alias("n_items"), items.alias("item_ids"),
        F.array_max("leaks.similarity").alias("similarity"), F.array_min("leaks.first_word").alias("first_word"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.find_licenses(read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = quality.score_documents(docs, quality.train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    folder = token_files.new_folder(spark)
    token_files.write_token_files(read(spark, sf_dir, "documents"), folder)
    return token_files.read_documents(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives.hard_negatives(rows, F.col("id") % 100 == 0)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergences(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_token_counts, op2_chat_format, op3_line_dedup, op4_exact_dedup, op5_packing, op6_secret_scan, op7_simhash_dedup, op8_decontamination, op9_license_scan, op10_quality,
           op11_token_files, op12_hard_negatives, op13_source_divergence)
    return {f.__name__: f for f in own}


_CHAT = """
WITH t AS (
  SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS pos
  FROM conversations),
c AS (SELECT conv_id, count(*) AS n, max(pos) FILTER (role = 'assistant') AS last FROM t GROUP BY conv_id),
reply AS (SELECT xor(t.conv_id, 1) AS conv_id, t.role, t.text FROM t JOIN c USING (conv_id) WHERE t.pos = c.last),
k AS (
  SELECT c.conv_id, r.text AS reply,
         CASE WHEN c.last IS NULL THEN c.n - 1 WHEN r.text = own.text THEN c.last ELSE c.last - 1 END AS n_common
  FROM c LEFT JOIN reply r ON r.conv_id = c.conv_id AND c.last IS NOT NULL
         LEFT JOIN t own ON own.conv_id = c.conv_id AND own.pos = c.last),
s AS (
  SELECT t.*, k.n_common, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown
  FROM t JOIN k USING (conv_id)),
o AS (SELECT *, sum(length(shown)) OVER (PARTITION BY conv_id, pos > n_common ORDER BY pos) AS stop FROM s)
SELECT k.conv_id, k.n_common,
       coalesce(string_agg(o.shown, '' ORDER BY o.pos) FILTER (o.pos <= k.n_common), '') AS prompt,
       coalesce(string_agg(o.shown, '' ORDER BY o.pos) FILTER (o.pos > k.n_common), '') AS chosen,
       CASE WHEN max(k.reply) IS NOT NULL AND NOT bool_or(o.pos = k.n_common AND o.role = 'assistant' AND o.text = k.reply AND o.pos = c.last)
            THEN '<|assistant|>' || chr(10) || max(k.reply) || '<|end|>' || chr(10) ELSE '' END AS rejected,
       coalesce(string_agg((stop - length(shown) + length(role) + 5)::VARCHAR || ':' || stop::VARCHAR, ',' ORDER BY o.pos)
                FILTER (o.pos > k.n_common AND o.role = 'assistant'), '') AS chosen_mask,
       CASE WHEN max(k.reply) IS NOT NULL AND NOT bool_or(o.pos = k.n_common AND o.role = 'assistant' AND o.text = k.reply AND o.pos = c.last)
            THEN '14:' || (length(max(k.reply)) + 14 + 8)::VARCHAR ELSE '' END AS rejected_mask
FROM k JOIN o USING (conv_id) JOIN c USING (conv_id) GROUP BY k.conv_id, k.n_common
"""

_EXACT = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""


_NEGATIVES = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT vec_id AS anchor_id, label, v FROM r WHERE vec_id % 100 = 0),
s AS (
  SELECT anchor_id, vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM a JOIN r ON anchor_id <> vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""

_DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
t AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (
  SELECT lang, source, coalesce(any_value(v.v), 0) AS v, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN v USING (lang) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n + 5 * g.v) AS p
  FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
l AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // ((SELECT sum(n) FROM g WHERE g.lang = p.lang) + 5 * (SELECT v FROM v WHERE v.lang = p.lang)) AS q
  FROM p GROUP BY lang, term),
valued AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(any_value(f), 0)::BIGINT AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
       LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f
                  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
  GROUP BY g.lang, g.source, h.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER w)::INTEGER AS rank FROM valued
WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item)
QUALIFY part = 'pair' OR row_number() OVER w <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": _CHAT, "op4_exact_dedup": _EXACT, "op12_hard_negatives": _NEGATIVES, "op13_source_divergence": _DIVERGENCE}
