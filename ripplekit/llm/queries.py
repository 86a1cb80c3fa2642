"""The registered queries opN_<name> and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, licenses, lm_scoring, mixing, packing, quality_rules, quality_vote, search, sharding, simhash
from .common import id_bucket, table


def op1_latent_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = id_bucket("doc_id", 5) == 0
    model = quality_vote.train(docs, labels, ~held_out)
    return quality_vote.vote(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])


def op2_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), id_bucket("doc_id", 7) == 2)


def op3_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


def op5_segmentation_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_bucket("doc_id", 3) == 1
    model = language.train(docs.where(~held_out))
    return language.identify(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])


def op6_boosted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op8_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (op1_latent_vote, op2_attention_scores, op3_branch_and_bound, op4_hilbert_packing, op5_segmentation_language, op6_boosted_rules, op7_virtual_slots, op8_license_windows, op9_fair_queue_mix, op10_simhash_balls)}

#: Templates as rows of a DuckDB table: number, license, words.
_TEMPLATE_ROWS = ", ".join(f"({i}, '{name}', {licenses.template_words(text)!r})" for i, (name, text) in enumerate(licenses.TEMPLATES))

ORACLE_SQL = {
    "op3_branch_and_bound": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
""",
    "op8_license_windows": f"""
WITH t AS (
  SELECT *, least(5, len(words)) AS width, len(words) - least(5, len(words)) + 1 AS span FROM (VALUES {_TEMPLATE_ROWS}) v(template, license, words)),
s AS (SELECT DISTINCT template, license, width, span, array_to_string(words[i:i + width - 1], ' ') AS shingle FROM t, range(1, span + 1) r(i)),
k AS (SELECT template, count(*) AS all_of_it FROM s GROUP BY template),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS words FROM documents),
p AS (SELECT doc_id, width, i - 1 AS pos, array_to_string(words[i:i + width - 1], ' ') AS shingle
      FROM d, (SELECT DISTINCT width FROM t), range(1, greatest(len(words) - width + 2, 1)) r(i)),
h AS (SELECT doc_id, template, license, span, shingle, pos // span - o AS win FROM p JOIN s USING (width, shingle), (VALUES (0), (1)) b(o)),
w AS (SELECT doc_id, template, license, span, win, count(DISTINCT shingle) AS held FROM h WHERE win >= 0 GROUP BY ALL)
SELECT doc_id, license, template::INTEGER AS template, max(held::DOUBLE / all_of_it) AS containment, min(win * span)::BIGINT AS first_word, count(*) AS windows
FROM w JOIN k USING (template) WHERE held::DOUBLE / all_of_it >= 0.8 GROUP BY doc_id, license, template
""",
    "op9_fair_queue_mix": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos
  FROM d GROUP BY source),
w AS (
  SELECT *, CASE pos % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, 3.0::DOUBLE * source_size AS top FROM s),
l AS (
  SELECT *, top / weight AS ratio, (sum(source_size) OVER ())::DOUBLE AS all_words,
         coalesce(sum(top) OVER (ORDER BY top / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY top / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM w),
t AS (
  SELECT source, source_size,
         coalesce(least((SELECT (all_words - capped) / open FROM l WHERE ratio >= (all_words - capped) / open ORDER BY ratio, pos LIMIT 1) * weight, top), 0) AS target
  FROM l),
q AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.size ROWS UNBOUNDED PRECEDING) AS sent
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT doc_id, size, (e * source_size + sent)::DOUBLE / target AS finish FROM q, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0),
f AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish RANGE UNBOUNDED PRECEDING) AS total FROM c),
k AS (SELECT doc_id, count(*) AS copies FROM f WHERE total <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(k.copies, 0))::BIGINT AS taken
FROM q LEFT JOIN k ON q.doc_id = k.doc_id
""",
}
