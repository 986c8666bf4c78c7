"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, importance, lm_scoring, main_text, metric_trees, near_dedup, packing, private_data, quality_model, quality_rules, syncmers, warc
from .shared import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=[])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("llr", 6).alias("llr")
    )


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), k=4)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    planted = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    real = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_digest(real.unionByName(planted))


def op4_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.digest(private_data.find(table(spark, sf_dir, "documents")))


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = syncmers.edited_pairs(table(spark, sf_dir, "documents"))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        syncmers.as_text(F.col("fp")).alias("fingerprint"),
        syncmers.as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = byte_bpe.encode_documents(table(spark, sf_dir, "documents"), *vocabulary)
    return byte_bpe.decode_documents(encoded, *vocabulary).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("raw", 256).alias("decoded_sha256"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 4))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~quality_model.held_out())
    scored = quality_model.score(documents, quality_model.train(documents, labels))
    return scored.select(
        "doc_id", quality_model.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_metric_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_trees.cluster(table(spark, sf_dir, "embeddings"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_near_dedup": op2_near_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_private_data": op4_private_data,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_warc": op6_warc,
    "op7_quality_model": op7_quality_model,
    "op8_packing": op8_packing,
    "op9_syncmers": op9_syncmers,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_metric_trees": op12_metric_trees,
    "op13_main_text": op13_main_text,
}

_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _round(n: int) -> str:
    """A round of centroid clustering: a<n> is the assignment to c<n>, and c<n + 1> are the centroids after it."""
    return f"""
d{n} AS MATERIALIZED (
  SELECT p.row, p.vec_id, c.c, CAST(list_sum(list_transform(range(1, 65), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i]))) AS BIGINT) AS d FROM p CROSS JOIN c{n} c),
a{n} AS MATERIALIZED (SELECT row, any_value(vec_id) AS vec_id, arg_min(c, d * 64 + c) AS c, min(d) AS d FROM d{n} GROUP BY row),
m{n} AS (
  SELECT c, i, CAST(floor(sum(x) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT a.c, unnest(range(1, 65)) AS i, unnest(p.v) AS x FROM a{n} a JOIN p ON p.row = a.row) GROUP BY c, i),
c{n + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN (SELECT c, list(x ORDER BY i) AS v FROM m{n} GROUP BY c) m ON m.c = c.c),"""


ORACLES: dict[str, str] = {
    "op2_near_dedup": f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
u AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.doc_id),
g AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, g.component_id, s.doc_id = g.component_id AS kept
FROM s JOIN g ON g.doc_id = s.doc_id""",
    "op3_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev FROM c),
a AS (
  SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS t,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS l,
    sum(length(replace(replace(text, '\', '\e'), '<', '\l')) + CASE WHEN prev = role THEN 6 ELSE length(replace(replace(replace(role, '\', '\e'), '<', '\l'), '>', '\g')) + 15 END) AS f
  FROM o GROUP BY conv_id)
SELECT conv_id, n AS n_turns, sha256(t) AS turns_sha256, length(l) AS loss_chars, sha256(l) AS loss_sha256, CAST(f AS BIGINT) AS formatted_chars FROM a""",
    "op6_warc": """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS least FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN least <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN least <> page_id THEN least END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest""",
    "op10_lm_scoring": f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w, unnest(list_concat(CAST([NULL] AS VARCHAR[]), w[1:len(w) - 1])) AS v FROM w WHERE len(w) > 0),
one AS (SELECT w, count(*) AS n FROM g GROUP BY w),
two AS (SELECT v, w, count(*) AS n FROM g WHERE i > 1 GROUP BY v, w),
t AS (SELECT count(*) AS n FROM g),
s AS (
  SELECT g.doc_id, CASE WHEN two.n >= 2 THEN ln(CAST(two.n AS DOUBLE) / pv.n) WHEN g.i > 1 THEN ln(CAST(0.4 AS DOUBLE) * pw.n / t.n)
    ELSE ln(CAST(pw.n AS DOUBLE) / t.n) END AS x
  FROM g CROSS JOIN t JOIN one pw ON pw.w = g.w LEFT JOIN one pv ON pv.w = g.v LEFT JOIN two ON two.v = g.v AND two.w = g.w AND g.i > 1),
m AS (SELECT doc_id, round(avg(x), 4) AS score FROM s GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, m.score FROM w LEFT JOIN m ON m.doc_id = w.doc_id""",
    "op12_metric_trees": f"""
WITH p AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM p ORDER BY h LIMIT 16)),
{"".join(_round(n) for n in range(3))}
d AS (SELECT p.vec_id, p.row, c.c, CAST(list_sum(list_transform(range(1, 65), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i]))) AS BIGINT) AS d FROM p CROSS JOIN c3 c),
a AS (SELECT row, any_value(vec_id) AS vec_id, arg_min(c, d * 64 + c) AS c, min(d) AS d FROM d GROUP BY row)
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a JOIN c3 ON c3.c = a.c""",
    # The given pages have one layout: an article of headings and paragraphs.
    "op13_main_text": r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS h FROM pages),
b AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(replace(replace(h, '<b>', ''), '<br>', ' '), '<[^>]*>'), lambda x:
    trim(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS b FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t""",
}
