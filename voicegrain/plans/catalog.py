"""The named queries over feedback facts, each with SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text
from ..config import shared_dir
from ..operators import agglomerative, extract, language, pii, search_index, similarity, store, topics, unitize
from ..operators import labels as spelling
from ..sources import adapters
from ..sources.adapters import table
from ..streaming import flush, windows
from . import alerts, dashboard, explorer, loess, review, signals, taxonomy, trends

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

UNITS = """
u AS (SELECT event_id AS unit_id, user_id AS account_id, ts, CAST(ts AS DATE) AS unit_date,
  CASE event_type WHEN 'error' THEN 'bug_report' WHEN 'signup' THEN 'feature_request' WHEN 'purchase' THEN 'praise'
    WHEN 'view' THEN 'question' ELSE 'churn_signal' END AS intent_type,
  CAST(k % 12 AS BIGINT) AS topic_id, CAST(k - 50 AS DOUBLE) / CAST(50 AS DOUBLE) AS polarity,
  CAST(50 + event_id % 50 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence, CAST(event_id % 6 AS BIGINT) AS channel_id,
  event_id % 11 = 0 AS is_starred, CAST(event_id % 5 AS BIGINT) AS duplicate_count, k >= 90 AS is_new_topic
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)),
a AS (SELECT c_custkey AS account_id, c_name AS name, c_mktsegment AS segment FROM customer),
l AS (SELECT CAST(n_nationkey AS BIGINT) AS topic_id, n_name AS label FROM nation)"""
UNIT_COLUMNS = "unit_id, account_id, ts, unit_date, intent_type, topic_id, polarity, confidence, channel_id, is_starred, duplicate_count, is_new_topic"
DAYS = """
days AS (SELECT topic_id, CAST(d AS DATE) AS day FROM (SELECT DISTINCT topic_id FROM u),
  (SELECT unnest(generate_series(min(unit_date), max(unit_date), INTERVAL 1 DAY)) AS d FROM u)),
s AS (SELECT days.topic_id, days.day, count(u.unit_id) AS n FROM days LEFT JOIN u ON u.topic_id = days.topic_id AND u.unit_date = days.day
  GROUP BY days.topic_id, days.day)"""
TREE = """
n AS (SELECT 'R' || r_regionkey AS node_id, CAST(NULL AS VARCHAR) AS parent_id, r_name AS label, CAST(0 AS DOUBLE) AS weight FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name, 0 FROM nation
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, s_name, s_acctbal FROM supplier),
p AS (SELECT node_id, node_id AS root, 0 AS depth, label AS path, [node_id] AS ancestors FROM n WHERE parent_id IS NULL
  UNION ALL SELECT n.node_id, p.root, p.depth + 1, p.path || ' > ' || n.label, list_append(p.ancestors, n.node_id) FROM p JOIN n ON n.parent_id = p.node_id)"""
VECTORS = """
v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
w AS MATERIALIZED (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v)"""
#: Similarity of the synthetic vectors never comes near the defaults; so low a threshold links some of them.
DEDUP_AT, TOPIC_AT = 0.40, 0.30


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def units(spark: SparkSession, d: str) -> DataFrame:
    return adapters.unit_facts(table(spark, d, "events"))


def accounts(spark: SparkSession, d: str) -> DataFrame:
    return adapters.accounts(table(spark, d, "customer"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("topic_id"), F.col("n_name").alias("label"))


def tree(spark: SparkSession, d: str) -> DataFrame:
    return adapters.taxonomy(table(spark, d, "region"), table(spark, d, "nation"), table(spark, d, "supplier"))


# Redaction and unitization

# Fixed values, as the SQL side has them for itself: kinds, patterns and the group that is the value.
PII_SQL = (
    ("EMAIL", r"(?i)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", 0),
    ("PHONE", r"(?:\+?1[\s\-.]?)?(?:\(?\d{3}\)?[\s\-.]?)\d{3}[\s\-.]?\d{4}", 0),
    ("CREDIT_CARD", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12}|(?:[0-9]{4}[\s\-]?){3}[0-9]{4})\b", 0),
    ("SSN", r"\b\d{3}[- ]?\d{2}[- ]?\d{4}\b", 0),
    ("IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", 0),
    ("URL", r"(?i)https?://[^\s<>\"]+|www\.[^\s<>\"]+", 0),
    ("ACCOUNT_NUM", r"(?i)(?:account|order|ticket|ref|reference|id|#|no\.?)\s*[:\-]?\s*([A-Za-z0-9\-]{6,20})", 1),
)
#: Spans of all patterns, those that overlap as one of the first one's kind (z), and the texts without them (c).
REDACTION = "b AS MATERIALIZED (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), m AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, list_transform(range(1, len(w) + 1), lambda i: {{'e': list_sum(list_transform(w[1:i], lambda x: length(x))) "
    f"+ list_sum(list_transform(g[1:i], lambda x: length(x))), 'n': length(v[i])}}) AS p FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS w, "
    f"string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}', {group}) AS v FROM b) WHERE len(w) > 0"
    for rank, (kind, pattern, group) in enumerate(PII_SQL)
) + """),
x AS (SELECT doc_id, rank, kind, CAST(q.e - q.n AS BIGINT) AS s, CAST(q.e AS BIGINT) AS e FROM (SELECT doc_id, rank, kind, unnest(p) AS q FROM m)),
y AS (SELECT *, coalesce(s >= max(e) OVER (PARTITION BY doc_id ORDER BY s, rank, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM x),
k AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY s, rank, e ROWS UNBOUNDED PRECEDING) AS grp FROM y),
z AS (SELECT doc_id, grp, min(s) AS s, max(e) AS e, first(kind ORDER BY s, rank, e) AS kind FROM k GROUP BY doc_id, grp),
o AS (SELECT *, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS a FROM z),
f AS (SELECT b.doc_id, count(*) AS n, max(o.e) AS last, string_agg(substring(t, CAST(a + 1 AS BIGINT), CAST(s - a AS BIGINT)) || '[' || kind || ']', '' ORDER BY s) AS head
  FROM o JOIN b ON b.doc_id = o.doc_id GROUP BY b.doc_id),
c AS (SELECT b.doc_id, source, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN t ELSE head || substring(t, CAST(last + 1 AS BIGINT)) END AS clean FROM b LEFT JOIN f ON f.doc_id = b.doc_id)"""


@query(
    "SELECT source, pii_type, sum(n)::BIGINT AS n FROM ("
    + " UNION ALL ".join(
        f"SELECT source, '{kind}' AS pii_type, len(regexp_extract_all(text, '{pattern.replace(chr(39), chr(39) * 2)}')) AS n FROM documents"
        for kind, pattern, _ in PII_SQL
    )
    + ") GROUP BY source, pii_type HAVING sum(n) > 0"
)
def pii_pattern_counts(spark, d):
    marked = table(spark, d, "documents").select("source", pii.regex_spans(F.col("text")).alias("pii_spans"))
    return pii.counts_by_kind(marked, "source")


@query(f"WITH {REDACTION} SELECT concat('doc-', doc_id) AS id, n > 0 AS pii_redacted, n AS n_spans, sha256(clean) AS clean_sha256 FROM c")
def pii_redacted(spark, d):
    done = pii.redact(adapters.cfo_from_documents(table(spark, d, "documents")))
    return done.select("id", "pii_redacted", F.size("pii_spans").cast("long").alias("n_spans"), F.sha2("clean_text", 256).alias("clean_sha256"))


@query(f"WITH {REDACTION} SELECT source AS source_channel, kind AS pii_type, count(*) AS n FROM z JOIN b ON b.doc_id = z.doc_id GROUP BY source, kind")
def pii_type_counts(spark, d):
    done = pii.redact(adapters.cfo_from_documents(table(spark, d, "documents")))
    return pii.counts_by_kind(done, "source_channel")


@query(r"""
SELECT id, count(*) AS n_segments, sum(length(x))::BIGINT AS n_chars FROM (
  SELECT concat('doc-', doc_id) AS id, unnest(regexp_extract_all(text, '[^.!?\n]*[.!?\n]+|[^.!?\n]+')) AS x FROM documents)
WHERE length(regexp_replace(x, '[\s.!?]', '', 'g')) > 0 GROUP BY id""")
def unitize_segments(spark, d):
    records = adapters.cfo_from_documents(table(spark, d, "documents"))
    parts = records.select("id", F.explode(F.regexp_extract_all("raw_text", F.lit(unitize.SEGMENT), F.lit(0))).alias("x"))
    parts = parts.where(F.length(F.regexp_replace("x", r"[\s.!?]", "")) > 0)
    return parts.groupBy("id").agg(F.count("*").alias("n_segments"), F.sum(F.length("x")).alias("n_chars"))


@query(r"""
WITH x AS (SELECT concat('doc-', doc_id) AS id, regexp_extract_all(text, '[^.!?\n]*[.!?\n]+|[^.!?\n]+') AS p FROM documents),
y AS (SELECT id, unnest(range(len(p))) AS i, unnest(p) AS p FROM x),
z AS (SELECT id, i, p, coalesce(sum(length(p)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(p) - length(ltrim(p)) AS s FROM y)
SELECT id, CAST(i AS INT) AS unit_index, CAST(s AS INT) AS char_start, CAST(s + length(regexp_replace(trim(p), '\n+$', '')) AS INT) AS char_end, sha256(id || '|' || i) AS unit_id
FROM z WHERE length(regexp_replace(p, '[\s.!?]', '', 'g')) > 0""")
def unitize_sentences(spark, d):
    records = adapters.cfo_from_documents(table(spark, d, "documents"))
    found = unitize.sentences(records, "raw_text")
    return found.select("id", "unit_index", "char_start", "char_end", unitize.unit_id(F.col("id"), F.col("unit_index")).alias("unit_id"))


@query(r"""
SELECT concat_ws('-', 'conv', conv_id, turn) AS id, length(text) AS n_chars FROM conversations WHERE role = 'user'""")
def transcript_records(spark, d):
    return adapters.cfo_from_transcripts(table(spark, d, "conversations")).select("id", F.length("raw_text").cast("long").alias("n_chars"))


# Fixed values, as the SQL side has them for itself: providers of consumers' addresses and the pattern of an address.
@query(r"""
SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '\b[A-Za-z0-9._%+\-]+@([A-Za-z0-9.\-]+\.[A-Za-z]{2,})\b', 1), lambda x: lower(x)),
  lambda x: x NOT IN ('gmail.com', 'yahoo.com', 'outlook.com', 'hotmail.com', 'icloud.com', 'live.com', 'me.com', 'aol.com', 'protonmail.com',
    'pm.me', 'googlemail.com', 'msn.com', 'ymail.com'))[1] AS domain FROM documents""")
def account_email_domain(spark, d):
    return table(spark, d, "documents").select("doc_id", text.email_domain(F.col("text")).alias("domain"))


@query("""
SELECT b.item_id, count(d.doc_id) AS n_grounded FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id""")
def grounding_evidence(spark, d):
    """How many documents hold each benchmark passage verbatim: the passages are evidence, a document is grounded if it has it.

    Passages and texts meet on a hash of each passage's first eight words, and are then compared whole.
    """
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("evidence"))
    return extract.evidence_counts(table(spark, d, "documents").select("doc_id", "text"), items)


@query(r"""
SELECT sha256(text) AS text_hash, count(*) AS copies, count(DISTINCT source) AS n_sources FROM documents GROUP BY text HAVING count(DISTINCT source) >= 2""")
def exact_text_duplicates(spark, d):
    return review.spam(adapters.cfo_from_documents(table(spark, d, "documents")))


# Fixed values, as the SQL side has them for itself: stop words.
@query("""
SELECT doc_id, lang, CASE WHEN s = 0 THEN 'unknown' WHEN en = s THEN 'en' WHEN fr = s THEN 'fr' WHEN de = s THEN 'de' ELSE 'es' END AS guessed FROM (
  SELECT *, greatest(en, fr, de, es) AS s FROM (SELECT doc_id, lang,
    len(list_filter(w, lambda x: x IN ('the', 'and', 'of', 'to', 'in', 'is', 'that', 'with'))) AS en,
    len(list_filter(w, lambda x: x IN ('le', 'la', 'les', 'et', 'des', 'est', 'une', 'dans'))) AS fr,
    len(list_filter(w, lambda x: x IN ('der', 'die', 'das', 'und', 'ist', 'ein', 'nicht', 'mit'))) AS de,
    len(list_filter(w, lambda x: x IN ('el', 'los', 'las', 'y', 'una', 'por', 'con', 'que'))) AS es
  FROM (SELECT doc_id, lang, string_split_regex(lower(text), '[^a-zà-ÿ]+') AS w FROM documents)))""")
def language_detection(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", rules.language(F.col("text")).alias("guessed"))


@query(f"""
WITH {REDACTION}, w AS (SELECT concat('doc-', doc_id) AS id, string_split_regex(lower(clean), '[^a-zà-ÿ]+') AS w FROM c),
n AS (SELECT id, w, CAST(len(list_filter(w, lambda x: x IN ('good', 'great', 'love', 'excellent', 'easy', 'fast', 'helpful', 'thanks', 'perfect', 'happy'))) AS DOUBLE) AS p,
  CAST(len(list_filter(w, lambda x: x IN ('bad', 'slow', 'crash', 'crashes', 'broken', 'hate', 'terrible', 'error', 'fail', 'fails', 'frustrating', 'cancel'))) AS DOUBLE) AS q FROM w),
v AS (SELECT id, w, CASE WHEN p + q = 0 THEN CAST(0 AS DOUBLE) ELSE (p - q) / (p + q) END AS polarity FROM n),
i AS (SELECT *, CASE WHEN list_has_any(w, ['cancel', 'leaving', 'switch', 'unsubscribe']) THEN 'churn_signal'
  WHEN list_has_any(w, ['crash', 'crashes', 'error', 'broken', 'fail', 'fails', 'bug']) THEN 'bug_report'
  WHEN list_has_any(w, ['wish', 'add', 'feature', 'support', 'please']) THEN 'feature_request'
  WHEN list_has_any(w, ['how', 'why', 'what', 'when', 'where']) THEN 'question'
  WHEN list_has_any(w, ['love', 'great', 'excellent', 'thanks', 'perfect']) THEN 'praise' ELSE 'general_comment' END AS intent_type FROM v)
SELECT id, polarity, CASE WHEN abs(polarity) >= 0.8 THEN 'strong' WHEN abs(polarity) >= 0.4 THEN 'moderate' ELSE 'mild' END AS intensity, intent_type,
  CASE WHEN intent_type IN ('churn_signal', 'bug_report') THEN 'high' ELSE 'low' END AS urgency FROM i""")
def rule_analysis(spark, d):
    """Every document through redaction and the rule backend's sentiment and intent answers."""
    clean = pii.redact(adapters.cfo_from_documents(table(spark, d, "documents"))).select("id", "clean_text")
    both = text.parse_combined(rules.combined_answer(F.col("clean_text")))
    got = clean.select("id", both.alias("b"))
    return got.select("id", "b.sentiment.polarity", "b.sentiment.intensity", "b.intent.intent_type", "b.intent.urgency")


# Exploring


@query(f"WITH {UNITS} SELECT {UNIT_COLUMNS} FROM u WHERE unit_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'")
def explorer_filter_dates(spark, d):
    f = explorer.Filters(since=datetime.date(2024, 1, 10), until=datetime.date(2024, 1, 20))
    return explorer.apply(units(spark, d), f)


@query(f"WITH {UNITS} SELECT {UNIT_COLUMNS} FROM u WHERE intent_type IN ('bug_report', 'churn_signal')")
def explorer_filter_intents(spark, d):
    return explorer.apply(units(spark, d), explorer.Filters(intents=("bug_report", "churn_signal")))


@query(f"WITH {UNITS} SELECT {UNIT_COLUMNS} FROM u WHERE polarity BETWEEN CAST(-1 AS DOUBLE) AND CAST(-0.4 AS DOUBLE)")
def explorer_filter_polarity(spark, d):
    return explorer.apply(units(spark, d), explorer.Filters(most_polarity=-0.4))


@query(f"WITH {UNITS} SELECT {UNIT_COLUMNS} FROM u WHERE topic_id = 3 AND is_starred")
def explorer_filter_topic_starred(spark, d):
    return explorer.apply(units(spark, d), explorer.Filters(topic_id=3, starred=True))


@query(f"WITH {UNITS} SELECT {UNIT_COLUMNS} FROM u WHERE account_id = 7")
def explorer_filter_account(spark, d):
    return explorer.apply(units(spark, d), explorer.Filters(account_id=7))


@query(f"""WITH {UNITS}, t AS (SELECT topic_id FROM u WHERE intent_type = 'churn_signal' GROUP BY topic_id HAVING count(DISTINCT account_id) >= 20)
SELECT {UNIT_COLUMNS} FROM u SEMI JOIN t ON t.topic_id = u.topic_id WHERE intent_type = 'churn_signal'""")
def explorer_min_accounts(spark, d):
    return explorer.apply(units(spark, d), explorer.Filters(intents=("churn_signal",), min_accounts=20))


_SORTS = {
    "most_recent": "ts DESC",
    "oldest": "ts",
    "worst_sentiment": "polarity",
    "best_sentiment": "polarity DESC",
    "most_duplicates": "duplicate_count DESC",
}


def _page(order: str) -> Query:
    return lambda spark, d: explorer.page(units(spark, d), order, 50)


for _order, _by in _SORTS.items():
    QUERIES[f"explorer_page_{_order}"] = _page(_order)
    ORACLES[f"explorer_page_{_order}"] = f"WITH {UNITS} SELECT {UNIT_COLUMNS} FROM u ORDER BY {_by}, unit_id LIMIT 50"


@query(f"""WITH {UNITS} SELECT {UNIT_COLUMNS} FROM u
WHERE polarity < CAST(0.5 AS DOUBLE) OR (polarity = CAST(0.5 AS DOUBLE) AND unit_id > 100) ORDER BY polarity DESC, unit_id LIMIT 50""")
def explorer_next_page(spark, d):
    return explorer.page(units(spark, d), "best_sentiment", 50, after=(0.5, 100))


@query(f"""WITH {UNITS}, i AS (SELECT intent_type FROM u GROUP BY intent_type ORDER BY count(*) DESC, intent_type LIMIT 1),
t AS (SELECT topic_id FROM u GROUP BY topic_id ORDER BY count(*) DESC, topic_id LIMIT 1)
SELECT count(*) AS n_units, count(DISTINCT account_id) AS n_accounts, coalesce(CAST(round(CAST(avg(polarity) AS DECIMAL(28, 12)), 6) AS DOUBLE), 0) AS mean_polarity,
  any_value(i.intent_type) AS top_intent_type, any_value(t.topic_id) AS top_topic_id FROM u, i, t""")
def explorer_summary(spark, d):
    return explorer.summary(units(spark, d))


@query(f"WITH {UNITS} SELECT topic_id, count(DISTINCT account_id) AS n_accounts FROM u GROUP BY topic_id HAVING count(DISTINCT account_id) >= 20")
def min_accounts_topics(spark, d):
    return explorer.broad_topics(units(spark, d), 20)


@query(f"""WITH {UNITS} SELECT * FROM (SELECT 'topic' AS kind, CAST(topic_id AS VARCHAR) AS id, label FROM l WHERE contains(lower(label), 'on') ORDER BY topic_id LIMIT 4)
UNION ALL SELECT * FROM (SELECT 'account', CAST(account_id AS VARCHAR), name FROM a WHERE contains(lower(name), 'on') ORDER BY account_id LIMIT 4)
UNION ALL SELECT * FROM (SELECT 'unit', CAST(doc_id AS VARCHAR), text FROM documents WHERE contains(lower(text), 'on') ORDER BY doc_id LIMIT 4)""")
def global_search(spark, d):
    return explorer.search(
        "On",
        labels(spark, d).select(F.col("topic_id").alias("id"), "label"),
        accounts(spark, d).select(F.col("account_id").alias("id"), F.col("name").alias("label")),
        table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("label")),
    )


@query(f"""WITH {UNITS} SELECT {UNIT_COLUMNS}, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY ts DESC, unit_id) AS rank FROM u) WHERE rank <= 5""")
def newest_verbatims(spark, d):
    return explorer.newest(units(spark, d), "topic_id")


@query(f"WITH {UNITS} SELECT {UNIT_COLUMNS} FROM u WHERE is_starred AND unit_id % 3 = 0")
def starred_collection(spark, d):
    members = table(spark, d, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("unit_id"))
    return explorer.starred_in(units(spark, d), members)


# Dashboard, topics, accounts


@query(f"""WITH {UNITS} SELECT count(DISTINCT topic_id) AS active_topics, CAST(round(CAST(avg(polarity) AS DECIMAL(28, 12)), 6) AS DOUBLE) AS mean_polarity,
  count(DISTINCT account_id) AS accounts, count(*) FILTER (intent_type = 'churn_signal') AS signals FROM u""")
def kpi(spark, d):
    return dashboard.key_figures(units(spark, d))


@query(f"""WITH {UNITS}, c AS (SELECT intent_type, topic_id, count(*) AS units FROM u GROUP BY intent_type, topic_id),
r AS (SELECT *, row_number() OVER (PARTITION BY intent_type ORDER BY units DESC, topic_id) AS rank FROM c)
SELECT r.topic_id, intent_type, units, CAST(rank AS INTEGER) AS rank, coalesce(label, CAST(r.topic_id AS VARCHAR)) AS label
FROM r LEFT JOIN l ON l.topic_id = r.topic_id WHERE rank <= 5""")
def top_topics_by_intent(spark, d):
    return dashboard.top_topics(units(spark, d), labels(spark, d))


@query(f"""WITH {UNITS}, w AS (SELECT CAST(x AS DATE) AS week FROM (
  SELECT unnest(generate_series(date_trunc('week', min(unit_date)), date_trunc('week', max(unit_date)), INTERVAL 7 DAY)) AS x FROM u))
SELECT w.week, {", ".join(f"count(*) FILTER (intent_type = '{i}') AS {i}" for i in adapters.INTENT_TYPES)}
FROM w LEFT JOIN u ON CAST(date_trunc('week', unit_date) AS DATE) = w.week GROUP BY w.week""")
def weekly_volume_by_type(spark, d):
    return dashboard.weekly_volume(units(spark, d))


@query(f"""WITH {UNITS}, b AS (SELECT unnest(range(10)) AS bin),
c AS (SELECT CAST(least(floor((polarity + 1) / CAST(0.2 AS DOUBLE)), 9) AS BIGINT) AS bin FROM u)
SELECT b.bin, round(CAST(-1 AS DOUBLE) + CAST(0.2 AS DOUBLE) * b.bin, 1) AS low, count(c.bin) AS n FROM b LEFT JOIN c ON c.bin = b.bin GROUP BY b.bin""")
def sentiment_histogram(spark, d):
    return dashboard.histogram(units(spark, d))


@query(f"""WITH {UNITS} SELECT topic_id, intent_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY topic_id), 6) AS share
FROM u GROUP BY topic_id, intent_type""")
def intent_breakdown(spark, d):
    return dashboard.intent_shares(units(spark, d))


@query(f"""WITH {UNITS}, m AS (SELECT topic_id, account_id, count(*) AS n, CAST(round(CAST(avg(polarity) AS DECIMAL(28, 12)), 6) AS DOUBLE) AS mean_polarity FROM u GROUP BY topic_id, account_id)
SELECT m.account_id, topic_id, n, mean_polarity, name FROM m LEFT JOIN a ON a.account_id = m.account_id""")
def accounts_mentioning(spark, d):
    return dashboard.mentions(units(spark, d), accounts(spark, d))


@query(f"""WITH {UNITS}, g AS (SELECT topic_id, CAST(x AS DATE) AS week FROM (SELECT DISTINCT topic_id FROM u), (
  SELECT unnest(generate_series(date_trunc('week', min(unit_date)), date_trunc('week', max(unit_date)), INTERVAL 7 DAY)) AS x FROM u))
SELECT g.topic_id, g.week, count(u.unit_id) AS volume, CAST(round(CAST(avg(polarity) AS DECIMAL(28, 12)), 6) AS DOUBLE) AS mean_polarity
FROM g LEFT JOIN u ON u.topic_id = g.topic_id AND CAST(date_trunc('week', unit_date) AS DATE) = g.week GROUP BY g.topic_id, g.week""")
def topic_weekly_trend(spark, d):
    return dashboard.weekly_trend(units(spark, d))


@query(f"WITH {UNITS} SELECT account_id, topic_id, count(*) AS n FROM u GROUP BY account_id, topic_id")
def account_topic_breakdown(spark, d):
    return dashboard.account_topics(units(spark, d))


@query(f"""WITH {UNITS} SELECT account_id, strftime(unit_date, '%Y-%m') AS month, round(CAST(round(CAST(avg(polarity) AS DECIMAL(28, 12)), 6) AS DOUBLE), 2) AS mean_polarity
FROM u GROUP BY account_id, month""")
def account_sentiment_monthly(spark, d):
    return dashboard.account_months(units(spark, d))


_ROLLUP = f"""WITH {UNITS}, c AS (SELECT account_id, topic_id, count(*) AS n FROM u GROUP BY account_id, topic_id),
t AS (SELECT account_id, topic_id FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY n DESC, topic_id) AS r FROM c) WHERE r = 1),
x AS (SELECT u.account_id, count(*) AS unit_count, CAST(round(CAST(avg(polarity) AS DECIMAL(28, 12)), 6) AS DOUBLE) AS net_sentiment, max(unit_date) AS last_date FROM u GROUP BY u.account_id)
SELECT x.account_id, unit_count, net_sentiment, t.topic_id AS top_topic, last_date, name, segment FROM x JOIN t ON t.account_id = x.account_id JOIN a ON a.account_id = x.account_id"""


@query(_ROLLUP)
def account_rollup(spark, d):
    return dashboard.account_rollup(units(spark, d), accounts(spark, d))


@query(f"{_ROLLUP} WHERE contains(lower(name), '00001') AND segment = 'BUILDING'")
def account_list_search(spark, d):
    return dashboard.account_list(dashboard.account_rollup(units(spark, d), accounts(spark, d)), "00001", "BUILDING", "worst_sentiment")


@query(f"""WITH {UNITS} SELECT CASE WHEN polarity >= CAST(0.5 AS DOUBLE) THEN 'Positive' WHEN polarity >= CAST(0.1 AS DOUBLE) THEN 'Slightly positive'
  WHEN polarity >= CAST(-0.1 AS DOUBLE) THEN 'Neutral' WHEN polarity >= CAST(-0.5 AS DOUBLE) THEN 'Slightly negative' ELSE 'Negative' END AS sentiment,
  count(*) AS n FROM u GROUP BY sentiment""")
def sentiment_label_counts(spark, d):
    return dashboard.label_counts(units(spark, d))


_STATS = f"""WITH {UNITS}, e AS (SELECT max(unit_date) AS last FROM u),
x AS (SELECT topic_id, count(*) AS unit_count, round(avg(confidence), 6) AS confidence_avg, count(*) FILTER (last - unit_date < 7) AS current,
  count(*) FILTER (last - unit_date BETWEEN 7 AND 13) AS previous FROM u, e GROUP BY topic_id)
SELECT topic_id, unit_count, confidence_avg, current, previous, round(CASE WHEN previous > 0 THEN (current - previous) / previous END, 6) AS trend FROM x"""


@query(_STATS)
def topic_stats(spark, d):
    return dashboard.topic_stats(units(spark, d))


@query(f"""WITH {UNITS} SELECT channel_id, segment, count(*) AS n, CAST(round(CAST(avg(polarity) AS DECIMAL(28, 12)), 6) AS DOUBLE) AS mean_polarity
FROM u JOIN a ON a.account_id = u.account_id GROUP BY CUBE (channel_id, segment)""")
def channel_segment_cube(spark, d):
    return dashboard.cube_slices(units(spark, d), accounts(spark, d))


# Trends, alerts, impact


@query(f"""WITH {UNITS} SELECT topic_id, count(*) AS absolute_count, round(count(*) / sum(count(*)) OVER (), 6) AS relative_share,
  count(DISTINCT account_id) AS unique_users FROM u GROUP BY topic_id""")
def volume_metrics(spark, d):
    return trends.volumes(units(spark, d))


@query(f"WITH {UNITS} SELECT topic_id, channel_id, count(*) AS n FROM u GROUP BY topic_id, channel_id")
def channel_distribution(spark, d):
    return trends.channels(units(spark, d))


@query(f"""WITH {UNITS} SELECT topic_id, CAST(round(CAST(avg(polarity) AS DECIMAL(28, 12)), 6) AS DOUBLE) AS mean_polarity, round(stddev_samp(polarity), 6) AS sd_polarity,
  round(corr(polarity, confidence), 6) AS correlation FROM u GROUP BY topic_id""")
def sentiment_metrics(spark, d):
    return trends.sentiment_metrics(units(spark, d))


@query(f"""WITH {UNITS}, e AS (SELECT max(unit_date) AS last FROM u),
x AS (SELECT topic_id, count(*) AS n, avg(polarity) AS p, avg(CASE WHEN segment = 'MACHINERY' THEN 1.0::DOUBLE ELSE 0 END) AS seg,
  count(*) FILTER (last - unit_date < 7) AS cur, count(*) FILTER (last - unit_date BETWEEN 7 AND 13) AS prev
  FROM u JOIN a ON a.account_id = u.account_id, e GROUP BY topic_id)
SELECT topic_id, round(0.4::DOUBLE * n / (SELECT max(n) FROM x) + 0.3::DOUBLE * abs(p) * (CASE WHEN p < 0 THEN 1 ELSE 0.5::DOUBLE END)
  + 0.2::DOUBLE * seg + 0.1::DOUBLE * greatest(-1, least(1, (cur - prev) / greatest(prev, 1))), 6) AS impact FROM x""")
def impact_score(spark, d):
    return trends.impact(units(spark, d), accounts(spark, d))


@query(f"""SELECT i.topic_id, impact, unit_count, printf('Topic %d: %d units, impact %.3f', i.topic_id, unit_count, impact) AS line FROM ({ORACLES['impact_score']}) i
JOIN (WITH {UNITS} SELECT topic_id, count(*) AS unit_count FROM u GROUP BY topic_id) t ON t.topic_id = i.topic_id ORDER BY impact DESC, i.topic_id LIMIT 5""")
def executive_summary(spark, d):
    u = units(spark, d)
    return trends.executive_inputs(trends.impact(u, accounts(spark, d)), dashboard.topic_stats(u).select("topic_id", "unit_count"))


@query(f"WITH {UNITS}, {DAYS} SELECT topic_id, day, n FROM s")
def daily_series_zero_filled(spark, d):
    return trends.daily_series(units(spark, d))


@query(f"""WITH {UNITS}, {DAYS}, m AS (SELECT *, round(avg(n) OVER (PARTITION BY topic_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS mean_before FROM s)
SELECT topic_id, day, n, mean_before FROM m WHERE n > 1.5 * mean_before""")
def volume_spike_7d(spark, d):
    return trends.spikes(trends.daily_series(units(spark, d)), times=1.5)


@query(f"""WITH {UNITS}, {DAYS}, m AS (SELECT *, avg(n) OVER w AS m, stddev_samp(n) OVER w AS sd FROM s
  WINDOW w AS (PARTITION BY topic_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT topic_id, day, n, round(CASE WHEN sd > 0 THEN (n - m) / sd END, 6) AS z FROM m)
SELECT topic_id, day, n, z, coalesce(abs(z) > 2.5, false) AS is_anomaly FROM z""")
def anomaly_zscore(spark, d):
    return trends.anomalies(trends.daily_series(units(spark, d)))


@query(f"""WITH {UNITS}, {DAYS}, t AS (SELECT *, avg(n) OVER (PARTITION BY topic_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend FROM s),
r AS (SELECT *, avg(n - trend) OVER (PARTITION BY topic_id, isodow(day)) AS season FROM t)
SELECT topic_id, day, n, round(trend, 6) AS trend, round(season, 6) AS season, round(n - trend - season, 6) AS residual FROM r""")
def seasonal_decomposition(spark, d):
    return trends.decomposed(trends.daily_series(units(spark, d)))


@query(f"""WITH {UNITS}, w AS (SELECT topic_id, CAST(date_trunc('week', unit_date) AS DATE) AS week, count(*) AS n FROM u GROUP BY topic_id, week),
p AS (SELECT *, lag(n) OVER (PARTITION BY topic_id ORDER BY week) AS previous FROM w),
c AS (SELECT *, round((n - previous) / previous, 6) AS change FROM p)
SELECT topic_id, week, n, previous, change, coalesce(change > 0.5, false) AS is_alert FROM c""")
def wow_change(spark, d):
    return trends.week_over_week(units(spark, d))


@query(f"""WITH {UNITS}, x AS (SELECT account_id, unit_date, CAST(round(CAST(avg(polarity) AS DECIMAL(28, 12)), 6) AS DOUBLE) AS net_sentiment, count(*) AS n FROM u GROUP BY account_id, unit_date)
SELECT * FROM x WHERE net_sentiment < -0.8""")
def account_sentiment_alert(spark, d):
    return trends.account_alerts(units(spark, d))


@query(f"""WITH {UNITS}, x AS (SELECT u.account_id, count(*) AS n FROM u JOIN a ON a.account_id = u.account_id
  WHERE intent_type = 'churn_signal' AND segment = 'MACHINERY' GROUP BY u.account_id)
SELECT account_id, n, CASE WHEN n >= 5 THEN 'red' WHEN n >= 3 THEN 'yellow' ELSE 'green' END AS severity FROM x""")
def churn_alerts(spark, d):
    return trends.churn_alerts(units(spark, d), accounts(spark, d), "MACHINERY")


@query(f"""WITH {UNITS}, x AS (SELECT channel_id, round(avg(CASE WHEN is_new_topic THEN 1.0::DOUBLE ELSE 0 END), 6) AS new_rate, count(*) AS n
  FROM u, (SELECT max(unit_date) AS last FROM u) WHERE last - unit_date < 7 GROUP BY channel_id)
SELECT channel_id, new_rate, n, new_rate > 0.15 AS is_emerging FROM x""")
def emerging_rate(spark, d):
    return trends.emerging(units(spark, d))


@query(f"""WITH {UNITS}, {DAYS}, r AS (SELECT *, max(n) OVER w AS top, count(*) OVER w AS seen FROM s
  WINDOW w AS (PARTITION BY topic_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT topic_id, max(day) AS last_quiet FROM r WHERE seen = 3 AND top <= 40 GROUP BY topic_id""")
def deprecated_topics(spark, d):
    return trends.fading(trends.daily_series(units(spark, d)), most=40)


@query(f"""WITH {UNITS} SELECT unit_date AS day, count(*) AS n_units, count(DISTINCT topic_id) AS n_topics, CAST(round(CAST(avg(polarity) AS DECIMAL(28, 12)), 6) AS DOUBLE) AS mean_polarity FROM u GROUP BY unit_date""")
def metrics_snapshots(spark, d):
    return trends.snapshots(units(spark, d))


@query(f"""WITH {UNITS} SELECT CAST(date_trunc('week', unit_date) AS DATE) AS week, count(*) AS n_units, count(DISTINCT topic_id) AS n_topics,
  CAST(round(CAST(avg(polarity) AS DECIMAL(28, 12)), 6) AS DOUBLE) AS mean_polarity FROM u GROUP BY 1""")
def metrics_snapshots_weekly(spark, d):
    return trends.snapshots(units(spark, d), "week")


@query(f"WITH {UNITS} SELECT {UNIT_COLUMNS} FROM u WHERE unit_date > (SELECT max(unit_date) FROM u) - 30")
def explorer_default_window(spark, d):
    return explorer.default_window(units(spark, d)).select(*UNIT_COLUMNS.split(", "))


@query(f"WITH {UNITS} SELECT {UNIT_COLUMNS} FROM u WHERE unit_date > (SELECT max(unit_date) FROM u) - 7")
def explorer_window_7d(spark, d):
    """The default window of a week; the tables hold thirty days, so that the usual one keeps all rows."""
    return explorer.default_window(units(spark, d), 7).select(*UNIT_COLUMNS.split(", "))


@query(f"""
WITH {UNITS}, f AS (SELECT account_id, min(unit_date) AS day FROM u GROUP BY account_id),
d AS (SELECT day, count(*) AS n_new FROM u JOIN f ON f.account_id = u.account_id AND f.day = u.unit_date GROUP BY day)
SELECT day, n_new, n_new > (SELECT avg(n_new) + 2.5::DOUBLE * stddev_pop(n_new) FROM d) AS spike FROM d""")
def new_account_spikes(spark, d):
    return review.new_account_spikes(units(spark, d))


@query(f"""
WITH p AS (SELECT lang AS gold, guessed AS predicted FROM ({ORACLES['language_detection']}) WHERE lang IS NOT NULL),
c AS (SELECT gold, predicted, count(*) AS n FROM p GROUP BY gold, predicted),
g AS (SELECT gold AS label, sum(n)::DOUBLE AS told FROM c GROUP BY gold), s AS (SELECT predicted AS label, sum(n)::DOUBLE AS said FROM c GROUP BY predicted),
e AS (SELECT coalesce(told, 0) AS told, coalesce(said, 0) AS said, coalesce(c.n, 0)::DOUBLE AS hit FROM g FULL JOIN s ON s.label = g.label LEFT JOIN c ON c.gold = g.label AND c.predicted = g.label),
t AS (SELECT sum(told) AS n, sum(hit) / sum(told) AS po, avg(2 * hit / (told + said)) AS f1, sum(told * said) / (sum(told) * sum(told)) AS pe FROM e)
SELECT n::BIGINT AS n, round(po, 6) AS accuracy, round(f1, 6) AS macro_f1, round((po - pe) / (1 - pe), 6) AS kappa FROM t""")
def language_agreement(spark, d):
    """Labels of more than two kinds: the languages that rules guess against those that the table tells."""
    found = language_detection(spark, d).where(F.col("lang").isNotNull())
    return review.label_agreement(found.select(F.col("lang").alias("gold"), F.col("guessed").alias("predicted")))


# Fixed values, as the SQL side has them for itself: 59 letters and three places make 205,379 trigrams.
_TRAINED = """
WITH d AS (SELECT doc_id, lang, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 1) IN ('0', '1', '2') AS held_out,
  string_split(regexp_replace(lower(' ' || coalesce(text, '') || ' '), '[^a-zà-ÿ]+', '_', 'g'), '') AS s FROM documents),
g AS (SELECT doc_id, lang, held_out, gram, count(*) AS n FROM (
  SELECT doc_id, lang, held_out, unnest(list_transform(list_zip(s, s[2:], s[3:]), lambda x: x[1] || x[2] || x[3])) AS gram FROM d) WHERE gram IS NOT NULL GROUP BY ALL),
k AS (SELECT lang, gram, sum(n) AS n FROM g WHERE NOT held_out AND lang IN ('en', 'fr', 'de', 'es') GROUP BY lang, gram),
t AS (SELECT x.lang, coalesce(sum(n), 0) AS total FROM (VALUES ('en'), ('fr'), ('de'), ('es')) x(lang) LEFT JOIN k ON k.lang = x.lang GROUP BY x.lang),
b AS (SELECT lang, CAST(floor(1000 * ln(CAST(1 AS DOUBLE) / CAST(total + 205379 AS DOUBLE))) AS BIGINT) AS w FROM t),
m AS (SELECT k.lang, gram, CAST(floor(1000 * ln(CAST(n + 1 AS DOUBLE) / CAST(total + 205379 AS DOUBLE))) AS BIGINT) - b.w AS w FROM k JOIN t ON t.lang = k.lang JOIN b ON b.lang = k.lang),
z AS (SELECT doc_id, sum(n) AS n FROM g GROUP BY doc_id),
e AS (SELECT z.doc_id, b.lang, z.n * b.w + coalesce(x.w, 0) AS score FROM z CROSS JOIN b
  LEFT JOIN (SELECT doc_id, m.lang, sum(n * w) AS w FROM g JOIN m ON m.gram = g.gram GROUP BY doc_id, m.lang) x ON x.doc_id = z.doc_id AND x.lang = b.lang),
r AS (SELECT doc_id, list(lang ORDER BY score DESC, lang) AS l, list(score ORDER BY score DESC, lang) AS s FROM e GROUP BY doc_id)"""


@query(f"""{_TRAINED} SELECT d.doc_id, d.lang, held_out, coalesce(l[1], 'unknown') AS guessed, CAST(coalesce(r.s[1] - r.s[2], 0) AS BIGINT) AS margin FROM d LEFT JOIN r ON r.doc_id = d.doc_id""")
def trained_language(spark, d):
    """Every document's language by a model that learned from those that are not held out."""
    docs = table(spark, d, "documents").withColumn("held_out", language.held_out(F.col("doc_id")))
    found = language.detect(docs, language.train(docs.where(~F.col("held_out"))))
    return found.select("doc_id", "lang", "held_out", "guessed", "margin")


@query(f"""{_TRAINED}, p AS (SELECT d.lang AS gold, coalesce(l[1], 'unknown') AS predicted FROM d LEFT JOIN r ON r.doc_id = d.doc_id WHERE held_out AND d.lang IS NOT NULL),
x AS (SELECT label, count(*) FILTER (gold = label) AS told, count(*) FILTER (predicted = label) AS said, count(*) FILTER (gold = label AND predicted = label) AS hit
  FROM p, (SELECT gold AS label FROM p UNION SELECT predicted FROM p) GROUP BY label)
SELECT label, told, said, hit, round(hit / said, 6) AS precision, round(hit / told, 6) AS recall, round(2 * hit / (told + said), 6) AS f1 FROM x""")
def trained_language_quality(spark, d):
    """The model against the table's languages on what it did not learn from, by language."""
    found = trained_language(spark, d).where(F.col("held_out") & F.col("lang").isNotNull())
    return review.label_quality(found.select(F.col("lang").alias("gold"), F.col("guessed").alias("predicted")))


def _document_index(spark: SparkSession, d: str) -> search_index.SearchIndex:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("label"))
    return search_index.SearchIndex(spark, f"{shared_dir(spark)}/search-{uuid.uuid4().hex}").add(rows)


@query(ORACLES["global_search"])
def global_search_indexed(spark, d):
    """What global_search gives, with the documents found by their index."""
    return explorer.search(
        "On",
        labels(spark, d).select(F.col("topic_id").alias("id"), "label"),
        accounts(spark, d).select(F.col("account_id").alias("id"), F.col("name").alias("label")),
        _document_index(spark, d).first("On").select("id", "label"),
    )


_NEEDLES = ("on", "token =", "the of", "é", "licens", "Tion", "no such text")


@query("""
SELECT needle, doc_id, CAST((length(t) - length(replace(t, needle, ''))) // length(needle) AS BIGINT) AS hits FROM (SELECT doc_id, lower(text) AS t FROM documents),
  (VALUES ('on'), ('token ='), ('the of'), ('licens'), ('tion'), ('no such text')) v(needle) WHERE contains(t, needle)""")
def search_hits(spark, d):
    """All documents that hold each of some needles, and how often, by the index; a needle of one character finds nothing."""
    index, out = _document_index(spark, d), None
    for needle in _NEEDLES:
        found = index.find(needle).select(F.lit(needle.lower()).alias("needle"), F.col("id").alias("doc_id"), "hits")
        out = found if out is None else out.unionByName(found)
    return out


# Similarity and topics


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return adapters.unit_vectors(table(spark, d, "embeddings"))


@query("""SELECT vec_id AS unit_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings""")
def l2_norm(spark, d):
    return vectors(spark, d).select("unit_id", F.round(similarity.norm(F.col("embedding")), 6).alias("norm"))


@query(f"""WITH {VECTORS}, s AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, list_dot_product(a.e, b.e) AS sim FROM w a JOIN w b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbour) AS rank FROM s)
SELECT query, neighbour, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def knn_top5(spark, d):
    v = vectors(spark, d)
    return similarity.nearest(v.where("seq % 100 = 0"), v).withColumn("sim", F.round("sim", 6))


def _leader_sql(threshold: float, last: str) -> str:
    """Scans the vectors in order of vec_id and keeps a list of the leaders so far."""
    return f"""WITH RECURSIVE {VECTORS},
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.e, b.e) AS sim FROM w a JOIN w b ON a.vec_id < b.vec_id WHERE list_dot_product(a.e, b.e) >= {threshold}::DOUBLE),
o AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i, (SELECT list(e.a) FROM e WHERE e.b = vec_id) AS near FROM v),
r(i, c) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT r.i + 1, CASE WHEN len(list_intersect(c, coalesce(near, []))) > 0 THEN c ELSE list_append(c, vec_id) END FROM r JOIN o ON o.i = r.i + 1),
c AS MATERIALIZED (SELECT unnest(c) AS seq FROM r WHERE i = (SELECT max(i) FROM r)),
n AS (SELECT b AS seq, arg_max(a, (sim, -a)) AS near, max(sim) AS sim FROM e JOIN c ON c.seq = e.a GROUP BY b),
x AS (SELECT v.vec_id AS seq, c.seq IS NULL AS is_duplicate, CASE WHEN c.seq IS NULL THEN n.near ELSE v.vec_id END AS canonical_seq,
  CASE WHEN c.seq IS NULL THEN round(n.sim, 6) END AS similarity FROM v LEFT JOIN c ON c.seq = v.vec_id LEFT JOIN n ON n.seq = v.vec_id)
{last}"""


#: The highest cosine of each canonical vector to the canonical ones before it.
_BEFORE = """, h AS (SELECT c.seq, max(list_dot_product(p.e, q.e)) AS best FROM c JOIN w q ON q.vec_id = c.seq JOIN c d ON d.seq < c.seq JOIN w p ON p.vec_id = d.seq GROUP BY c.seq)
SELECT x.seq, is_duplicate, canonical_seq, CASE WHEN is_duplicate THEN similarity ELSE round(coalesce(h.best, CAST(0 AS DOUBLE)), 6) END AS similarity FROM x LEFT JOIN h ON h.seq = x.seq"""


def _leaders(spark: SparkSession, d: str, threshold: float) -> DataFrame:
    return similarity.dedup(vectors(spark, d), threshold)


@query(_leader_sql(DEDUP_AT, _BEFORE))
def dedup_leader(spark, d):
    return _leaders(spark, d, DEDUP_AT).drop("was_indexed").withColumn("similarity", F.round("similarity", 6))


@query(_leader_sql(DEDUP_AT, "SELECT canonical_seq AS canonical_id, count(*) AS cluster_size FROM x GROUP BY canonical_seq"))
def dedup_counts(spark, d):
    return dashboard.duplicate_clusters(_leaders(spark, d, DEDUP_AT).withColumnRenamed("canonical_seq", "canonical_id"))


def _topics(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    named = v.select("seq", "embedding", F.concat(F.lit("topic "), F.col("topic_id")).alias("label"), ((F.col("seq") % 10) / 10.0).alias("confidence"))
    return topics.assign_topics(named, TOPIC_AT)


@query(_leader_sql(TOPIC_AT, """SELECT x.seq, x.canonical_seq AS topic_seq, 'topic ' || t.label AS topic_label, NOT is_duplicate AS is_new_topic,
  round(CASE WHEN is_duplicate THEN similarity ELSE CAST(x.seq % 10 AS DOUBLE) / 10 END, 6) AS topic_confidence,
  CASE WHEN NOT is_duplicate AND CAST(x.seq % 10 AS DOUBLE) / 10 >= 0.7::DOUBLE THEN 'topic ' || o.label END AS suggested_label,
  NOT is_duplicate AND CAST(x.seq % 10 AS DOUBLE) / 10 < 0.7::DOUBLE AS needs_review,
  CASE WHEN is_duplicate AND o.label <> t.label THEN 'topic ' || o.label END AS alias
FROM x JOIN v t ON t.vec_id = x.canonical_seq JOIN v o ON o.vec_id = x.seq"""))
def topic_leader(spark, d):
    return _topics(spark, d).withColumn("topic_confidence", F.round("topic_confidence", 6))


@query(_leader_sql(TOPIC_AT, """SELECT x.canonical_seq AS topic_seq, count(*) AS feedback_count,
  CAST(count(DISTINCT CASE WHEN is_duplicate AND o.label <> t.label THEN o.label END) AS BIGINT) AS n_aliases
FROM x JOIN v t ON t.vec_id = x.canonical_seq JOIN v o ON o.vec_id = x.seq GROUP BY x.canonical_seq"""))
def topic_alias(spark, d):
    return topics.topic_table(_topics(spark, d)).select("topic_seq", "feedback_count", F.size("aliases").cast("long").alias("n_aliases"))


@query("""WITH c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i)
SELECT CAST(label AS BIGINT) AS topic_id, round(sqrt(sum(m * m)), 6) AS norm FROM c GROUP BY label""")
def centroid_norms(spark, d):
    return similarity.centroids(vectors(spark, d)).select("topic_id", F.round(similarity.norm(F.col("centroid")), 6).alias("norm"))


@query(f"""WITH {VECTORS}, c AS (SELECT label, list(m ORDER BY i) AS c FROM (
  SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(e) AS x, unnest(range(len(e))) AS i FROM v) GROUP BY label, i) GROUP BY label),
f AS (SELECT label, arg_min(e, vec_id) AS e FROM v GROUP BY label),
s AS (SELECT CAST(c.label AS BIGINT) AS topic_id, round(list_dot_product(f.e, c) / sqrt(list_dot_product(f.e, f.e) * list_dot_product(c, c)), 6) AS sim FROM c JOIN f ON f.label = c.label)
SELECT topic_id, sim, sim < 0.8 AS drifted FROM s""")
def topic_drift(spark, d):
    v = vectors(spark, d)
    founder = v.groupBy("topic_id").agg(F.min_by("embedding", "seq").alias("node"))
    return topics.drift(founder, v)


@query(f"""WITH RECURSIVE {VECTORS},
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM w a JOIN w b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) >= {DEDUP_AT}::DOUBLE),
r(seq, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.seq)
SELECT seq, min(c) AS cluster FROM r GROUP BY seq""")
def single_link_clusters(spark, d):
    v = vectors(spark, d)
    return similarity.linked(v, DEDUP_AT)


@query()
def bootstrap_clusters(spark, d):
    """The first taxonomy's clusters: average linkage, cut where 30 to 80 are left."""
    v = vectors(spark, d).select("seq", "embedding")
    return agglomerative.flat(v, agglomerative.dendrogram(v))


# Taxonomy


@query(f"WITH RECURSIVE {TREE} SELECT node_id, root, depth, path, CAST(len(ancestors) AS INTEGER) AS n_ancestors FROM p")
def tree_paths(spark, d):
    return taxonomy.paths(tree(spark, d)).select("node_id", "root", "depth", "path", F.size("ancestors").alias("n_ancestors"))


INTERVALS = """
o AS (SELECT node_id, ancestors, row_number() OVER (ORDER BY ancestors) AS lo FROM p),
e AS (SELECT node_id, unnest(ancestors) AS ancestor FROM p),
t AS (SELECT ancestor, round(sum(weight), 2) AS total, count(*) AS n_nodes FROM e JOIN n ON n.node_id = e.node_id GROUP BY ancestor)
SELECT o.node_id, n.parent_id, o.lo, o.lo + t.n_nodes - 1 AS hi, t.total FROM o JOIN t ON t.ancestor = o.node_id JOIN n ON n.node_id = o.node_id"""


@query(f"WITH RECURSIVE {TREE}, {INTERVALS}")
def tree_intervals(spark, d):
    """Where each node's subtree begins and ends in a walk of the tree, by pointer jumping."""
    return taxonomy.intervals(tree(spark, d))


@query(f"""WITH RECURSIVE {TREE.replace("'R' || n_regionkey,", "CASE WHEN n_nationkey = 7 THEN 'R3' ELSE 'R' || n_regionkey END,")}, {INTERVALS}""")
def tree_intervals_moved(spark, d):
    """The same after N7 has moved below R3, by renumbering what lies between; the SQL walks the new tree."""
    return taxonomy.move_interval(taxonomy.intervals(tree(spark, d)), "N7", "R3")


@query(f"""WITH RECURSIVE {TREE}, e AS (SELECT node_id, unnest(ancestors) AS ancestor FROM p)
SELECT ancestor AS node_id, round(sum(weight), 2) AS total, count(*) AS n_nodes FROM e JOIN n ON n.node_id = e.node_id GROUP BY ancestor""")
def subtree_rollup(spark, d):
    nodes = tree(spark, d)
    return taxonomy.subtree_totals(nodes, taxonomy.paths(nodes))


@query(f"""WITH RECURSIVE {TREE}, k AS (SELECT DISTINCT unnest(ancestors) AS node_id FROM p JOIN n ON n.node_id = p.node_id WHERE contains(lower(label), '1'))
SELECT n.node_id, parent_id, label, weight FROM n SEMI JOIN k ON k.node_id = n.node_id""")
def search_with_ancestors(spark, d):
    nodes = tree(spark, d)
    return taxonomy.search(nodes, taxonomy.paths(nodes), "1")


@query(f"""WITH RECURSIVE {TREE} SELECT node_id, CASE WHEN parent_id = 'N1' THEN 'N2' ELSE parent_id END AS parent_id, label,
  CASE WHEN node_id = 'N2' THEN round(weight + (SELECT sum(weight) FROM n WHERE node_id = 'N1'), 2) ELSE weight END AS weight FROM n WHERE node_id <> 'N1'""")
def merge_nodes(spark, d):
    return taxonomy.merge(tree(spark, d), "N1", "N2")


@query(f"""WITH RECURSIVE {TREE} SELECT node_id, CASE WHEN node_id = 'N1' THEN 'R2' ELSE parent_id END AS parent_id,
  CASE WHEN node_id = 'R0' THEN 'Renamed' ELSE label END AS label, weight FROM n""")
def rename_and_move(spark, d):
    return taxonomy.move(taxonomy.rename(tree(spark, d), "R0", "Renamed"), "N1", "R2")


@query(f"WITH RECURSIVE {TREE} SELECT node_id, parent_id, label, weight FROM n WHERE parent_id = 'R1'")
def tree_children(spark, d):
    return taxonomy.children(tree(spark, d), "R1")


@query(f"""WITH {UNITS} SELECT unit_id, CASE WHEN topic_id = 3 THEN 4 ELSE topic_id END AS topic_id FROM u""")
def repointed_units(spark, d):
    merges = table(spark, d, "nation").where("n_nationkey = 3").select(F.col("n_nationkey").cast("long").alias("topic_id"), F.lit(4).cast("long").alias("merge_target"))
    return taxonomy.repoint(units(spark, d), merges).select("unit_id", "topic_id")


@query(f"""WITH {UNITS} SELECT unit_id, topic_id, CASE WHEN unit_date < DATE '2024-01-15' THEN 1 ELSE 2 END AS version FROM u""")
def version_asof(spark, d):
    rows = [(1, datetime.date(1970, 1, 1), datetime.date(2024, 1, 15)), (2, datetime.date(2024, 1, 15), datetime.date(9999, 1, 1))]
    versions = labels(spark, d).select("topic_id").crossJoin(F.broadcast(spark.createDataFrame(rows, "version int, valid_from date, valid_to date")))  # two versions of each topic
    return taxonomy.as_of(units(spark, d), versions).select("unit_id", "topic_id", "version")


@query(f"WITH {UNITS} SELECT unit_id, CASE WHEN unit_id % 7 = 0 THEN 11 ELSE topic_id END AS topic_id FROM u")
def reclassified_units(spark, d):
    u = units(spark, d)
    overrides = u.where("unit_id % 7 = 0").select("unit_id", F.lit(11).cast("long").alias("new_topic"), F.col("ts").alias("at"))
    return taxonomy.reclassify(u, overrides).select("unit_id", "topic_id")


@query(f"WITH {UNITS} SELECT topic_id, count(*) AS support FROM u WHERE is_new_topic GROUP BY topic_id HAVING count(*) >= 5")
def promoted_candidates(spark, d):
    return taxonomy.promote(units(spark, d))


# Decomposition by loess, alert rules


@query()
def stl_decomposition(spark, d):
    parts = loess.outliers(loess.decompose(trends.daily_series(units(spark, d))))
    return parts.select("topic_id", "day", "n", *(F.round(c, 6).alias(c) for c in ("trend", "season", "remainder", "weight", "expected", "z")), "is_anomaly")


RULES = alerts.rules_from(
    [
        {"rule_id": "topic volume", "entity": "topic", "measure": "volume", "times": 1.3, "days": 7, "cooldown": 2, "severity": "red"},
        {"rule_id": "account mood", "entity": "account", "measure": "polarity", "below": -0.8, "cooldown": 3, "quiet": 10},
        {"rule_id": "segment churn", "entity": "segment", "measure": "churn", "above": 30.0, "severity": "red"},
        {"rule_id": "topic confidence", "entity": "topic", "measure": "confidence", "below": 0.7, "least": 5, "cooldown": 4},
    ]
)
_FIRINGS = f"""WITH {UNITS}, j AS (SELECT u.*, segment FROM u LEFT JOIN a ON a.account_id = u.account_id),
g AS (SELECT 'topic' AS kind, CAST(topic_id AS VARCHAR) AS entity, * FROM j UNION ALL SELECT 'account', CAST(account_id AS VARCHAR), * FROM j
  UNION ALL SELECT 'segment', segment, * FROM j WHERE segment IS NOT NULL),
d AS (SELECT kind, entity, unit_date AS day, count(*) AS units, CAST(count(*) AS DOUBLE) AS volume, avg(polarity) AS polarity, avg(confidence) AS confidence,
  CAST(count(*) FILTER (intent_type = 'churn_signal') AS DOUBLE) AS churn FROM g GROUP BY kind, entity, unit_date),
b AS (SELECT *, CAST(1.3 AS DOUBLE) * coalesce(sum(volume) OVER (PARTITION BY kind, entity ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) / 7 AS usual FROM d),
f AS (SELECT 'topic volume' AS rule_id, 'red' AS severity, kind, entity, day, volume AS value, usual AS bound FROM b WHERE kind = 'topic' AND volume > usual AND usual > 0
  UNION ALL SELECT 'account mood', 'yellow', kind, entity, day, polarity, CAST(-0.8 AS DOUBLE) FROM b WHERE kind = 'account' AND polarity < CAST(-0.8 AS DOUBLE)
  UNION ALL SELECT 'segment churn', 'red', kind, entity, day, churn, CAST(30 AS DOUBLE) FROM b WHERE kind = 'segment' AND churn > 30
  UNION ALL SELECT 'topic confidence', 'yellow', kind, entity, day, confidence, CAST(0.7 AS DOUBLE) FROM b WHERE kind = 'topic' AND units >= 5 AND confidence < CAST(0.7 AS DOUBLE))"""


@query(f"{_FIRINGS} SELECT rule_id, severity, kind, entity, day, round(value, 6) AS value, round(bound, 6) AS bound FROM f")
def alert_firings(spark, d):
    return alerts.firings(alerts.daily(units(spark, d), accounts(spark, d)), RULES)


@query(f"""{_FIRINGS},
k AS (SELECT 'topic volume' AS rule_id, CAST(topic_id AS VARCHAR) AS entity, unit_date AS day, max(CAST(duplicate_count = 0 AS INT)) AS resolves, max(CAST(duplicate_count > 0 AS INT)) AS acks
  FROM u WHERE is_starred AND confidence >= CAST(0.9 AS DOUBLE) GROUP BY topic_id, unit_date),
r AS (SELECT * FROM (VALUES ('topic volume', 2, 14), ('account mood', 3, 10), ('segment churn', 1, 14), ('topic confidence', 4, 14)) r(rule_id, cooldown, quiet)),
e AS (SELECT rule_id, entity, day, 0 AS late, round(value, 6) AS value, severity, kind, 0 AS resolves, 0 AS acks FROM f
  UNION ALL SELECT rule_id, entity, day, 1, NULL, NULL, NULL, resolves, acks FROM k),
s AS (SELECT e.*, cooldown, quiet, max(CASE WHEN late = 0 THEN day END) OVER w AS previous, max(CASE WHEN resolves = 1 THEN day END) OVER w AS settled FROM e JOIN r ON r.rule_id = e.rule_id
  WINDOW w AS (PARTITION BY e.rule_id, entity ORDER BY day, late ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT *, sum(CASE WHEN late = 0 AND (previous IS NULL OR day - previous > cooldown OR coalesce(settled >= previous, false)) THEN 1 ELSE 0 END)
  OVER (PARTITION BY rule_id, entity ORDER BY day, late ROWS UNBOUNDED PRECEDING) AS alert FROM s),
t AS (SELECT rule_id, entity, alert, max(severity) AS severity, max(kind) AS kind, min(day) AS opened, max(CASE WHEN late = 0 THEN day END) AS last_fired, count(*) FILTER (late = 0) AS n_firings,
  max(abs(value)) AS peak, max(resolves) AS resolves, max(acks) AS acks, max(quiet) AS quiet FROM n WHERE alert > 0 GROUP BY rule_id, entity, alert)
SELECT rule_id, entity, severity, kind, opened, last_fired, n_firings, peak,
  CASE WHEN resolves = 1 OR (SELECT max(day) FROM f) - last_fired >= quiet THEN 'resolved' WHEN acks = 1 THEN 'acknowledged' ELSE 'open' END AS state FROM t""")
def alert_states(spark, d):
    """Alerts of all rules; starred units of much confidence stand in for what reviewers did about their topic's volume."""
    u = units(spark, d)
    fired = alerts.firings(alerts.daily(u, accounts(spark, d)), RULES)
    done = u.where("is_starred AND confidence >= 0.9D").select(
        F.lit("topic volume").alias("rule_id"), F.col("topic_id").cast("string").alias("entity"), F.col("unit_date").alias("day"), F.when(F.col("duplicate_count") == 0, "resolve").otherwise("acknowledge").alias("action")
    )
    return alerts.alerts(fired, RULES, done)


# Review, evaluation, lifecycle


@query(f"""WITH {UNITS} SELECT unit_id, 'low confidence' AS reason, confidence FROM u WHERE confidence < 0.7::DOUBLE
UNION ALL SELECT unit_id, 'new theme', confidence FROM u WHERE is_new_topic""")
def review_queue(spark, d):
    return review.queue(units(spark, d))


@query(f"WITH {UNITS} SELECT unit_id, round((1 - confidence) * (duplicate_count + 1), 6) AS priority FROM u")
def review_priority(spark, d):
    return review.priority(units(spark, d))


_GOLD = "p AS (SELECT l.quality AS gold, CASE WHEN length(d.text) >= 200 THEN 1 ELSE 0 END AS predicted FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """Reviewers' quality labels against a rule on the text's length."""
    docs = table(spark, d, "documents").select("doc_id", (F.length("text") >= 200).cast("int").alias("predicted"))
    return table(spark, d, "labels").join(docs, "doc_id").select(F.col("quality").alias("gold"), "predicted")


@query(f"WITH {_GOLD} SELECT gold, predicted, count(*) AS n FROM p GROUP BY gold, predicted")
def eval_confusion(spark, d):
    return review.confusion(_gold(spark, d))


@query(f"""WITH {_GOLD}, c AS (SELECT count(*) FILTER (gold = 1 AND predicted = 1)::DOUBLE AS tp, count(*) FILTER (gold = 0 AND predicted = 1)::DOUBLE AS fp,
  count(*) FILTER (gold = 1 AND predicted = 0)::DOUBLE AS fn, count(*) FILTER (gold = 0 AND predicted = 0)::DOUBLE AS tn, count(*)::DOUBLE AS n FROM p),
k AS (SELECT *, (tp + tn) / n AS po, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS pe FROM c)
SELECT round(po, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
  round((po - pe) / (1 - pe), 6) AS kappa, round((fp + fn) / n, 6) AS mae FROM k""")
def eval_agreement(spark, d):
    return review.agreement(_gold(spark, d))


_LIFE = """SELECT user_id, min(ts) FILTER (event_type = 'view') AS intake, min(ts) FILTER (event_type = 'click') AS analyzed, min(ts) FILTER (event_type = 'signup') AS triaged,
  min(ts) FILTER (event_type = 'error') AS assigned, min(ts) FILTER (event_type = 'purchase') AS resolved FROM events GROUP BY user_id"""


def _life(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"view": "intake", "click": "analyzed", "signup": "triaged", "error": "assigned", "purchase": "resolved"}
    stage = F.lit(None).cast("string")
    for kind, name in kinds.items():
        stage = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(stage)
    return review.lifecycle(table(spark, d, "events"), "user_id", stage, "ts")


@query(f"WITH f AS ({_LIFE}) " + " UNION ALL ".join(f"SELECT '{s}' AS stage, count({s}) AS reached FROM f" for s in review.STAGES))
def funnel(spark, d):
    return review.funnel(_life(spark, d))


@query(f"WITH f AS ({_LIFE}) SELECT round(quantile_cont(date_sub('second', intake, resolved) / 3600.0::DOUBLE, 0.5), 6) AS median_hours, count(*) AS n FROM f WHERE resolved >= intake")
def median_sla(spark, d):
    return review.median_hours(_life(spark, d), "intake", "resolved")


@query(f"""WITH {UNITS}, m AS (SELECT unit_id % 500 AS unit_id, CASE WHEN unit_id % 2 = 0 THEN 'resolved' ELSE 'open' END AS status, unit_id AS "at" FROM u)
SELECT unit_id, arg_max(status, "at") AS status, max("at") AS "at" FROM m GROUP BY unit_id""")
def resolved_marks(spark, d):
    marks = units(spark, d).select((F.col("unit_id") % 500).alias("unit_id"), F.when(F.col("unit_id") % 2 == 0, "resolved").otherwise("open").alias("status"), F.col("unit_id").alias("at"))
    return review.resolutions(marks)


# Conversation signals


# Fixed values, as the SQL side has them for itself: the words of each track.
@query("""
WITH w AS (SELECT conv_id, turn, string_split_regex(lower(text), '[^a-z]+') AS w FROM conversations WHERE role = 'user'),
v AS (FROM (VALUES ('action_item', ['will', 'todo', 'task', 'follow']), ('churn_risk', ['cancel', 'leave', 'urgent', 'deadline']),
  ('competitive_mention', ['competitor', 'alternative', 'instead']), ('expansion', ['more', 'upgrade', 'seats', 'expand']),
  ('organisational', ['team', 'hired', 'manager', 'reorg']), ('stakeholder', ['director', 'ceo', 'owner', 'boss']),
  ('compliance', ['privacy', 'legal', 'audit', 'compliance'])) t(kind, said)),
x AS (SELECT conv_id, turn, kind, len(list_filter(w, lambda x: list_contains(said, x)))::BIGINT AS words FROM w, v)
SELECT conv_id, turn, kind, words FROM x WHERE words > 0""")
def conversation_signals(spark, d):
    return signals.tracks(table(spark, d, "conversations"))


@query(f"""WITH {UNITS} SELECT topic_id, channel_id, intent_type, count(*) AS weight, min(ts) AS first_seen, max(ts) AS last_seen FROM u GROUP BY topic_id, channel_id, intent_type""")
def knowledge_edges(spark, d):
    u = units(spark, d)
    older, newer = u.where(F.col("unit_date") < datetime.date(2024, 1, 15)), u.where(F.col("unit_date") >= datetime.date(2024, 1, 15))
    return signals.merge_knowledge(signals.knowledge(older), signals.knowledge(newer))


# Labels of near spelling

#: The longest word of each document as its label; letters of two bytes as one, since the SQL side counts edits of bytes.
_WORDS = """
WITH RECURSIVE l AS MATERIALIZED (SELECT label, count(*) AS weight, translate(label, 'àáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ012345') AS x FROM (
  SELECT list_reverse_sort(list_transform(string_split_regex(lower(coalesce(text, '')), '[^a-zà-ÿ]+'), lambda w: {'n': length(w), 'w': w}))[1].w AS label FROM documents) WHERE label <> '' GROUP BY label),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY weight DESC, label) AS i FROM l),
e AS MATERIALIZED (SELECT p.i AS a, q.i AS b, levenshtein(p.x, q.x) AS edits FROM o p JOIN o q ON p.i < q.i AND abs(length(p.x) - length(q.x)) <= 2 WHERE levenshtein(p.x, q.x) <= 2)"""


def _words(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select(spelling.longest_word(F.col("text")).alias("label"))
    return found.groupBy("label").agg(F.count("*").alias("weight")).where("label <> ''")


@query(f"{_WORDS} SELECT least(p.label, q.label) AS a, greatest(p.label, q.label) AS b, CAST(edits AS INTEGER) AS edits FROM e JOIN o p ON p.i = e.a JOIN o q ON q.i = e.b")
def near_labels(spark, d):
    return spelling.near_labels(_words(spark, d), 2)


@query(f"""{_WORDS}, n AS MATERIALIZED (SELECT o.i, o.label, (SELECT list(e.a) FROM e WHERE e.b = o.i) AS near FROM o),
r(i, c) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT r.i + 1, CASE WHEN len(list_intersect(c, coalesce(near, []))) > 0 THEN c ELSE list_append(c, n.i) END FROM r JOIN n ON n.i = r.i + 1),
c AS MATERIALIZED (SELECT unnest(c) AS i FROM r WHERE i = (SELECT max(i) FROM r)),
f AS (SELECT b, arg_min(a, (edits, a)) AS a FROM e JOIN c ON c.i = e.a GROUP BY b)
SELECT o.label, o.weight, CASE WHEN c.i IS NULL THEN k.label ELSE o.label END AS canonical FROM o LEFT JOIN c ON c.i = o.i LEFT JOIN f ON f.b = o.i LEFT JOIN o k ON k.i = f.a""")
def unified_labels(spark, d):
    return spelling.unified(_words(spark, d), 2)


# Stored tables


@query(f"""WITH {UNITS} SELECT topic_id, count(*) AS delta FROM u WHERE duplicate_count < 3 GROUP BY topic_id""")
def topic_delta_counts(spark, d):
    analysed = units(spark, d).withColumn("is_duplicate", F.col("duplicate_count") >= 3)
    return store.topic_deltas(analysed)


_OLD = "o AS (SELECT topic_id, 'old ' || topic_id AS label, count(*) AS n FROM u WHERE unit_date < DATE '2024-01-15' AND topic_id < 8 GROUP BY topic_id)"
_NEW = "w AS (SELECT topic_id, 'new ' || topic_id AS label, count(*) AS n FROM u WHERE unit_date >= DATE '2024-01-15' AND topic_id >= 4 GROUP BY topic_id)"


@query(f"""WITH {UNITS}, {_OLD}, {_NEW} SELECT CAST(coalesce(o.topic_id, w.topic_id) AS VARCHAR) AS topic_id, coalesce(w.label, o.label) AS label,
  coalesce(o.n, 0) + coalesce(w.n, 0) AS feedback_count, CASE WHEN o.topic_id IS NULL THEN 'praise' ELSE 'question' END AS intent_type,
  CAST((o.topic_id IS NOT NULL)::INT + (w.topic_id IS NOT NULL)::INT AS BIGINT) AS n_aliases FROM o FULL JOIN w ON w.topic_id = o.topic_id""")
def topic_upsert(spark, d):
    u = units(spark, d)
    cut = datetime.date(2024, 1, 15)
    count = lambda x: x.groupBy("topic_id").agg(F.count("*").alias("n"), F.max("ts").cast("timestamp").alias("at"))
    old = count(u.where((F.col("unit_date") < cut) & (F.col("topic_id") < 8))).select(
        F.col("topic_id").cast("string").alias("topic_id"), F.concat(F.lit("old "), "topic_id").alias("label"), F.lit("").alias("description"), F.array(F.lit("a")).alias("aliases"),
        F.col("n").alias("feedback_count"), F.lit("question").alias("intent_type"), F.lit("low").alias("intent_urgency"), F.col("at").alias("created_at"), F.col("at").alias("updated_at"),
    )
    new = count(u.where((F.col("unit_date") >= cut) & (F.col("topic_id") >= 4))).select(
        F.col("topic_id").cast("string").alias("topic_id"), F.concat(F.lit("new "), "topic_id").alias("label"), F.lit("").alias("description"), F.array(F.lit("b")).alias("aliases"),
        F.col("n").alias("delta"), F.lit("praise").alias("intent_type"), F.lit("high").alias("intent_urgency"), "at",
    )
    return store.upsert_topics(old, new).select("topic_id", "label", "feedback_count", "intent_type", F.size("aliases").cast("long").alias("n_aliases"))


@query(f"""WITH {UNITS} SELECT unit_id, 'old' AS version FROM u WHERE unit_id % 3 = 0 UNION ALL SELECT unit_id, 'new' FROM u WHERE unit_id % 2 = 0 AND unit_id % 3 <> 0""")
def unit_insert_ignore(spark, d):
    u = units(spark, d)
    old = u.where("unit_id % 3 = 0").select("unit_id", F.lit("old").alias("version"))
    new = u.where("unit_id % 2 = 0").select("unit_id", F.lit("new").alias("version"))
    return store.insert_ignore(old, new.unionByName(new), "unit_id")


@query(f"""WITH {UNITS} SELECT 'topic count' AS "check", CAST(12 AS BIGINT) AS bad UNION ALL SELECT 'topic key', 0 UNION ALL SELECT 'unit key', 0
UNION ALL SELECT 'unit to topic', 0 UNION ALL SELECT 'unit to canonical', (SELECT count(*) FROM u WHERE unit_id % 5 = 4 AND unit_id + 1 NOT IN (SELECT unit_id FROM u))
UNION ALL SELECT 'sentiment to unit', (SELECT count(*) FROM u WHERE unit_id % 9 = 0)""")
def store_integrity(spark, d):
    u = units(spark, d).select("unit_id", "topic_id", F.lit(False).alias("is_duplicate"), F.when(F.col("unit_id") % 5 == 4, F.col("unit_id") + 1).alias("canonical_id"))
    tops = u.groupBy("topic_id").agg((F.count("*") + 1).alias("feedback_count"))
    sentiments = u.select(F.when(F.col("unit_id") % 9 == 0, -1 - F.col("unit_id")).otherwise(F.col("unit_id")).alias("unit_id"))
    return store.integrity(u, tops, sentiments)


# Streams


@query("SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY start, event_type")
def stream_windows_tumbling(spark, d):
    return windows.run_to_end(windows.counted(windows.event_stream(spark, d), "7 days"), "tumbling")


@query("""SELECT s AS start, event_type, count(*) AS n FROM (
  SELECT event_type, ts, unnest([time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') - INTERVAL 1 DAY]) AS s FROM events)
GROUP BY s, event_type""")
def stream_windows_sliding(spark, d):
    return windows.run_to_end(windows.counted(windows.event_stream(spark, d), "2 days", "1 day"), "sliding")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_windows_session(spark, d):
    return windows.run_to_end(windows.sessions(windows.event_stream(spark, d), "6 hours"), "session")


@query("SELECT event_id, event_type FROM events")
def stream_dedup_watermark(spark, d):
    """The event stream delivered twice, and told apart by event_id within the watermark."""
    twice = windows.event_stream(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return windows.run_to_end(windows.once(twice).select("event_id", "event_type"), "dedup", mode="append")


@query("""SELECT event_id % 8 AS shard, count(*) // 100 AS n_batches, 100 * (count(*) // 100) AS n_messages, 100 AS largest
FROM events GROUP BY 1 HAVING count(*) >= 100""")
def stream_full_batches(spark, d):
    """The event stream gathered by eight consumers: the batches of 100 that are full when the input ends; the rest goes on waiting for its deadline."""
    payload = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    told = windows.event_stream(spark, d).withWatermark("ts", "30 days").select((F.col("event_id") % 8).alias("shard"), payload.alias("payload"), "ts")
    sent = windows.run_to_end(flush.gathered(told, 100, 10**12, "ts"), "gathered", mode="append")  # the deadline is decades away
    sizes = sent.groupBy("shard", "flush").agg(F.count("*").alias("n"))
    return sizes.groupBy("shard").agg(F.count("*").alias("n_batches"), F.sum("n").alias("n_messages"), F.max("n").cast("int").alias("largest"))
