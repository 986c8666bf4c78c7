"""Sources: the adapters that turn tables, JSON messages and channels into feedback records and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CFO


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cfo_from_documents(documents: DataFrame) -> DataFrame:
    """id, raw_text, source_channel, language."""
    return documents.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"),
        F.col("text").alias("raw_text"),
        F.col("source").alias("source_channel"),
        F.col("lang").alias("language"),
    )


def cfo_from_transcripts(conversations: DataFrame, roles: tuple[str, ...] = ("user",)) -> DataFrame:
    """One record for each turn of the given roles: the customer's side of a conversation."""
    return conversations.where(F.col("role").isin(*roles)).select(
        F.concat_ws("-", F.lit("conv"), "conv_id", "turn").alias("id"),
        F.col("text").alias("raw_text"),
        F.lit("chat").alias("source_channel"),
    )


#: Channel to the column expressions that fill a record from its raw payload.
CHANNELS: dict[str, dict[str, str]] = {
    "survey": {"raw_text": "answer", "survey_question": "question"},
    "ticket": {"raw_text": "body", "ticket_category": "category"},
    "review": {"raw_text": "review", "star_rating": "stars", "app_store": "store"},
    "social": {"raw_text": "post", "platform": "network"},
    "chat": {"raw_text": "message"},
    "email": {"raw_text": "body", "survey_question": "subject"},
}


def cfo_from_channel(raw: DataFrame, channel: str) -> DataFrame:
    """id and raw payload columns of one channel to a record; columns that a channel lacks are absent, for unionByName."""
    mapped = CHANNELS[channel]
    return raw.select(F.col("id"), F.lit(channel).alias("source_channel"), *(F.col(b).alias(a) for a, b in mapped.items()))


def cfo_from_channels(raw: dict[str, DataFrame]) -> DataFrame:
    """All channels in one table."""
    parts = [cfo_from_channel(df, channel) for channel, df in sorted(raw.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def chosen_text() -> Column:
    """clean_text, or else raw_text; an empty string counts as absent."""
    return F.coalesce(F.nullif(F.col("clean_text"), F.lit("")), F.col("raw_text"), F.lit(""))


def has_text() -> Column:
    return F.coalesce(F.nullif(F.col("raw_text"), F.lit("")), F.nullif(F.col("clean_text"), F.lit(""))).isNotNull()


def parse_messages(messages: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON messages to (records, rejects). Rejects: what isn't a JSON object of the schema, and records without any text."""
    schema = CFO + ", _corrupt_record string"
    read = messages.select(
        F.col(column).cast("string").alias("raw"),
        F.from_json(F.col(column).cast("string"), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"),
    )
    fields = read.select("raw", "r.*")
    corrupt = F.col("_corrupt_record").isNotNull() | F.col("raw").isNull()
    good = fields.where(~corrupt & has_text()).drop("raw", "_corrupt_record")
    bad = fields.where(corrupt | ~has_text()).select(
        "raw", F.when(corrupt, F.lit("not a record")).otherwise(F.lit("no text")).alias("reason")
    )
    return good, bad


#: Kind of event to intent.
INTENTS = {"error": "bug_report", "signup": "feature_request", "purchase": "praise", "view": "question"}
INTENT_TYPES = ("bug_report", "feature_request", "praise", "question", "churn_signal")


def unit_facts(events: DataFrame) -> DataFrame:
    """The serving view: a row for each analysed unit, with account, topic, intent, polarity, confidence, channel and date."""
    k = F.get_json_object("props", "$.k").cast("int")
    intent = F.lit("churn_signal")
    for event, name in INTENTS.items():
        intent = F.when(F.col("event_type") == event, F.lit(name)).otherwise(intent)
    return events.withColumn("k", k).select(
        F.col("event_id").alias("unit_id"),
        F.col("user_id").alias("account_id"),
        "ts",
        F.col("ts").cast("date").alias("unit_date"),
        intent.alias("intent_type"),
        F.pmod("k", F.lit(12)).cast("long").alias("topic_id"),
        ((F.col("k") - 50).cast("double") / F.lit(50.0)).alias("polarity"),
        ((50 + F.col("event_id") % 50).cast("double") / F.lit(100.0)).alias("confidence"),
        (F.col("event_id") % 6).cast("long").alias("channel_id"),
        (F.col("event_id") % 11 == 0).alias("is_starred"),
        (F.col("event_id") % 5).cast("long").alias("duplicate_count"),
        (F.col("k") >= 90).alias("is_new_topic"),
    )


def accounts(customer: DataFrame) -> DataFrame:
    return customer.select(F.col("c_custkey").alias("account_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))


def taxonomy(region: DataFrame, nation: DataFrame, supplier: DataFrame) -> DataFrame:
    """A three-level tree: node_id, parent_id (null for a root), label, weight."""
    top = region.select(F.concat(F.lit("R"), "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("label"), F.lit(0.0).alias("weight"))
    middle = nation.select(F.concat(F.lit("N"), "n_nationkey").alias("node_id"), F.concat(F.lit("R"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("label"), F.lit(0.0).alias("weight"))
    leaves = supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("node_id"), F.concat(F.lit("N"), "s_nationkey").alias("parent_id"), F.col("s_name").alias("label"), F.col("s_acctbal").alias("weight"))
    return top.unionByName(middle).unionByName(leaves)


def unit_vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").alias("unit_id"), F.col("vec_id").alias("seq"), "embedding", F.col("label").cast("long").alias("topic_id"))
