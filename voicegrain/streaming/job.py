"""Feedback records as a stream: parse, redact, split, tell duplicates, match topics, ask for sentiment and intent, store.

Each micro-batch is processed and stored before its offsets are committed. Unit ids come from the record, the state of earlier
batches is read from the store, and a batch id that the store has is not applied again, so redelivery changes nothing.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..config import Settings
from ..functions import rules, text
from ..operators import extract, pii, topics, unitize
from ..operators.backend import Backend, Rules, prompt
from ..operators.cells import cut
from ..operators.similarity import edges, leaders
from ..operators.store import Store, first_of
from ..sources.adapters import chosen_text, parse_messages
from . import flush

#: A batch's units are numbered from batch_id * 2^45 on, in order of record id and place.
BATCH_BITS = 45


def rule_backend() -> Rules:
    return Rules({"topic": rules.topic_answer, "sentiment": rules.sentiment_answer, "combined": rules.combined_answer})


def units_of(records: DataFrame, batch_id: int, backend: Backend) -> DataFrame:
    """unit_id, parent_cfo_id, text, char_start, char_end, unit_index, metadata, error, seq, embedding of a batch's records, each record id once.

    A backend that answers `unitize` splits the records, else sentences do.
    """
    given = first_of(records, "id").withColumn("raw_text", chosen_text()).drop("clean_text")
    clean = pii.redact(given)
    if backend.kinds is None or "unitize" in backend.kinds:
        split = unitize.model_units(clean, backend)
    else:
        split = unitize.sentences(clean).withColumn("error", F.lit(None).cast("string"))
    units = unitize.with_metadata(split, given)
    ordered = units.repartitionByRange("id", "unit_index").sortWithinPartitions("id", "unit_index")
    return cut(
        ordered.select(
            "unit_id",
            F.col("id").alias("parent_cfo_id"),
            "text",
            "char_start",
            "char_end",
            F.col("unit_index").cast("int").alias("unit_index"),
            "metadata",
            "error",
            (F.lit(batch_id << BATCH_BITS) + F.monotonically_increasing_id()).alias("seq"),
            rules.embed(F.col("text")).alias("embedding"),
        )
    )


def accounts_of(records: DataFrame, backend: Backend) -> DataFrame:
    """parent_cfo_id and the account of each record, once for each id: by its e-mail domain, and a model where there is one that names accounts.

    The domain is looked for in the text as it came; the model is told the redacted text and the domain.
    """
    given = first_of(records, "id").withColumn("raw_text", chosen_text()).drop("clean_text")
    clean = pii.redact(given).select("id", F.col("raw_text").alias("text"), "clean_text")
    domain = text.email_domain(F.col("text"))
    if backend.kinds is not None and "account" not in backend.kinds:
        found = clean.select("id", domain.alias("email_domain")).select(
            "id", "email_domain", F.col("email_domain").alias("account_name"), F.when(F.col("email_domain").isNotNull(), F.lit("email_domain")).otherwise(F.lit("none")).alias("method"),
            F.when(F.col("email_domain").isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0)).alias("confidence"), F.lit(None).cast("string").alias("error"),
        )
    else:
        asked = F.col("clean_text") if backend.plain else prompt("account", F.col("clean_text"), email_domain=domain)
        named = clean.select(F.col("id").alias("unit_id"), "text", asked.alias("prompt"), F.array().cast("array<string>").alias("candidates"))
        found = extract.accounts_of(named, backend).withColumnRenamed("unit_id", "id")
    return found.select(
        F.col("id").alias("parent_cfo_id"), "email_domain", "account_name", F.col("method").alias("account_method"), F.col("confidence").alias("account_confidence"), F.col("error").alias("account_error")
    )


def process(records: DataFrame, batch_id: int, store: Store, backend: Backend, settings: Settings) -> bool:
    """Analyses one batch and stores it; False if it was stored before.

    A call that fails costs what it was to give, and its error is stored with the unit: a unit without an answer about its topic has no topic
    and founds none. A unit whose evidence does not occur in its text keeps its topic, but does not count for it.
    """
    if store.has(batch_id):
        return False
    began = time.monotonic()
    units = units_of(records, batch_id, backend).join(store.read("feedback_units").select("unit_id"), "unit_id", "left_anti")
    asked_of = lambda kind, said: said if backend.plain else prompt(kind, said)

    new = units.select("seq", "unit_id", "embedding")
    far, known = store.near("dedup_index", new, settings.dedup_threshold)
    pairs = cut(edges(new, settings.dedup_threshold).unionByName(far))
    met = known.join(pairs.select(F.col("a").alias("seq")).distinct(), "seq", "left_semi").select("seq", "unit_id", "embedding")
    pool = new.unionByName(met)
    found = leaders(pool, pairs, met)
    names = pool.select(F.col("seq").alias("canonical_seq"), F.col("unit_id").alias("canonical_id"))
    dedup = found.join(names, "canonical_seq").select("seq", "is_duplicate", F.when(F.col("is_duplicate"), F.col("canonical_id")).alias("canonical_id"))
    told = cut(units.join(dedup, "seq"))
    canonical = told.where(~F.col("is_duplicate"))

    asked = cut(backend.complete(canonical.select("unit_id", "seq", asked_of("topic", F.col("text")).alias("prompt")), "topic").withColumn("t", text.parse_topic(F.col("raw"))))
    labelled = F.col("raw").isNotNull() & (F.col("t.label") != "")
    unnamed = asked.where(~F.coalesce(labelled, F.lit(False))).select("unit_id", F.coalesce("error", F.lit("topic: no label")).alias("error"))
    named = asked.where(labelled).select("unit_id", "seq", "t.label", "t.description", "t.evidence", "t.confidence")
    looked_up, kept = topics.match_text(F.col("label"), F.col("description")), topics.stored_text(F.col("label"), F.col("description"))
    named = cut(named.select("*", rules.embed(looked_up).alias("embedding"), rules.embed(kept).alias("stored_embedding")))
    topic_pairs, stored = store.near("topic_index", named, settings.topic_threshold)
    assigned = topics.assign_topics(
        named.select("seq", "label", "confidence", "embedding", "stored_embedding"), settings.topic_threshold, settings.suggest_threshold, stored, topic_pairs
    )
    ids = stored.select(F.col("seq").alias("topic_seq"), "topic_id").unionByName(
        named.select(F.col("seq").alias("topic_seq"), F.sha2(F.concat(F.lit("topic|"), "unit_id"), 256).alias("topic_id"))
    )
    matched = assigned.join(ids, "topic_seq").join(named.select("seq", "unit_id", F.col("label").alias("own_label"), "description", "evidence", "stored_embedding"), "seq")
    matched = cut(extract.grounded(matched.join(canonical.select("unit_id", "text"), "unit_id")).drop("text"))

    prompts = canonical.select("unit_id", "text").join(matched.select("unit_id", "topic_id"), "unit_id", "left")
    analysed = cut(extract.extract(prompts, store.read("topics"), backend, asked_of))
    intents = extract.learned_intents(analysed, canonical.select("unit_id", "seq"))

    now = F.current_timestamp()
    fresh = matched.groupBy("topic_id").agg(
        F.min_by("topic_label", "seq").alias("label"),
        F.min_by("description", "seq").alias("description"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("alias").isNotNull(), F.struct("seq", "alias")))), lambda x: x["alias"])).alias("aliases"),
        F.count_if("is_grounded").alias("delta"),
    )
    fresh = fresh.join(intents, "topic_id", "left").withColumn("at", now)
    topic = matched.select("unit_id", "topic_id", "topic_label", "topic_confidence", "is_new_topic", "own_label", "evidence", "ungrounded", "is_grounded")
    topic = topic.join(unnamed, "unit_id", "full")
    intent = analysed.select("unit_id", "intent.specific_request", "intent.competitor_mention", "intent.churn_indicators", "error")
    accounts = accounts_of(records, backend)
    dedup = told.select("unit_id", "is_duplicate", "canonical_id")
    from_record = told.drop("is_duplicate", "canonical_id").join(accounts.drop("account_error"), "parent_cfo_id", "left")
    failed = told.where("unit_index = 0").join(accounts.where("account_error is not null"), "parent_cfo_id").select("unit_id", "account_error")
    wide = extract.assemble(from_record, dedup, topic, intent).join(failed, "unit_id", "left")
    empty = F.array().cast("array<string>")
    rows = cut(wide.select(
        "unit_id", "parent_cfo_id", "text", "char_start", "char_end", "unit_index", "is_duplicate", "canonical_id", "topic_id", "topic_label", "topic_confidence",
        F.col("is_new_topic").alias("topic_is_new"), "metadata", F.col("own_label").alias("raw_extracted_label"),
        F.coalesce("evidence", empty).alias("evidence_spans"), "specific_request", "competitor_mention",
        F.coalesce("churn_indicators", F.array().cast("array<struct<signal:string,severity:double>>")).alias("churn_indicators"),
        "account_name", "account_method", "account_confidence", "email_domain", F.coalesce("ungrounded", empty).alias("ungrounded_spans"), "is_grounded",
        F.array_compact(F.concat("errors", F.array("account_error"))).alias("errors"), now.alias("created_at"),
    ))
    sentiments = analysed.select(
        "unit_id", "sentiment.polarity", "sentiment.intensity", "sentiment.sarcasm_flag", "sentiment.confidence", "sentiment.emotions",
        F.col("sentiment.aspects").alias("aspect_sentiments"), now.alias("created_at"),
    )
    founded = matched.where("is_new_topic").select("topic_id", "seq", F.col("topic_label").alias("label"), F.col("stored_embedding").alias("embedding"))
    took = F.lit(int(1000 * (time.monotonic() - began))).cast("long")
    done = extract.batch_metrics(records.select("id").distinct(), rows).select(F.lit(batch_id).cast("long").alias("batch_id"), "*", took.alias("processing_ms"), now.alias("created_at"))
    indexes = {"dedup_index": canonical.select("unit_id", "seq", "embedding"), "topic_index": founded}
    applied = store.apply(batch_id, fresh, rows, sentiments, indexes, done, fresh=True)
    if len(store.versions()) > settings.compact_after:
        store.compact()
    return applied


def messages(spark: SparkSession, settings: Settings) -> DataFrame:
    """The stream of raw messages: of a Kafka topic where servers are set, else of the text files of a folder."""
    if settings.kafka_servers:
        return (
            spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", settings.kafka_servers)
            .option("subscribe", settings.kafka_topic)
            .option("startingOffsets", "earliest")
            .option("maxOffsetsPerTrigger", settings.batch_size)
            .load()
            .select("value")
        )
    return spark.readStream.option("maxFilesPerTrigger", settings.batch_size).text(settings.input_path)


def start(spark: SparkSession, settings: Settings, backend: Backend | None = None, once: bool = False) -> StreamingQuery:
    """Starts the stream; messages that are no records go to the folder `rejects`.

    Messages are gathered by `gather_shards` consumers and leave each in batches of `batch_size`, or fewer once the first has waited
    `batch_timeout_ms`; what leaves in one trigger is analysed together. once: what is there now is analysed at once, by files, and the stream ends.
    """
    store = Store(spark, settings.store_path)
    model = backend or rule_backend()
    gather = settings.gather_shards > 0 and not once

    def batch(raw: DataFrame, batch_id: int) -> None:
        if gather:
            raw = cut(raw.select(F.col("payload").alias("value")))  # the state is used once
            if raw.isEmpty():
                return
        good, bad = parse_messages(raw)
        bad.write.mode("overwrite").parquet(f"{store.path}/rejects/batch={batch_id}")
        process(good, batch_id, store, model, settings)

    stream = messages(spark, settings)
    if gather:
        payload = F.col("value").cast("string")
        stream = flush.gathered(stream.select(F.pmod(F.xxhash64(payload), F.lit(settings.gather_shards)).alias("shard"), payload.alias("payload")), settings.batch_size, settings.batch_timeout_ms)
    writer = stream.writeStream.option("checkpointLocation", settings.checkpoint_path).foreachBatch(batch)
    every = min(1_000, settings.batch_timeout_ms) if gather else settings.batch_timeout_ms
    trigger = {"availableNow": True} if once else {"processingTime": f"{every} milliseconds"}
    return writer.trigger(**trigger).start()
