"""Sentiment and intent for canonical units with one model call each, accounts, evidence, and the assembly of all results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import email_domain, parse_account, parse_combined, parse_sentiment
from .backend import Backend


def extract(units: DataFrame, topics: DataFrame, backend: Backend, asked_of: Callable[[str, Column], Column] | None = None) -> DataFrame:
    """units: unit_id, topic_id, prompt; topics: topic_id, intent_type, intent_urgency. unit_id, sentiment, intent, from_cache, error.

    A unit whose topic has a stored intent asks for its sentiment only; any other asks for both in one call. asked_of makes the prompt of a
    kind of call from the column text, where units have no prompts of their own.
    """
    ask = lambda rows, kind: backend.complete(rows.withColumn("prompt", asked_of(kind, F.col("text"))) if asked_of else rows, kind)
    known = units.join(topics.select("topic_id", "intent_type", "intent_urgency"), "topic_id", "left")
    cached, fresh = known.where(F.col("intent_type").isNotNull()), known.where(F.col("intent_type").isNull())
    empty_churn = F.array().cast("array<struct<signal:string,severity:double>>")
    kept = F.struct(
        F.col("intent_type"),
        F.coalesce("intent_urgency", F.lit("medium")).alias("urgency"),
        F.lit(None).cast("string").alias("specific_request"),
        F.lit(None).cast("string").alias("competitor_mention"),
        empty_churn.alias("churn_indicators"),
    )
    one = ask(cached, "sentiment").select("unit_id", "topic_id", parse_sentiment(F.col("raw")).alias("sentiment"), kept.alias("intent"), F.lit(True).alias("from_cache"), "error")
    two = ask(fresh, "combined").withColumn("both", parse_combined(F.col("raw")))
    two = two.select("unit_id", "topic_id", F.col("both.sentiment").alias("sentiment"), F.col("both.intent").alias("intent"), F.lit(False).alias("from_cache"), "error")
    return one.unionByName(two)


def learned_intents(extracted: DataFrame, order: DataFrame) -> DataFrame:
    """topic_id, intent_type, intent_urgency to store: those of the topic's first unit (order: unit_id, seq) that was asked afresh."""
    fresh = extracted.where(~F.col("from_cache") & F.col("topic_id").isNotNull()).join(order, "unit_id")
    return fresh.groupBy("topic_id").agg(F.min_by("intent.intent_type", "seq").alias("intent_type"), F.min_by("intent.urgency", "seq").alias("intent_urgency"))


def accounts_of(records: DataFrame, backend: Backend, candidates: str = "candidates") -> DataFrame:
    """records: unit_id, text, prompt, candidates (array of names). Account of each; without any signal the model isn't asked."""
    signalled = records.withColumn("email_domain", email_domain(F.col("text"))).withColumn(
        candidates, F.array_distinct(F.filter(F.transform(F.coalesce(candidates, F.array().cast("array<string>")), lambda c: F.trim(c)), lambda c: F.length(c) > 2))
    )
    silent = F.col("email_domain").isNull() & (F.size(candidates) == 0)
    asked = backend.complete(signalled.where(~silent), "account").withColumn("a", parse_account(F.col("raw"), F.col("email_domain")))
    kept = F.when(F.col("error").isNull(), F.col(candidates)).otherwise(F.array().cast("array<string>"))  # a failed call drops them
    asked = asked.select("unit_id", "email_domain", kept.alias(candidates), "a.account_name", "a.confidence", "a.method", "error")
    none = signalled.where(silent).select(
        "unit_id", "email_domain", candidates, F.lit(None).cast("string").alias("account_name"), F.lit(0.0).alias("confidence"), F.lit("none").alias("method"), F.lit(None).cast("string").alias("error")
    )
    return asked.unionByName(none)


def grounded(units: DataFrame) -> DataFrame:
    """units: text, evidence (array). Adds ungrounded (the spans that do not occur, whatever their case) and is_grounded; no evidence is no wrong one."""
    missing = F.filter(F.coalesce("evidence", F.array().cast("array<string>")), lambda s: ~F.contains(F.lower("text"), F.lower(s)))
    return units.withColumn("ungrounded", missing).withColumn("is_grounded", F.size("ungrounded") == 0)


#: Words by which evidence and texts find each other before they are compared whole, and how many passages without such words are allowed.
EVIDENCE_WORDS, MAX_WORDLESS = 8, 1_000


def evidence_counts(units: DataFrame, evidence: DataFrame) -> DataFrame:
    """units: doc_id, text; evidence: item_id, evidence. item_id, n_grounded: how many texts hold each passage verbatim.

    A passage that begins and ends inside words of a text still holds its inner words whole; so they meet on a hash of its first inner
    words, eight or as many as there are. Passages of one or two words have none and are looked for in every text: an error if there are
    more than MAX_WORDLESS of them.
    """
    split = lambda c: F.split(F.coalesce(c, F.lit("")), r"\s+")
    inner = F.greatest(F.least(F.size(split(F.col("evidence"))) - 2, F.lit(EVIDENCE_WORDS)), F.lit(0))
    items = evidence.select("item_id", "evidence", inner.alias("n")).withColumn("key", F.xxhash64("n", F.slice(split(F.col("evidence")), F.lit(2), F.col("n"))))
    sizes = sorted(r["n"] for r in items.select("n").distinct().collect())  # EVIDENCE_WORDS + 1 of them at most
    grams = lambda n: F.when(
        F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.xxhash64(F.lit(n), F.slice(F.col("w"), i, F.lit(n))))
    ).otherwise(F.array().cast("array<bigint>"))
    keyed = units.withColumn("w", split(F.col("text")))
    keys = F.array_distinct(F.concat(*(grams(n) for n in sizes if n), F.array().cast("array<bigint>")))
    met = keyed.select("doc_id", F.explode(keys).alias("key")).join(items.where("n > 0").select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
    held = met.join(units, "doc_id").join(items.select("item_id", "evidence"), "item_id").where(F.contains("text", F.col("evidence"))).select("item_id")
    if sizes and not sizes[0]:
        short = items.where("n = 0").select("item_id", "evidence")
        if short.count() > MAX_WORDLESS:
            raise ValueError(f"more than {MAX_WORDLESS} passages of one or two words")
        held = held.unionByName(units.join(F.broadcast(short), F.contains("text", F.col("evidence"))).select("item_id"))  # MAX_WORDLESS rows at most
    n = held.groupBy("item_id").agg(F.count("*").alias("n_grounded"))
    return evidence.select("item_id").join(n, "item_id", "left").withColumn("n_grounded", F.coalesce("n_grounded", F.lit(0)))


def assemble(units: DataFrame, dedup: DataFrame, topics: DataFrame, extracted: DataFrame) -> DataFrame:
    """One wide row for each unit; a duplicate carries its canonical_id only. errors: those of all stages that have one (columns named error)."""
    said = [df.withColumnRenamed("error", f"error_{i}") for i, df in enumerate((units, dedup, topics, extracted.drop("topic_id")))]
    out = said[0]
    for more in said[1:]:
        out = out.join(more, "unit_id", "left")
    named = [c for c in out.columns if c.startswith("error_")]
    return out.withColumn("errors", F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")).drop(*named)


def batch_metrics(records: DataFrame, analysed: DataFrame) -> DataFrame:
    """One row: total_cfos, total_units, canonical_units, errors (analysed: is_duplicate, errors)."""
    counts = analysed.agg(
        F.count("*").alias("total_units"), F.count_if(~F.coalesce("is_duplicate", F.lit(False))).alias("canonical_units"), F.coalesce(F.sum(F.size("errors")), F.lit(0)).cast("long").alias("errors")
    )
    return records.agg(F.count("*").alias("total_cfos")).join(F.broadcast(counts), F.lit(True))  # one row on either side


def stage_errors(analysed: DataFrame) -> DataFrame:
    """stage, n: how many units each stage failed for; an error begins with its stage and a colon."""
    each = analysed.select(F.explode("errors").alias("e"))
    return each.groupBy(F.substring_index("e", ":", 1).alias("stage")).agg(F.count("*").alias("n"))
