"""Signals in conversations, one track for each kind, and the store of what is known about areas of the product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.labels import relabelled

#: Kind of signal to the words of its track; a model backend may fill the same columns.
WORDS: dict[str, tuple[str, ...]] = {
    "action_item": ("will", "todo", "task", "follow"),
    "churn_risk": ("cancel", "leave", "urgent", "deadline"),
    "competitive_mention": ("competitor", "alternative", "instead"),
    "expansion": ("more", "upgrade", "seats", "expand"),
    "organisational": ("team", "hired", "manager", "reorg"),
    "stakeholder": ("director", "ceo", "owner", "boss"),
    "compliance": ("privacy", "legal", "audit", "compliance"),
}


def tracks(conversations: DataFrame, role: str = "user") -> DataFrame:
    """conv_id, turn, kind, words: how many words of each track the customer's turns have; a text is split once for all."""
    said = conversations.where(F.col("role") == role).select("conv_id", "turn", F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+").alias("w"))
    n = lambda words: F.size(F.filter("w", lambda x: x.isin(*words))).cast("long")
    each = F.array(*(F.struct(F.lit(kind).alias("kind"), n(words).alias("words")) for kind, words in WORDS.items()))
    return said.select("conv_id", "turn", F.inline(each)).where("words > 0")


def knowledge(units: DataFrame) -> DataFrame:
    """Edges area (topic), feature (channel) and pain point (intent) of one batch, with how often and when they were seen."""
    return units.groupBy("topic_id", "channel_id", "intent_type").agg(F.count("*").alias("weight"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def merge_knowledge(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored edges and a batch's: weights add up, the span of time grows."""
    return stored.unionByName(batch).groupBy("topic_id", "channel_id", "intent_type").agg(
        F.sum("weight").alias("weight"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


def unify_knowledge(edges: DataFrame, unified_labels: DataFrame) -> DataFrame:
    """Edges by label, channel and intent, with those of near labels merged under the canonical one."""
    renamed = relabelled(edges, unified_labels)
    return renamed.groupBy("label", "channel_id", "intent_type").agg(
        F.sum("weight").alias("weight"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )
