"""Topic matching on top of leaders: a unit joins the nearest earlier topic at or over the threshold, or founds a new one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import cut
from .similarity import centroids, dedup, dot, edges, edges_between, leaders, norm

MATCH, SUGGEST = 0.82, 0.70


def match_text(label, description):
    """What an extracted topic is looked up by: label and description, without dots and spaces at either end."""
    return F.regexp_replace(F.concat(label, F.lit(". "), description), r"^[. ]+|[. ]+$", "")


def stored_text(label, description):
    """What a new topic is stored by; nothing is cut off."""
    return F.concat(label, F.lit(". "), description)


def assign_topics(units: DataFrame, threshold: float = MATCH, suggest: float = SUGGEST, stored: DataFrame | None = None, stored_pairs: DataFrame | None = None) -> DataFrame:
    """units: seq, embedding, label, confidence. A row for each: topic_seq (its founder), is_new_topic, topic_confidence,
    suggested_label (null if the extraction was unsure), needs_review, alias (its own label, where that differs from the topic's).

    stored: seq, label, embedding of the topics of earlier batches, with stored_pairs their pairs with the units (a, b, sim), where they are known; those
    that a unit matches have a row, too. Where units have a column
    stored_embedding, a unit is compared by its embedding with the earlier units' stored_embedding.
    """
    if "stored_embedding" in units.columns:
        pairs = edges_between(units, units.select("seq", F.col("stored_embedding").alias("embedding")), threshold)
    elif stored is not None:
        pairs = edges(units, threshold)
    else:
        pairs = None
    units = units.select("seq", "label", "confidence", "embedding")
    decided = None
    if stored is not None:
        pairs = cut(pairs.unionByName(edges_between(units, stored, threshold) if stored_pairs is None else stored_pairs))
        decided = stored.join(pairs.select(F.col("a").alias("seq")).distinct(), "seq", "left_semi")
        units = units.unionByName(decided.select("seq", "label", F.lit(0.0).alias("confidence"), "embedding"))
    chosen = dedup(units, threshold) if pairs is None else leaders(units, pairs, decided)
    own = units.select("seq", "label", "confidence")
    topic = units.select(F.col("seq").alias("canonical_seq"), F.col("label").alias("topic_label"))
    out = chosen.join(own, "seq").join(topic, "canonical_seq")
    new = F.col("was_indexed")
    return out.select(
        "seq",
        F.col("canonical_seq").alias("topic_seq"),
        "topic_label",
        new.alias("is_new_topic"),
        F.when(new, F.col("confidence")).otherwise(F.col("similarity")).alias("topic_confidence"),
        F.when(new & (F.col("confidence") >= suggest), F.col("label")).alias("suggested_label"),
        (new & (F.col("confidence") < suggest)).alias("needs_review"),
        F.when(~new & (F.col("label") != F.col("topic_label")), F.col("label")).alias("alias"),
    )


def topic_table(assigned: DataFrame) -> DataFrame:
    """topic_seq, label, feedback_count, aliases in the order in which they were first seen."""
    seen = F.array_sort(F.collect_list(F.when(F.col("alias").isNotNull(), F.struct("seq", "alias"))))
    return assigned.groupBy("topic_seq").agg(
        F.first("topic_label").alias("label"), F.count("*").alias("feedback_count"), F.array_distinct(F.transform(seen, lambda x: x["alias"])).alias("aliases")
    )


def drift(nodes: DataFrame, units: DataFrame, below: float = 0.8) -> DataFrame:
    """topic_id, sim, drifted: cosine of each node's embedding (nodes: topic_id, node) and the centroid of its units."""
    both = nodes.join(centroids(units), "topic_id")
    sim = F.round(F.try_divide(dot(F.col("node"), F.col("centroid")), norm(F.col("node")) * norm(F.col("centroid"))), 6)
    return both.select("topic_id", sim.alias("sim")).withColumn("drifted", F.col("sim") < below)
