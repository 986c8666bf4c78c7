"""Roll-ups over units: key figures, topics, accounts, histograms and volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentiment_label
from ..sources.adapters import INTENT_TYPES


def r6(c: Column) -> Column:
    """Six digits, of twelve: sums of doubles depend on their order behind that, and a tie must not."""
    return F.round(F.round(c, 12), 6)


def key_figures(units: DataFrame) -> DataFrame:
    return units.agg(
        F.count_distinct("topic_id").alias("active_topics"),
        r6(F.avg("polarity")).alias("mean_polarity"),
        F.count_distinct("account_id").alias("accounts"),
        F.count_if(F.col("intent_type") == "churn_signal").alias("signals"),
    )


def top_topics(units: DataFrame, labels: DataFrame, n: int = 5) -> DataFrame:
    """The n most frequent topics of each intent, with label (the id without one)."""
    counts = units.groupBy("intent_type", "topic_id").agg(F.count("*").alias("units"))
    rank = F.row_number().over(Window.partitionBy("intent_type").orderBy(F.desc("units"), "topic_id"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= n)
    return top.join(labels, "topic_id", "left").withColumn("label", F.coalesce("label", F.col("topic_id").cast("string")))


def weekly_volume(units: DataFrame) -> DataFrame:
    """week and a count for each intent; weeks without units are there, with zeros."""
    counted = units.groupBy(F.to_date(F.date_trunc("week", "unit_date")).alias("week")).pivot("intent_type", list(INTENT_TYPES)).agg(F.count(F.lit(1)))
    span = units.agg(F.to_date(F.date_trunc("week", F.min("unit_date"))).alias("a"), F.to_date(F.date_trunc("week", F.max("unit_date"))).alias("b"))
    weeks = span.where("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("week"))
    return weeks.join(counted, "week", "left").fillna(0, list(INTENT_TYPES))


def histogram(units: DataFrame) -> DataFrame:
    """bin 0 to 9 of width 0.2 from -1, its lower end, and how many units; empty bins are there."""
    at = F.least(F.floor((F.col("polarity") + F.lit(1.0)) / F.lit(0.2)), F.lit(9))
    counts = units.groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    bins = units.sparkSession.range(10).withColumnRenamed("id", "bin")
    return bins.join(counts, "bin", "left").select("bin", F.round(F.lit(-1.0) + F.lit(0.2) * F.col("bin"), 1).alias("low"), F.coalesce("n", F.lit(0)).alias("n"))


def intent_shares(units: DataFrame, by: str = "topic_id") -> DataFrame:
    counts = units.groupBy(by, "intent_type").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(by))
    return counts.withColumn("share", r6(F.col("n") / total))


def mentions(units: DataFrame, accounts: DataFrame, by: str = "topic_id") -> DataFrame:
    """Accounts that mention each topic: how often, and their mean polarity."""
    counts = units.groupBy(by, "account_id").agg(F.count("*").alias("n"), r6(F.avg("polarity")).alias("mean_polarity"))
    return counts.join(accounts.select("account_id", "name"), "account_id", "left")


def weekly_trend(units: DataFrame) -> DataFrame:
    """topic_id, week, volume, mean_polarity, for every topic and week from the first week to the last."""
    week = F.to_date(F.date_trunc("week", "unit_date"))
    seen = units.groupBy("topic_id", week.alias("week")).agg(F.count("*").alias("volume"), r6(F.avg("polarity")).alias("mean_polarity"))
    span = units.agg(F.to_date(F.date_trunc("week", F.min("unit_date"))).alias("a"), F.to_date(F.date_trunc("week", F.max("unit_date"))).alias("b"))
    grid = units.select("topic_id").distinct().join(F.broadcast(span), F.lit(True))  # span is one row
    grid = grid.select("topic_id", F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("week"))
    return grid.join(seen, ["topic_id", "week"], "left").withColumn("volume", F.coalesce("volume", F.lit(0)))


def account_topics(units: DataFrame) -> DataFrame:
    return units.groupBy("account_id", "topic_id").agg(F.count("*").alias("n"))


def account_months(units: DataFrame) -> DataFrame:
    """Mean polarity of each account and month, with two digits."""
    return units.groupBy("account_id", F.date_format("unit_date", "yyyy-MM").alias("month")).agg(F.round(r6(F.avg("polarity")), 2).alias("mean_polarity"))


def account_rollup(units: DataFrame, accounts: DataFrame) -> DataFrame:
    """Every account with units: unit_count, net_sentiment, top_topic (the least of equally frequent ones), last_date."""
    cells = units.groupBy("account_id", "topic_id").agg(F.count("*").alias("n"), F.sum("polarity").alias("p"), F.max("unit_date").alias("d"))
    rolled = cells.groupBy("account_id").agg(
        F.sum("n").alias("unit_count"),
        r6(F.sum("p") / F.sum("n")).alias("net_sentiment"),
        F.max_by("topic_id", F.struct(F.col("n"), -F.col("topic_id"))).alias("top_topic"),
        F.max("d").alias("last_date"),
    )
    return rolled.join(accounts, "account_id")


ACCOUNT_ORDERS = {
    "most_units": ["unit_count DESC"],
    "worst_sentiment": ["net_sentiment ASC"],
    "most_recent": ["last_date DESC"],
    "alphabetical": ["lower(name) ASC", "name ASC"],
}


def account_list(rolled: DataFrame, needle: str = "", segment: str = "All", order: str = "most_units") -> DataFrame:
    """Accounts whose name holds the needle in any case, of one segment or All, with their place in the order."""
    out = rolled.where(F.contains(F.lower("name"), F.lit(needle.lower()))) if needle else rolled
    out = out if segment == "All" else out.where(F.col("segment") == segment)
    columns = [(F.expr(c.rpartition(" ")[0]), c.endswith("DESC")) for c in ACCOUNT_ORDERS[order]]
    return out.orderBy(*(c.desc() if down else c.asc() for c, down in columns), "account_id")


def label_counts(units: DataFrame) -> DataFrame:
    return units.groupBy(sentiment_label(F.col("polarity")).alias("sentiment")).agg(F.count("*").alias("n"))


def topic_stats(units: DataFrame, days: int = 7) -> DataFrame:
    """topic_id, unit_count, confidence_avg, current and previous volume of the last `days` days, trend (null if there was none)."""
    end = units.agg(F.max("unit_date").alias("end"))
    dated = units.join(F.broadcast(end), F.lit(True)).withColumn("age", F.datediff("end", "unit_date"))  # end is one row
    out = dated.groupBy("topic_id").agg(
        F.count("*").alias("unit_count"),
        r6(F.avg("confidence")).alias("confidence_avg"),
        F.count_if(F.col("age") < days).alias("current"),
        F.count_if(F.col("age").between(days, 2 * days - 1)).alias("previous"),
    )
    return out.withColumn("trend", r6(F.try_divide(F.col("current") - F.col("previous"), F.col("previous"))))


def cube_slices(units: DataFrame, accounts: DataFrame) -> DataFrame:
    """Counts and mean polarity by channel, by segment, by both and over all (null: any)."""
    joined = units.join(accounts.select("account_id", "segment"), "account_id")
    return joined.cube("channel_id", "segment").agg(F.count("*").alias("n"), r6(F.avg("polarity")).alias("mean_polarity"))


def duplicate_clusters(units: DataFrame) -> DataFrame:
    """canonical_id and how many units it stands for, itself included."""
    return units.groupBy("canonical_id").agg(F.count("*").alias("cluster_size"))
