"""Series, alerts, anomalies, impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dashboard import r6


def daily_series(units: DataFrame, by: str = "topic_id") -> DataFrame:
    """by, day, n for every group and day from the first day to the last."""
    seen = units.groupBy(by, F.col("unit_date").alias("day")).agg(F.count("*").alias("n"))
    span = units.agg(F.min("unit_date").alias("a"), F.max("unit_date").alias("b"))
    grid = units.select(by).distinct().join(F.broadcast(span), F.lit(True))  # span is one row
    grid = grid.select(by, F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    return grid.join(seen, [by, "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def spikes(series: DataFrame, by: str = "topic_id", times: float = 2.0) -> DataFrame:
    """Days with more than `times` the mean of the seven days before."""
    w = Window.partitionBy(by).orderBy("day").rowsBetween(-7, -1)
    out = series.withColumn("mean_before", r6(F.avg("n").over(w)))
    return out.where(F.col("n") > times * F.col("mean_before"))


def anomalies(series: DataFrame, by: str = "topic_id", sigma: float = 2.5) -> DataFrame:
    """z of each day against all days before it (two at least), and whether it is beyond sigma."""
    w = Window.partitionBy(by).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    past = series.withColumn("m", F.avg("n").over(w)).withColumn("s", F.stddev_samp("n").over(w))
    z = r6(F.try_divide(F.col("n") - F.col("m"), F.col("s")))
    return past.select(by, "day", "n", z.alias("z")).withColumn("is_anomaly", F.coalesce(F.abs("z") > sigma, F.lit(False)))


def decomposed(series: DataFrame, by: str = "topic_id") -> DataFrame:
    """trend (centred mean of seven days), season (mean of the rest by weekday) and residual: a plain stand-in for loess."""
    w = Window.partitionBy(by).orderBy("day").rowsBetween(-3, 3)
    t = series.withColumn("trend", F.avg("n").over(w)).withColumn("rest", F.col("n") - F.col("trend")).withColumn("weekday", F.weekday("day"))
    t = t.withColumn("season", F.avg("rest").over(Window.partitionBy(by, "weekday")))
    return t.select(by, "day", "n", r6(F.col("trend")).alias("trend"), r6(F.col("season")).alias("season"), r6(F.col("rest") - F.col("season")).alias("residual"))


def week_over_week(units: DataFrame, rise: float = 0.5) -> DataFrame:
    """topic_id, week, n, previous, change, and whether it rose by more than `rise`; weeks without units are not compared."""
    week = F.to_date(F.date_trunc("week", "unit_date"))
    n = units.groupBy("topic_id", week.alias("week")).agg(F.count("*").alias("n"))
    out = n.withColumn("previous", F.lag("n").over(Window.partitionBy("topic_id").orderBy("week")))
    return out.withColumn("change", r6(F.try_divide(F.col("n") - F.col("previous"), F.col("previous")))).withColumn("is_alert", F.coalesce(F.col("change") > rise, F.lit(False)))


def account_alerts(units: DataFrame, below: float = -0.8) -> DataFrame:
    """Accounts whose net sentiment on a day is under the bound."""
    net = units.groupBy("account_id", "unit_date").agg(r6(F.avg("polarity")).alias("net_sentiment"), F.count("*").alias("n"))
    return net.where(F.col("net_sentiment") < below)


def churn_alerts(units: DataFrame, accounts: DataFrame, segment: str) -> DataFrame:
    """Accounts of a segment with churn signals, and how severe their number is."""
    n = units.where(F.col("intent_type") == "churn_signal").join(accounts.where(F.col("segment") == segment), "account_id").groupBy("account_id").agg(F.count("*").alias("n"))
    return n.withColumn("severity", F.when(F.col("n") >= 5, "red").when(F.col("n") >= 3, "yellow").otherwise("green"))


def emerging(units: DataFrame, days: int = 7, rate: float = 0.15) -> DataFrame:
    """Share of units on new topics in the last days by channel, and whether it is over the rate."""
    end = units.agg(F.max("unit_date").alias("end"))
    recent = units.join(F.broadcast(end), F.lit(True)).where(F.datediff("end", "unit_date") < days)  # end is one row
    out = recent.groupBy("channel_id").agg(r6(F.avg(F.col("is_new_topic").cast("double"))).alias("new_rate"), F.count("*").alias("n"))
    return out.withColumn("is_emerging", F.col("new_rate") > rate)


def fading(series: DataFrame, by: str = "topic_id", periods: int = 3, most: int = 0) -> DataFrame:
    """Groups with some run of `periods` days of at most `most` units; last_quiet is the end of the last such run."""
    w = Window.partitionBy(by).orderBy("day").rowsBetween(-(periods - 1), 0)
    runs = series.withColumn("top", F.max("n").over(w)).withColumn("seen", F.count("*").over(w))
    return runs.where((F.col("seen") == periods) & (F.col("top") <= most)).groupBy(by).agg(F.max("day").alias("last_quiet"))


def volumes(units: DataFrame) -> DataFrame:
    """topic_id, absolute_count, relative_share, unique_users."""
    n = units.groupBy("topic_id").agg(F.count("*").alias("absolute_count"), F.count_distinct("account_id").alias("unique_users"))
    total = n.agg(F.sum("absolute_count").alias("total"))
    return n.join(F.broadcast(total), F.lit(True)).select("topic_id", "absolute_count", r6(F.col("absolute_count") / F.col("total")).alias("relative_share"), "unique_users")


def channels(units: DataFrame) -> DataFrame:
    return units.groupBy("topic_id", "channel_id").agg(F.count("*").alias("n"))


def sentiment_metrics(units: DataFrame) -> DataFrame:
    """topic_id, mean, spread, and the correlation of polarity and confidence."""
    return units.groupBy("topic_id").agg(
        r6(F.avg("polarity")).alias("mean_polarity"), r6(F.stddev_samp("polarity")).alias("sd_polarity"), r6(F.corr("polarity", "confidence")).alias("correlation")
    )


def impact(units: DataFrame, accounts: DataFrame, weights: tuple[float, float, float, float] = (0.4, 0.3, 0.2, 0.1), days: int = 7) -> DataFrame:
    """topic_id, impact: volume over the largest topic's, |mean polarity| (halved if positive), share of the weightiest segment, growth.

    segment weight: share of units of accounts in MACHINERY; growth: (current - previous) / max(previous, 1), within -1 and 1.
    """
    end = units.agg(F.max("unit_date").alias("end"))
    dated = units.join(accounts.select("account_id", "segment"), "account_id").join(F.broadcast(end), F.lit(True)).withColumn("age", F.datediff("end", "unit_date"))
    t = dated.groupBy("topic_id").agg(
        F.count("*").alias("n"),
        F.avg("polarity").alias("p"),
        F.avg((F.col("segment") == "MACHINERY").cast("double")).alias("seg"),
        F.count_if(F.col("age") < days).alias("cur"),
        F.count_if(F.col("age").between(days, 2 * days - 1)).alias("prev"),
    )
    most = t.agg(F.max("n").alias("most"))
    growth = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("cur") - F.col("prev")) / F.greatest(F.col("prev"), F.lit(1))))
    mood = F.abs("p") * F.when(F.col("p") < 0, F.lit(1.0)).otherwise(F.lit(0.5))
    a, b, c, d = map(F.lit, weights)
    score = a * F.col("n") / F.col("most") + b * mood + c * F.col("seg") + d * growth
    return t.join(F.broadcast(most), F.lit(True)).select("topic_id", F.round(score, 6).alias("impact"))


def executive_inputs(impacts: DataFrame, stats: DataFrame, k: int = 5) -> DataFrame:
    """The k topics of most impact with their trend, as sentences for a summary."""
    top = impacts.orderBy(F.desc("impact"), "topic_id").limit(k).join(stats, "topic_id")
    line = F.format_string("Topic %d: %d units, impact %.3f", "topic_id", "unit_count", "impact")
    return top.select("topic_id", "impact", "unit_count", line.alias("line"))


def snapshots(units: DataFrame, grain: str = "day") -> DataFrame:
    """Figures to store for each day, or week (its Monday): day or week, n_units, n_topics, mean_polarity."""
    period = F.col("unit_date") if grain == "day" else F.date_trunc(grain, "unit_date").cast("date")
    return units.groupBy(period.alias(grain)).agg(F.count("*").alias("n_units"), F.count_distinct("topic_id").alias("n_topics"), r6(F.avg("polarity")).alias("mean_polarity"))
