"""Review queues, spam, evaluation against a gold set, and the life of a unit after analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def queue(units: DataFrame, below: float = 0.7) -> DataFrame:
    """unit_id, reason, confidence: a row for each reason to look at a unit.

    units: unit_id, confidence, is_new_topic, and where there are: is_grounded, sarcasm_flag, error (of the unitizer).
    """
    reasons = {"low confidence": F.col("confidence") < below, "new theme": F.col("is_new_topic")}
    more = {
        "is_grounded": ("ungrounded evidence", ~F.col("is_grounded")),
        "sarcasm_flag": ("sarcasm", F.col("sarcasm_flag")),
        "error": ("ambiguous split", F.col("error").isNotNull()),
    }
    reasons |= dict(told for column, told in more.items() if column in units.columns)
    out = None
    for reason, condition in reasons.items():
        part = units.where(condition).select("unit_id", F.lit(reason).alias("reason"), "confidence")
        out = part if out is None else out.unionByName(part)
    return out


def of_store(units: DataFrame, sentiments: DataFrame, below: float = 0.7) -> DataFrame:
    """The queue of stored units (feedback_units, unit_sentiments): canonical units and those that a model could not split."""
    joined = units.join(sentiments.select("unit_id", "sarcasm_flag"), "unit_id", "left")
    split = F.get(F.filter("errors", lambda e: F.startswith(e, F.lit("unitize:"))), F.lit(0))
    return queue(joined.select("unit_id", F.col("topic_confidence").alias("confidence"), F.col("topic_is_new").alias("is_new_topic"), "is_grounded", "sarcasm_flag", split.alias("error")), below)


def priority(units: DataFrame) -> DataFrame:
    """unit_id, priority: uncertainty times the number of similar items."""
    return units.select("unit_id", F.round((1 - F.col("confidence")) * (F.col("duplicate_count") + 1), 6).alias("priority"))


def spam(records: DataFrame, least: int = 2) -> DataFrame:
    """Texts that several sources send alike: text_hash, copies, n_sources."""
    same = records.groupBy(F.sha2("raw_text", 256).alias("text_hash")).agg(F.count("*").alias("copies"), F.count_distinct("source_channel").alias("n_sources"))
    return same.where(F.col("n_sources") >= least)


def confusion(pairs: DataFrame) -> DataFrame:
    """gold, predicted, n."""
    return pairs.groupBy("gold", "predicted").agg(F.count("*").alias("n"))


def agreement(pairs: DataFrame) -> DataFrame:
    """One row for 0/1 labels: accuracy, precision, recall, f1, kappa, mae."""
    tp, fp, fn, tn = (
        F.count_if((F.col("gold") == g) & (F.col("predicted") == p)).cast("double").alias(name) for name, g, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))
    )
    c = pairs.agg(tp, fp, fn, tn).withColumn("n", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    by = lambda a, b: F.try_divide(a, b)
    po = by(F.col("tp") + F.col("tn"), F.col("n"))
    pe = by((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) + (F.col("fn") + F.col("tn")) * (F.col("fp") + F.col("tn")), F.col("n") * F.col("n"))
    r = lambda x, name: F.round(x, 6).alias(name)
    return c.select(
        r(po, "accuracy"),
        r(by(F.col("tp"), F.col("tp") + F.col("fp")), "precision"),
        r(by(F.col("tp"), F.col("tp") + F.col("fn")), "recall"),
        r(by(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), "f1"),
        r(by(po - pe, 1 - pe), "kappa"),
        r(by(F.col("fp") + F.col("fn"), F.col("n")), "mae"),
    )


def label_quality(pairs: DataFrame) -> DataFrame:
    """label, told, said, hit, precision, recall, f1 of each label that either side of (gold, predicted) has; a rate without rows is null."""
    c = confusion(pairs)
    sides = F.array(F.struct(F.col("gold").alias("label"), F.col("n").alias("told"), F.lit(0).alias("said")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("told"), F.col("n").alias("said")))
    hit = F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)
    each = c.select(hit.alias("hit"), F.inline(sides)).groupBy("label").agg(F.sum("told").alias("told"), F.sum("said").alias("said"), (F.sum("hit") / 2).cast("long").alias("hit"))
    rate = lambda n, of, name: F.round(F.try_divide(n.cast("double"), of), 6).alias(name)
    h, t, s = F.col("hit"), F.col("told"), F.col("said")
    return each.select("label", "told", "said", "hit", rate(h, s, "precision"), rate(h, t, "recall"), rate(2 * h, t + s, "f1"))


def label_agreement(pairs: DataFrame) -> DataFrame:
    """One row for labels of any number (gold, predicted): n, accuracy, macro_f1 (over labels that either side has), kappa."""
    c = confusion(pairs)
    of = lambda side, name: c.groupBy(F.col(side).alias("label")).agg(F.sum("n").alias(name))
    hits = c.where(F.col("gold") == F.col("predicted")).select(F.col("gold").alias("label"), F.col("n").alias("hit"))
    each = of("gold", "told").join(of("predicted", "said"), "label", "full").join(hits, "label", "left").na.fill(0, ["told", "said", "hit"])
    f1 = F.col("hit") * 2 / (F.col("told") + F.col("said"))
    sums = each.agg(
        F.sum("told").alias("n"), F.sum("hit").alias("hits"), F.avg(f1).alias("f1"), F.sum(F.col("told").cast("double") * F.col("said")).alias("chance")
    ).select("n", F.try_divide("hits", "n").alias("po"), "f1", F.try_divide(F.col("chance"), F.col("n").cast("double") * F.col("n")).alias("pe"))
    r = lambda x, name: F.round(x, 6).alias(name)
    return sums.select("n", r(F.col("po"), "accuracy"), r(F.col("f1"), "macro_f1"), r(F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")), "kappa"))


def new_account_spikes(units: DataFrame, sigmas: float = 2.5) -> DataFrame:
    """day, n_new, spike: units of accounts on the day that they were first seen; a spike lies over the mean of all days by so many deviations."""
    first = units.groupBy("account_id").agg(F.min("unit_date").alias("unit_date"))
    days = units.join(first, ["account_id", "unit_date"]).groupBy(F.col("unit_date").alias("day")).agg(F.count("*").alias("n_new"))
    usual = days.agg(F.avg("n_new").alias("m"), F.stddev_pop("n_new").alias("s"))
    return days.join(F.broadcast(usual), F.lit(True)).select("day", "n_new", (F.col("n_new") > F.col("m") + sigmas * F.col("s")).alias("spike"))  # one row


STAGES = ("intake", "analyzed", "triaged", "assigned", "resolved")


def lifecycle(events: DataFrame, entity: str, stage: Column, at: str) -> DataFrame:
    """entity and the first time that it reached each stage."""
    first = events.withColumn("__stage", stage).groupBy(entity).pivot("__stage", list(STAGES)).agg(F.min(at))
    return first


def funnel(life: DataFrame) -> DataFrame:
    """stage, reached: how many entities ever reached it."""
    return life.select(F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(s).isNotNull().alias("there")) for s in STAGES))).alias("x")).groupBy("x.stage").agg(
        F.count_if("x.there").alias("reached")
    )


def median_hours(life: DataFrame, start: str, end: str) -> DataFrame:
    """One row: median hours from one stage to a later one, over the entities that reached both in that order."""
    hours = F.timestamp_diff("SECOND", F.col(start), F.col(end)) / 3600.0
    return life.where(F.col(end) >= F.col(start)).agg(F.round(F.percentile(hours, 0.5), 6).alias("median_hours"), F.count("*").alias("n"))


def resolutions(marks: DataFrame) -> DataFrame:
    """The last mark of each unit (marks: unit_id, status, at)."""
    return marks.groupBy("unit_id").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"))
