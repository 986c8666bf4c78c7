"""Alert rules as data: a rule is a row, all rules are evaluated in one scan of the units, and alerts have a state.

A rule looks at one kind of entity (topic, account, segment, channel) and one measure of its days, and compares it with a bound, or with a multiple of the mean
of the days before. Units are counted once by entity and day for all rules; a day's row then carries the rules that it fires. Firings that are no more than
a rule's cool-down apart are one alert, which is open, acknowledged or resolved.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTITIES = ("topic", "account", "segment", "channel")
#: Measures of an entity's day, over its units. Means of doubles are sums in the order of unit_id (see daily).
MEASURES = {
    "volume": lambda: F.count("*").cast("double"),
    "polarity": lambda: F.max_by("polarity_sum", "place") / F.count("polarity"),
    "confidence": lambda: F.max_by("confidence_sum", "place") / F.count("confidence"),
    "churn": lambda: F.count_if(F.col("intent_type") == "churn_signal").cast("double"),
    "new_rate": lambda: F.avg(F.col("is_new_topic").cast("double")),
}


@dataclass(frozen=True)
class Rule:
    """above / below: bounds of the measure. times: the measure exceeds so many times the mean of the `days` calendar days before, of which days without units count as 0.

    least: fewer units on the day fire nothing. cooldown: firings that are no more days apart belong to one alert. quiet: an alert without firings
    for so many days until the last day of all is resolved.
    """

    rule_id: str
    entity: str
    measure: str
    above: float | None = None
    below: float | None = None
    times: float | None = None
    days: int = 7
    least: int = 1
    cooldown: int = 1
    quiet: int = 14
    severity: str = "yellow"

    def __post_init__(self) -> None:
        if self.entity not in ENTITIES or self.measure not in MEASURES:
            raise ValueError(f"{self.rule_id}: no such entity or measure")
        if sum(x is not None for x in (self.above, self.below, self.times)) != 1:
            raise ValueError(f"{self.rule_id}: one of above, below and times")


def rules_from(rows: Iterable[dict]) -> list[Rule]:
    """Rules of a table's rows (as dicts); absent and null fields have their defaults."""
    return [Rule(**{k: v for k, v in row.items() if v is not None}) for row in rows]


def daily(units: DataFrame, accounts: DataFrame) -> DataFrame:
    """kind, entity, day, units and the measures: a row for each entity and day with units. Each unit is one row until it is counted.

    The last bit of a sum of doubles depends on its order, and a mean next to a bound on that bit; so doubles are added up in the order of unit_id, as a scan of the
    table would, however the rows are partitioned. The running sums need a sort of each entity's day, which can spill.
    """
    known = units.join(accounts.select("account_id", "segment"), "account_id", "left")
    of = {"topic": "topic_id", "account": "account_id", "segment": "segment", "channel": "channel_id"}
    each = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("entity")) for kind, c in of.items())))
    rows = known.select(each.alias("e"), F.col("unit_date").alias("day"), "unit_id", "polarity", "confidence", "intent_type", "is_new_topic").where("e.entity IS NOT NULL")
    rows = rows.select("e.kind", "e.entity", *rows.columns[1:])
    order = Window.partitionBy("kind", "entity", "day").orderBy("unit_id", "polarity", "confidence").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumns({"polarity_sum": F.sum("polarity").over(order), "confidence_sum": F.sum("confidence").over(order), "place": F.count("*").over(order)})
    return summed.groupBy("kind", "entity", "day").agg(F.count("*").alias("units"), *(m().alias(name) for name, m in MEASURES.items()))


def _fires(rule: Rule) -> tuple[Column, Column, Column]:
    """Whether a day fires the rule, the value that was compared, and the bound."""
    value = F.col(rule.measure)
    if rule.times is None:
        bound = F.lit(float(rule.below if rule.above is None else rule.above))
        hit = value > bound if rule.above is not None else value < bound
    else:
        at = F.datediff("day", F.lit("1970-01-01").cast("date"))
        before = Window.partitionBy("kind", "entity").orderBy(at).rangeBetween(-rule.days, -1)
        bound = F.lit(float(rule.times)) * F.coalesce(F.sum(value).over(before), F.lit(0.0)) / F.lit(float(rule.days))
        hit = (value > bound) & (bound > 0)
    return F.coalesce((F.col("kind") == rule.entity) & (F.col("units") >= rule.least) & hit, F.lit(False)), value, bound


def firings(days: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule_id, severity, kind, entity, day, value, bound: a row for each rule that a day of daily() fires."""
    kinds = sorted({r.entity for r in rules})
    rows = days.where(F.col("kind").isin(kinds))
    told = []
    for i, rule in enumerate(rules):
        hit, value, bound = _fires(rule)
        rows = rows.withColumn(f"__{i}", F.when(hit, F.struct(value.cast("double").alias("value"), bound.alias("bound"))))
        told.append(F.struct(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.severity).alias("severity"), F.col(f"__{i}").alias("at")))
    each = rows.select("kind", "entity", "day", F.explode(F.filter(F.array(*told), lambda t: t["at"].isNotNull())).alias("f"))
    return each.select("f.rule_id", "f.severity", "kind", "entity", "day", F.round("f.at.value", 6).alias("value"), F.round("f.at.bound", 6).alias("bound"))


def alerts(fired: DataFrame, rules: list[Rule], actions: DataFrame, last_day: Column | None = None) -> DataFrame:
    """rule_id, severity, kind, entity, opened, last_fired, n_firings, peak, state of each alert. actions: rule_id, entity, day, action (acknowledge, resolve).

    An action belongs to the last alert of its rule and entity that was opened on its day or before. The state is resolved after a resolve, or when the rule's
    quiet days have passed without a firing; acknowledged after an acknowledge alone; else open. A firing on a later day than a resolve opens a new alert.
    """
    spark = fired.sparkSession
    spans = spark.createDataFrame([(r.rule_id, r.cooldown, r.quiet) for r in rules], "rule_id string, cooldown int, quiet int")  # as many rows as rules
    key = ("rule_id", "entity")
    marks = actions.where(F.col("action").isin("acknowledge", "resolve")).select(*key, "day", F.col("action"))
    marks = marks.groupBy(*key, "day").agg(F.max((F.col("action") == "resolve").cast("int")).alias("resolves"), F.max((F.col("action") == "acknowledge").cast("int")).alias("acknowledges"))
    both = fired.select(*key, "severity", "kind", "day", "value", F.lit(0).alias("late")).unionByName(marks.withColumn("late", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*key).orderBy("day", "late")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    seen = both.join(F.broadcast(spans), "rule_id").withColumn("previous", F.max(F.when(F.col("late") == 0, F.col("day"))).over(before))
    seen = seen.withColumn("settled", F.max(F.when(F.col("resolves") == 1, F.col("day"))).over(before))
    fresh = F.col("previous").isNull() | (F.datediff("day", "previous") > F.col("cooldown")) | (F.col("settled") >= F.col("previous"))
    numbered = seen.withColumn("opens", F.when(F.col("late") == 0, fresh.cast("int")).otherwise(0)).withColumn("alert", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    end = fired.agg(F.max("day").alias("end")) if last_day is None else spark.range(1).select(last_day.alias("end"))
    firing = F.col("late") == 0
    grouped = numbered.where("alert > 0").groupBy(*key, "alert").agg(
        F.max("severity").alias("severity"), F.max("kind").alias("kind"), F.min("day").alias("opened"), F.max(F.when(firing, F.col("day"))).alias("last_fired"),
        F.count_if(firing).alias("n_firings"), F.max(F.abs("value")).alias("peak"), F.max("resolves").alias("resolves"), F.max("acknowledges").alias("acknowledges"), F.max("quiet").alias("quiet"),
    )
    over = F.datediff("end", "last_fired") >= F.col("quiet")
    state = F.when((F.col("resolves") == 1) | over, "resolved").when(F.col("acknowledges") == 1, "acknowledged").otherwise("open")
    return grouped.join(F.broadcast(end), F.lit(True)).select(*key, "severity", "kind", "opened", "last_fired", "n_firings", "peak", state.alias("state"))  # end is one row
