"""Exploring units: filters, orders, the summary bar, breadth, search."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    """What is None or empty does not filter; a missing end of the polarity range is -1 or 1."""

    since: datetime.date | None = None
    until: datetime.date | None = None
    intents: tuple[str, ...] = ()
    least_polarity: float | None = None
    most_polarity: float | None = None
    topic_id: int | None = None
    account_id: int | None = None
    starred: bool = False
    min_accounts: int | None = None

    def active(self) -> int:
        """How many of intents, polarity, topic, account and star are set."""
        polarity = self.least_polarity is not None or self.most_polarity is not None
        return sum(map(bool, (self.intents, polarity, self.topic_id is not None, self.account_id is not None, self.starred)))


def apply(units: DataFrame, f: Filters) -> DataFrame:
    keep: list[Column] = []
    if f.since is not None:
        keep.append(F.col("unit_date") >= F.lit(f.since))
    if f.until is not None:
        keep.append(F.col("unit_date") <= F.lit(f.until))
    if f.intents:
        keep.append(F.col("intent_type").isin(*f.intents))
    if f.least_polarity is not None or f.most_polarity is not None:
        low = -1.0 if f.least_polarity is None else f.least_polarity
        high = 1.0 if f.most_polarity is None else f.most_polarity
        keep.append(F.col("polarity").between(F.lit(low), F.lit(high)))
    if f.topic_id is not None:
        keep.append(F.col("topic_id") == f.topic_id)
    if f.account_id is not None:
        keep.append(F.col("account_id") == f.account_id)
    if f.starred:
        keep.append(F.col("is_starred"))
    out = units
    for condition in keep:
        out = out.where(condition)
    if f.min_accounts is not None:
        out = out.join(broad_topics(out, f.min_accounts).select("topic_id"), "topic_id", "left_semi")
    return out


def broad_topics(units: DataFrame, least: int) -> DataFrame:
    """topic_id, n_accounts of topics that at least so many accounts mention."""
    return units.groupBy("topic_id").agg(F.count_distinct("account_id").alias("n_accounts")).where(F.col("n_accounts") >= least)


#: Each order ends with unit_id, so that ties have one order.
ORDERS: dict[str, list] = {
    "most_recent": [F.desc, "ts"],
    "oldest": [F.asc, "ts"],
    "worst_sentiment": [F.asc, "polarity"],
    "best_sentiment": [F.desc, "polarity"],
    "most_duplicates": [F.desc, "duplicate_count"],
}


def ordered(units: DataFrame, order: str) -> DataFrame:
    by, column = ORDERS[order]
    key = F.coalesce(F.col(column), F.lit(0)) if column == "duplicate_count" else F.col(column)
    return units.orderBy(by(key), "unit_id")


def page(units: DataFrame, order: str, size: int, after: tuple | None = None) -> DataFrame:
    """One page by keyset: the rows behind (value, unit_id) of the last page's last row."""
    by, column = ORDERS[order]
    if after is not None:
        value, unit_id = after
        beyond = F.col(column) < F.lit(value) if by is F.desc else F.col(column) > F.lit(value)
        units = units.where(beyond | ((F.col(column) == F.lit(value)) & (F.col("unit_id") > unit_id)))
    return ordered(units, order).limit(size)


def summary(units: DataFrame) -> DataFrame:
    """One row: n_units, n_accounts, mean_polarity (0 if empty), top_intent, top_topic (of equally frequent ones the least)."""
    cells = units.groupBy("intent_type", "topic_id").agg(F.count("*").alias("n"))
    top = lambda c: (
        cells.groupBy(c).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), c).limit(1).agg(F.max(c).alias(f"top_{c}"))
    )
    totals = units.agg(
        F.count("*").alias("n_units"),
        F.count_distinct("account_id").alias("n_accounts"),
        F.round(F.round(F.coalesce(F.avg("polarity"), F.lit(0.0)), 12), 6).alias("mean_polarity"),
    )
    return totals.join(F.broadcast(top("intent_type")), F.lit(True)).join(F.broadcast(top("topic_id")), F.lit(True))  # one row each


def newest(units: DataFrame, by: str, n: int = 5) -> DataFrame:
    """The n newest units of each group."""
    w = Window.partitionBy(by).orderBy(F.desc("ts"), "unit_id")
    return units.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def search(needle: str, topics: DataFrame, accounts: DataFrame, units: DataFrame, each: int = 4) -> DataFrame:
    """kind, id, label: the first few topics, accounts and units whose text holds the needle in any case; none under 2 characters."""
    if len(needle) < 2:
        needle = "\u0000"
    found = None
    for kind, df in (("topic", topics), ("account", accounts), ("unit", units)):
        hits = df.where(F.contains(F.lower("label"), F.lit(needle.lower()))).orderBy("id").limit(each)
        hits = hits.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "label")
        found = hits if found is None else found.unionByName(hits)
    return found


def starred_in(units: DataFrame, members: DataFrame) -> DataFrame:
    """Starred units that belong to a collection (members: unit_id)."""
    return units.where("is_starred").join(members, "unit_id", "left_semi")


def collection_sizes(collections: DataFrame) -> DataFrame:
    return collections.select("collection_id", F.size("unit_ids").alias("n_units"))


def edit_collection(collections: DataFrame, collection_id: int, add: tuple = (), remove: tuple = ()) -> DataFrame:
    ids = F.array_union("unit_ids", F.array(*map(F.lit, add)).cast("array<bigint>"))
    ids = F.array_except(ids, F.array(*map(F.lit, remove)).cast("array<bigint>"))
    return collections.withColumn("unit_ids", F.when(F.col("collection_id") == collection_id, ids).otherwise(F.col("unit_ids")))


def export_csv(df: DataFrame, path: str) -> None:
    """Every cell quoted, quotes inside cells doubled, with a header."""
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').mode("overwrite").csv(path)


def default_window(units: DataFrame, days: int = 30) -> DataFrame:
    """Units of the last days before the newest one."""
    newest = units.agg(F.date_sub(F.max("unit_date"), days).alias("__since"))
    return units.join(F.broadcast(newest), F.col("unit_date") > F.col("__since")).drop("__since")  # one row
