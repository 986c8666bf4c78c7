"""Stored tables in a folder: upsert and insert-ignore as joins, one manifest that makes a batch visible.

A batch writes the rows that it adds to the units, sentiments, batches and indexes as a part of its own, and the topics, which change, as a new
snapshot; then the manifest row that names them. Readers follow the manifest, so a batch is seen whole or not at all, and a batch id that the
manifest has is not applied again. compact() joins the parts into one. One writer at a time.

Vectors of the indexes are stored by cell, a folder each. near() reads only the cells that a batch's vectors can have neighbours in. Pivots come from
the first vectors and anew, in a number that goes with that of the vectors, from compact(), which deals all vectors to them.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import BATCHES, FEEDBACK_UNITS, TOPICS, UNIT_SENTIMENTS
from . import cells
from .similarity import angle_of

TABLES = {"topics": TOPICS, "feedback_units": FEEDBACK_UNITS, "unit_sentiments": UNIT_SENTIMENTS, "batches": BATCHES}
#: What later batches need of earlier ones, appended with each batch: table to schema and key; stored with the cell of each vector.
INDEXES = {
    "dedup_index": ("unit_id string, seq long, embedding array<float>", "unit_id"),
    "topic_index": ("topic_id string, seq long, label string, embedding array<float>", "topic_id"),
}
#: Of the cells: their pivots, and of each part the largest angles and how many vectors there are.
PIVOTS, CELLS = "index_name string, cell int, pivot array<double>", "index_name string, cell int, radius double, n long"


def counted() -> Column:
    """Whether a unit counts for its topic: it is canonical, and its evidence is not known to be made up."""
    return ~F.col("is_duplicate") & F.coalesce(F.col("is_grounded"), F.lit(True))


def topic_deltas(analysed: DataFrame) -> DataFrame:
    """topic_id, delta: new canonical units of each topic; where there is a column is_grounded, without those that are not grounded."""
    canonical = counted() if "is_grounded" in analysed.columns else ~F.col("is_duplicate")
    return analysed.where(canonical & F.col("topic_id").isNotNull()).groupBy("topic_id").agg(F.count("*").alias("delta"))


def upsert_topics(old: DataFrame, new: DataFrame) -> DataFrame:
    """old: TOPICS; new: topic_id, label, description, aliases, delta, intent_type, intent_urgency, at.

    Label and description are overwritten, aliases united, counts added; a stored intent stays.
    """
    n = new.select("topic_id", *(F.col(c).alias(f"n_{c}") for c in new.columns if c != "topic_id"))
    both = old.join(n, "topic_id", "full")
    empty = F.array().cast("array<string>")
    return both.select(
        "topic_id",
        F.coalesce("n_label", "label").alias("label"),
        F.coalesce("n_description", "description").alias("description"),
        F.array_distinct(F.concat(F.coalesce("aliases", empty), F.coalesce("n_aliases", empty))).alias("aliases"),
        (F.coalesce("feedback_count", F.lit(0)) + F.coalesce("n_delta", F.lit(0))).cast("long").alias("feedback_count"),
        F.coalesce("intent_type", "n_intent_type").alias("intent_type"),
        F.coalesce("intent_urgency", "n_intent_urgency").alias("intent_urgency"),
        F.coalesce("created_at", "n_at").alias("created_at"),
        F.coalesce("n_at", "updated_at").alias("updated_at"),
    )


def first_of(rows: DataFrame, key: str) -> DataFrame:
    """Of rows with one key the first one, in the order of all their columns as JSON, however they are dealt."""
    order = F.row_number().over(Window.partitionBy(key).orderBy(F.to_json(F.struct(*rows.columns))))
    return rows.withColumn("__n", order).where("__n = 1").drop("__n")


def absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Those rows of new whose key old lacks; of rows of one key in new, the first one."""
    return first_of(new.join(old.select(key), key, "left_anti").select(*new.columns), key)


def insert_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old, and what absent() gives."""
    return old.unionByName(absent(old, new, key).select(*old.columns))


class Store:
    """The tables in a folder."""

    MANIFEST = "batch_id long, version string, whole boolean"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._seen: tuple[str, ...] = ()
        self._known: tuple[list[str], int | None] = ([], None)

    def _listed(self) -> tuple[str, ...]:
        """The manifest's files; each row of it is one."""
        files = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        where = files.Path(f"{self.path}/manifest")
        system = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(where):
            return ()
        return tuple(sorted(f.getPath().getName() for f in system.listStatus(where) if f.getPath().getName().startswith("part-")))

    def _state(self) -> tuple[list[str], int | None]:
        """The parts that make up the tables, and the last batch; read anew if the manifest has other files than before."""
        listed = self._listed()
        if listed != self._seen:
            m, parts, last = self.spark.read.schema(self.MANIFEST).parquet(f"{self.path}/manifest"), [], None
            ends = m.agg(F.max(F.when(F.col("whole"), F.col("batch_id"))).alias("whole"), F.max("batch_id").alias("last")).head()
            if ends["last"] is not None:
                since = m if ends["whole"] is None else m.where(F.col("batch_id") >= ends["whole"])
                rows = sorted((r["batch_id"], r["whole"], r["version"]) for r in since.collect())  # those since the last compact()
                begin = max((i for i, r in enumerate(rows) if r[1]), default=0)
                parts, last = [version for _, _, version in rows[begin:]], ends["last"]
            self._seen, self._known = listed, (parts, last)
        return self._known

    def versions(self) -> list[str]:
        """The parts that make up the tables, the last one with the topics; one for each batch since the last compact()."""
        return self._state()[0]

    def has(self, batch_id: int) -> bool:
        last = self._state()[1]
        return last is not None and last >= batch_id

    def read(self, name: str, only: list[int] | None = None) -> DataFrame:
        """A table; of an index only the vectors of some cells, where they are told."""
        schema = TABLES[name] if name in TABLES else INDEXES[name][0] + ", cell int" if name in INDEXES else {"pivots": PIVOTS, "cells": CELLS}[name]
        parts = self.versions()
        if not parts:
            rows = self.spark.createDataFrame([], schema)
        elif name in INDEXES:
            reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}")
            rows = reader.parquet(*(f"{self.path}/{name}/part={v}" for v in parts)).drop("part")
        else:
            rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/{name}/{v}" for v in (parts[-1:] if name == "topics" else parts)))
        if name in INDEXES:
            return rows.drop("cell") if only is None else rows.where(F.col("cell").isin(only))  # folders of other cells are not opened
        return rows

    def cells_of(self, name: str) -> cells.Cells | None:
        """The pivots of an index with its radii and sizes; None before it has vectors."""
        found = {r["cell"]: r["pivot"] for r in self.read("pivots").where(F.col("index_name") == name).collect()}  # MAX_CELLS rows at most
        if not found:
            return None
        middle = np.array([found[c] for c in range(len(found))], float)
        return cells.gathered(self.read("cells").where(F.col("index_name") == name), middle)

    def near(self, name: str, batch: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
        """Pairs of a stored vector a and one b of the batch (seq, embedding) with a cosine of at least the threshold, as (a, b, sim), and the stored rows of the cells that were read."""
        at = self.cells_of(name)
        if at is None:
            return self.spark.createDataFrame([], "a long, b long, sim double"), self.read(name)
        visitors = cells.cut(cells.visits(batch, at, angle_of(threshold)))
        touched = sorted(r["cell"] for r in visitors.select("cell").distinct().collect())  # MAX_CELLS at most
        held = self.read(name, touched)
        return cells.across_cells(visitors, held.select("seq", "embedding", "cell"), threshold, ordered=True), held.drop("cell")

    def _put_index(self, name: str, rows: DataFrame, version: str, anew: bool) -> None:
        """Writes an index's rows by cell, their radii, and pivots where there are none yet or new ones are wanted."""
        columns = [c.split()[0] for c in INDEXES[name][0].split(", ")]
        rows = cells.cut(rows.select(*columns))
        at, middle = None if anew else self.cells_of(name), None
        if at is not None:
            middle = at.pivots
        elif not rows.isEmpty():
            middle = cells.pivots(rows)
            told = [(name, i, p.tolist()) for i, p in enumerate(middle)]
            self.spark.createDataFrame(told, PIVOTS).coalesce(1).write.mode("append").parquet(f"{self.path}/pivots/{version}")
        where = f"{self.path}/{name}/part={version}"
        if middle is None:
            rows.withColumn("cell", F.lit(0)).write.partitionBy("cell").parquet(where)
            return
        placed = cells.cut(cells.place(rows, middle).select("seq", "cell", "angle"))
        rows.join(placed.select("seq", "cell"), "seq").select(*columns, "cell").repartition("cell").write.partitionBy("cell").parquet(where)
        stats = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
        stats.select(F.lit(name).alias("index_name"), "cell", "radius", "n").coalesce(1).write.mode("append").parquet(f"{self.path}/cells/{version}")

    def _name(self, batch_id: int, version: str, whole: bool) -> None:
        self.spark.createDataFrame([(batch_id, version, whole)], self.MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def apply(self, batch_id: int, topics: DataFrame, units: DataFrame, sentiments: DataFrame, indexes: dict[str, DataFrame] | None = None, batch: DataFrame | None = None, fresh: bool = False) -> bool:
        """Writes a batch; False if it was applied before. fresh: the store is known to lack the keys of units, sentiments and indexes."""
        if self.has(batch_id):
            return False
        version = f"{batch_id}-{uuid.uuid4().hex}"
        self._begin(version)
        upsert_topics(self.read("topics"), topics).write.parquet(f"{self.path}/topics/{version}")
        missing = lambda name, rows, key: first_of(rows, key) if fresh else absent(self.read(name), rows, key)
        for name, rows in {"feedback_units": units, "unit_sentiments": sentiments}.items():
            missing(name, rows, "unit_id").select(*self.read(name).columns).write.parquet(f"{self.path}/{name}/{version}")
        for name, (schema, key) in INDEXES.items():
            self._put_index(name, missing(name, (indexes or {}).get(name, self.spark.createDataFrame([], schema)), key), version, False)
        done = self.spark.createDataFrame([], BATCHES) if batch is None else batch
        done.select(*self.read("batches").columns).write.parquet(f"{self.path}/batches/{version}")
        self._name(batch_id, version, False)
        return True

    def _begin(self, version: str) -> None:
        """Empty tables of pivots and cells, which a part may add to."""
        for name, schema in {"pivots": PIVOTS, "cells": CELLS}.items():
            self.spark.createDataFrame([], schema).write.parquet(f"{self.path}/{name}/{version}")

    def compact(self) -> None:
        """Joins the parts of every table into one, under the id of the last batch, and deals the vectors of the indexes to new pivots."""
        last = self._state()[1]
        if last is None:
            return
        version = f"{last}-{uuid.uuid4().hex}"
        self._begin(version)
        for name in TABLES:
            self.read(name).write.parquet(f"{self.path}/{name}/{version}")
        for name in INDEXES:
            self._put_index(name, self.read(name), version, True)
        self._name(last, version, True)


def integrity(units: DataFrame, topics: DataFrame, sentiments: DataFrame) -> DataFrame:
    """check, bad: how many rows break each key or reference, and how many topic counts differ from their units."""
    twice = lambda df, key: df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.count("*").alias("bad"))
    canonical = units.select(F.col("unit_id").alias("canonical_id"))
    units = units if "is_grounded" in units.columns else units.withColumn("is_grounded", F.lit(True))
    actual = units.where(counted()).groupBy("topic_id").agg(F.count("*").alias("n"))
    drift = topics.join(actual, "topic_id", "left").where(F.col("feedback_count") != F.coalesce("n", F.lit(0)))
    checks = {
        "topic key": twice(topics, "topic_id"),
        "unit key": twice(units, "unit_id"),
        "unit to canonical": units.where("canonical_id is not null").join(canonical, "canonical_id", "left_anti").select(F.count("*").alias("bad")),
        "unit to topic": units.where("topic_id is not null").join(topics, "topic_id", "left_anti").select(F.count("*").alias("bad")),
        "sentiment to unit": sentiments.join(units, "unit_id", "left_anti").select(F.count("*").alias("bad")),
        "topic count": drift.select(F.count("*").alias("bad")),
    }
    out = None
    for name, df in checks.items():
        row = df.select(F.lit(name).alias("check"), F.col("bad"))
        out = row if out is None else out.unionByName(row)
    return out
