"""The topic tree: paths, roll-ups, search, edits, versions, review of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.cells import cut


def paths(nodes: DataFrame) -> DataFrame:
    """node_id, root, depth (a root's is 0), path of labels, ancestors (array, the node itself last), of trees of any depth.

    Every node holds the way up to some ancestor and takes over that one's way in each round, so that ways double and a tree of depth d
    takes log2(d) rounds. Nodes whose ancestors end at a missing one are left out; a cycle is an error.
    """
    ways = nodes.select("node_id", F.col("parent_id").alias("up"), F.col("label").alias("path"), F.array("node_id").alias("ancestors"))
    looped = F.col("up").isNotNull() & F.array_contains("ancestors", F.col("up"))
    while True:
        ways = cut(ways)
        left = ways.agg(F.count_if(F.col("up").isNotNull()).alias("open"), F.count_if(looped).alias("looped")).head()
        if left["looped"]:
            raise ValueError("the tree has a cycle")
        if not left["open"]:
            return ways.select("node_id", F.col("ancestors")[0].alias("root"), (F.size("ancestors") - 1).alias("depth"), "path", "ancestors")
        above = ways.select(F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("path").alias("above"), F.col("ancestors").alias("over"))
        longer = ways.where("up is not null").join(above, "up").select("node_id", F.col("next").alias("up"), F.concat_ws(" > ", "above", "path").alias("path"), F.concat("over", "ancestors").alias("ancestors"))
        ways = ways.where("up is null").unionByName(longer)


def intervals(nodes: DataFrame) -> DataFrame:
    """node_id, parent_id, lo, hi, total: places in a walk from the roots down, siblings by node_id; lo to hi is a node's subtree, total its weight.

    The walk enters and leaves every node once. Steps are ranked by pointer jumping: each holds the sum of what lies before its pointer, and
    both double in log2(2 n) rounds, however deep the trees are. A subtree's size and weight are the difference of its two steps, and ancestry is
    a comparison of numbers. Nodes under a missing one are left out; a cycle is an error. Siblings are put in order by one window for each parent.
    """
    row = nodes.select("node_id", "parent_id", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    first = row.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.min("node_id").alias("child"))
    beside = row.withColumn("beside", F.lead("node_id").over(Window.partitionBy("parent_id").orderBy("node_id"))).join(first, "node_id", "left")
    step = lambda way, of: F.concat(F.lit(way), F.col(of))
    enter = F.struct(step("in ", "node_id").alias("step"), F.coalesce(step("in ", "child"), step("out ", "node_id")).alias("next"), F.lit(1).cast("long").alias("n"), F.col("weight").alias("w"))
    leave = F.struct(step("out ", "node_id").alias("step"), F.coalesce(step("in ", "beside"), step("out ", "parent_id")).alias("next"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("w"))
    steps = beside.select(F.explode(F.array(enter, leave)).alias("s")).select("s.*")
    rounds = None
    while True:
        steps = cut(steps)
        left = steps.agg(F.count("*").alias("all"), F.count("next").alias("open"), F.max("n").alias("n")).head()
        if not left["open"]:
            break
        rounds = left["all"].bit_length() + 1 if rounds is None else rounds - 1
        if rounds == 0:
            raise ValueError("the tree has a cycle")
        ahead = steps.select(F.col("step").alias("next"), F.col("next").alias("after"), F.col("n").alias("more"), F.col("w").alias("heavier"))
        longer = steps.where("next is not null").join(ahead, "next").select("step", F.col("after").alias("next"), (F.col("n") + F.col("more")).alias("n"), (F.col("w") + F.col("heavier")).alias("w"))
        steps = steps.where("next is null").unionByName(longer)
    within = lambda way, n, w: steps.where(F.col("step").startswith(way)).select(F.substr("step", F.lit(len(way) + 1)).alias("node_id"), F.col("n").alias(n), F.col("w").alias(w))
    both = within("in ", "from", "w_from").join(within("out ", "upto", "w_upto"), "node_id").join(row.select("node_id", "parent_id"), "node_id")
    lo = F.lit(left["n"] or 0) - F.col("from") + 1
    return both.select("node_id", "parent_id", lo.alias("lo"), (lo + F.col("from") - F.col("upto") - 1).alias("hi"), F.round(F.col("w_from") - F.col("w_upto"), 2).alias("total"))


def subtree(numbers: DataFrame, node_id: str) -> DataFrame:
    """The rows of intervals() that lie in a node's subtree, itself included."""
    top = numbers.where(F.col("node_id") == node_id).select(F.col("lo").alias("from"), F.col("hi").alias("upto"))
    return numbers.join(F.broadcast(top), (F.col("lo") >= F.col("from")) & (F.col("lo") <= F.col("upto"))).drop("from", "upto")  # one row


def move_interval(numbers: DataFrame, node_id: str, parent_id: str) -> DataFrame:
    """What intervals() gives after move(): only the nodes between the old and the new place, and the sizes of their ancestors, change.

    A move below the node itself, and one of or to a node that is not there, change nothing.
    """
    of = lambda name: numbers.where(F.col("node_id") == name)
    block = of(node_id).select(F.col("lo").alias("a"), F.col("hi").alias("b"), F.col("total").alias("w"))
    target = of(parent_id).select(F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"))
    elder = numbers.where((F.col("parent_id") == parent_id) & (F.col("node_id") < node_id)).agg(F.max("hi").alias("elder"))
    told = numbers.join(F.broadcast(block.join(target, F.lit(True)).join(elder, F.lit(True))), F.lit(True), "left")  # one row
    a, b, size = F.col("a"), F.col("b"), F.col("b") - F.col("a") + 1
    after = F.coalesce("elder", "p_lo")  # the block's new place is behind this number
    mine = F.col("lo").between(a, b)
    shift: Column = (
        F.when(mine, F.when(after > b, after - b).otherwise(after + 1 - a))
        .when((F.col("lo") > b) & (F.col("lo") <= after), -size)
        .when((F.col("lo") < a) & (F.col("lo") > after), size)
        .otherwise(F.lit(0))
    )
    loses = (~mine & (F.col("lo") < a) & (F.col("hi") >= b)).cast("long")
    gains = (~mine & (F.col("lo") <= F.col("p_lo")) & (F.col("hi") >= F.col("p_hi"))).cast("long")
    moves = F.coalesce(~F.col("p_lo").between(a, b), F.lit(False))
    lo = F.col("lo") + F.when(moves, shift).otherwise(F.lit(0))
    grown = F.when(moves, gains - loses).otherwise(F.lit(0))
    return told.select(
        "node_id",
        F.when(moves & (F.col("node_id") == node_id), F.lit(parent_id)).otherwise(F.col("parent_id")).alias("parent_id"),
        lo.alias("lo"),
        (lo + F.col("hi") - F.col("lo") + grown * F.coalesce(size, F.lit(0))).alias("hi"),
        F.round(F.col("total") + grown * F.coalesce("w", F.lit(0.0)), 2).alias("total"),
    )


def subtree_totals(nodes: DataFrame, walked: DataFrame) -> DataFrame:
    """node_id, total weight and number of nodes in its subtree, itself included."""
    each = walked.select("node_id", F.explode("ancestors").alias("ancestor")).join(nodes.select("node_id", "weight"), "node_id")
    return each.groupBy(F.col("ancestor").alias("node_id")).agg(F.round(F.sum("weight"), 2).alias("total"), F.count("*").alias("n_nodes"))


def search(nodes: DataFrame, walked: DataFrame, needle: str) -> DataFrame:
    """Nodes whose label holds the needle, or with a descendant whose label does."""
    hits = nodes.where(F.contains(F.lower("label"), F.lit(needle.lower()))).select("node_id")
    kept = walked.join(hits, "node_id", "left_semi").select(F.explode("ancestors").alias("node_id")).distinct()
    return nodes.join(kept, "node_id", "left_semi")


def children(nodes: DataFrame, node_id: str | None) -> DataFrame:
    return nodes.where(F.col("parent_id").isNull() if node_id is None else F.col("parent_id") == node_id)


def rename(nodes: DataFrame, node_id: str, label: str) -> DataFrame:
    return nodes.withColumn("label", F.when(F.col("node_id") == node_id, F.lit(label)).otherwise(F.col("label")))


def move(nodes: DataFrame, node_id: str, parent_id: str) -> DataFrame:
    return nodes.withColumn("parent_id", F.when(F.col("node_id") == node_id, F.lit(parent_id)).otherwise(F.col("parent_id")))


def merge(nodes: DataFrame, source: str, target: str) -> DataFrame:
    """The target takes over the source's weight and children; the source goes."""
    moved = nodes.where(F.col("node_id") == source).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("moved"))
    return (
        nodes.where(F.col("node_id") != source)
        .join(F.broadcast(moved), F.lit(True))  # one row
        .withColumn("weight", F.when(F.col("node_id") == target, F.round(F.col("weight") + F.col("moved"), 2)).otherwise(F.col("weight")))
        .withColumn("parent_id", F.when(F.col("parent_id") == source, F.lit(target)).otherwise(F.col("parent_id")))
        .drop("moved")
    )


def repoint(units: DataFrame, merges: DataFrame) -> DataFrame:
    """Units of merged topics under their merge target (merges: topic_id, merge_target)."""
    return units.join(merges, "topic_id", "left").withColumn("topic_id", F.coalesce("merge_target", "topic_id")).drop("merge_target")


def reclassify(units: DataFrame, overrides: DataFrame) -> DataFrame:
    """Units with a reviewer's topic where there is one; of several the last (overrides: unit_id, new_topic, at)."""
    last = overrides.groupBy("unit_id").agg(F.max_by("new_topic", "at").alias("new_topic"))
    return units.join(last, "unit_id", "left").withColumn("topic_id", F.coalesce("new_topic", "topic_id")).drop("new_topic")


def as_of(units: DataFrame, versions: DataFrame) -> DataFrame:
    """Units with the version of their topic that was valid at their time (versions: topic_id, version, valid_from, valid_to)."""
    v = versions.withColumnRenamed("topic_id", "v_topic")
    on = (F.col("topic_id") == F.col("v_topic")) & (F.col("unit_date") >= F.col("valid_from")) & (F.col("unit_date") < F.col("valid_to"))
    return units.join(v, on, "left").drop("v_topic", "valid_from", "valid_to")


def promote(units: DataFrame, least: int = 5) -> DataFrame:
    """Candidate topics that enough units on new topics support."""
    return units.where("is_new_topic").groupBy("topic_id").agg(F.count("*").alias("support")).where(F.col("support") >= least)
