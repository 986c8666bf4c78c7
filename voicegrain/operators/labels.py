"""Labels that differ by a few characters only: pairs by edit distance, one label for each group, and what is stored under labels merged.

Two texts within d edits share one of the d + 1 parts into which the shorter one is cut, at nearly the same place: fewer than d + 1 edits leave a part
untouched. So each label names its own parts, looks for parts of labels that are as long or up to d shorter, and only labels that meet are compared.
Of the parts that d edits leave untouched there is one, part i (from 0), with at most i edits before it and at most d - i after it (the multi-match
rule of PassJoin), so that it lies no more than i places from where the shorter label has it, and no more than d - i if both are counted from the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import cut
from .similarity import leaders

#: Characters that a task takes at a time, if a text is not longer.
CHUNK = 1 << 20


def longest_word(text: Column) -> Column:
    """What rules.longest_word gives, for whole texts: the longest word in lower case, of equally long ones the last by text; empty without any."""

    @F.arrow_udf("string")
    def longest(low: pa.Array) -> pa.Array:
        texts = low.to_pylist()
        ends = np.cumsum([len(t) + 1 for t in texts])
        out: list[str] = []
        while len(out) < len(texts):
            begin = len(out)
            before = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + CHUNK, side="right")))
            joined = "\n".join(texts[begin:end]) + "\n"
            x = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            letter = np.zeros(len(x) + 1, np.int8)  # no word reaches over the end of a text
            letter[1:] = ((x >= 97) & (x <= 122)) | ((x >= 224) & (x <= 255))
            step = np.diff(letter)
            first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            of, size = np.searchsorted(ends[begin:end] - before, first, side="right"), last - first
            most = np.zeros(end - begin, np.int64)
            np.maximum.at(most, of, size)
            best = [""] * (end - begin)
            for i in np.flatnonzero(size == most[of]).tolist():
                word = joined[first[i] : last[i]]
                best[of[i]] = max(best[of[i]], word)
            out += best
        return pa.array(out, pa.string())

    return longest.asNondeterministic()(F.lower(F.coalesce(text, F.lit(""))))  # so that a filter of the words does not find them a second time


def _parts(size: Column, distance: int) -> list[tuple[Column, Column]]:
    """Begin (from 0) and length of the parts of a text of a size: nearly equal ones, the longer ones last."""
    n = distance + 1
    short = F.floor(size / n).cast("int")
    longer = size - short * n
    out = []
    for i in range(n):
        before = F.greatest(F.lit(0), F.lit(i - n) + longer)  # of the longer ones, those that lie before part i
        out.append((short * i + before, short + F.when(F.lit(i) >= n - longer, 1).otherwise(0)))
    return out


def _key(size: Column, i: int, part: Column) -> Column:
    return F.struct(size.alias("size"), F.lit(i).alias("i"), part.alias("part"))


def near_labels(labels: DataFrame, distance: int = 1) -> DataFrame:
    """a, b, edits: all pairs of different labels (column label) at most so many edits (insert, delete, replace a character) apart, a < b.

    Repeated labels count once; null ones are near nothing; case counts. A part that very many labels share makes one key of the join large, which is a
    sort-merge join that Spark can split.
    """
    if distance < 1:
        raise ValueError("distance must be at least 1")
    each = cut(labels.select(F.col("label").cast("string").alias("label")).where("label IS NOT NULL").distinct())
    size = F.length("label")
    own = F.array(*(_key(size, i, F.substring(F.col("label"), begin + 1, n)) for i, (begin, n) in enumerate(_parts(size, distance))))
    sought = []
    for less in range(distance + 1):
        shorter = size - less
        for i, (begin, n) in enumerate(_parts(F.greatest(shorter, F.lit(0)), distance)):
            for shift in range(max(-i, less - (distance - i)), min(i, less + distance - i) + 1):
                at = begin + shift
                inside = (shorter >= 0) & (at >= 0) & (at + n <= size)
                sought.append(F.when(inside, _key(shorter, i, F.substring(F.col("label"), at + 1, n))))
    left = each.select(F.col("label").alias("x"), F.explode(own).alias("key"))
    right = each.select(F.col("label").alias("y"), F.explode(F.array_distinct(F.array_compact(F.array(*sought)))).alias("key"))
    edits = F.levenshtein("x", "y", distance)
    once = (F.length("x") < F.length("y")) | (F.col("x") < F.col("y"))  # y is as long or longer; equally long ones meet from either side
    met = left.hint("merge").join(right, "key").where(once)
    near = met.select("x", "y", edits.alias("edits")).where(F.col("edits").between(1, distance))
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "edits").distinct()


def unified(labels: DataFrame, distance: int = 1) -> DataFrame:
    """label, weight, canonical: labels (label, weight long) in order of falling weight, equal ones by text. One that is near an earlier canonical one
    takes the nearest such (of equally near ones the first), the others are canonical. Weights of one label are added up; a null weight is 0."""
    total = labels.where("label IS NOT NULL").groupBy("label").agg(F.sum(F.coalesce("weight", F.lit(0))).cast("long").alias("weight"))
    placed = cut(total.orderBy(F.desc("weight"), "label").withColumn("seq", F.monotonically_increasing_id()))  # ascending with the ranges of the sort
    name = lambda c, s: placed.select(F.col("label").alias(c), F.col("seq").alias(s))
    near = near_labels(placed, distance).join(name("a", "i"), "a").join(name("b", "j"), "b")
    pairs = near.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), (-F.col("edits")).cast("double").alias("sim"))
    chosen = leaders(placed, pairs).select("seq", "canonical_seq")
    return placed.join(chosen, "seq").join(name("canonical", "canonical_seq"), "canonical_seq").select("label", "weight", "canonical")


def relabelled(rows: DataFrame, unified_labels: DataFrame, column: str = "label") -> DataFrame:
    """rows with the canonical label in place of each one's own; labels that are not among the unified ones, and nulls, stay."""
    there, here = "__own", "__canonical"
    while there in rows.columns or here in rows.columns:
        there, here = there + "_", here + "_"
    names = unified_labels.select(F.col("label").alias(there), F.col("canonical").alias(here))
    out = rows.join(names, F.col(column) == F.col(there), "left").withColumn(column, F.coalesce(F.col(here), F.col(column)))
    return out.drop(there, here)
