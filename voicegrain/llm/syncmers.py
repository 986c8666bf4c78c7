"""Document fingerprints from closed syncmers over words, and their positional matching.

A window of 4 words is an anchor if the least hash of its three inner 2-word substrings is that of the first or the last one. The
choice looks at the window alone, so an anchor survives any edit outside of it; about two thirds of the windows are anchors. A
fingerprint holds the SKETCH least anchor hashes of the whole text, or, if there are more of them, all those under BOUND, so that it
grows with the text; each with the place of its first occurrence. Two fingerprints are matched by place: equal anchors are grouped by the
difference of their places, as all anchors of a passage that two texts share have one difference; a group of two or more is a matched
range, and single ones are chance. The likeness is the share of anchors in matched ranges among all that both fingerprints cover. Everything is
native.

Cases: a null text is an empty text, has an empty fingerprint, and is like another empty one (1.0) and unlike any other (0.0); a
text of fewer than 4 words has one anchor, its word sequence, and a likeness that rests on one anchor needs no second one; rows with equal
ids follow each other by text; a null doc_id comes after all others; a table of one row is its own next document; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import let, pairwise, words

SKETCH = 64
_MASK = (1 << 48) - 1
#: A quarter of all hashes.
BOUND = 1 << 46
FINGERPRINT = "array<struct<hash:bigint,position:int>>"


def anchors(text: Column) -> Column:
    """array<struct<position, hash>>: the closed syncmers of a text, by the position of their first word."""
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))

    def chosen(h: Column) -> Column:
        def closed(s: Column) -> Column:
            windows = F.sequence(F.lit(0), F.size(s) - 3)
            found = F.transform(
                windows,
                lambda i: F.when(
                    F.get(s, i + 1) >= F.least(F.get(s, i), F.get(s, i + 2)),
                    F.struct(i.alias("position"), F.xxhash64(F.get(s, i), F.get(s, i + 2)).bitwiseAND(_MASK).alias("hash")),
                ),
            )
            whole = F.array(F.struct(F.lit(0).alias("position"), F.xxhash64(h).bitwiseAND(_MASK).alias("hash")))
            return (
                F.when(F.size(s) >= 3, F.filter(found, lambda x: x.isNotNull()))
                .when(F.size(h) > 0, whole)
                .otherwise(F.slice(whole, 1, 0))
            )

        return let(pairwise(h, 1, lambda a, b: F.xxhash64(a, b)), closed)

    return let(hashes, chosen)


def _firsts(ordered: Column) -> Column:
    """Of sorted structs, the first one of each hash."""
    return let(
        ordered, lambda o: F.filter(o, lambda x, i: (i == 0) | (x["hash"] != F.coalesce(F.get(o, i - 1)["hash"], F.lit(-1))))
    )


def _covered(hashes: Column, size: int) -> Column:
    """How many of some ascending hashes a fingerprint holds."""
    return F.least(F.size(hashes), F.greatest(F.lit(size), F.size(F.filter(hashes, lambda h: h < BOUND))))


def sketch(text: Column, size: int = SKETCH) -> Column:
    """The fingerprint: FINGERPRINT, by hash."""
    placed = F.array_sort(F.transform(anchors(text), lambda a: F.struct(a["hash"].alias("hash"), a["position"].alias("position"))))
    return let(_firsts(placed), lambda f: F.slice(f, F.lit(1), _covered(F.transform(f, lambda x: x["hash"]), size)))


def _matching(a: Column, b: Column, size: int, use) -> Column:
    """use(covered, ranges): how many anchors both fingerprints cover, and array<struct<shift, start, end, anchors>> of the matched ranges
    in a, by the place of their first and last anchor."""
    tagged = lambda f, side: F.transform(f, lambda x: F.struct(x["hash"].alias("hash"), F.lit(side).alias("side"), x["position"].alias("position")))

    def found(m: Column, n: Column, limit: Column) -> Column:
        before = lambda i: F.get(m, i - 1)
        same = F.transform(
            m,
            lambda x, i: F.when(
                (x["side"] == 1) & (before(i)["hash"] == x["hash"]) & (x["hash"] <= limit),
                F.struct((x["position"] - before(i)["position"]).alias("shift"), before(i)["position"].alias("position")),
            ),
        )
        pairs = F.array_sort(F.filter(same, lambda x: x.isNotNull()))

        def grouped(p: Column) -> Column:
            heads = F.filter(
                F.transform(p, lambda x, i: F.when((i == 0) | (x["shift"] != F.coalesce(F.get(p, i - 1)["shift"], F.lit(0))), i)), lambda i: i.isNotNull()
            )

            def one(i: Column, last: Column) -> Column:
                first = F.get(p, i)
                return F.struct(first["shift"].alias("shift"), first["position"].alias("start"), F.get(p, last)["position"].alias("end"), (last - i + 1).alias("anchors"))

            groups = let(heads, lambda h: F.transform(h, lambda i, k: one(i, F.coalesce(F.get(h, k + 1), F.size(p)) - 1)))
            return F.filter(groups, lambda g: g["anchors"] >= F.least(n, F.lit(2)))

        return use(n, let(pairs, grouped))

    def run(m: Column) -> Column:
        hashes = F.transform(_firsts(m), lambda x: x["hash"])
        return let(hashes, lambda h: let(_covered(h, size), lambda n: found(m, n, F.get(h, n - 1))))

    return let(F.array_sort(F.concat(tagged(a, 0), tagged(b, 1))), run)


def matched_ranges(a: Column, b: Column, size: int = SKETCH) -> Column:
    """array<struct<start, other_start, words, anchors>>: what two texts share, by words, as their fingerprints a and b tell."""
    window = 4
    told = lambda g: F.struct(
        g["start"].alias("start"), (g["start"] + g["shift"]).alias("other_start"), (g["end"] - g["start"] + window).alias("words"), g["anchors"].alias("anchors")
    )
    return _matching(a, b, size, lambda n, ranges: F.transform(ranges, told))


def likeness(a: Column, b: Column, size: int = SKETCH) -> Column:
    """Share of the covered anchors that lie in matched ranges, 0 to 1; 1 for two empty fingerprints."""
    total = lambda n, ranges: F.aggregate(ranges, F.lit(0), lambda acc, g: acc + g["anchors"]) / F.greatest(n, F.lit(1))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(_matching(a, b, size, total))


def as_text(fingerprint: Column) -> Column:
    """For each anchor its hash and, after a colon, its place; with a blank between."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat(F.lpad(F.lower(F.hex(x["hash"])), 12, "0"), F.lit(":"), x["position"])), " ")


def with_next(documents: DataFrame, ranges: int | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """documents (doc_id, text, and others), with next: a struct of the row that follows by descending doc_id, the first one after the last.

    more: further columns, which are computed once the rows are dealt out, so that they are not shuffled.

    Rows are dealt to ranges of ids whose bounds are ids of the table, and each bound's row is also handed to the range
    below it, where it follows the least id. So one shuffle does, and no window spans the whole table.
    """
    spark = documents.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.coalesce("doc_id", F.lit(-(1 << 63)))
    names = [*documents.columns, *(more or {})]
    cuts = documents.agg(
        F.percentile_approx(at, [(i + 1) / ranges for i in range(ranges)], max(10_000, 10 * ranges)).alias("cuts"), F.max(at).alias("top")
    ).head()
    bounds = sorted({*(cuts["cuts"] or []), *([] if cuts["top"] is None else [cuts["top"]])})
    steps = max(1, len(bounds)).bit_length()
    splits = F.lit(bounds) if bounds else F.array().cast("array<bigint>")
    # how many bounds are less than the id, by bisection
    below = F.aggregate(
        F.lit([1 << (steps - 1 - i) for i in range(steps)]),
        F.lit(0),
        lambda acc, step: F.when(F.get(splits, acc + step - 1) < F.col("__at"), acc + step).otherwise(acc),
    )
    placed = documents.withColumn("__at", at).withColumn("__range", below)
    own = F.struct(F.col("__range").alias("range"), F.lit(0).alias("extra"))
    up = F.when(F.col("__range") == len(bounds) - 1, F.lit(0)).otherwise(F.col("__range") + 1)
    edge = F.get(splits, F.col("__range")) == F.col("__at")
    dealt = placed.withColumn(
        "__to", F.explode(F.when(edge, F.array(own, F.struct(up.alias("range"), F.lit(1).alias("extra")))).otherwise(F.array(own)))
    )
    order = Window.partitionBy("__to.range").orderBy(F.col("__to.extra"), F.col("__at").desc(), F.col("text"))
    following = F.lead(F.struct(*names)).over(order)
    dealt = dealt.repartition("__to.range").withColumns(more or {})
    return dealt.withColumn("next", following).where(F.col("__to.extra") == 0).drop("__at", "__range", "__to")


def edited_pairs(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited (text), fp, edited_fp, near_edited, near_next for each row."""
    text = F.coalesce("text", F.lit(""))
    ready = documents.select("doc_id", text.alias("text"))
    pairs = with_next(ready, more={"fp": sketch(F.col("text"))}).withColumn("n_chars", F.length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring(F.col("next.text"), F.lit(1), half))
    pairs = pairs.select("doc_id", "n_chars", "fp", F.col("next.fp").alias("next_fp"), edited.alias("edited"))
    pairs = pairs.withColumn("edited_fp", sketch(F.col("edited")))
    return pairs.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited",
        "fp",
        "edited_fp",
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
