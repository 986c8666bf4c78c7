"""Splitting records into atomic feedback units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_fences
from ..schemas import UNITS
from .backend import Backend, prompt

#: Every character belongs to one segment: text up to and with its closing marks or line ends.
SEGMENT = r"[^.!?\n]*[.!?\n]+|[^.!?\n]+"
#: So many characters must agree for an offset to be accepted, and so many are searched for otherwise.
ACCEPT_CHARS, SEARCH_CHARS = 15, 20


def unit_id(cfo_id: Column, index: Column) -> Column:
    """The same record always gives the same ids, so that redelivery is recognised."""
    return F.sha2(F.concat_ws("|", cfo_id, index.cast("string")), 256)


def sentences(records: DataFrame, text: str = "clean_text") -> DataFrame:
    """The rule backend: one unit for each sentence or line. id, unit_index, text, char_start, char_end; blank records have none."""
    parts = records.select("id", F.posexplode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SEGMENT), F.lit(0))).alias("unit_index", "segment"))
    before = Window.partitionBy("id").orderBy("unit_index").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("at", F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0)))
    bare = F.trim("segment")
    lead = F.length("segment") - F.length(F.ltrim("segment"))
    return (
        placed.where(F.length(F.regexp_replace("segment", r"[\s.!?]", "")) > 0)
        .select("id", "unit_index", F.regexp_replace(bare, r"\n+$", "").alias("text"), (F.col("at") + lead).cast("int").alias("char_start"))
        .withColumn("char_end", (F.col("char_start") + F.length("text")).cast("int"))
    )


def repair_offsets(unit: Column, start: Column, end: Column, original: Column) -> Column:
    """struct<char_start, char_end>: clamped, then accepted if the text there starts like the unit, else searched for, else kept."""
    n = F.length(original)
    low = F.greatest(F.lit(0), F.least(start, n))
    high = F.greatest(low, F.least(end, n))
    there = F.lower(F.trim(F.substring(original, low + 1, high - low)))
    agrees = F.startswith(there, F.lower(F.left(unit, F.lit(ACCEPT_CHARS))))
    found = F.instr(F.lower(original), F.lower(F.left(unit, F.lit(SEARCH_CHARS))))
    moved = (~agrees) & (found > 0)
    return F.struct(
        F.when(moved, found - 1).otherwise(low).cast("int").alias("char_start"),
        F.when(moved, found - 1 + F.length(unit)).otherwise(high).cast("int").alias("char_end"),
    )


def parse_units(answers: DataFrame) -> DataFrame:
    """answers (id, text, raw) to units: id, unit_index, text, char_start, char_end, error.

    Items without text are skipped and leave a gap in unit_index. No valid item, or an answer that isn't a JSON array, gives the
    whole text as one unit; the latter also an error. Blank texts have no units.
    """
    bare = strip_fences(F.col("raw"))
    is_array = F.coalesce(F.startswith(bare, F.lit("[")) & F.try_parse_json(bare).isNotNull(), F.lit(False))
    items = F.filter(
        F.transform(
            F.coalesce(F.from_json(bare, UNITS), F.array().cast(UNITS)),
            lambda x, i: F.struct(
                i.alias("unit_index"),
                F.regexp_replace(F.coalesce(x["text"], F.lit("")), r"^\s+|\s+$", "").alias("text"),
                F.coalesce(x["char_start"], F.lit(0)).alias("char_start"),
                F.coalesce(x["char_end"], F.length("text")).alias("char_end"),
            ),
        ),
        lambda x: x["text"] != F.lit(""),
    )
    whole = F.array(F.struct(F.lit(0).alias("unit_index"), F.col("text").alias("text"), F.lit(0).alias("char_start"), F.length("text").alias("char_end")))
    read = answers.where(F.rlike("text", F.lit(r"(?U)\S"))).select(
        "id", F.col("text").alias("original"), F.when(is_array & (F.size(items) > 0), items).otherwise(whole).alias("items"), (~is_array).alias("failed")
    )
    each = read.select("id", "original", "failed", F.inline("items"))
    fixed = each.withColumn("at", repair_offsets(F.col("text"), F.col("char_start"), F.col("char_end"), F.col("original")))
    return fixed.select(
        "id",
        "unit_index",
        "text",
        "at.char_start",
        "at.char_end",
        F.when(F.col("failed"), F.lit("unitize: not a JSON array")).alias("error"),
    )


def with_metadata(units: DataFrame, records: DataFrame) -> DataFrame:
    """Units with their id and the eight fields that they carry over from their record."""
    carried = records.select(
        "id",
        F.struct(
            F.col("source_channel"),
            F.col("source_metadata.survey_question"),
            F.col("source_metadata.star_rating"),
            F.col("source_metadata.platform"),
            F.col("user_metadata.segment").alias("user_segment"),
            F.col("user_metadata.geography"),
            F.col("user_metadata.anonymized_user_id").alias("anonymized_uid"),
            F.col("timestamps.feedback_created"),
        ).alias("metadata"),
    )
    return units.join(carried, "id", "left").withColumn("unit_id", unit_id(F.col("id"), F.col("unit_index")))


def model_units(records: DataFrame, backend: Backend) -> DataFrame:
    """Units as a model splits the records (id, clean_text, source_channel, source_metadata, user_metadata): what parse_units gives."""
    text = F.coalesce("clean_text", F.lit(""))
    context = {
        "channel": F.col("source_channel"),
        "survey_question": F.col("source_metadata.survey_question"),
        "star_rating": F.col("source_metadata.star_rating"),
        "segment": F.col("user_metadata.segment"),
    }
    asked = prompt("unitize", text, **context)
    answers = backend.complete(records.select("id", text.alias("text"), (text if backend.plain else asked).alias("prompt")), "unitize")
    units = parse_units(answers.select("id", "text", "raw"))
    failed = answers.where("error is not null").select("id", F.col("error").alias("call_error"))
    return units.join(failed, "id", "left").withColumn("error", F.coalesce("call_error", "error")).drop("call_error")


def unit_counts(units: DataFrame) -> DataFrame:
    """id, unit_count, is_atomic."""
    return units.groupBy("id").agg(F.count("*").alias("unit_count")).withColumn("is_atomic", F.col("unit_count") <= 1)
