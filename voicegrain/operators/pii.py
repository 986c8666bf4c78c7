"""Redaction of personal data by seven patterns (and entity spans from a backend, if given), as column expressions only.

mode "reference": spans of all patterns, in their order, are merged where they overlap; the earlier span names the whole, and of
spans with one start the one of the earlier pattern. mode "strict" asks for a keyword that is a word of its own before
an account number, and lets the longest of overlapping spans name the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, matches, overlaps, replace_spans

# The patterns of the seven kinds.
PATTERNS: tuple[tuple[str, str], ...] = (
    ("EMAIL", r"(?i)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("PHONE", r"(?:\+?1[\s\-.]?)?(?:\(?\d{3}\)?[\s\-.]?)\d{3}[\s\-.]?\d{4}"),
    (
        "CREDIT_CARD",
        r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12}|(?:[0-9]{4}[\s\-]?){3}[0-9]{4})\b",
    ),
    ("SSN", r"\b\d{3}[- ]?\d{2}[- ]?\d{4}\b"),
    ("IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"),
    ("URL", r"(?i)https?://[^\s<>\"]+|www\.[^\s<>\"]+"),
    ("ACCOUNT_NUM", r"(?i)(?:account|order|ticket|ref|reference|id|#|no\.?)\s*[:\-]?\s*([A-Za-z0-9\-]{6,20})"),
)
# What a text must have for a pattern to match at all, which is quicker to look for; a kind without one is always searched.
NEEDED = {"EMAIL": "@", "PHONE": "[0-9]{3}", "CREDIT_CARD": "[0-9]{4}", "SSN": "[0-9]{3}", "IP_ADDRESS": r"[0-9]\.[0-9]", "URL": r"://|[wW]\."}
STRICT_ACCOUNT = r"(?i)(?:\b(?:account|order|ticket|ref|reference|id|no\.?)|#)\s*[:\-]?\s*(?:(?:is|number|id)\s+)?([A-Za-z0-9\-]*[0-9][A-Za-z0-9\-]{4,})"
# Kind of named entity to kind of personal data, for an entity backend.
ENTITY_KINDS = {"PERSON": "PERSON_NAME", "ORG": "ORG_NAME", "GPE": "ADDRESS", "LOC": "ADDRESS", "FAC": "ADDRESS"}

SPAN = "struct<start:int,entity:int,rank:int,end:int,kind:string>"


def _found(text: Column, rank: int, kind: str, pattern: str) -> Column:
    """Spans of one pattern. Where the pattern has a group it ends the match, and the span is the group's."""
    span = lambda m: F.struct(
        m["start"].alias("start"), F.lit(0).alias("entity"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")
    )
    if kind == "ACCOUNT_NUM":
        pattern = pattern.replace("(?i)", "(?i)(?=[aotrin#])", 1)  # the keywords' first letters, which is quicker than to try each keyword everywhere
    found = F.transform(matches(text, pattern, 1 if kind == "ACCOUNT_NUM" else 0), span)
    if kind not in NEEDED:
        return found
    there = F.contains(text, F.lit("@")) if kind == "EMAIL" else F.rlike(text, F.lit(NEEDED[kind]))
    return F.when(text.isNull(), F.lit(None)).when(there, found).otherwise(F.array().cast(f"array<{SPAN}>"))


def regex_spans(text: Column, mode: str = "reference") -> Column:
    """array<SPAN> of all patterns, in their order."""
    rules = [(k, STRICT_ACCOUNT if mode == "strict" and k == "ACCOUNT_NUM" else p) for k, p in PATTERNS]
    return F.concat(*(_found(text, i, kind, pattern) for i, (kind, pattern) in enumerate(rules)))


def merge_spans(spans: Column, mode: str = "reference") -> Column:
    """Sorts by (start, pattern before entity, order) and joins what overlaps; spans that only touch stay apart."""

    def named(s: Column, g: Column) -> Column:
        if mode != "strict":
            return F.get(s, g["first"])["kind"]
        inside = F.slice(s, g["first"] + 1, g["last"] - g["first"] + 1)
        return F.array_max(F.transform(inside, lambda x, i: F.struct((x["end"] - x["start"]).alias("n"), (-i).alias("i"), x["kind"].alias("kind"))))["kind"]

    def joined(s: Column, g: Column) -> Column:
        first = F.get(s, g["first"])
        return F.struct(
            first["start"].alias("start"), first["entity"].alias("entity"), first["rank"].alias("rank"), g["end"].alias("end"), named(s, g).alias("kind")
        )

    return bind(F.array_sort(spans), lambda s: F.transform(overlaps(s), lambda g: joined(s, g)))


def apply_spans(text: Column, spans: Column) -> Column:
    """text with each span replaced by [KIND]."""
    label = lambda s: F.concat(F.lit("["), s["kind"], F.lit("]"))
    return replace_spans(text, F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), label(s).alias("label"))))


def redact(records: DataFrame, mode: str = "reference", entities: str | None = None) -> DataFrame:
    """records (raw_text, ...) with clean_text, pii_redacted and pii_spans. entities: a column of further spans (array<SPAN>)."""
    text = F.coalesce("raw_text", F.lit(""))
    spans = regex_spans(text, mode)
    if entities:
        spans = F.concat(spans, F.coalesce(entities, F.array().cast(f"array<{SPAN}>")))
    marked = records.withColumn("pii_spans", merge_spans(spans, mode))
    clean = F.when(F.size("pii_spans") == 0, text).otherwise(apply_spans(text, F.col("pii_spans")))
    return marked.withColumn("clean_text", clean).withColumn("pii_redacted", F.size("pii_spans") > 0)


def counts_by_kind(redacted: DataFrame, *by: str) -> DataFrame:
    return redacted.select(*by, F.explode("pii_spans.kind").alias("pii_type")).groupBy(*by, "pii_type").agg(F.count("*").alias("n"))
