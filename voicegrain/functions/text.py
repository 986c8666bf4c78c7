"""Scalar text functions: fences, model protocols, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ACCOUNT, COMBINED, INTENT, SENTIMENT


def is_blank(text: Column) -> Column:
    return ~F.rlike(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S"))


def strip_fences(raw: Column) -> Column:
    """Takes a markdown code fence off a model's answer, and white space off both ends."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.regexp_replace(bare, r"^\s+|\s+$", "")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parse_topic(raw: Column) -> Column:
    """The four-line protocol LABEL, DESCRIPTION, EVIDENCE, CONFIDENCE to a struct; of repeated lines the last one holds."""

    def last(name: str) -> Column:
        found = F.regexp_extract_all(raw, F.lit(f"(?m)^{name}:(.*)$"), F.lit(1))
        return _strip(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("")))

    spans = F.filter(F.transform(F.split(last("EVIDENCE"), ","), _strip), lambda s: s != F.lit(""))
    return F.struct(
        last("LABEL").alias("label"),
        last("DESCRIPTION").alias("description"),
        spans.alias("evidence"),
        F.coalesce(last("CONFIDENCE").try_cast("double"), F.lit(0.0)).alias("confidence"),
    )


def _json(raw: Column, schema: str) -> tuple[Column, Column]:
    """Parsed struct, its numbers and flags as strings, and whether the answer was JSON at all."""
    bare = strip_fences(raw)
    return F.from_json(bare, schema.replace("double", "string").replace("boolean", "string")), F.try_parse_json(bare).isNotNull()


def _number(x: Column) -> Column:
    """Models write numbers with and without quotes; what is no number is 0."""
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def _sentiment(s: Column) -> Column:
    emotions = F.transform(s["emotions"], lambda e: F.struct(e["emotion"].alias("emotion"), _number(e["confidence"]).alias("confidence")))
    aspects = F.transform(
        s["aspect_sentiments"], lambda a: F.struct(a["aspect"].alias("aspect"), _number(a["polarity"]).alias("polarity"), a["evidence"].alias("evidence"))
    )
    return F.struct(
        _number(s["polarity"]).alias("polarity"),
        F.coalesce(s["intensity"], F.lit("mild")).alias("intensity"),
        F.coalesce(emotions, F.array().cast("array<struct<emotion:string,confidence:double>>")).alias("emotions"),
        F.coalesce(aspects, F.array().cast("array<struct<aspect:string,polarity:double,evidence:string>>")).alias("aspects"),
        F.coalesce(s["sarcasm"].try_cast("boolean"), F.lit(False)).alias("sarcasm_flag"),
        _number(s["confidence"]).alias("confidence"),
    )


def _intent(s: Column) -> Column:
    churn = F.transform(s["churn_indicators"], lambda c: F.struct(c["signal"].alias("signal"), _number(c["severity"]).alias("severity")))
    return F.struct(
        F.coalesce(s["intent_type"], F.lit("complaint")).alias("intent_type"),
        F.coalesce(s["urgency"], F.lit("medium")).alias("urgency"),
        F.nullif(s["specific_request"], F.lit("")).alias("specific_request"),
        F.nullif(s["competitor_mention"], F.lit("")).alias("competitor_mention"),
        F.coalesce(churn, F.array().cast("array<struct<signal:string,severity:double>>")).alias("churn_indicators"),
    )


def parse_sentiment(raw: Column) -> Column:
    """A sentiment answer with its defaults; what isn't JSON is neutral, mild and of no confidence."""
    return bind(_json(raw, SENTIMENT)[0], _sentiment)


def parse_intent(raw: Column) -> Column:
    """An intent answer with its defaults; what isn't JSON is a complaint of medium urgency."""
    return bind(_json(raw, INTENT)[0], _intent)


def parse_combined(raw: Column) -> Column:
    """struct<sentiment, intent> of a combined answer; a missing section gets its defaults."""
    both, _ = _json(raw, COMBINED)
    return bind(both, lambda b: F.struct(_sentiment(b["sentiment"]).alias("sentiment"), _intent(b["intent"]).alias("intent")))


def parse_account(raw: Column, domain: Column) -> Column:
    """account_name, confidence, evidence, method. The method is email_domain if the name is part of the e-mail domain."""
    got, _ = _json(raw, ACCOUNT)
    name = F.nullif(got["account_name"], F.lit(""))
    method = (
        F.when(name.isNull(), F.lit("none"))
        .when(F.coalesce(F.contains(F.lower(domain), F.lower(name)), F.lit(False)), F.lit("email_domain"))
        .otherwise(F.lit("llm"))
    )
    return F.struct(
        name.alias("account_name"),
        _number(got["confidence"]).alias("confidence"),
        F.coalesce(got["evidence"], F.lit("")).alias("evidence"),
        method.alias("method"),
    )


def sentiment_label(polarity: Column) -> Column:
    return (
        F.when(polarity >= F.lit(0.5), "Positive")
        .when(polarity >= F.lit(0.1), "Slightly positive")
        .when(polarity >= F.lit(-0.1), "Neutral")
        .when(polarity >= F.lit(-0.5), "Slightly negative")
        .otherwise("Negative")
    )


def sentiment_bar(polarity: Column) -> Column:
    """Place of a polarity on a bar of 0 to 100."""
    return (polarity + 1) / 2 * 100


def trend_sign(trend: Column) -> Column:
    """A trend such as +12% or -3% to flat, up or down."""
    return F.when(F.coalesce(trend, F.lit("")).isin("", "0%"), "flat").when(F.startswith(trend, F.lit("+")), "up").otherwise("down")


#: Mail providers for consumers, whose domains say nothing about an account.
CONSUMER_DOMAINS = (
    "gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "icloud.com", "live.com", "me.com", "aol.com", "protonmail.com",
    "pm.me", "googlemail.com", "msn.com", "ymail.com",
)
# Fixed value: the pattern of an e-mail address whose domain names an account.
DOMAIN_PATTERN = r"\b[A-Za-z0-9._%+\-]+@([A-Za-z0-9.\-]+\.[A-Za-z]{2,})\b"


def email_domain(text: Column) -> Column:
    """The first e-mail domain that isn't a consumer provider's, lower-cased; null without one."""
    found = F.transform(F.regexp_extract_all(text, F.lit(DOMAIN_PATTERN), F.lit(1)), lambda d: F.lower(d))
    return F.try_element_at(F.filter(found, lambda d: ~d.isin(*CONSUMER_DOMAINS)), F.lit(1))


def bind(value: Column, body) -> Column:
    """body(x) with x bound to value, so that value is computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine) -> Column:
    """The running results of an associative operation over an array<int>, such as its running sums. They are made in blocks of about the
    root of its size, so that no list grows over all of it."""
    none = F.array().cast("array<int>")
    last = lambda a: F.element_at(a, -1)

    def blocked(a: Column, width: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / width).cast("int") - 1), lambda i: F.slice(a, i * width + 1, width))
        own = F.transform(
            blocks,
            lambda b: F.aggregate(b, none, lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(combine(last(acc), x))))),
        )
        add = lambda acc, b: bind(last(acc), lambda at: F.concat(acc, F.transform(b, lambda x: combine(at, x))))
        return F.aggregate(own, none, lambda acc, b: F.when(F.size(acc) == 0, b).otherwise(add(acc, b)))

    def run(a: Column) -> Column:
        return F.when(F.size(a) == 0, none).otherwise(bind(F.ceil(F.sqrt(F.size(a))).cast("int"), lambda width: blocked(a, width)))

    return bind(values, run)


def overlaps(spans: Column) -> Column:
    """array<struct<first:int,last:int,end:int>>: the groups of sorted spans (start, end) that overlap, by index, and where each ends. Spans
    that only touch stay apart."""

    def run(s: Column, ends: Column) -> Column:
        heads = F.filter(
            F.transform(s, lambda x, i: F.when((i == 0) | (x["start"] >= F.coalesce(F.get(ends, i - 1), F.lit(0))), i)), lambda i: i.isNotNull()
        )
        group = lambda first, last: F.struct(first.alias("first"), last.alias("last"), F.get(ends, last).alias("end"))
        return bind(heads, lambda h: F.transform(h, lambda i, k: bind(F.coalesce(F.get(h, k + 1), F.size(s)) - 1, lambda last: group(i, last))))

    return bind(spans, lambda s: bind(running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b)), lambda ends: run(s, ends)))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start:int,end:int,value:string,before:string>> of a pattern's matches, `before` being what lies between the last match
    and this one. With a group, start and value are the group's, which must end the match."""

    def placed(whole: Column, before: Column, ends: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
        return F.transform(
            values,
            lambda v, i: F.struct((F.get(ends, i) - F.length(v)).alias("start"), F.get(ends, i).alias("end"), v.alias("value"), F.get(before, i).alias("before")),
        )

    def run(whole: Column) -> Column:
        between = F.split(text, pattern, -1)
        some = bind(
            between, lambda b: bind(running(F.transform(whole, lambda v, i: F.length(v) + F.length(F.get(b, i))), lambda x, y: x + y), lambda ends: placed(whole, b, ends))
        )
        none = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")
        return F.when(F.size(whole) == 0, none).otherwise(some)

    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), run)


def cut_spans(text: Column, spans: Column) -> Column:
    """array<string>: the parts of a text at sorted spans (start, end). The text is cut by groups of spans first, as finding a place in a
    text means walking to it."""

    def grouped(s: Column, width: Column) -> Column:
        def one(g: Column) -> Column:
            begin = F.get(g, F.lit(0))["start"]
            part = F.substring(text, begin + 1, F.element_at(g, -1)["end"] - begin)
            return bind(part, lambda p: F.transform(g, lambda x: F.substring(p, x["start"] - begin + 1, x["end"] - x["start"])))

        groups = F.transform(F.sequence(F.lit(0), F.ceil(F.size(s) / width).cast("int") - 1), lambda i: F.slice(s, i * width + 1, width))
        return F.flatten(F.transform(groups, one))

    none = F.array().cast("array<string>")
    return bind(spans, lambda s: F.when(F.size(s) == 0, none).otherwise(bind(F.ceil(F.sqrt(F.size(s))).cast("int"), lambda width: grouped(s, width))))


def replace_spans(text: Column, spans: Column) -> Column:
    """text with each span (start, end, label) replaced by its label; spans are sorted and do not overlap.

    The text is cut by groups of spans first, as finding a place in a text means walking to it.
    """

    def grouped(s: Column, width: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.ceil(F.size(s) / width).cast("int") - 1), lambda i: F.slice(s, i * width + 1, width))

        def one(g: Column, begin: Column) -> Column:
            end = F.element_at(g, -1)["end"]
            kept = lambda part: F.transform(
                g,
                lambda x, i: bind(
                    F.when(i == 0, begin).otherwise(F.get(g, F.greatest(i - 1, F.lit(0)))["end"]),
                    lambda at: F.concat(F.substring(part, at - begin + 1, x["start"] - at), x["label"]),
                ),
            )
            return bind(F.substring(text, begin + 1, end - begin), lambda part: F.array_join(kept(part), ""))

        ends = lambda gs: F.transform(gs, lambda g, i: one(g, F.when(i == 0, F.lit(0)).otherwise(F.element_at(F.get(gs, F.greatest(i - 1, F.lit(0))), -1)["end"])))
        return F.concat(F.array_join(bind(groups, ends), ""), F.substring(text, F.element_at(s, -1)["end"] + 1, F.length(text)))

    def run(s: Column) -> Column:
        return F.when(F.size(s) == 0, text).otherwise(bind(F.ceil(F.sqrt(F.size(s))).cast("int"), lambda width: grouped(s, width)))

    return bind(spans, run)
