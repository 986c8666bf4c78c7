"""Rule answers in place of a model: lexicons and hashed words, as column expressions. Deterministic, and no claim of a model's quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POSITIVE = ("good", "great", "love", "excellent", "easy", "fast", "helpful", "thanks", "perfect", "happy")
NEGATIVE = ("bad", "slow", "crash", "crashes", "broken", "hate", "terrible", "error", "fail", "fails", "frustrating", "cancel")
#: Words of an intent, the first that has one wins.
INTENT_WORDS = {
    "churn_signal": ("cancel", "leaving", "switch", "unsubscribe"),
    "bug_report": ("crash", "crashes", "error", "broken", "fail", "fails", "bug"),
    "feature_request": ("wish", "add", "feature", "support", "please"),
    "question": ("how", "why", "what", "when", "where"),
    "praise": ("love", "great", "excellent", "thanks", "perfect"),
}
#: All words that polarity and intent look for.
LEXICON = tuple(sorted({*POSITIVE, *NEGATIVE, *(w for words in INTENT_WORDS.values() for w in words)}))
LANGUAGES = ("en", "fr", "de", "es")
STOP_WORDS = {
    "en": ("the", "and", "of", "to", "in", "is", "that", "with"),
    "fr": ("le", "la", "les", "et", "des", "est", "une", "dans"),
    "de": ("der", "die", "das", "und", "ist", "ein", "nicht", "mit"),
    "es": ("el", "los", "las", "y", "una", "por", "con", "que"),
}
DIMENSIONS = 64


def words_of(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-zà-ÿ]+")


def hits(words: Column, lexicon: tuple[str, ...]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*lexicon)))


def _bind(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def language(text: Column) -> Column:
    """The language with the most stop words, the first of equal ones; `unknown` without any."""

    def choose(w: Column) -> Column:
        counts = F.array(*(F.struct(hits(w, STOP_WORDS[c]).alias("n"), F.lit(-i).alias("i"), F.lit(c).alias("lang")) for i, c in enumerate(LANGUAGES)))
        return _bind(F.array_max(counts), lambda best: F.when(best["n"] == 0, F.lit("unknown")).otherwise(best["lang"]))

    return _bind(words_of(text), choose)


def _told(text: Column, body) -> Column:
    """body(w) with w bound to the words of a text that are in the lexicon, which are few; so the text is cut into words once."""
    return _bind(F.filter(words_of(text), lambda w: w.isin(*LEXICON)), body)


def _polarity(w: Column) -> Column:
    weigh = lambda p, q: F.coalesce(F.try_divide((p - q).cast("double"), p + q), F.lit(0.0))
    return _bind(hits(w, POSITIVE), lambda p: _bind(hits(w, NEGATIVE), lambda q: weigh(p, q)))


def _intent_type(w: Column) -> Column:
    out = F.lit("general_comment")
    for name, lexicon in reversed(INTENT_WORDS.items()):
        out = F.when(hits(w, lexicon) > 0, F.lit(name)).otherwise(out)
    return out


def polarity(text: Column) -> Column:
    """(positive - negative) / (positive + negative) words; 0 without either."""
    return _told(text, _polarity)


def intent(text: Column) -> Column:
    return _told(text, _intent_type)


def _sentiment(w: Column) -> Column:
    def answer(p: Column) -> Column:
        strength = F.when(F.abs(p) >= 0.8, "strong").when(F.abs(p) >= 0.4, "moderate").otherwise("mild")
        return F.struct(p.alias("polarity"), strength.alias("intensity"), F.when(p == 0, F.lit(0.5)).otherwise(F.lit(0.8)).alias("confidence"))

    return _bind(_polarity(w), answer)


def _intent(w: Column) -> Column:
    return _bind(
        _intent_type(w), lambda name: F.struct(name.alias("intent_type"), F.when(name.isin("churn_signal", "bug_report"), "high").otherwise("low").alias("urgency"))
    )


def sentiment_answer(text: Column) -> Column:
    return F.to_json(_told(text, _sentiment))


def combined_answer(text: Column) -> Column:
    return F.to_json(_told(text, lambda w: F.struct(_sentiment(w).alias("sentiment"), _intent(w).alias("intent"))))


def longest_word(text: Column) -> Column:
    """The longest word in lower case, of equally long ones the last by text; empty without any."""
    return _bind(words_of(text), lambda w: F.array_max(F.transform(w, lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))["w"])


def topic_answer(text: Column) -> Column:
    """Intent and the longest word, in the line protocol of topics."""
    longest = longest_word(text)
    return F.concat(F.lit("LABEL: "), intent(text), F.lit(" "), F.coalesce(longest, F.lit("")), F.lit("\nDESCRIPTION: \nEVIDENCE: "), F.coalesce(longest, F.lit("")), F.lit("\nCONFIDENCE: 0.75"))


def embed(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Counts of hashed words: array<float>."""
    hashed = F.transform(F.filter(words_of(text), lambda w: w != F.lit("")), lambda w: F.pmod(F.xxhash64(w), F.lit(dimensions)))
    return _bind(hashed, lambda h: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.size(F.filter(h, lambda x: x == i)).cast("float")))
