"""Where a model's answers come from: recorded answers, rules in column expressions, or a live client called in batches.

A backend takes a DataFrame with a column prompt and returns it with two more: raw, the answer, null where there is none, and error, why a call
failed. Model calls are never made for rows that were filtered out before. `kinds` names the calls that it answers (all if None), and
`plain` tells that its prompts are the bare texts, without the instructions of PROMPTS.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_TASKS = {
    "unitize": "Split the feedback into units that each say one thing. Answer with a JSON array of objects with text, char_start and char_end.",
    "topic": "Name the one topic of the feedback. Answer with four lines: LABEL:, DESCRIPTION:, EVIDENCE: (quotes, with commas between) and CONFIDENCE: (0 to 1).",
    "sentiment": "Judge the feedback. Answer with a JSON object with polarity (-1 to 1), intensity, emotions, aspect_sentiments, sarcasm and confidence.",
    "combined": "Judge the feedback. Answer with a JSON object with sentiment (polarity, intensity, emotions, aspect_sentiments, sarcasm, confidence) and "
    "intent (intent_type, urgency, specific_request, competitor_mention, churn_indicators).",
    "account": "Name the customer's company. Answer with a JSON object with account_name, confidence and evidence.",
}


def prompt(kind: str, text: Column, **context: Column) -> Column:
    """Instructions of a call, then lines of context (those that are not null), then the text."""
    lines = [F.concat(F.lit(f"{name.replace('_', ' ')}: "), value.cast("string")) for name, value in context.items()]
    return F.concat_ws("\n", F.lit(_TASKS[kind]), *lines, F.concat(F.lit("feedback: "), text))


class Backend(Protocol):
    kinds: tuple[str, ...] | None
    plain: bool

    def complete(self, prompts: DataFrame, kind: str) -> DataFrame: ...


class Recorded:
    """Answers from a table: prompt_hash (sha2-256 of the prompt), kind, raw."""

    def __init__(self, answers: DataFrame, kinds: tuple[str, ...] | None = ("topic", "sentiment", "combined", "account"), plain: bool = True):
        self.answers, self.kinds, self.plain = answers, kinds, plain

    def complete(self, prompts: DataFrame, kind: str) -> DataFrame:
        known = self.answers.where(F.col("kind") == kind).groupBy("prompt_hash").agg(F.min("raw").alias("raw"))
        asked = prompts.withColumn("prompt_hash", F.sha2("prompt", 256))
        return asked.join(known, "prompt_hash", "left").drop("prompt_hash").withColumn("error", F.lit(None).cast("string"))


class Rules:
    """Answers from a column expression for each kind of call."""

    plain = True

    def __init__(self, rules: dict[str, Callable[[Column], Column]]):
        self.rules, self.kinds = rules, tuple(rules)

    def complete(self, prompts: DataFrame, kind: str) -> DataFrame:
        return prompts.withColumn("raw", self.rules[kind](F.col("prompt"))).withColumn("error", F.lit(None).cast("string"))


class Live:
    """Answers from a client: make_client(kind) is called once in each task and gives a function of a list of prompts.

    If a call raises, its prompts are asked again one by one; one that raises alone has a null answer and the error's text, so that only
    this row gets its defaults.
    """

    plain = False

    def __init__(self, make_client: Callable[[str], Callable[[list[str]], list[str]]], kinds: tuple[str, ...] | None = None):
        self.make_client, self.kinds = make_client, kinds

    def complete(self, prompts: DataFrame, kind: str) -> DataFrame:
        make = self.make_client
        none = F.lit(None).cast("string")
        schema = prompts.withColumn("raw", none).withColumn("error", none).schema

        def run(frames: Iterator) -> Iterator:
            ask = make(kind)

            def one(text: str) -> tuple[str | None, str | None]:
                try:
                    return ask([text])[0], None
                except Exception as e:  # noqa: BLE001  the contract: a failed call is an absent answer
                    return None, f"{kind}: {type(e).__name__}: {e}"

            for frame in frames:
                texts = frame["prompt"].tolist()
                try:
                    got = [(raw, None) for raw in ask(texts)]
                except Exception:  # noqa: BLE001
                    got = [one(t) for t in texts]
                yield frame.assign(raw=[raw for raw, _ in got], error=[error for _, error in got])

        return prompts.mapInPandas(run, schema)
