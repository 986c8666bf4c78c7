"""The language of a text by a multinomial model of letter trigrams, learned from texts whose language is known.

A trigram is a number: its three letters in base 59 (0 for what stands between words, a to z, à to ÿ). The model is one row with a weight for each
trigram and language, whatever the size of the corpus, so that it goes to the tasks whole; what a task counts while learning are at most so many keys, which it
sums before they are shuffled. Scores are sums of integers, so that their order changes nothing. A text is scored in its row, without a shuffle; texts become
numbers by arrays, some million characters at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import LANGUAGES

BASE = 59
#: All trigrams; a trigram that a language lacks counts as seen once in so many more.
GRAMS = BASE**3


#: Characters that a task makes numbers of at a time, if a text is not longer.
CHUNK = 1 << 20


def _bind(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _letter(c: Column) -> Column:
    n = F.ascii(c)
    return F.when(n == 95, 0).when(n <= 122, n - 96).otherwise(n - 197)


def letters_of(text: Column) -> Column:
    """A text's letters in lower case, with one _ for whatever stands between, before and after them."""
    return F.regexp_replace(F.lower(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))), "[^a-zà-ÿ]+", "_")


def _grams(plain: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For successive parts of letters_of() texts: begin and end of the part, the trigrams, and the text in the part that each belongs to."""
    code = np.arange(256, dtype=np.int32)
    code = np.where(code == 95, 0, np.where(code <= 122, code - 96, code - 197)).astype(np.int32)
    texts = plain.to_pylist()
    size = np.array([len(t) for t in texts], np.int64)
    begin = 0
    while begin < len(texts):
        end = begin + max(1, int(np.searchsorted(np.cumsum(size[begin:]), CHUNK, side="right")))
        x = code[np.frombuffer("".join(texts[begin:end]).encode("latin-1"), np.uint8)]
        of = np.repeat(np.arange(end - begin), size[begin:end])
        whole = np.flatnonzero(of[:-2] == of[2:])  # a trigram lies in one text
        grams = x[:-2] * (BASE * BASE) + x[1:-1] * BASE + x[2:]
        yield begin, end, grams[whole], of[whole]
        begin = end


def trigrams(text: Column) -> Column:
    """array<int> of a text's trigrams in order, repeats included; the ends count as space. None for null and for texts without letters."""
    def numbers(letters: Column) -> Column:
        each = F.transform(letters, lambda x, i: x * BASE * BASE + F.get(letters, i + 1) * BASE + F.get(letters, i + 2))
        return F.filter(each, lambda x: x.isNotNull())

    return _bind(F.transform(F.split(letters_of(text), ""), _letter), numbers)


def held_out(key: Column) -> Column:
    """Three sixteenths of all keys, by their SHA-256: what no model learns from."""
    return F.substring(F.sha2(key.cast("string"), 256), 1, 1).isin("0", "1", "2")


def counts(texts: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """lang, gram, n over texts (lang, text) of the given languages."""
    known = texts.where(F.col("lang").isin(*languages)).select("lang", letters_of(F.col("text")).alias("plain"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(batch["lang"].to_pylist(), object)
            for begin, end, grams, of in _grams(batch["plain"]):
                for name in sorted(set(lang[begin:end])):
                    seen.setdefault(name, np.zeros(GRAMS, np.int64))
                    seen[name] += np.bincount(grams[(lang[begin:end] == name)[of]], minlength=GRAMS)
        for name, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "gram", "n"])

    return known.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def merge_counts(stored: DataFrame, more: DataFrame) -> DataFrame:
    """Counts of an earlier corpus and of more texts, so that a model is kept up to date without the earlier texts."""
    return stored.unionByName(more).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def model(counted: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """One row, weights: of each language in order of name its GRAMS weights, floor(1000 ln((n + 1) / (total + GRAMS))). A language without texts has equal ones."""
    told = F.array(*(F.lit(name) for name in sorted(languages)))
    every = counted.sparkSession.range(GRAMS).select(F.col("id").cast("int").alias("gram"), F.explode(told).alias("lang"))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    full = every.join(counted, ["lang", "gram"], "left").join(F.broadcast(totals), "lang", "left")  # a row for each language
    share = (F.coalesce("n", F.lit(0)) + 1).cast("double") / (F.coalesce("total", F.lit(0)) + GRAMS)
    rows = full.select("lang", F.struct("gram", F.floor(1000 * F.log(share)).cast("int").alias("w")).alias("x"))
    one = rows.groupBy("lang").agg(F.sort_array(F.collect_list("x"))["w"].alias("w"))  # GRAMS items each
    return one.agg(F.sort_array(F.collect_list(F.struct("lang", "w"))).alias("weights"))


def train(texts: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """The model of texts (lang, text)."""
    return model(counts(texts, languages), languages)


def detect(rows: DataFrame, trained: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """rows with guessed, the language of the highest score (of equal ones the first by name; `unknown` without trigrams), and margin, what it is ahead
    of the second, in thousandths of a nat (0 with one language only). A column of rows with one of these names is replaced."""
    names, found = sorted(languages), "__found"
    while found in rows.columns:
        found += "_"
    told = {x["lang"]: x["w"] for x in trained.head()["weights"]}  # GRAMS small numbers for each language
    weights = np.array([told[name] for name in names], np.int32)

    @F.arrow_udf("struct<guessed:string,margin:bigint>")
    def judge(plain: pa.Array) -> pa.Array:
        guessed, margin = np.full(len(plain), "unknown", object), np.zeros(len(plain), np.int64)
        for begin, end, grams, of in _grams(plain):
            scores = np.zeros((len(names), end - begin), np.int64)
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, int)
            for i in range(len(names) if len(of) else 0):
                scores[i, of[first]] = np.add.reduceat(weights[i][grams], first, dtype=np.int64)
            order = np.argsort(-scores, axis=0, kind="stable")  # the first by name of equal ones
            at, every = np.unique(of), np.arange(end - begin)
            guessed[begin + at] = np.array(names, object)[order[0, at]]
            margin[begin:end] = scores[order[0], every] - scores[order[min(1, len(names) - 1)], every]
        return pa.StructArray.from_arrays([pa.array(guessed, pa.string()), pa.array(margin)], ["guessed", "margin"])

    judged = rows.withColumn(found, judge(letters_of(F.col("text"))))
    return judged.withColumns({"guessed": F.col(found)["guessed"], "margin": F.col(found)["margin"]}).drop(found)
