"""Importance resampling: documents drawn by how much likelier their words are in a target corpus than in all documents.

Features are all runs of 1 to `order` consecutive words, hashed by CRC-32 to a fixed number of buckets. Each task makes tries of its texts'
words, one for each PIECE bytes of text, level by level in arrays: a node is a distinct run of words, has the run without its last word as its parent, and
holds the CRC state of its bytes, which comes from the parent's state and the CRC of the last word. In the first pass nodes hold counts, which
are added up by bucket; the totals of all tasks are merged. In the second pass nodes hold their bucket's gain, and a document's sum is that over
the nodes which its words lead to. The first level's words are kept from trie to trie, up to NODES of them. Texts are read twice and never shuffled.

Ranks come from one range-partitioned sort of (score, doc_id): rows before a partition and the place in it, so that no task holds more than its range.

Cases: a null or empty text has no words, no features and weight 0; repeated rows each count, have a row, and are drawn apart; a null doc_id
is hashed as an empty one and comes last among equals; an empty target or corpus counts 0 everywhere; an empty table gives an empty result.
Only doc_id and text are read, so that clashing names do no harm.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

BUCKETS, ORDER = 10_000, 2
#: A first level with more words is thrown away.
NODES = 400_000
#: Bytes of text that are split into words at once.
PIECE = 1_000_000
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
#: A-Z become small letters, other bytes below 0x80 that are no letter or digit become spaces.
TO_WORDS = _LETTERS.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


class Words(dict):
    """The trie's first level: the number of each word, with its CRC and length."""

    def __init__(self) -> None:
        self.crc, self.length = array("q"), array("q")

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.crc)
        self.crc.append(zlib.crc32(word))
        self.length.append(len(word))
        return number


def _through(table: np.ndarray, state: np.ndarray, row=()) -> np.ndarray:
    """A linear map of 32-bit numbers, given by its values for each byte at each of the four places; row picks one of several."""
    out = table[(*row, 0, state & 255)]
    for place in (1, 2, 3):
        out = out ^ table[(*row, place, (state >> (8 * place)) & 255)]
    return out


_BYTES = np.arange(256, dtype=np.int64)
_ONE = np.array([[zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], *(_BYTES << (8 * place) for place in range(3))])
_SPACE = zlib.crc32(b" ")


@functools.cache
def _after(length: int) -> np.ndarray:
    """The map of a CRC state that so many more bytes make, but for the bytes' own CRC."""
    if length == 1:
        return _ONE
    half = _after(length // 2)
    whole = _through(half, half)
    return whole if length % 2 == 0 else _through(_ONE, whole)


class Trie:
    """The runs of 1 to `order` words of some segments of texts, level by level.

    A level's nodes are its distinct runs; node n of a level has the CRC states[n], and its parent is the run without the last word.
    """

    def __init__(self, order: int) -> None:
        self.order = order
        self.known = Words()

    def levels(self, segments: list[tuple[list[bytes], int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each level: the states of its nodes; and of each feature in the order of the text, its node and its segment.

        segments: words, and how many first ones belong to the segment before, whose runs are only continued.
        """
        if len(self.known) > NODES:
            self.known = Words()
        path = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(w for w, _ in segments)), np.int64)
        sizes = np.array([len(w) for w, _ in segments], np.int64)
        end = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        fresh = (end - sizes + np.array([lead for _, lead in segments], np.int64))[owner]
        start = np.arange(len(path))
        crc, length = np.array(self.known.crc, np.int64), np.array(self.known.length, np.int64)
        words, node = np.unique(path, return_inverse=True)
        states = crc[words]
        for run in range(1, self.order + 1):
            if run > 1:
                inside = start + run <= end[owner]
                start, owner, node, fresh = start[inside], owner[inside], node[inside], fresh[inside]
                keys, node = np.unique(node * len(crc) + path[start + run - 1], return_inverse=True)
                parent, word = keys // max(len(crc), 1), keys % max(len(crc), 1)
                lengths, row = np.unique(length[word], return_inverse=True)
                maps = np.array([_after(n) for n in lengths.tolist()], np.int64).reshape(-1, 4, 256)
                states = _through(maps, _through(_ONE, states[parent]) ^ _SPACE, (row,)) ^ crc[word]
            counted = start + run > fresh
            yield states, node[counted], owner[counted]


def segments(texts: pa.Array, lead: int) -> Iterator[tuple[list[int], list[tuple[list[bytes], int]]]]:
    """The texts' words in segments, about PIECE bytes of text at a time: the rows, and (words, how many are those before)."""
    rows, held, size = [], [], 0
    for row, text in enumerate(texts):
        raw, at, before = text.as_buffer().to_pybytes() if text.is_valid else b"", 0, []
        while at < len(raw):
            gap = _GAP.search(raw, at + PIECE)
            end = gap.start() if gap else len(raw)
            words = raw[at:end].translate(TO_WORDS).split()
            rows.append(row)
            held.append(([*before, *words], len(before)))
            before = held[-1][0][-lead:] if lead else []
            size, at = size + end - at, end
            if size >= PIECE:
                yield rows, held
                rows, held, size = [], [], 0
    if held:
        yield rows, held


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """bucket (int), n (long): how many features of all texts fall into each bucket that has any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, trie = np.zeros(buckets, np.int64), Trie(order)
        for batch in batches:
            for _, some in segments(batch["text"], order - 1):
                for states, node, _ in trie.levels(some):
                    np.add.at(total, states % buckets, np.bincount(node, minlength=len(states)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket: floor(1000 ln of its smoothed share in the target over that in the corpus). Both: bucket_counts()."""
    s, t = ({r["bucket"]: r["n"] for r in counts.collect()} for counts in (corpus, target))  # at most `buckets` rows
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    ratio = lambda b: float(t.get(b, 0) + 1) * float(all_s) / (float(s.get(b, 0) + 1) * float(all_t))
    return [math.floor(1000 * math.log(ratio(b))) for b in range(buckets)]


def weigh(documents: DataFrame, gain: list[int], order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_features, weight (long): the floored mean of the gains of a document's features; gain: by bucket."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, of_bucket = Trie(order), np.array(gain, np.int64)
        for batch in batches:
            n_words, n, total = np.zeros((3, batch.num_rows), np.int64)
            for rows, some in segments(batch["text"], order - 1):
                row = np.array(rows)
                np.add.at(n_words, row, [len(w) - lead for w, lead in some])
                for states, node, owner in trie.levels(some):
                    gains_here = of_bucket[states % len(of_bucket)][node]
                    np.add.at(n, row, np.bincount(owner, minlength=len(row)))
                    np.add.at(total, row[owner], gains_here)
            weight = total // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, (n_words, n, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def ranked(scored: DataFrame) -> DataFrame:
    """scored (doc_id, score) and rank: 1, 2, ... by score, highest first, then by doc_id, null last; equal rows in any order.

    Ranges of the sorted rows are written; a row's rank is the rows of earlier ranges and its place in its own.
    """
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    dealt = scored.repartitionByRange(*order, F.rand(7)).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    placed = materialize(dealt.withColumn("part", F.shiftright(place, 33)).withColumn("place", place.bitwiseAND((1 << 33) - 1)), "ranges")
    parts = placed.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    before = parts.select("part", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    return placed.join(F.broadcast(before), "part").withColumn("rank", F.coalesce("before", F.lit(0)) + F.col("place") + 1).drop("part", "place", "before")


def resample(documents: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """doc_id, n_features, weight, score, rank (long) of every document; rank is null if it is not drawn.

    Of the documents with at least min_words words, floor(percent %) are drawn: those with the highest sum of weight and Gumbel noise, which is
    a draw without replacement in proportion to exp(weight / 1000). documents: doc_id, text; target: text.
    """
    gain = gains(bucket_counts(documents, buckets, order), bucket_counts(target, buckets, order), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialize(weigh(documents, gain, order).withColumn("score", F.col("weight") + noise), "scored")
    long_enough = F.col("n_words") >= min_words
    drawn = scored.where(long_enough).count() * percent // 100
    rest = scored.where(~long_enough).withColumn("rank", F.lit(None).cast("long"))
    rows = ranked(scored.where(long_enough)).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return rows.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
