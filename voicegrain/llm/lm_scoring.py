"""Stupid-backoff scores of documents under n-gram counts of the whole corpus, computed as joins.

1. Documents are dealt to blocks of about BLOCK_CHARS characters; each block's n-grams (up to `order` words, lower-cased A-Z, as 64-bit
   hashes) are exploded to distinct rows (block, gram, n). So a frequent n-gram costs a row for each block, not for each occurrence.
2. Rows are partitioned by the n-gram's hash, where the count table is made, and every row is joined with its n-gram's total. Rows of
   one block and one of the 2^PART_BITS hash ranges share a shuffled record, so that it is little more than the hashes themselves; the
   number of records a block makes does not depend on the corpus.
3. The totals go back to the blocks, those of one block and range as one record in the order of the n-grams, and are joined to the
   documents' n-grams there. The scores are summed for each document.

score = mean of log S over the words. S(w | v1 .. vk) = c(v1 .. vk w) / c(v1 .. vk) if c(v1 .. vk w) >= MIN_COUNT, else BACKOFF * S(w | v2 .. vk);
S(w) = c(w) / N. The context is as many of the order - 1 words before as the text has.

Cases: a text without words (null, empty, blank) has 0 words and a null score; repeated rows each count and each get a row, but are
scored once; a null doc_id is scored like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import chunks, mix, text_buffers, word_hashes
from .shared import words

MIN_COUNT, BACKOFF = 2, 0.4
#: Characters of text in a block, about; bits of a hash that name its range.
BLOCK_CHARS, PART_BITS = 12_000_000, 14
#: Records of n-grams that are sent on at once; bytes of text that are hashed at once, which takes some thirty times as much memory.
SENT_ROWS, HASHED_BYTES = 1_024, 500_000
#: Repeated rows are given back in groups of so many.
COPIES = 1_000


def _grams(column: pa.ChunkedArray, order: int) -> Iterator[tuple[int, int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """For rows [a, b) of some texts: where each text's words begin, and for 1 to order words the n-grams' hashes and the places of
    their last words."""
    data, offsets = text_buffers(column)
    for a, b in chunks(offsets, HASHED_BYTES):
        h, first = word_hashes(data, offsets[a : b + 1])
        place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
        grams, at = h, np.arange(len(h))
        found = [(grams, at)]
        for n in range(2, order + 1):
            at = np.flatnonzero(place >= n - 1)
            before = np.zeros(len(h), np.uint64)  # the n - 1 words that end just before a place
            before[found[-1][1]] = found[-1][0]
            found.append((mix(before[at - 1] * np.uint64(3) + mix(h[at])), at))
        yield a, b, first, found


def _counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams, and how often each is there. Sorts grams in place."""
    if not len(grams):
        return grams, np.zeros(0, np.int64)
    grams.sort()
    fresh = np.empty(len(grams), bool)
    fresh[0] = True
    np.not_equal(grams[1:], grams[:-1], out=fresh[1:])
    begin = np.flatnonzero(fresh)
    n = np.empty(len(begin), np.int64)
    np.subtract(begin[1:], begin[:-1], out=n[:-1])
    n[-1] = len(grams) - begin[-1]
    del begin
    return grams[fresh], n


def _all(column: pa.ChunkedArray, order: int) -> np.ndarray:
    """All n-grams of some texts, put into one array (two bytes make a word at most, and untouched memory costs nothing)."""
    size = pc.sum(pc.binary_length(column)).as_py() or 0
    out, used = np.empty(order * ((size + len(column)) // 2 + 1), np.uint64), 0
    for _, _, _, found in _grams(column, order):
        for grams, _ in found:
            out[used : used + len(grams)] = grams
            used += len(grams)
    return out[:used]


def _distinct(table: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's n-grams, sorted, and how often it has them."""
    repeated = table.filter(pc.greater(table["copies"], 1))
    once = table["text"] if not repeated.num_rows else table.filter(pc.equal(table["copies"], 1))["text"]
    grams, n = _counted(_all(once, order))
    if repeated.num_rows:
        parts = [(grams, n)]
        for i, copies in enumerate(repeated["copies"].to_pylist()):
            more, times = _counted(_all(repeated["text"].slice(i, 1), order))
            parts.append((more, times * copies))
        grams, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.argsort(grams, kind="stable")
        grams, n = grams[by], n[by]
        begin = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
        grams, n = grams[begin], np.add.reduceat(n, begin) if len(grams) else n
    return grams, n


def _exploded(order: int):
    def run(table: pa.Table) -> pa.Table:
        grams, n = _distinct(table, order)
        part = (grams >> np.uint64(64 - PART_BITS)).astype(np.int32)
        begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
        at = pa.array(np.append(begin, len(part)), pa.int32())
        block = table["block"][0].as_py() if table.num_rows else 0
        out = pa.table(
            {
                "block": pa.array(np.full(len(begin), block, np.int64)),
                "part": pa.array(part[begin]),
                "grams": pa.ListArray.from_arrays(at, pa.array(grams.view(np.int64))),
                "n": pa.ListArray.from_arrays(at, pa.array(n)),
            }
        )
        return pa.Table.from_batches(out.to_batches(max_chunksize=SENT_ROWS), out.schema)

    return run


def _scored(tokens: int, order: int):
    def run(docs: pa.Table, totals: pa.Table) -> pa.Table:
        known, _ = _distinct(docs, order)
        total = totals.sort_by("part")["totals"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        del totals
        if len(total) != len(known):
            raise ValueError("a block's totals do not match its n-grams")

        def count(grams: np.ndarray) -> np.ndarray:
            return total[np.searchsorted(known, grams)].astype(float)

        n_words, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
        for a, b, first, found in _grams(docs["text"], order):
            shorter = count(found[0][0])
            logs = np.log(shorter / tokens)
            for grams, at in found[1:]:
                now = np.ones(len(logs))
                now[at] = count(grams)
                seen = now[at] >= MIN_COUNT
                logs[at] = np.where(seen, np.log(now[at] / shorter[at - 1]), logs[at] + np.log(BACKOFF))
                shorter = now
            n = np.diff(first)
            n_words.append(n)
            sums.append(np.bincount(np.repeat(np.arange(b - a), n), logs, b - a))
        n, total_log = np.concatenate(n_words), np.concatenate(sums)
        score = pa.array(total_log / np.maximum(n, 1), mask=n == 0)
        return pa.table({"doc_id": docs["doc_id"], "n_words": pa.array(n), "score": score, "copies": docs["copies"]})

    return run


def _dealt(documents: DataFrame, order: int) -> tuple[DataFrame, DataFrame, int]:
    """Documents by block, repeated rows as one with their number; their n-grams (block, part, grams, n); and N."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.length("text")).alias("chars"), F.sum(F.size(words(F.col("text"))).cast("long")).alias("tokens")).head()
    blocks = 1 + (size["chars"] or 0) // BLOCK_CHARS
    placed = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).repartition("block")
    dealt = placed.groupBy("block", "doc_id", "text").agg(F.count("*").alias("copies"))
    grams = dealt.groupBy("block").applyInArrow(_exploded(order), "block long, part int, grams array<long>, n array<long>")
    return dealt, grams, size["tokens"] or 0


def _rows(grams: DataFrame) -> DataFrame:
    """block, part, i, gram, n: partitioned by part, which is a part of the gram's hash; i is the gram's place in its block and part."""
    placed = grams.repartition("part").select("block", "part", "n", F.posexplode("grams").alias("i", "gram"))
    return placed.select("block", "part", "i", "gram", F.get("n", F.col("i")).alias("n"))


def score_documents(documents: DataFrame, order: int = 2) -> DataFrame:
    """doc_id, n_words, score for each row, with counts of all rows; n-grams have `order` words at most."""
    dealt, grams, tokens = _dealt(documents, order)
    joined = _rows(grams).select("block", "part", "i", F.sum("n").over(Window.partitionBy("gram", "part")).alias("total"))
    inside = F.array_sort(F.collect_list(F.struct("i", "total")))  # no more than one block's n-grams
    totals = joined.groupBy("part", "block").agg(F.transform(inside, lambda x: x["total"]).alias("totals"))
    scored = dealt.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(
        _scored(tokens, order), "doc_id long, n_words long, score double, copies long"
    )
    full, rest = F.floor(F.col("copies") / COPIES).cast("int"), (F.col("copies") % COPIES).cast("int")
    sizes = scored.withColumn("some", F.explode(F.concat(F.array_repeat(F.lit(COPIES), full), F.array(rest))))
    return sizes.select("doc_id", "n_words", "score", F.explode(F.array_repeat(F.lit(0), F.col("some"))).alias("copy")).drop("copy")


def ngram_counts(documents: DataFrame, order: int = 2) -> DataFrame:
    """The count table: gram (hash), n; one row for each distinct n-gram of up to `order` words."""
    return _rows(_dealt(documents, order)[1]).groupBy("gram", "part").agg(F.sum("n").alias("n")).drop("part")
