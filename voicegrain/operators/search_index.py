"""Search for parts of texts by an index of trigrams, without a scan of the texts.

Postings name for each trigram and block of BLOCK successive ids the ids whose text has it. They lie in a folder for each hash of a trigram's first two
characters, sorted by trigram, so that a needle reads some folders, and of them the row groups of its trigrams. The texts lie sorted by id, so that the
few that are to be compared are found by the files' statistics. What the postings of a needle's trigrams have in common is compared with the needle
itself; results are those of a scan. A text ends with an extra mark, so that a needle of two characters is the beginning of a trigram everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 4_096
FOLDERS = 64
END = "\u0000"
#: Candidates that first() compares at a time, and how often before it leaves the rest to find().
PAGE, PAGES = 256, 4
#: Characters of text that a task makes postings of at a time, if a text is not longer.
CHUNK = 1 << 22


def _postings(ids: list[int], texts: list[str]) -> pa.RecordBatch:
    """gram, block, ids of some texts in lower case. A trigram is a number of three times 21 bits until it is sent on."""
    found, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in sorted(range(len(ids)), key=ids.__getitem__):
        x = np.frombuffer((texts[i] + END).encode("utf-32-le"), np.uint32).astype(np.int64)
        grams = np.unique(x[:-2] << 42 | x[1:-1] << 21 | x[2:]) if len(x) > 2 else found[0]
        found.append(grams)
        of.append(np.full(len(grams), ids[i], np.int64))
    gram, own = np.concatenate(found), np.concatenate(of)
    by = np.argsort(gram, kind="stable")  # ids ascend in each trigram
    gram, own = gram[by], own[by]
    block = own // BLOCK
    changed = lambda x: np.append(True, x[1:] != x[:-1])[: len(x)]
    fresh = changed(gram) | changed(own)  # several texts of one id
    gram, own, block = gram[fresh], own[fresh], block[fresh]
    begin = np.flatnonzero(changed(gram) | changed(block))
    low = (1 << 21) - 1
    told = np.stack([gram[begin] >> 42, gram[begin] >> 21 & low, gram[begin] & low], 1).astype("<u4").tobytes().decode("utf-32-le")
    lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(own)).astype(np.int32)), pa.array(own))
    return pa.RecordBatch.from_arrays([pa.array([told[i : i + 3] for i in range(0, len(told), 3)], pa.string()), pa.array(block[begin]), lists], ["gram", "block", "ids"])


def posted(rows: DataFrame) -> DataFrame:
    """gram, block, ids: the postings of rows (id, label), none of them null. A task puts the ids of a trigram and block together before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[str] = []
        size = 0
        for batch in batches:
            for i, text in zip(batch["id"].to_pylist(), batch["low"].to_pylist(), strict=True):
                ids.append(i)
                texts.append(text)
                size += len(text) + 1
                if size >= CHUNK:
                    yield _postings(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield _postings(ids, texts)

    some = rows.select("id", F.lower("label").alias("low")).mapInArrow(run, "gram string, block long, ids array<bigint>")
    return some.groupBy("gram", "block").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))  # BLOCK ids at most


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(gram, 1, 2)), F.lit(FOLDERS)).cast("int")


def occurrences(text: Column, needle: str) -> Column:
    """How often a text in lower case has the needle, without overlaps."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


class SearchIndex:
    """The index in a folder of the shared storage."""

    TEXTS, POSTINGS = "id long, label string", "gram string, block long, ids array<bigint>, folder int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, rows: DataFrame) -> SearchIndex:
        """Indexes rows (id long, label), beside those that are there; rows without id or text are never found. Further columns are left out.

        Of one id there may be several rows, each of which is found by its own text.
        """
        rows = rows.select(F.col("id").cast("long").alias("id"), "label").where("id IS NOT NULL AND label IS NOT NULL")
        rows.repartitionByRange("id").sortWithinPartitions("id").write.mode("append").option("parquet.block.size", 1 << 23).parquet(f"{self.path}/texts")
        told = posted(rows).withColumn("folder", _folder(F.col("gram"))).repartitionByRange("folder", "gram", "block").sortWithinPartitions("folder", "gram", "block")
        told.write.mode("append").option("parquet.block.size", 1 << 23).partitionBy("folder").parquet(f"{self.path}/postings")
        return self

    def texts(self) -> DataFrame:
        return self.spark.read.schema(self.TEXTS).parquet(f"{self.path}/texts")

    def postings(self, needle: str) -> DataFrame:
        """gram, block, ids of the needle's trigrams, or of all that begin with it if it has two characters."""
        stored = self.spark.read.schema(self.POSTINGS).parquet(f"{self.path}/postings")
        if len(needle) == 2:
            heads = {needle}
            wanted = F.startswith("gram", F.lit(needle))
        else:
            grams = {needle[i : i + 3] for i in range(len(needle) - 2)}
            heads = {g[:2] for g in grams}
            wanted = F.col("gram").isin(*sorted(grams))
        told = self.spark.createDataFrame([(h,) for h in sorted(heads)], "head string").select(_folder(F.col("head")).alias("f")).distinct()
        folders = sorted(r["f"] for r in told.collect())  # FOLDERS at most
        return stored.where(F.col("folder").isin(*folders) & wanted)

    def candidates(self, needle: str) -> DataFrame:
        """id: those whose text has all trigrams of a needle in lower case of two characters or more."""
        found = self.postings(needle).select("block", "gram", F.explode("ids").alias("id"))
        if len(needle) == 2:
            return found.select("id").distinct()
        n = len({needle[i : i + 3] for i in range(len(needle) - 2)})
        return found.groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == n).select("id")

    def find(self, needle: str) -> DataFrame:
        """id, label, hits: all rows whose text holds the needle in any case, and how often; none for needles under two characters."""
        needle = needle.lower()
        if len(needle) < 2:
            return self.texts().where(F.lit(False)).withColumn("hits", F.lit(0).cast("long"))
        held = self.texts().join(self.candidates(needle), "id", "left_semi")
        return self._holding(held, needle)

    def first(self, needle: str, each: int = 4) -> DataFrame:
        """id, label, hits: those of find() with the least ids. Candidates are compared by the page, each read by the ids of its rows."""
        needle = needle.lower()
        if len(needle) < 2:
            return self.find(needle)
        candidates, last, page = self.candidates(needle), None, []
        ids: list[int] = []
        for _ in range(PAGES):
            rest = candidates if last is None else candidates.where(F.col("id") > last)
            page = [r["id"] for r in rest.orderBy("id").limit(PAGE).collect()]  # PAGE rows at most
            if page:
                held = self._holding(self.texts().where(F.col("id").isin(*page)), needle)
                ids += [r["id"] for r in held.select("id").orderBy("id").limit(each).collect()]
                last = page[-1]
            if len(ids) >= each or len(page) < PAGE:
                wanted = self.texts().where(F.col("id").isin(*ids)) if ids else self.texts().where(F.lit(False))
                return self._holding(wanted, needle).orderBy("id").limit(each)
        return self.find(needle).orderBy("id").limit(each)

    def ranked(self, needle: str, n: int = 10) -> DataFrame:
        """id, label, hits: the n rows that hold the needle most often, of equal ones those with the least ids."""
        return self.find(needle).orderBy(F.desc("hits"), "id").limit(n)

    @staticmethod
    def _holding(rows: DataFrame, needle: str) -> DataFrame:
        low = F.lower("label")
        return rows.where(F.contains(low, F.lit(needle))).select("id", "label", occurrences(low, needle).alias("hits"))
