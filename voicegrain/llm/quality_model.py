"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Features are words, pairs of adjacent words, and the same of word shapes (kind of the first character, the last character
unless it is a letter, whether all are capitals, and whether the word equals one of the two before it), each hashed to 2^BITS
buckets. A feature's value is SCALE times its share of the document's n-grams of that kind. Training takes a bounded sample of
the labelled rows, in one task; the weights are an array of fixed size that is broadcast, and every document is scored where it
is read, as a sparse dot product over its whole text.

Cases: a null text is an empty text and gets the bias alone; null labels are not learned from; repeated rows each get a row;
without labelled rows every score is 0.5; the result has doc_id and score only, so clashing names do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import chunks, mix, text_buffers, word_hashes, word_spans

BITS = 18
SCALE = 8.0
#: At most so many labelled rows are learned from: those with the least hashes of their doc_id.
SAMPLE_ROWS = 4_000
_KIND = np.full(256, 4, np.uint64)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 2


def _shapes(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    starts, ends = word_spans(data, offsets)
    first, last = data[starts], data[ends - 1]
    upper = np.concatenate(([0], np.cumsum((data >= 97) & (data < 123))))
    again = np.zeros(len(hashes), np.uint64)
    for back in (1, 2):
        again[back:] |= ((hashes[back:] == hashes[:-back]) & (owner[back:] == owner[:-back])).astype(np.uint64) << np.uint64(back)
    shouted = ((upper[ends] == upper[starts]) & (ends - starts > 2)).astype(np.uint64)
    ending = np.where(_KIND[last] == 2, 97, np.where(_KIND[last] == 3, 48, last)).astype(np.uint64)
    return mix((((_KIND[first] * np.uint64(256) + ending) * np.uint64(2) + shouted) * np.uint64(8) + again) ^ np.uint64(0xA5A5A5A5A5A5))


def features(column: pa.Array, bits: int = BITS):
    """For each chunk of rows [a, b): the owner, bucket and value of every n-gram."""
    data, offsets = text_buffers(column)
    for a, b in chunks(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        h, first = word_hashes(part, at)
        owner = np.repeat(np.arange(b - a), np.diff(first))
        shape = _shapes(part, at, h, owner)
        same = owner[1:] == owner[:-1]
        owners, buckets, values = [], [], []
        for kind, grams in enumerate((h, shape)):
            pairs = mix(grams[:-1] * np.uint64(3) + grams[1:] + np.uint64(kind))[same]
            for who, what in ((owner, grams), (owner[1:][same], pairs)):
                owners.append(who)
                buckets.append((what & np.uint64((1 << bits) - 1)).astype(np.int64))
                values.append(SCALE / np.maximum(np.bincount(who, minlength=b - a), 1)[who])
        yield a, b, np.concatenate(owners), np.concatenate(buckets), np.concatenate(values)


def ftrl(rows: list, bits: int = BITS, epochs: int = 6, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-4) -> np.ndarray:
    """FTRL-proximal over rows of (buckets, values, label), in the order given; the last weight is the bias."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        kept = np.abs(z[at]) > l1
        return np.where(kept, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    for _ in range(epochs):
        for bucket, value, label in rows:
            at, x = np.append(bucket, size - 1), np.append(value, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    return weights(slice(None)).astype("<f4")


def _sparse(batches):
    """Text to its distinct buckets and their summed values, as binary columns."""
    for batch in batches:
        at, values = [], []
        for a, b, owner, bucket, value in features(batch["text"]):
            key, inverse = np.unique((owner << BITS) | bucket, return_inverse=True)
            summed = np.bincount(inverse, value, len(key)).astype("<f4")
            low = (key & ((1 << BITS) - 1)).astype("<i4")
            cut = np.searchsorted(key, np.arange(b - a + 1) << BITS).tolist()
            at += [low[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)]
            values += [summed[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)]
        yield pa.RecordBatch.from_arrays(
            [batch["rank"], batch["quality"], pa.array(at, pa.binary()), pa.array(values, pa.binary())], ["rank", "quality", "at", "val"]
        )


def _fit(group: pa.Table) -> pa.Table:
    data = group.sort_by([("rank", "ascending"), ("quality", "ascending"), ("at", "ascending")]).to_pydict()
    rows = [
        (np.frombuffer(a, "<i4"), np.frombuffer(v, "<f4"), q)
        for a, v, q in zip(data["at"], data["val"], data["quality"], strict=True)
    ]
    return pa.table({"weights": pa.array([ftrl(rows).tobytes()], pa.binary())})


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> bytes:
    """Weights as little-endian float32: 2^BITS + 1 of them, whatever the input's size.

    labels: doc_id, quality. The sample is chosen from the labels alone and holds sample_rows rows at most, so that its ids can
    be broadcast to the scan of documents and its features fit in one task.
    """
    sample = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col("quality").cast("int")).alias("quality"))
        .select("doc_id", "quality", F.xxhash64("doc_id").alias("rank"))
        .orderBy("rank", "doc_id")
        .limit(sample_rows)
    )
    learned = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "rank", "quality").agg(F.min("text").alias("text"))
    sparse = learned.select("rank", "quality", "text").mapInArrow(_sparse, "rank long, quality int, at binary, val binary")
    got = sparse.groupBy().applyInArrow(_fit, "weights binary").head()
    return bytes(got["weights"]) if got else np.zeros((1 << BITS) + 1, "<f4").tobytes()


def score(documents: DataFrame, weights: bytes) -> DataFrame:
    """All columns of documents, and score: the likelihood of label 1, a double from 0 to 1."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    plain = documents.drop("score")
    schema = plain.withColumn("score", F.lit(0.0)).schema

    def run(batches):
        w = np.frombuffer(shared.value, "<f4")
        for batch in batches:
            found = np.zeros(batch.num_rows)
            for a, b, owner, bucket, value in features(batch.column("text")):
                found[a:b] = np.bincount(owner, w[bucket] * value, b - a)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(1 / (1 + np.exp(-(found + float(w[-1])))))], [*batch.schema.names, "score"]
            )

    return plain.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the documents whose labels are never learned from; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
