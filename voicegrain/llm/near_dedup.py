"""MinHash near-deduplication by a multi-index Hamming join, confirmed on full shingle sets.

1. Each document becomes the set of its distinct k-word shingles, and a signature of 40 b-bit symbols (b = 16): for each of
   40 hash functions, the low bits of the least hash.
2. Documents with equal sets are one class; only one node for each class goes on.
3. Multi-index: a signature is cut into 8 chunks of 5 symbols. Two signatures that differ in at most 15 symbols agree, by
   pigeonhole, in some chunk but for at most one symbol; so the 5 ways to leave one symbol of a chunk out are enumerated, and
   every pair under that distance meets under one of 40 keys. (Pairs at 16 to 20 differing symbols that meet are kept, too. A
   pair of similarity 0.8 is missed with a chance of about 3 in 100,000.)
4. Nodes that meet and differ in at most 20 symbols form families: inside a key's group a breadth-first walk compares
   signatures and emits a tree, never all pairs. A key's group that is large is cut into blocks, and pairs of blocks are spread over
   tasks, so a hot key is neither gathered in one task nor dropped.
5. Families are confirmed on full sets. First all members are compared with the family's centre, the member whose keys most others
   have, in blocks that each get a copy of it. Those that it does not link are then compared with all members, by pairs of blocks, so that
   a text is copied once for each block of them, and not for each block of the family. Components of the confirmed links are the groups.

Joins on keys that many rows share (a set with many copies, a node with many links) are sort-merge joins, whose skewed sides Spark splits
(spark.sql.adaptive.skewJoin.enabled); what is grouped by such a key is aggregated before it is shuffled.

Cases: null, empty and blank texts have no shingles and are linked with nothing; a text of fewer than k words is one shingle;
repeated rows share a class; rows of one doc_id count as linked, even if their texts are unlike; rows of a null doc_id go by a hash of their text in its place, are
linked as any other, and have a null component if no row with a doc_id is linked to them; an empty table gives an empty result; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .hashing import chunks, mix, reduce_each, shingles, text_buffers, word_hashes
from .shared import materialize

CHUNKS, WIDTH = 8, 5
SYMBOLS = CHUNKS * WIDTH
#: Signatures that differ in more symbols are not compared on full sets.
MAX_DIFFERENCE = 20
#: Nodes of one key, and nodes and shingles of one family, that a block holds.
KEY_BLOCK, FAMILY_BLOCK, FAMILY_SHINGLES = 2_048, 128, 1_000_000
_SEEDS = np.random.default_rng(77).integers(1, 2**63, (2, SYMBOLS), dtype=np.uint64) | np.uint64(1)
_SALTS = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64)).reshape(CHUNKS, WIDTH)


def signatures(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of SYMBOLS 16-bit symbols for each document."""
    out = np.zeros((len(at) - 1, SYMBOLS), "<u2")
    for j in range(SYMBOLS):
        least = reduce_each(np.minimum, (values ^ _SEEDS[0, j]) * _SEEDS[1, j], at, 0)
        out[:, j] = mix(least).astype("<u2")
    return out


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch["text"])
            for a, b in chunks(offsets):
                values, at = shingles(*word_hashes(data, offsets[a : b + 1]), k)
                sums = [reduce_each(np.add, mix(values ^ np.uint64(salt)), at, 0) for salt in (11, 13)]
                whole = np.stack(sums, axis=1).astype("<u8")
                n = np.diff(at)
                sig = signatures(values, at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(a, b - a),
                        batch["known"].slice(a, b - a),
                        pa.array(n.astype(np.int64)),
                        pa.array([x.tobytes() for x in whole], pa.binary()),
                        pa.array([x.tobytes() for x in sig], pa.binary()),
                    ],
                    ["doc_id", "known", "n_shingles", "set", "sig"],
                )

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, sig to node and its 40 keys: each chunk with each one symbol left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), "<u2").reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
        keys = np.empty((len(sig), CHUNKS, WIDTH), np.uint64)
        for j in range(WIDTH):
            rest = [sig[:, :, i] for i in range(WIDTH) if i != j]
            keys[:, :, j] = rest[0] | rest[1] << np.uint64(16) | rest[2] << np.uint64(32) | rest[3] << np.uint64(48)
        keys = mix(keys ^ _SALTS).reshape(-1).view(np.int64)
        node = np.repeat(batch["node"].to_numpy(zero_copy_only=False), SYMBOLS)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(node)], ["key", "node"])


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups, many at a time, from batches that are sorted by the columns `by`."""
    rest = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        if rest is not None:
            now = pa.concat_tables([rest, now])
        if not now.num_rows:
            continue
        last = now.num_rows - 1
        same = np.ones(now.num_rows, bool)
        for c in by:
            column = now[c].to_numpy()
            same &= column == column[last]
        cut = int(np.argmax(same))
        if cut:
            yield now.slice(0, cut).combine_chunks()
        rest = now.slice(cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


def _bounds(table: pa.Table, by: list[str]) -> np.ndarray:
    """Where the groups of a table begin, and its end."""
    fresh = np.zeros(table.num_rows, bool)
    fresh[0] = True
    for c in by:
        column = table[c].to_numpy()
        fresh[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(fresh), table.num_rows)


def _walk(sig: np.ndarray, node: np.ndarray, a: list, b: list) -> None:
    """Appends a tree for each part of the group that signatures connect."""
    left = np.arange(len(node))
    while len(left) > 1:
        frontier, left, root = [left[0]], left[1:], node[left[0]]
        while frontier and len(left):
            near = (sig[left] != sig[frontier.pop()]).sum(axis=1) <= MAX_DIFFERENCE
            if near.any():
                found = left[near]
                left = left[~near]
                frontier += found.tolist()
                a += [root] * len(found)
                b += node[found].tolist()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted groups of one key to the edges of their trees."""
    by = ["key", "pair"]
    for table in _groups(batches, by):
        at = _bounds(table, by)
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), "<u2").reshape(-1, SYMBOLS)
        node = table["node"].to_numpy()
        size = np.diff(at)
        two = at[:-1][size == 2]
        near = two[(sig[two] != sig[two + 1]).sum(axis=1) <= MAX_DIFFERENCE]
        a, b = node[near].tolist(), node[near + 1].tolist()
        for i in np.flatnonzero(size > 2):
            rows = slice(at[i], at[i + 1])
            _walk(sig[rows], node[rows], a, b)
        edges = np.unique(np.sort(np.array([a, b], np.int64).reshape(2, -1), axis=0), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], ["a", "b"])


def _links(some: list[np.ndarray], others: list[np.ndarray], percent: int) -> np.ndarray:
    """Matrix of which of some sets are like which others: 100 * intersection >= percent * union."""
    values = some + others
    n, k = len(values), len(some)
    sizes = np.array([len(v) for v in values], np.float64)
    owner = np.repeat(np.arange(n), [len(v) for v in values])
    flat = np.concatenate(values)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.append(True, flat[1:] != flat[:-1])
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    common = np.zeros((k, n - k))
    step = max(1, 4_000_000 // n)
    for lo in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(column, (lo, lo + step))
        m = np.zeros((n, step), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        common += m[:k] @ m[k:].T
    return 100 * common >= percent * (sizes[:k, None] + sizes[None, k:] - common)


def _tree(linked: np.ndarray, node: np.ndarray, a: list, b: list) -> None:
    left = np.arange(len(node))
    while len(left) > 1:
        frontier, left, root = [left[0]], left[1:], node[left[0]]
        while frontier and len(left):
            near = linked[frontier.pop(), left]
            found, left = left[near], left[~near]
            frontier += found.tolist()
            a += [root] * len(found)
            b += node[found].tolist()


def _confirmed(k: int, percent: int):
    """Groups of one family and pair, sorted by side, to a forest of the links between the sets of side 0 and those of side 1."""
    by = ["family", "pair"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, by):
            at = _bounds(table, by)
            node, side = table["node"].to_numpy(), table["side"].to_numpy()
            a: list[int] = []
            b: list[int] = []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                cut = int((side[lo:hi] == 0).sum())
                if not 0 < cut < hi - lo:
                    continue
                data, offsets = text_buffers(table["text"].slice(lo, hi - lo))
                values: list[np.ndarray] = []
                for x, y in chunks(offsets):
                    flat, ends = shingles(*word_hashes(data, offsets[x : y + 1]), k)
                    values += np.split(flat, ends[1:-1])
                linked = np.zeros((hi - lo, hi - lo), bool)
                linked[:cut, cut:] = _links(values[:cut], values[cut:], percent)
                _tree(linked | linked.T, node[lo:hi], a, b)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64))], ["a", "b"])

    return run


def _in_blocks(rows: DataFrame, blocks, node: str = "node") -> DataFrame:
    """Adds pair: the id of each pair of blocks that a row belongs to. Any two rows of a group meet in some pair."""
    own = F.pmod(F.xxhash64(node, F.lit(5)), blocks)
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other")
    return (
        rows.withColumn("block", own)
        .select("*", other)
        .withColumn("pair", F.least("block", "other") * blocks + F.greatest("block", "other"))
        .drop("block", "other")
    )


def _blocks(members: str, shingles_: str):
    """How many blocks some nodes with so many shingles make."""
    return F.ceil(F.greatest(F.col(members) / FAMILY_BLOCK, F.col(shingles_) / FAMILY_SHINGLES, F.lit(1.0))).cast("long")


def _own(blocks: str, salt: int):
    return F.pmod(F.xxhash64("node", F.lit(salt)), F.col(blocks))


def _every(blocks: str):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))


def _compared(placed: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: links on full sets. placed: family, pair, side, node; of each family and pair the nodes of side 0 are compared with those of side 1."""
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # set, as what a byte of sets costs is far above the usual
    rows = placed.join(texts.hint("merge"), "node")
    rows = rows.repartition(tasks, "family", "pair").sortWithinPartitions("family", "pair", "side")
    return materialize(rows.mapInArrow(_confirmed(k, percent), "a long, b long"), "links")


def _confirm(family: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: links that join whatever members of one family are connected by links. family: node, family, n, popularity."""
    texts = docs.withColumnRenamed("doc_id", "node").join(family.select("node").distinct().hint("merge"), "node", "left_semi")
    texts = materialize(texts, "family-texts")  # so that the other texts are shuffled once
    centres = family.groupBy("family").agg(
        F.min(F.struct(-F.col("popularity"), "node"))["node"].alias("centre"), F.count("*").alias("members"), F.sum("n").alias("all")
    )
    centres = materialize(centres.withColumn("blocks", _blocks("members", "all")), "centres")
    around = family.join(centres, "family").where(F.col("node") != F.col("centre"))
    around = around.select("family", _own("blocks", 5).alias("pair"), F.lit(1).alias("side"), "node")
    centre = centres.select("family", _every("blocks").alias("pair"), F.lit(0).alias("side"), F.col("centre").alias("node"))
    linked = _compared(around.unionByName(centre), texts, k, percent)

    met = linked.select(F.col("a").alias("node")).unionByName(linked.select(F.col("b").alias("node"))).distinct()
    left = family.join(centres, "family").where(F.col("node") != F.col("centre")).join(met.hint("merge"), "node", "left_anti")
    left = materialize(left.select("family", "node", "n", "blocks"), "outsiders")
    rows = left.groupBy("family").agg(F.count("*").alias("members"), F.sum("n").alias("all"), F.max("blocks").alias("blocks"))
    rows = rows.select("family", "blocks", _blocks("members", "all").alias("rows"))
    pair = lambda row, column: (row * F.col("blocks") + column).alias("pair")
    some = left.drop("blocks").join(rows, "family").withColumn("column", _every("blocks"))
    some = some.select("family", pair(_own("rows", 7), F.col("column")), F.lit(0).alias("side"), "node")
    others = family.join(rows, "family").withColumn("row", _every("rows"))
    others = others.select("family", pair(F.col("row"), _own("blocks", 5)), F.lit(1).alias("side"), "node")
    return linked.unionByName(_compared(some.unionByName(others), texts, k, percent))


def near_groups(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of documents."""
    spark = documents.sparkSession
    doc_id = F.col("doc_id").cast("long")
    docs = documents.select(F.coalesce(doc_id, F.xxhash64(F.lit("no id"), "text")).alias("doc_id"), doc_id.isNotNull().alias("known"), "text")
    signed = materialize(docs.mapInArrow(_signed(k), "doc_id long, known boolean, n_shingles long, set binary, sig binary"), "signatures")
    docs = docs.drop("known")
    classes = (
        signed.where("n_shingles > 0")
        .groupBy("set")
        .agg(
            F.min(F.when(F.col("known"), F.col("doc_id"))).alias("least"), F.min("doc_id").alias("any"),
            F.first("sig").alias("sig"), F.first("n_shingles").alias("n"), F.count("*").alias("rows"),
        )
    )
    classes = materialize(classes.withColumn("node", F.coalesce("least", "any")).drop("any"), "classes")
    nodes = classes.select("node", "sig", "n")

    keyed = nodes.select("node", "sig").mapInArrow(_keyed, "key long, node long")
    hot = keyed.groupBy("key").agg(F.count("*").alias("met")).where("met > 1")
    # Merge joins at every size, so that one plan holds from the first gigabyte on.
    keyed = materialize(keyed.join(hot.hint("merge"), "key"), "keys")
    met = keyed.join(nodes.select("node", "sig").hint("merge"), "node")
    met = _in_blocks(met, F.ceil(F.col("met") / KEY_BLOCK)).select("key", "pair", "node", "sig")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # set, as what a byte of signatures costs is far above the usual
    met = met.repartition(tasks, "key", "pair").sortWithinPartitions("key", "pair")
    near = materialize(met.mapInArrow(_met, "a long, b long"), "near")

    known = nodes.groupBy("node").agg(F.max("n").alias("n")).join(keyed.groupBy("node").agg(F.sum("met").alias("popularity")), "node")
    family = connected_components(near).withColumnRenamed("component", "family")
    family = materialize(family.join(known, "node"), "families")
    component = connected_components(_confirm(family, docs, k, percent))

    joined = classes.join(component, "node", "left").select("set", "rows", "least", "component")
    named = joined.where("component is not null").groupBy("component").agg(F.min("least").alias("least_of_all"))
    grouped = (
        joined.where((F.col("rows") > 1) | F.col("component").isNotNull())
        .join(named, "component", "left")
        .select("set", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("least_of_all")).alias("component"))
    )
    found = signed.select(F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "n_shingles", "set").join(grouped, "set", "left")
    of = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", of.alias("component_id"), F.coalesce(F.col("doc_id") == of, F.lit(False)).alias("kept"))
