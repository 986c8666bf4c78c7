"""WARC archives with a two-level capture index.

Pages are sorted by reversed-host URL key, dealt to ranges, and each task writes one archive (a gzip member for each record) and
its index: capture lines in compressed blocks of BLOCK_LINES, then a sparse directory with the first key of each
block, then the directory's length. The files' ranges are an index of the same kind, the root. Looking a key up takes a binary search in the
root's directory and one in a file's, one range read for each block and one for each record; nothing of it passes through the driver. Files go to the folder that all executors share; a task that is run again
writes under another name, and only the files of the attempt whose rows count are ever read.

A record whose payload (100 bytes or more) equals that of a page with a smaller page_id is a revisit of the smallest one.

Cases: a null html is an empty payload, a null url an empty key; page_id may be null, and then is read back as null; repeated rows
are separate records (those with the smallest page_id are all responses); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, shared_dir

BLOCK_LINES = 512
#: Smaller payloads are always written out.
REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
FILES = "archive string, index string, first string, last string, records long"


def url_key(url: Column) -> Column:
    """The host's labels in reverse, joined by commas, then `)` and the path and query; no scheme, user or fragment."""
    rest = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, "^[^/?]*", 0), "^.*@", ""))
    path = F.regexp_replace(rest, "^[^/?]*", "")
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), path)
    )


@contextmanager
def open_shared(uri: str, write: bool = False):
    """A binary file in the shared folder, by whatever scheme its name has."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    if write:
        system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) if write else system.open_input_file(path) as f:
        yield f


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit has the HTTP header of the full payload and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 5, mtime=0)


def parse_record(raw: bytes) -> dict:
    """What a record says, its payload checked against its digest (a revisit's is empty)."""
    text = zlib.decompress(raw, 31)
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = dict(re.findall(r"^([A-Za-z-]+): (.*)$", head.decode().replace("\r", ""), re.M))
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda x: int(x[10:-1]) if x and x != "<urn:page:>" else None
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "payload": payload,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("WARC-Refers-To")),
    }


class IndexWriter:
    """Writes sorted lines (lists, a key first) in compressed blocks, then the directory of the blocks' first keys and its length."""

    def __init__(self, file):
        self.file, self.lines, self.directory, self.at = file, [], [], 0

    def add(self, line: list) -> None:
        self.lines.append(json.dumps(line))
        if len(self.lines) == BLOCK_LINES:
            self._block()

    def _block(self) -> None:
        raw = zlib.compress("\n".join(self.lines).encode(), 5)
        self.directory.append((json.loads(self.lines[0])[0], self.at, len(raw)))
        self.file.write(raw)
        self.at += len(raw)
        self.lines.clear()

    def close(self) -> None:
        if self.lines:
            self._block()
        tail = zlib.compress(json.dumps(self.directory).encode())
        self.file.write(tail + len(tail).to_bytes(8, "big"))


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/{uuid.uuid4().hex}"
        batches = (b for b in batches if b.num_rows)
        start = next(batches, None)
        if start is None:
            return
        at = total = 0
        first = last = mark = refers_to = None
        with open_shared(f"{name}.warc.gz", True) as archive, open_shared(f"{name}.cdx", True) as file:
            index = IndexWriter(file)
            while start is not None:
                for row in start.to_pylist():
                    this = row["key"], row["page_id"], row["digest"]
                    if not row["is_page"]:  # sorted before the pages that it marks as revisits
                        mark, refers_to = this, row["refers_to"]
                        continue
                    raw = record(row["page_id"], row["url"], (row["html"] or "").encode(), row["digest"], refers_to if this == mark else None)
                    archive.write(raw)
                    index.add([row["key"], at, len(raw)])
                    at, total, last = at + len(raw), total + 1, row["key"]
                    first = last if first is None else first
                start = next(batches, None)
            index.close()
        yield pa.RecordBatch.from_pylist(
            [{"archive": f"{name}.warc.gz", "index": f"{name}.cdx", "first": first, "last": last, "records": total}]
        )

    return run


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages (page_id, url, html); returns the table of files: FILES, a row for each task that wrote."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    size = F.octet_length(F.coalesce("html", F.lit("")))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), url_key(F.col("url")).alias("key")
    )
    large = rows.where(size >= REVISIT_BYTES).select("key", "page_id", "digest")
    same = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    # Revisits are found without their payloads and meet their pages in the range that both are dealt to, so that html moves once.
    revisits = large.join(same.hint("merge"), "digest").where(F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()))
    marks = revisits.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "key", F.col("first").alias("refers_to"), F.lit(False).alias("is_page"))
    both = rows.withColumn("refers_to", F.lit(None).cast("long")).withColumn("is_page", F.lit(True)).unionByName(marks)
    placed = both.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "digest", "is_page")
    return materialize(placed.mapInArrow(_writer(folder), FILES), "warc-files")


class CaptureIndex:
    """An index file: its directory is read once, its blocks when a key needs them."""

    def __init__(self, file):
        self.file, self.block, self.at = file, [], -1
        size = file.size()
        length = int.from_bytes(file.read_at(8, size - 8), "big")
        self.directory = json.loads(zlib.decompress(file.read_at(length, size - 8 - length)))
        self.keys = [d[0] for d in self.directory]

    def since(self, key: str) -> Iterator[list]:
        """The lines from this key on, by binary search and a range read for each block."""
        i = max(0, bisect.bisect_left(self.keys, key) - 1)  # equal keys may begin in the block before
        while i < len(self.keys):
            if i != self.at:
                _, offset, length = self.directory[i]
                self.block = [json.loads(x) for x in zlib.decompress(self.file.read_at(length, offset)).decode().split("\n")]
                self.at = i
            block = self.block
            yield from block[bisect.bisect_left(block, key, key=lambda line: line[0]) :]
            i += 1

    def find(self, key: str) -> Iterator[tuple[int, int]]:
        """Offset and length of each record with this key."""
        for found, offset, length in self.since(key):
            if found != key:
                return
            yield offset, length


def write_root(files: DataFrame) -> str:
    """Writes the root: for each file, sorted, its last key, its first key and its name. It has a line for each task that wrote."""
    path = f"{shared_dir(files.sparkSession)}/warc-root-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{path}/{uuid.uuid4().hex}"
        with open_shared(name, True) as file:
            root = IndexWriter(file)
            for batch in batches:
                for row in batch.to_pylist():
                    root.add([row["last"], row["first"], row["index"]])
            root.close()
        yield pa.RecordBatch.from_pylist([{"root": name}])

    lines = files.select("last", "first", "index").repartition(1).sortWithinPartitions("last", "first", "index")
    return materialize(lines.mapInArrow(run, "root string"), "warc-roots").head()["root"]


CAPTURES = "key string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def lookup(keys: DataFrame, files: DataFrame, with_payload: bool = True) -> DataFrame:
    """All captures (CAPTURES) of the URL keys in column `key`, read back from the archives.

    Every task reads what it needs of the root and of the files' indexes.
    """
    if files.isEmpty():
        return keys.sparkSession.createDataFrame([], CAPTURES)
    root_path = write_root(files)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open_shared(root_path) as file:
            root = CaptureIndex(file)
            for batch in batches:
                key, index = [], []
                for k in batch["key"].to_pylist():
                    for _, first, name in root.since(k):
                        if first > k:
                            break
                        key.append(k)
                        index.append(name)
                yield pa.RecordBatch.from_arrays([pa.array(index, pa.string()), pa.array(key, pa.string())], ["index", "key"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
        )
        for batch in batches:
            names, keys_now = batch["index"].to_pylist(), batch["key"].to_pylist()
            first = 0
            while first < len(names):
                end = bisect.bisect_right(names, names[first])
                out, held = [], 0
                with open_shared(names[first]) as blocks, open_shared(names[first].removesuffix(".cdx") + ".warc.gz") as archive:
                    index = CaptureIndex(blocks)
                    for key in keys_now[first:end]:
                        for offset, length in index.find(key):
                            got = parse_record(archive.read_at(length, offset))
                            held += len(got["payload"])
                            out.append({"key": key} | got | ({} if with_payload else {"payload": None}))
                            if held > 4_000_000:
                                yield pa.RecordBatch.from_pylist(out, schema)
                                out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, schema)
                first = end

    wanted = keys.select("key").where(F.col("key").isNotNull()).distinct().sortWithinPartitions("key").mapInArrow(deal, "index string, key string")
    return wanted.repartitionByRange("index", "key").sortWithinPartitions("index", "key").mapInArrow(read, CAPTURES)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages and reads every capture back by its URL: the columns of query op6."""
    files = write_archives(pages)
    found = lookup(pages.select(url_key(F.col("url")).alias("key")), files, with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
