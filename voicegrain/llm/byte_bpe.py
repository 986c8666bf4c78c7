"""Byte-level BPE by prefix dynamic programming.

For each prefix of a piece there is one token that ends it in the prefix's own encoding. It is the one token t, ending there,
for which the last token before it and t stay apart when their bytes are merged by rank. Storing that token for
each prefix gives an encoder to which bytes can be appended exactly, one at a time, and which after an edit
computes only the prefixes behind the edit. A piece's encoding is read off backwards from its end.

The pieces of a text are the matches of a pattern, as in the public tokenizers. The pieces of some megabytes of text are encoded side
by side, prefix by prefix. For the pattern of the public vocabularies, texts between spaces are looked up in a table of bounded
size, so that most are split and encoded once in a task; by any other pattern each text is matched whole. Ranks are read on each
executor from a path that is a parameter.

Cases: a null text is an empty text and has no tokens; repeated rows each get a row; the result has its own columns and
doc_id only.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import cache, cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

#: Texts between spaces that a worker remembers in each of two generations, the longest one that it keeps, and pairs of tokens.
TABLE_ENTRIES, TABLE_TEXT, PAIR_ENTRIES = 250_000, 64, 1_000_000
#: Bytes of text that are handled at once; the longest piece that is encoded beside others, and how many bytes of such pieces.
CHUNK_BYTES, LONGEST_BESIDE, BESIDE_BYTES = 1_500_000, 64, 300_000
#: Fixed value: the pattern of which no match goes past a space that stands between two characters other than white space.
SPACED_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Just before such a space.
_CUT = re.compile(r"(?<=\S)(?= \S)")
_PUNCTUATION = "!#$%&()*+,-./:;<=>?@[]^_`{|}~\"\\"


class _Numbers:
    """A table from 64-bit keys, 0 or more, to numbers that is asked for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        """keys: all different."""
        self.size, self.bits = len(keys), (2 * len(keys) + 64).bit_length()
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        self._place(keys, values)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        at, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]  # of several keys for one place the last one gets it
            mine = self.keys[at[left]] == keys[left]
            self.values[at[left[mine]]] = values[left[mine]]
            left = left[~mine]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Their numbers, -1 for those that have none."""
        at, out, left = self._slots(keys), np.full(len(keys), -1, np.int32), np.arange(len(keys))
        while len(left):
            there = self.keys[at[left]]
            same = there == keys[left]
            out[left[same]] = self.values[at[left[same]]]
            left = left[~same & (there >= 0)]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds different keys that it lacks."""
        if 2 * (self.size + len(keys)) > len(self.keys):
            full = self.keys >= 0
            self.__init__(np.concatenate((self.keys[full], keys)), np.concatenate((self.values[full], values)))
        else:
            self._place(keys, values)
            self.size += len(keys)


class Vocabulary:
    """Ranks of a public byte-level vocabulary and what encoding and decoding need."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            parts = (line.split() for line in lines if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in parts}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.sizes = np.array([len(t) for t in self.tokens], np.int32)
        self.longest = max(map(len, self.ranks))
        #: The last three bytes of tokens, and the length of the longest one that ends so.
        self.reach: dict[bytes, int] = {}
        for token in sorted(self.ranks, key=len):
            self.reach[token[-3:]] = len(token)
        self.pattern, self.spaced = regex.compile(pattern), pattern == SPACED_PATTERN
        self._spines: dict[int, tuple[list, list]] = {}
        self._apart: dict[tuple[int, int], bool] = {}
        self._pairs = _Numbers(np.zeros(0, np.int64), np.zeros(0, np.int32))
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    @cached_property
    def _nodes(self) -> tuple[_Numbers, np.ndarray]:
        """The tree of all tokens by their bytes: which node follows a node by a byte, and which token ends in it."""
        after: dict[int, int] = {}
        ends = {}
        for token, rank in self.ranks.items():
            node = 0
            for byte in token:
                node = after.setdefault(node << 8 | byte, len(after) + 1)
            ends[node] = rank
        token_at = np.full(len(after) + 1, -1, np.int32)
        token_at[list(ends)] = list(ends.values())
        return _Numbers(np.array(list(after), np.int64), np.array(list(after.values()), np.int32)), token_at

    def merge(self, raw: bytes, stop: int = 1) -> list[bytes]:
        """Parts of some bytes straight from the definition: merge the pair of least rank, leftmost first, down to `stop` parts."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > stop:
            rank, i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(pairwise(parts)))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _spine(self, token: int) -> tuple[list, list]:
        """The parts that a token's bytes go through at its left and right edge while they are merged, from whole to single byte,
        each with the rank at which it is merged into the next larger one; empty lists if the bytes never become the token."""
        known = self._spines.get(token)
        if known is None:
            raw, sides = self.tokens[token], ([], [])
            if self.merge(raw) == [raw]:
                for side in (0, 1):
                    part, used = raw, 1 << 60
                    while True:
                        sides[side].append((part, used))
                        if len(part) == 1:
                            break
                        part, used = self.merge(part, 2)[-side], self.ranks[part]
            known = self._spines[token] = sides
        return known

    def _stays(self, a: int, b: int) -> bool:
        left = self._spine(b)[0]
        if a >= 0:
            get = self.ranks.get
            for x, x_used in self._spine(a)[1]:
                for y, y_used in left:
                    rank = get(x + y)
                    if rank is not None and rank < x_used and rank <= y_used:
                        return False
        return bool(left)

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the bytes of tokens a and b, put together, are encoded as a and b; a of -1 asks for b alone.

        They are unless a part x at the right edge of a and a part y at the left edge of b make a token that is merged before x
        and y are merged into larger parts of their own tokens (of equal ranks the left one goes first).
        """
        known = self._apart.get((a, b))
        if known is None:
            if len(self._apart) >= TABLE_ENTRIES:
                self._apart.clear()
            known = self._apart[a, b] = self._stays(a, b)
        return known

    def _all_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """stay_apart of many pairs."""
        keys = (a.astype(np.int64) + 1) << 32 | b
        known = self._pairs.get(keys)
        missing = np.flatnonzero(known < 0)
        if len(missing):
            new, at = np.unique(keys[missing], return_inverse=True)
            found = np.fromiter((self._stays((k >> 32) - 1, k & 0xFFFFFFFF) for k in new.tolist()), np.int32, len(new))
            if self._pairs.size >= PAIR_ENTRIES:
                self._pairs = _Numbers(new, found)
            else:
                self._pairs.put(new, found)
            known[missing] = found[at]
        return known == 1

    def _candidates(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and number of every token that lies in data without going past ends[start]."""
        after, token_at = self._nodes
        start = np.arange(len(data), dtype=np.int32)
        node = after.get(data.astype(np.int64))
        out, length = [], 1
        while len(start):
            token = token_at[node]
            has = token >= 0
            out.append((start[has], np.full(int(has.sum()), length, np.int32), token[has]))
            more = (node >= 0) & (start + length < ends[start])
            start, node = start[more], node[more]
            node = after.get(node.astype(np.int64) << 8 | data[start + length])
            start, node = start[node >= 0], node[node >= 0]
            length += 1
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _beside(self, raw: list[bytes]) -> list[bytes]:
        """Ids of short pieces: the last token of each prefix, for all pieces at once, by the place of the prefix's end."""
        sizes = np.array([len(x) for x in raw], np.int32)
        data = np.frombuffer(b"".join(raw), np.uint8)
        first = np.cumsum(sizes) - sizes
        piece = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
        start, length, token = self._candidates(data, (first + sizes)[piece])
        end = start - first[piece[start]] + length
        order = np.argsort((end * (LONGEST_BESIDE + 1) - length).astype(np.uint16), kind="stable")
        start, length, token, end = start[order], length[order], token[order], end[order]
        prefix = start + piece[start]  # a piece's prefixes have one place more than its bytes
        last = np.full(len(data) + len(raw), -2, np.int32)
        last[first + np.arange(len(raw))] = -1
        cuts = np.flatnonzero((end[1:] != end[:-1]) | (length[1:] != length[:-1])) + 1
        for lo, hi in pairwise([0, *cuts.tolist(), len(end)]):
            to = prefix[lo:hi] + length[lo]
            still = last[to] == -2
            to, new = to[still], token[lo:hi][still]
            fits = self._all_apart(last[prefix[lo:hi][still]], new)
            last[to[fits]] = new[fits]
        at, alive, found = first + sizes + np.arange(len(raw)), np.arange(len(raw)), []
        while len(alive):
            token = last[at]
            going = token >= 0
            at, alive, token = at[going], alive[going], token[going]
            found.append((alive, token))
            at = at - self.sizes[token]
        count = np.bincount(np.concatenate([a for a, _ in found]), minlength=len(raw))
        stop = np.cumsum(count)
        ids = np.zeros(int(stop[-1]), "<u4")
        for i, (alive, token) in enumerate(found):
            ids[stop[alive] - 1 - i] = token
        flat, at = ids.tobytes(), [0, *(4 * stop).tolist()]
        return [flat[i:j] for i, j in pairwise(at)]

    def pieces(self, texts: list[str]) -> dict[str, bytes]:
        """Ids, as little-endian unsigned 32-bit integers, of different matches of the pattern."""
        out, some, size = {}, [], 0
        for text in texts:
            if len(text) > LONGEST_BESIDE or len(raw := text.encode()) > LONGEST_BESIDE:
                out[text] = array("I", PrefixEncoder(self, text.encode()).ids()).tobytes()
                continue
            some.append((text, raw))
            size += len(raw)
            if size >= BESIDE_BYTES:
                out.update(zip((t for t, _ in some), self._beside([r for _, r in some]), strict=True))
                some, size = [], 0
        if some:
            out.update(zip((t for t, _ in some), self._beside([r for _, r in some]), strict=True))
        return out

    def _split(self, text: str) -> list[str]:
        """A text that no match goes out of, as matches."""
        core = text.rstrip(_PUNCTUATION)
        word = core[1:] if core[:1] == " " else core
        if word.isalpha() and (word.isascii() or max(word) < "\u0250"):  # one match, and one more for the marks behind it
            return [core, text[len(core) :]] if len(core) < len(text) else [core]
        return self.pattern.findall(text)

    def _spaced(self, texts: list[str]) -> list[bytes]:
        """Ids of texts by SPACED_PATTERN. What stands between spaces is looked up in a table; if white space of another kind or a
        further space is beside a space, the text is cut with care instead."""
        if len(self._young) >= TABLE_ENTRIES:
            self._young, self._old = {}, self._young
        young, old, known = self._young, self._old, self._young.get
        split = [t.split(" ") for t in texts]
        found = [list(map(known, parts)) for parts in split]
        gaps, missing = [], set()
        for parts, ids in zip(split, found, strict=True):
            ids[0] = b""
            gap = [j for j, x in enumerate(ids) if x is None]
            gaps.append(gap)
            missing.update([parts[j] for j in gap])
        new: dict[str, list[str]] = {}
        for x in missing:
            if x in old:
                young[x] = old[x]
            elif x and not x[0].isspace() and not x[-1].isspace():
                new[x] = self._split(" " + x)
        begun = {parts[0]: self._split(parts[0]) for parts in split}
        careful = {}
        for i, (parts, gap) in enumerate(zip(split, gaps, strict=True)):
            edge = parts[0][-1:]
            if (not edge and len(parts) > 1) or edge.isspace() or any(parts[j] not in new and parts[j] not in young for j in gap):
                careful[i] = _CUT.split(texts[i])
                begun.update((x, self._split(x)) for x in careful[i] if x not in begun)
        ids = self.pieces(list({p for made in (new, begun) for parts in made.values() for p in parts}))
        young.update((x, b"".join([ids[p] for p in parts])) for x, parts in new.items())
        heads = {x: b"".join([ids[p] for p in parts]) for x, parts in begun.items()}
        out = []
        for i, (parts, row, gap) in enumerate(zip(split, found, gaps, strict=True)):
            if i in careful:
                out.append(b"".join(map(heads.__getitem__, careful[i])))
            else:
                row[0] = heads[parts[0]]
                for j in gap:
                    row[j] = young[parts[j]]
                out.append(b"".join(row))
        for x in new:
            if len(x) > TABLE_TEXT:
                del young[x]
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers."""
        if self.spaced:
            return self._spaced(texts)
        split = [self.pattern.findall(t) for t in texts]
        ids = self.pieces(list({p for parts in split for p in parts}))
        return [b"".join(map(ids.__getitem__, parts)) for parts in split]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))


class PrefixEncoder:
    """The last token of each prefix of some bytes. Appending is exact; an edit recomputes only what lies behind it."""

    def __init__(self, vocabulary: Vocabulary, raw: bytes = b""):
        self.vocabulary, self.raw, self.last = vocabulary, bytearray(), [-1]
        self.append(raw)

    def append(self, more: bytes) -> None:
        v, last = self.vocabulary, self.last
        begin = len(self.raw)
        self.raw += more
        raw = bytes(self.raw)
        rank, reach, apart, stay = v.ranks.get, v.reach.get, v._apart.get, v.stay_apart
        for end in range(begin + 1, len(raw) + 1):
            for start in range(max(0, end - reach(raw[max(0, end - 3) : end], 2)), end):
                token = rank(raw[start:end])
                if token is not None:
                    known = apart((last[start], token))
                    if known or known is None and stay(last[start], token):
                        last.append(token)
                        break

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Puts new in place of bytes start to end and encodes again from there, until old and new prefixes agree."""
        tail, old = bytes(self.raw[end:]), self.last[end:]
        del self.raw[start:], self.last[start + 1 :]
        self.append(new)
        same = 0
        for i in range(len(tail)):
            self.append(tail[i : i + 1])
            same = same + 1 if self.last[-1] == old[i + 1] else 0
            if same >= self.vocabulary.longest:  # no token reaches back over so many equal prefixes
                self.raw += tail[i + 1 :]
                self.last += old[i + 2 :]
                break

    def ids(self) -> list[int]:
        out, end = [], len(self.raw)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


@cache
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about CHUNK_BYTES bytes each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(column):
        base = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, base + CHUNK_BYTES, "right")))
        yield first, last
        first = last


def encode_documents(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids: the token ids as little-endian unsigned 32-bit integers, of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            for a, b in _slices(batch["text"]):
                ids = v.encode_all([t or "" for t in batch["text"].slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, raw: the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            for a, b in _slices(batch["ids"]):
                ids = batch["ids"].slice(a, b - a)
                raw = [v.decode(x) for x in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), ids, pa.array(raw, pa.binary())], ["doc_id", "ids", "raw"])

    return encoded.mapInArrow(run, "doc_id long, ids binary, raw binary")
