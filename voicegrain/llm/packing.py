"""Vector bin packing of tokenized examples, by the dot-product heuristic.

An example's ids are a prompt and an answer; only the answer bears loss. It is cut into pieces that fit a sequence, and they are placed
under three limits at once: tokens, segments and loss-bearing tokens. A bin is filled one piece at a time by the piece that fits and has
the greatest dot product of its demand with the bin's remaining room, each in units of the limit. What room the heuristic leaves is filled
by cutting a piece, as pieces may be cut anywhere. What is left at the end of a partition is cut into sequences of a power of two, which
need no padding. Each partition of the input is packed where it is read, so nothing is shuffled; at most POOL pieces wait at a
time, each with its own ids alone, so memory is bounded by them and the longest document.

Cases: a null text is an empty text, whose only id is the end mark; repeated rows are packed again; an empty table gives an empty
result; other columns are ignored. Sequence ids are unique over the whole result: the partition's number, then a count. The strings of the
tokenizer's special tokens in a text become those tokens, as in the library, unless special_as_text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

POOL = 1_024
#: Words that a worker remembers in each of two generations, the longest word that it keeps, and the text handled at once.
CACHE_ENTRIES, CACHE_WORD, CHUNK_CHARS = 400_000, 64, 400_000
_PUNCTUATION = b"!#$%&()*+,-./:;<=>?@[]^_`{|}~\"\\"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordTokenizer:
    """Ids of whole texts from a tokenizer that never joins what ASCII white space separates, word by word.

    Words are remembered as their ids' bytes. New words that are letters only (but for punctuation behind them) are encoded
    together: each is one piece to the tokenizer, and ends with the one of its ids that is marked as a word's end.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        vocabulary = self.tokenizer.get_vocab()
        self.kind = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _raw(self, words: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in coded]

    def _letters(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters only."""
        flat = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(self.ends[flat]) + 1
        if len(ends) != len(words):  # some letter is not one to the tokenizer
            return self._raw([w.decode() for w in words])
        raw, width = flat.tobytes(), flat.itemsize
        cuts = [0, *(ends * width).tolist()]
        return [raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, words: list[bytes]) -> None:
        """Puts the ids of words that are not in the young generation there."""
        cores: dict[bytes, bytes] = {}
        split, rest = [], []
        for w in words:
            known = self.old.get(w)
            if known is not None:
                self.young[w] = known
                continue
            core = w.rstrip(_PUNCTUATION)
            if core.isalpha() or core and core.decode().isalpha():
                split.append((w, core, w[len(core) :]))
                cores[core] = b""
            else:
                rest.append(w)
        new = [c for c in cores if c not in self.young]
        if new:
            cores.update(zip(new, self._letters(new), strict=True))
        tails = {t for _, _, t in split if t and t not in self.young} | set(rest)
        listed = list(tails)
        coded = dict(zip(listed, self._raw([t.decode() for t in listed]), strict=True)) if listed else {}
        for w in rest:
            self.young[w] = coded[w]
        for w, core, tail in split:
            ids = cores[core] or self.young[core]
            self.young[w] = ids + (coded[tail] if tail in coded else self.young[tail]) if tail else ids

    def ids(self, texts: list[str], end: int) -> list[np.ndarray]:
        """Ids of each text, then `end`, as little-endian unsigned 32-bit integers."""
        if len(self.young) > CACHE_ENTRIES:
            self.young, self.old = {}, self.young
        split = [t.encode().split() for t in texts]
        young = self.young
        found = [list(map(young.get, words)) for words in split]
        gaps = [[i for i, x in enumerate(ids) if x is None] if None in ids else () for ids in found]
        new = {words[i] for words, gap in zip(split, gaps, strict=True) for i in gap}
        self._learn(list(new))
        last = np.array([end], self.kind).tobytes()
        out = []
        for words, ids, gap in zip(split, found, gaps, strict=True):
            for i in gap:
                ids[i] = young[words[i]]
            ids.append(last)
            out.append(np.frombuffer(b"".join(ids), self.kind).astype("<u4"))
        for w in new:
            if len(w) > CACHE_WORD:
                del young[w]
        return out


@cache
def tokenizer(path: str, special_as_text: bool = False) -> WordTokenizer:
    return WordTokenizer(path, special_as_text)


class Ids(NamedTuple):
    """The ids from place `first` on, or some of them, of a document that has `total` in all."""

    doc_id: int | None
    total: int
    first: int
    ids: np.ndarray

    def part(self, start: int, length: int) -> Ids:
        at = start - self.first
        return Ids(self.doc_id, self.total, start, self.ids[at : at + length].copy())


class Packer:
    """Takes pieces and gives full sequences; demand of a piece: (tokens, 1 segment, loss-bearing tokens).

    hold(doc, start, length): what is kept of a document while one of its pieces waits.
    """

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, hold: Callable = lambda doc, start, length: doc):
        self.limit = np.array([max_tokens, max_segments, max_loss], float)
        self.max_tokens, self.hold = max_tokens, hold
        self.pool: list[tuple] = []
        self.sequences = 0

    def add(self, doc: tuple, start: int, length: int, loss: int) -> Iterator[list]:
        """doc: anything; start, length: the piece's ids in it; loss: how many of them, the last ones, bear loss."""
        while length >= self.max_tokens and loss == length and self.limit[2] >= self.max_tokens:
            yield [(doc, start, self.max_tokens, self.max_tokens)]
            start, length, loss = start + self.max_tokens, length - self.max_tokens, loss - self.max_tokens
        while length > self.max_tokens or loss > self.limit[2]:
            n = min(self.max_tokens, length - loss + int(self.limit[2]))
            part = max(0, n - (length - loss))
            yield from self._put((doc, start, n, part))
            start, length, loss = start + n, length - n, loss - part
        if length:
            yield from self._put((doc, start, length, loss))

    def _put(self, piece: tuple) -> Iterator[list]:
        doc, start, length, loss = piece
        self.pool.append((self.hold(doc, start, length), start, length, loss))
        if len(self.pool) >= POOL:
            yield from self._fill(POOL // 2)

    def flush(self) -> Iterator[list]:
        yield from self._fill(0)
        while self.pool:
            yield from self._powers()

    def _fill(self, keep: int) -> Iterator[list]:
        """Sequences out of the pool, while it has more than `keep` pieces and the tokens of one sequence."""
        pool = self.pool
        length, loss = (np.array([p[i] for p in pool], np.int64) for i in (2, 3))
        free, count, tokens = np.ones(len(pool), bool), len(pool), int(length.sum())
        full = self.limit.astype(int)
        while count > keep and tokens >= self.max_tokens:
            room, chosen = full.copy(), []
            while room[1]:
                fits = free & (length <= room[0]) & (loss <= room[2])
                weight = room / self.limit**2  # dot product of room and demand, both in units of the limits
                best = int(np.argmax(np.where(fits, length * weight[0] + weight[1] + loss * weight[2], -1.0)))
                if not fits[best]:
                    break
                chosen.append(pool[best])
                room -= (length[best], 1, loss[best])
                free[best] = False
                count -= 1
            if room[0] and room[1]:  # some piece is cut, so that its first ids fill the room
                head = length - loss
                cuts = free & (length > room[0]) & (room[0] - head <= room[2])
                i = int(np.argmax(cuts))
                if cuts[i]:
                    n = int(room[0])
                    part = max(0, n - int(head[i]))
                    doc, start = pool[i][0], pool[i][1]
                    chosen.append((doc, start, n, part))
                    length[i], loss[i] = length[i] - n, loss[i] - part
                    pool[i] = (doc, start + n, int(length[i]), int(loss[i]))
            tokens -= sum(p[2] for p in chosen)
            yield chosen
        self.pool = [p for p, f in zip(pool, free.tolist(), strict=True) if f]

    def _powers(self) -> Iterator[list]:
        """The rest, cut so that each sequence has a power of two of tokens."""
        whole, self.pool = self.pool, []
        while whole:
            total = sum(p[2] for p in whole)
            size, now = 1 << (total.bit_length() - 1), []
            room = self.limit - 0
            while whole and size and room[1] >= 1:
                doc, start, length, loss = whole.pop(0)
                n = int(min(size, length, length - loss + room[2]))
                part = max(0, n - (length - loss))
                if n:
                    now.append((doc, start, n, part))
                    size, room = size - n, room - np.array([n, 1, part])
                if n < length:
                    whole.insert(0, (doc, start + n, length - n, loss - part))
                    if not n or not size:
                        break
            yield now


def _few(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """The batch's ids and texts, about CHUNK_CHARS of text at a time."""
    names, texts, held = [], [], 0
    for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
        names.append(doc_id)
        texts.append(text.as_py() or "")
        held += len(texts[-1])
        if held >= CHUNK_CHARS:
            yield names, texts
            names, texts, held = [], [], 0
    yield names, texts


def pack(
    documents: DataFrame,
    path: str,
    end: int = 1,
    max_tokens: int = 2_048,
    max_segments: int = 128,
    max_loss: int = 1_536,
    answer: float = 0.5,
    special_as_text: bool = False,
) -> DataFrame:
    """One row for each piece (SCHEMA): which ids of which document, and where in which sequence.

    The ids of a document are those of the tokenizer file at `path`, then `end`. The last ones, a share of `answer`, bear loss.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first_id = TaskContext.get().partitionId() << 40
        packer = Packer(max_tokens, max_segments, max_loss, Ids.part)
        t = tokenizer(path, special_as_text)
        rows: list[tuple] = []

        def place(sequences: Iterator[list]) -> None:
            for sequence in sequences:
                offset = 0
                for doc, start, length, _ in sequence:
                    at = start - doc.first
                    crc = zlib.crc32(doc.ids[at : at + length].tobytes())
                    rows.append((doc.doc_id, start, length, crc, doc.total, first_id + packer.sequences, offset))
                    offset += length
                packer.sequences += 1

        def out() -> pa.RecordBatch:
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batches:
            for names, texts in _few(batch):
                for doc_id, ids in zip(names, t.ids(texts, end), strict=True):
                    place(packer.add(Ids(doc_id, len(ids), 0, ids), 0, len(ids), math.ceil(answer * len(ids))))
                    if len(rows) >= 20_000:
                        yield out()
        place(packer.flush())
        yield out()

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)
