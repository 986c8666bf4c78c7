"""Quality classifier, byte-level BPE, archives, packing, language-model scores and the pipeline, against plain versions."""

import hashlib
import os
import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import tiktoken
from brute import base_rules, classifier_features, ftrl, lm_scores
from tiktoken.load import load_tiktoken_bpe
from tokenizers import Tokenizer

import corpus_pipeline
from voicegrain.llm import byte_bpe, lm_scoring, packing, quality_model, warc

SCHEMA = "doc_id long, text string"
BPE, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
BITS = ["hello", " world", "  ", "\n\n", " \t x", "don't", "I'LL", "12345", "é", "日本語", "🎉", " ", "...", "aaaaaaaa", "<|endoftext|>", "</w>", "[UNK]", "!?", "Ω̈", "\r\n", "zz", "qu", "İ"]


def odd_texts(seed, n=200):
    rng = random.Random(seed)
    return ["".join(rng.choices(BITS, k=rng.randint(0, 30))) for _ in range(n)] + [None, "", " ", "a" * 3000, "x1" * 1500, "lorem ipsum " * 20_000]


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), SCHEMA).selectExpr("*", "1 AS score", "2 AS ids", "3 AS start", "4 AS n_words", "5 AS block")


# Byte-level BPE


@pytest.fixture(scope="module")
def reference_bpe():
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(BPE), special_tokens={})


def test_bpe_equals_the_library_and_round_trips(spark, reference_bpe):
    texts = odd_texts(1)
    encoded = byte_bpe.encode_documents(documents(spark, texts), BPE, public_tokenizers.PATTERN)
    got = byte_bpe.decode_documents(encoded, BPE, public_tokenizers.PATTERN).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == reference_bpe.encode_ordinary(text), text
        assert bytes(r.raw) == text.encode()
    assert byte_bpe.encode_documents(spark.createDataFrame([], SCHEMA), BPE, public_tokenizers.PATTERN).count() == 0


def test_bpe_equals_the_library_for_another_pattern(spark):
    other = r"[^\r\n\p{L}\p{N}]?\p{Lu}*\p{Ll}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+|\p{L}"
    library = tiktoken.Encoding("other", pat_str=other, mergeable_ranks=load_tiktoken_bpe(BPE), special_tokens={})
    texts = [*odd_texts(11, 100), "helloWorld camelCaseName", "a bC dE"]
    for r in byte_bpe.encode_documents(documents(spark, texts), BPE, other).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(texts[r.doc_id] or ""), texts[r.doc_id]


def test_bpe_of_repeated_rows(spark):
    rows = [(1, "same text here")] * 5 + [(None, None)] * 2
    got = byte_bpe.encode_documents(spark.createDataFrame(rows, SCHEMA), BPE, public_tokenizers.PATTERN).collect()
    assert len(got) == 7 and len({(r.doc_id, bytes(r.ids)) for r in got}) == 2


def test_prefix_encoder_appends_and_edits(reference_bpe):
    rng = random.Random(2)
    v = byte_bpe.vocabulary(BPE, public_tokenizers.PATTERN)
    for _ in range(150):
        raw = bytes(rng.choices(b"abcdeinrst ", k=rng.randint(0, 60)))
        e = byte_bpe.PrefixEncoder(v)
        for i in range(0, len(raw), 7):
            e.append(raw[i : i + 7])
        assert e.ids() == reference_bpe._encode_single_piece(raw) if raw else e.ids() == []
        a, b = sorted((rng.randint(0, len(raw)), rng.randint(0, len(raw))))
        new = bytes(rng.choices(b"abcdeinrst ", k=rng.randint(0, 9)))
        e.replace(a, b, new)
        edited = raw[:a] + new + raw[b:]
        assert bytes(e.raw) == edited
        assert e.ids() == (reference_bpe._encode_single_piece(edited) if edited else [])


# Packing


def test_packing_places_each_id_once(spark):
    tokenizer = Tokenizer.from_file(WORDS)
    rng = random.Random(3)
    texts = odd_texts(2, 60) + ["<|endoftext|> x", "a<|endoftext|>.<|startoftext|>b", "<|ENDOFTEXT|> <|endoftext|", "x " * 500_000] + [" ".join(f"word{rng.randrange(500)}" for _ in range(rng.randint(1, 900))) for _ in range(60)]
    rows = packing.pack(documents(spark, texts), WORDS).collect()
    pieces, held = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        held[r.sequence_id].append(r)
    assert pieces.keys() == set(range(len(texts)))
    for d, parts in pieces.items():
        ids = np.array([*tokenizer.encode(texts[d] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for parts in held.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and len(parts) <= 128
        assert sum(max(0, p.start + p.length - max(p.start, p.doc_tokens // 2)) for p in parts) <= 1536  # the later half bears loss
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.02 * sum(r.length for r in rows)
    assert packing.pack(spark.createDataFrame([], SCHEMA), WORDS).count() == 0


def test_packer_holds_all_three_limits():
    rng = random.Random(4)
    packer = packing.Packer(100, 5, 60)
    examples = [(i, n := rng.randint(1, 330), rng.randint(0, n)) for i in range(2500)]
    sequences = [s for i, n, loss in examples for s in packer.add(i, 0, n, loss)] + list(packer.flush())
    seen = defaultdict(list)
    for s in sequences:
        assert sum(p[2] for p in s) <= 100 and len(s) <= 5 and sum(p[3] for p in s) <= 60
        for doc, start, length, loss in s:
            seen[doc].append((start, length, loss))
    for i, n, loss in examples:
        parts = sorted(seen[i])
        assert [p[0] for p in parts] == np.cumsum([0, *(p[1] for p in parts)])[:-1].tolist()
        assert sum(p[1] for p in parts) == n and sum(p[2] for p in parts) == loss


def test_waiting_pieces_hold_their_own_ids_alone():
    packer = packing.Packer(2048, 128, 1536, packing.Ids.part)
    for i in range(200):
        ids = np.arange(1_000_000, dtype="<u4")
        for sequence in packer.add(packing.Ids(i, len(ids), 0, ids), 0, len(ids), len(ids) // 2):
            assert all((doc.ids[start - doc.first] == start) for doc, start, _, _ in sequence)
        assert sum(p[0].ids.nbytes for p in packer.pool) <= packing.POOL * 2048 * 4
        assert all(p[0].ids.base is None for p in packer.pool)


# Archives


def test_archives_round_trip(spark):
    rng = random.Random(5)
    same = "<p>" + "x" * 200
    rows = [(i, f"http://h{rng.randrange(9)}.example.com/p{rng.randrange(40)}?q={rng.randrange(3)}", rng.choice([same, "short", f"<b>{i}</b>" * 60, "é" * 99, None, ""])) for i in range(1500)]
    rows += [(2000, None, same), (2001, "", None), (2002, "HTTPS://me@Host.org#frag", "\r\n\r\nbody" * 50), (None, "http://x.y/z", same), (3, "http://again.org/", same)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS key", "3 AS refers_to")
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    first = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= 100:
            first[h] = min(p, first.get(h, p))
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        to = first.get(h) if len(raw) >= 100 and first.get(h) != p else None
        want.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if to is not None else "response", to))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_index_finds_keys_over_several_blocks(spark):
    rows = [(i, "http://b.org/hot" if i % 3 else f"http://b.org/{i}", f"<i>{i}</i>") for i in range(2400)]
    files = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    found = warc.lookup(spark.createDataFrame([("org,b)/hot",), ("org,b)/9",), ("org,a)/",), ("zzz",), (None,), ("org,b)/9",)], "key string"), files).collect()
    assert sorted(r.page_id for r in found) == [i for i, u, _ in rows if u.endswith("/hot") or i == 9]
    assert all(bytes(r.payload) == f"<i>{r.page_id}</i>".encode() for r in found)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(empty).count() == 0


# Language-model scores


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_dictionaries(spark, monkeypatch, order):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["the", "The", "cat", "sat", "é", "on", "mat", "x" * 40], k=rng.randint(0, 40))) for _ in range(80)] + [None, "", " \n", "the " * 30_000, "the cat", "the cat"]
    monkeypatch.setattr(lm_scoring, "BLOCK_CHARS", 2_000)
    got = {r.doc_id: (r.n_words, r.score) for r in lm_scoring.score_documents(documents(spark, texts), order).collect()}
    for i, (n, score) in enumerate(lm_scores(texts, order)):
        assert got[i][0] == n
        assert (got[i][1] is None) if score is None else abs(got[i][1] - score) < 1e-9


def test_scores_of_repeated_rows_and_small_tables(spark):
    rows = [(7, "a b c"), (None, "b c d")] * 1_500 + [(8, "a b"), (8, None)]
    got = lm_scoring.score_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    want = lm_scores([t for _, t in rows])
    told = sorted(((r.doc_id, r.n_words, None if r.score is None else round(r.score, 9)) for r in got), key=str)
    assert told == sorted(((d, n, None if s is None else round(s, 9)) for (d, _), (n, s) in zip(rows, want, strict=True)), key=str)
    assert lm_scoring.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    assert sorted(r.n for r in lm_scoring.ngram_counts(spark.createDataFrame([(1, "a b a b"), (2, None)], SCHEMA)).collect()) == [1, 2, 2, 2]


def test_a_block_is_counted_in_little_memory_and_few_records():
    """A block of n bytes takes less than twenty times as much memory, and its n-grams go into 16,384 records at most."""
    texts = [" ".join(f"{(i * 7_919 + k * 104_729) % 99_991:06d}" for k in range(300)) for i in range(1_900)]
    table = pa.table({"block": pa.array([3] * len(texts)), "text": pa.array(texts), "copies": pa.array([1] * len(texts))})
    tracemalloc.start()
    try:
        made = lm_scoring._exploded(2)(table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 20 * sum(map(len, texts))
    assert 0 < made.num_rows <= 16_384 and pc.sum(pc.list_flatten(made["n"])).as_py() == 1_900 * 599


# Quality classifier


def labelled(seed, n=400):
    rng = random.Random(seed)
    good, bad = [f"good{i}" for i in range(80)], [f"bad{i}" for i in range(80)]
    rows = []
    for i in range(n):
        q = rng.random() < 0.7
        rows.append((i, " ".join(rng.choices((good if q else bad) + ["the", "of"], k=rng.randint(5, 60))), int(q)))
    return rows


def test_classifier_separates_held_out_rows(spark):
    rows = labelled(7)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], SCHEMA).selectExpr("*", "0.25D AS score", "'x' AS lang")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(3, None), (None, 1), (99_999, 1)], "doc_id long, quality int")
    weights = quality_model.train(docs, labels.where(~quality_model.held_out()))
    assert weights == quality_model.train(docs.repartition(7), labels.where(~quality_model.held_out()).repartition(3))
    got = {r.doc_id: r for r in quality_model.score(docs, weights).withColumn("h", quality_model.held_out()).collect()}
    held = [(got[i].score >= 0.3, q) for i, _, q in rows if got[i].h]
    assert len(held) == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(400)) and sum(a == bool(q) for a, q in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_classifier_equals_a_plain_version(spark):
    rng = random.Random(10)
    texts = [" ".join(rng.choices(["Good", "good", "BAD", "bad", "x1", "7%", "été", "the", "the", "-"], k=rng.randint(1, 30))) for _ in range(60)] + ["", None]
    labels = {i: int(rng.random() < 0.6) for i in range(len(texts))}
    docs, size = documents(spark, texts + texts[:5]), 1 << quality_model.BITS
    told = spark.createDataFrame([*labels.items(), *list(labels.items())[:9]], "doc_id long, quality int")
    weights = quality_model.train(docs, told)
    rank = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    rows = [classifier_features(texts[i], quality_model.BITS, quality_model.SCALE) for i in range(len(texts))]
    plain = ftrl([(rows[i], labels[i]) for i in sorted(labels, key=lambda i: rank[i])], size)
    assert np.abs(np.frombuffer(weights, "<f4") - np.array(plain)).max() < 1e-4
    for r in quality_model.score(docs, weights).collect():
        dot = sum(plain[b] * v for b, v in rows[r.doc_id % len(texts)].items()) + plain[-1]
        assert abs(r.score - 1 / (1 + np.exp(-dot))) < 1e-4


def test_classifier_edge_cases(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    texts = [None, "", " ", "word", "long " * 50_000]
    got = quality_model.score(documents(spark, texts + ["word"]), quality_model.train(documents(spark, texts), none)).collect()
    assert [r.score for r in got] == [0.5] * 6
    assert quality_model.score(spark.createDataFrame([], SCHEMA), b"\0" * 4 * ((1 << quality_model.BITS) + 1)).count() == 0


# The pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = [f"t{i}" for i in range(30)]
    clean = [" ".join(rng.choices(vocabulary, k=80)) for _ in range(120)]
    texts = clean + [c + " tail" for c in clean[:10]] + [clean[0]] * 5 + [f"junk{i % 7} $$$ " * 40 for i in range(60)] + ["few words", "", None]
    texts[20] += " write to someone@example.org please"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 100)] + [(i, 0, 0) for i in range(135, 190)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        after.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert kept.keys() == set(range(120))  # clean documents stay; copies, junk and short texts go
    assert kept[20].endswith(" write to [EMAIL] please")
    assert not any(base_rules(t)[-1] for t in kept.values())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == kept.keys()
    assert os.path.exists(f"{tmp_path}/packing") is False


def test_pipeline_edge_cases(spark, tmp_path):
    rng = random.Random(9)
    schema = "doc_id long, text string, lang string, source string, n_chars long, __row int"
    some = lambda: " ".join(rng.choices([f"t{i}" for i in range(60)], k=80))
    one, two, long = some(), some(), " ".join(f"v{rng.randrange(9_000)}" for _ in range(120_000))
    rows = [(1, one), (1, two), (None, one + " tail"), (None, some()), (7, one), (7, one), (8, long), (9, None), (10, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, None, None, None, 5) for i, t in rows], schema)
    kept = corpus_pipeline.dedup(spark, docs, "")
    assert kept.columns == docs.columns
    told = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert told == sorted([rows[0], rows[1], rows[3], *rows[6:]], key=str)
    labels = "doc_id long, quality int, toxic int"
    for name, texts in (("full", [(i, t) for i, t in rows]), ("empty", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame([(i, t, None, None, None) for i, t in texts], schema.rsplit(",", 1)[0]).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(None, 1, 0), (8, None, None)], labels).write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder)
        assert {r.doc_id for r in got.collect()} == ({1, None, 8} if texts else set())
