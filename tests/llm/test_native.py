"""Quality rules, personal data, syncmers and chat formatting against plain versions, and their edge cases."""

import hashlib
import math
import random
import time
import struct

import xxhash
from brute import WORD, base_rules, base_spans, discovered, fingerprint, positional_likeness

from voicegrain.llm import chat, private_data, quality_rules, syncmers

SCHEMA = "doc_id long, text string"
ODD = [None, "", " \n\t\r\x0b\x0c", " ", "one", "x" * 5000, "a\n\na\r\na \nb\n b", "été naïve 𝒳𝒴 #$|<>"]


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), SCHEMA).selectExpr("*", "1 AS kept", "2 AS row", "3 AS __h", "4 AS n_words")


def some_texts(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["é", "#tag", "a|b", "x<y>"]
    out = []
    for _ in range(n):
        w = rng.choices(words, k=rng.randint(0, 120))
        if rng.random() < 0.5 and len(w) > 12:
            at = rng.randrange(len(w) - 9)
            w += w[at : at + 9] * rng.randint(1, 3)
        out.append("".join(x + rng.choice([" ", "  ", "\n", "\t", "\x0b", "\r\n"]) for x in w))
    return out


# Quality rules


def buckets(text, n):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
    pairs = [xxhash.xxh64_intdigest(struct.pack("<Q", b), xxhash.xxh64_intdigest(struct.pack("<Q", a), 42)) for a, b in zip(h, h[1:], strict=False)]
    return [(x - (1 << 64) if x >> 63 else x) % n for x in h + pairs]


def test_base_rules(spark):
    texts = [*ODD, *some_texts(1), " ".join(f"v{i % 9000}" for i in range(20_000))]
    docs = documents(spark, texts)
    got = quality_rules.quality_rules(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_rules(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_log_likelihood_ratio(spark):
    texts = some_texts(2, 30) + [None, ""]
    trusted = {1, 4, 9, 31}
    n = 512
    weights = quality_rules.bucket_weights(documents(spark, texts), spark.createDataFrame([(i,) for i in [*trusted, 4, None, 77]], "doc_id long"), n)
    got = {r.doc_id: r.llr for r in quality_rules.score_documents(documents(spark, texts), weights, n).collect()}
    good, every = [0] * n, [0] * n
    for i, t in enumerate(texts):
        for b in buckets(t, n):
            every[b] += 1
            good[b] += i in trusted
    w = [math.log((g + 4) / (e * sum(good) / sum(every) + 4)) for g, e in zip(good, every, strict=True)]
    for i, t in enumerate(texts):
        g = buckets(t, n)
        assert (got[i] is None) == (not g)
        if g:
            assert abs(got[i] - sum(w[b] for b in g) / len(g)) < 1e-9


def test_equal_texts_count_once(spark):
    texts = some_texts(12, 20)
    rows = list(enumerate(texts))
    trusted = spark.createDataFrame([(i,) for i in (1, 4, 9)], "doc_id long")
    weights = lambda rows: quality_rules.bucket_weights(spark.createDataFrame(rows, SCHEMA), trusted, 64).collect()[0].weights
    plain = weights(rows)
    for more in ([(3, texts[3])] * 50, [(None, texts[3])] * 50, [(100 + i, texts[4]) for i in range(50)], [(None, None), (5, None)]):
        assert weights(rows + more) == plain
    assert weights([*rows, (1, texts[2])]) != plain  # a row of a trusted id is trusted


def test_rules_without_trusted_rows_and_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    long = " ".join(f"word{i}" for i in range(50))
    got = quality_rules.quality_rules(spark.createDataFrame([(1, long), (1, long), (None, long), (2, "few words")], SCHEMA), labels).collect()
    assert sorted(((r.doc_id, r.kept) for r in got), key=str) == sorted([(1, True), (1, True), (None, True), (2, False)], key=str)
    assert quality_rules.quality_rules(spark.createDataFrame([], SCHEMA), labels).count() == 0


def test_threshold_follows_the_trusted_scores(spark):
    rng = random.Random(11)
    clean, junk = [f"c{i}" for i in range(50)], [f"j{i}" for i in range(50)]
    texts = [" ".join(rng.choices(clean, k=100)) for _ in range(80)]
    texts += [" ".join(rng.choice(junk if rng.random() < 0.2 else clean) for _ in range(100)) for _ in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(80)] + [(80, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.quality_rules(documents(spark, texts), labels).collect()}
    good = sorted(round(got[i].llr, 4) for i in range(80))
    low = good[0] + (good[1] - good[0]) * quality_rules.LOW * 79
    threshold = low - quality_rules.MARGIN * ((good[39] + good[40]) / 2 - low)
    assert all(r.kept == (r.llr >= threshold) for r in got.values())
    assert all(got[i].kept for i in range(80))
    assert any(got[i].llr >= -0.12 and not got[i].kept for i in range(80, 100)), [got[i].llr for i in range(100)]


# Personal data

FRAGMENTS = [
    "a.b+c@mail-x.example.org", "x@y", "@", "a@b.c@d.ef", "..@--.-", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112",
    "5500005555555559", "12345678901234567890", "4111  1111 1111 1111", "+49 (30) 123-456.78", "+1", "+12345678", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "7", "-", " ", "\n", ".", "é", "word", ")", "(",
]


def test_base_spans_are_exact(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(FRAGMENTS) + rng.choice(["", "", " ", "x", "."]) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    texts += [*ODD, "1" * 30_000, "a@" * 2000, "1.2.3.4 " * 3000, "+" + "1 " * 5000, "a" * 20_000 + "@b.cd", None]
    got = private_data.digest(private_data.find(documents(spark, texts))).collect()
    assert len(got) == len(texts)
    for r in got:
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest(), texts[r.doc_id]
        assert r.spans == told or r.spans.startswith(told + ",") or not told


def test_contexts_discover_unseen_identifiers(spark):
    texts = [f"customer wrote from mailbox address: user{i}@mail.example.com today and left" for i in range(30)]
    texts += [f"customer wrote from mailbox address: handle#{i}77 today and left" for i in range(4)]
    texts += [f"they counted exactly {i}50 sheep near town" for i in range(30)]
    got = {r.doc_id: r.spans for r in private_data.digest(private_data.find(documents(spark, texts))).collect()}
    for i in range(30, 34):
        start = texts[i].index("handle")
        assert got[i] == f"email_like:{start}:{start + len(texts[i].split()[5])}"
    assert all(got[i] == "" for i in range(34, 64))


def spans_of(spark, texts):
    return {r.doc_id: r.spans for r in private_data.digest(private_data.find(documents(spark, texts))).collect()}


def test_discovered_identifiers_are_seeds_of_further_patterns(spark):
    names = [f"handle#{i}77" for i in range(9)]
    texts = [f"customer wrote from mailbox address: user{i}@mail.example.com today and left" for i in range(60)]
    texts += [f"customer wrote from mailbox address: {n} today and left" for n in names]
    texts += [f"please answer the account {n} before monday" for n in names]
    texts += ["please answer the account zeta#5512 before monday", "we met the big crowd zeta#9 on monday"]
    got = spans_of(spark, texts)
    start = texts[78].index("zeta")
    assert got[78] == f"email_like:{start}:{start + len('zeta#5512')}"
    assert got[79] == ""


def test_identifiers_in_digit_groups(spark):
    texts = [f"customer wrote from mailbox address: user{i}@mail.example.com today and left" for i in range(60)]
    unseen = ["4111 1111 1111 1112", "(030) 123 45", "DE89 3704 0044 0532 0130 01", "77-12 88.3"]
    texts += [f"customer wrote from mailbox address: {n}, today and left" for n in unseen]
    apart = ["5512,", "5512  7", "5512 7x", "5512 and 7", "1.2.3.4 5512"]
    texts += [f"customer wrote from mailbox address: {n} today and left" for n in apart]
    texts += [f"customer wrote from mailbox address: 5512 {i} 1.2.3.4 7 today and left" for i in range(1)]
    got = spans_of(spark, texts)
    start = texts[0].index("user")
    for i, n in enumerate(unseen):
        assert got[60 + i] == f"email_like:{start}:{start + len(n)}"
    for i in range(4):
        assert got[64 + i] == f"email_like:{start}:{start + 4}"
    assert got[68].split(",")[0] == f"ip:{start}:{start + 7}"
    assert set(got[69].split(",")) == {f"ip:{start + 7}:{start + 14}", f"email_like:{start}:{start + 6}"}


def test_names_are_discovered_and_contexts_are_whole_words(spark):
    long = "x" * 300
    texts = [f"reply to {long}a owner {long}b: user{i}@mail.example.com thanks" for i in range(30)]
    texts += [f"reply to {long}a owner {long}b: Maria thanks", f"reply to {long}c owner {long}d: Maria thanks", "we saw Maria there"]
    got = spans_of(spark, texts)
    at = texts[30].index("Maria")
    assert got[30] == f"email_like:{at}:{at + 5}"
    assert got[31] == got[32] == ""


def test_discovery_equals_a_plain_version(spark):
    rng = random.Random(9)
    seeds = ["a{}@b.example.com", "10.0.{}.7", "+1 (234) 567-8{}", "4111 1111 1111 1111"]
    fill = ["Anna", "x_{}", "ab{}", "{}" + "0c" * 15, "5512 {} 7", "(030) {}", "DE89 3704 {}", "tom", "it", "B{},"]
    frames = ["send it to {} today", "the box {} is", "{} wrote", "mail: {}", "from {}, and {} too", "call {} or {}"]
    def made(frame):  # each frame has a favourite kind, so that some patterns are worth trusting
        kind = seeds[frames.index(frame) % 4]
        return frame.format(*((kind if rng.random() < 0.85 else rng.choice(fill)).format(rng.randint(100, 160)) for _ in range(2)))

    texts = [(" " if rng.random() < 0.9 else "\n").join(made(rng.choice(frames)) for _ in range(rng.randint(1, 3))) for _ in range(400)] + ["", None]
    found = private_data.find(documents(spark, texts)).collect()
    want = discovered(texts)
    assert sum(map(len, want)) > 20
    for r in found:
        assert [(s.kind, s.start, s.end) for s in r.found] == want[r.doc_id], texts[r.doc_id]


def test_secrets_are_seeds_and_discover_further_ones(spark):
    made = random.Random(2)
    key = lambda n, digits="0123456789abcdef": "".join(made.choices(digits, k=n))
    texts = [f'word{i} token = "{key(38)}0a" more{i}' for i in range(20)]
    unseen = ["A94F" + key(12, "0123456789ABCDEF"), "Zq7-" + key(20, "qrstuv12"), key(16) + "0a"]
    texts += [f'other{i} token = "{u}" more' for i, u in enumerate(unseen)]
    texts += [f"{'1' * 40} and {'a' * 40}, in C99 or Token = X", key(31) + "0 a1"]
    got = spans_of(spark, texts)
    for i in range(23):
        start = texts[i].index('"') + 1
        assert got[i] == f"secret:{start}:{texts[i].rindex(chr(34))}"
    assert got[23].split(",") == [f"secret:{len(texts[23]) - 1}:{len(texts[23])}"] and got[24] == f"secret:0:32"
    clean = {r.doc_id: r.text for r in private_data.redact(documents(spark, texts)).collect()}
    assert clean[21] == 'other1 token = "[SECRET]" more'


def test_texts_with_very_many_matches(spark):
    texts = ["a1 " * 64_000, "a@b.cd " * 64_000, "1.2.3.4, " * 20_000]
    began = time.time()
    got = {r.doc_id: r for r in private_data.digest(private_data.find(documents(spark, texts))).collect()}
    assert (got[1].n_email, got[2].n_ip) == (64_000, 20_000)
    clean = {r.doc_id: r.text for r in private_data.redact(documents(spark, texts)).collect()}
    assert clean == {0: texts[0], 1: "[EMAIL] " * 64_000, 2: "[IP], " * 20_000}
    assert time.time() - began < 90


def test_redaction(spark):
    rows = [(1, "mail a@b.cd or 1.2.3.4 now", 7), (1, "mail a@b.cd or 1.2.3.4 now", 7), (None, "a@b.cd", 8), (3, None, None), (4, "clean", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base int")
    got = sorted(((r.doc_id, r.text, r.base) for r in private_data.redact(docs).collect()), key=str)
    masked = "mail [EMAIL] or [IP] now"
    assert got == sorted([(1, masked, 7), (1, masked, 7), (None, "[EMAIL]", 8), (3, None, None), (4, "clean", 1)], key=str)
    assert private_data.redact(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Syncmers


def test_edited_texts_follow_the_next_document(spark):
    texts = [t if t else None for t in some_texts(8, 40)] + ODD
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in syncmers.edited_pairs(docs).collect()}
    fps = {d: [tuple(x) for x in r.fp] for d, r in got.items()}
    assert len(got) == len(texts)
    for d, t in enumerate(texts):
        t, following = t or "", texts[d - 1 if d else len(texts) - 1] or ""
        half = len(t) // 2
        assert got[d].n_chars == len(t)
        assert got[d].edited == t[: len(t) - half] + following[:half]
        assert fps[d] == fingerprint(t, syncmers.SKETCH, syncmers.BOUND)
        assert [tuple(x) for x in got[d].edited_fp] == fingerprint(got[d].edited, syncmers.SKETCH, syncmers.BOUND)
        for other, near in ((following, got[d].near_next), (got[d].edited, got[d].near_edited)):
            assert abs(near - positional_likeness(fps[d], fingerprint(other, syncmers.SKETCH, syncmers.BOUND), syncmers.SKETCH, syncmers.BOUND)) < 1e-12


def test_anchors_depend_on_their_window_alone(spark):
    rng = random.Random(3)
    words = [f"q{rng.randrange(900)}" for _ in range(400)]
    edited = words[:200] + ["new"] + words[200:]
    rows = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(edited)), (2, " ".join(words))], SCHEMA)
    got = {r.doc_id: {(a.position, a.hash) for a in r.a} for r in rows.select("doc_id", syncmers.anchors(rows.text).alias("a")).collect()}
    assert got[0] == got[2]
    assert {a for a in got[0] if a[0] <= 196} == {a for a in got[1] if a[0] <= 196}
    assert {(p + 1, h) for p, h in got[0] if p >= 200} == {a for a in got[1] if a[0] > 200}
    assert 0.5 < len(got[0]) / 397 < 0.8


def test_fingerprints_grow_with_the_text(spark):
    rng = random.Random(4)
    some = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    passage = some(120)
    texts = [" ".join(some(9000) + passage + some(3000)), " ".join(some(1000) + passage + some(11_000)), " ".join(some(50))]
    got = {r.doc_id: r for r in syncmers.edited_pairs(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    a, b = ({x.hash for x in got[i].fp} for i in (1, 0))
    assert not set(sorted(a | b)[: syncmers.SKETCH]) & a & b
    assert 0 < got[1].near_next == len(a & b) / len(a | b) < 0.02
    assert 1700 < len(a) < 2300 and len(got[2].fp) < syncmers.SKETCH
    pair = spark.createDataFrame([(got[1].fp, got[0].fp)], f"a {syncmers.FINGERPRINT}, b {syncmers.FINGERPRINT}")
    ((shared,),) = pair.select(syncmers.matched_ranges(pair.a, pair.b)).collect()
    assert len(shared) == 1 and shared[0].other_start - shared[0].start == 8000
    assert 1000 <= shared[0].start and shared[0].start + shared[0].words <= 1120 and shared[0].words > 60


def test_single_equal_anchors_at_random_places_are_chance(spark):
    rng = random.Random(6)
    some = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    phrases = [some(6) for _ in range(12)]
    mixed = [" ".join(w for k in rng.sample(range(12), 12) for w in phrases[k] + some(rng.randint(0, 3))) for _ in range(2)]
    got = {r.doc_id: r for r in syncmers.edited_pairs(spark.createDataFrame(list(enumerate(mixed)), SCHEMA)).collect()}
    a, b = ({x.hash for x in got[i].fp} for i in (1, 0))
    assert got[1].near_next < len(a & b) / len(a | b)


def test_next_row_with_ties_nulls_and_small_tables(spark):
    assert syncmers.edited_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    one = syncmers.edited_pairs(spark.createDataFrame([(5, "abcd")], SCHEMA)).collect()
    assert [(r.edited, r.near_next) for r in one] == [("abab", 1.0)]
    rows = [(3, "aaaa"), (3, "bbbb"), (3, "aaaa"), (None, "cccc"), (9, "dddd")]
    got = syncmers.with_next(spark.createDataFrame(rows, SCHEMA), ranges=3).collect()
    assert sorted((r.text, r.next.text) for r in got) == [("aaaa", "aaaa"), ("aaaa", "bbbb"), ("bbbb", "cccc"), ("cccc", "dddd"), ("dddd", "aaaa")]


# Chat


def test_chat_reads_back(spark):
    rng = random.Random(2)
    bits = ["\\", "\\e", "\\l", "<", ">", "<turn user>", "</turn>\n", "<part>", "hi", "\n", "é𝒳", ""]
    rows, plain = [], {}
    for c in range(60):
        turns = [(rng.choice(["user", "assistant", "a<b\\>", None]), rng.choice([None, "".join(rng.choices(bits, k=5))])) for _ in range(rng.randint(1, 9))]
        plain[c] = [(r or "", t or "") for r, t in turns]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS turns", "2 AS mask", "3 AS formatted")
    got = {r.conv_id: r for r in chat.chat_digest(df).collect()}
    assert got.keys() == plain.keys()
    for c, turns in plain.items():
        told = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_ties_nulls_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.chat_digest(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, 1, "user", "b"), (None, 1, "user", "a"), (None, 1, "user", "a"), (None, None, "assistant", "z")]
    (got,) = chat.parse_chats(chat.format_chats(spark.createDataFrame(rows, schema))).collect()
    assert [(t.role, t.text) for t in got.turns] == [("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert got.formatted == "<turn assistant>z</turn>\n<turn user>a<part>a<part>b</turn>\n"


def test_a_very_long_conversation(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"é<{i}> some words") for i in range(40_000)]
    began = time.time()
    (got,) = chat.chat_digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    loss = "".join(t for _, _, r, t in rows if r == "assistant")
    assert (got.n_turns, got.loss_sha256) == (40_000, hashlib.sha256(loss.encode()).hexdigest())
    assert time.time() - began < 60
