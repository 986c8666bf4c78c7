"""Operators of the feedback engine on literal cases, against plain loops, and as a stream."""

import dataclasses
import json
import random
import re

import numpy as np
from pyspark.sql import functions as F

from voicegrain.config import Settings
from voicegrain.functions import text
from voicegrain.operators import extract, pii, similarity, topics, unitize
from voicegrain.operators.backend import Live, Recorded
from voicegrain.operators.store import Store, insert_ignore, integrity
from voicegrain.plans import catalog, explorer, review
from voicegrain.sources import adapters
from voicegrain.streaming import job

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


def test_redaction_cases(spark):
    cases = {
        "email is john.smith@example.com. Call (555) 867-5309 or check order #ORD-291847.": "email is [EMAIL]. Call [PHONE] or check order #[ACCOUNT_NUM].",
        "card 4111 1111 1111 1111 and SSN: 123-45-6789.": "card [CREDIT_CARD] and SSN: [SSN].",
        "card 4111111111111111 x": "card [PHONE] x",
        "Android crashes often": "Android [ACCOUNT_NUM] often",
        "push notification reference": "push no[ACCOUNT_NUM] ref[ACCOUNT_NUM]",
        "see https://a.com/u?id=abcdef12 now": "see [URL] now",
        "The app is fine. \U0001f389": "The app is fine. \U0001f389",
        "": "",
        None: "",
    }
    df = spark.createDataFrame(list(cases.items()), "raw_text string, want string")
    for r in pii.redact(df).collect():
        assert r.clean_text == r.want and r.pii_redacted == (len(r.pii_spans) > 0)


def test_redaction_equals_a_plain_loop(spark):
    docs = adapters.table(spark, SF, "documents").select("doc_id", F.col("text").alias("raw_text"))
    patterns = [(k, re.compile(p)) for k, p in pii.PATTERNS]
    for r in pii.redact(docs).collect():
        t = r.raw_text
        spans = [(m.start(1) if m.re.groups else m.start(), i, m.end(), k) for i, (k, p) in enumerate(patterns) for m in p.finditer(t)]
        merged = []
        for s, _, e, k in sorted(spans):
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e, k])
        for s, e, k in reversed(merged):
            t = f"{t[:s]}[{k}]{t[e:]}"
        assert r.clean_text == t


def test_model_answers_and_their_defaults(spark):
    s = one(spark, text.parse_sentiment(F.lit("not json")))
    assert (s.polarity, s.intensity, s.confidence, s.emotions) == (0.0, "mild", 0.0, [])
    i = one(spark, text.parse_intent(F.lit('```json\n{"intent_type": "praise", "specific_request": ""}\n```')))
    assert (i.intent_type, i.urgency, i.specific_request, i.churn_indicators) == ("praise", "medium", None, [])
    assert one(spark, text.parse_intent(F.lit("{}"))).intent_type == "complaint"
    t = one(spark, text.parse_topic(F.lit("LABEL: a\nLABEL: b \nEVIDENCE: a, b,, c \nCONFIDENCE: high")))
    assert (t.label, t.description, t.evidence, t.confidence) == ("b", "", ["a", "b", "c"], 0.0)
    mails = {"sarah.k@luminarylogistics.com": "luminarylogistics.com", "a@gmail.com or B@Acme.IO": "acme.io", "tom@gmail.com": None, None: None}
    for given, want in mails.items():
        assert one(spark, text.email_domain(F.lit(given).cast("string"))) == want
    labels = [one(spark, text.sentiment_label(F.lit(p))) for p in (0.5, 0.1, -0.1, -0.5, -0.6)]
    assert labels == ["Positive", "Slightly positive", "Neutral", "Slightly negative", "Negative"]


def test_unit_answers(spark):
    rows = [
        ("a", "First part. Second part.", '[{"text": "First part.", "char_start": 0, "char_end": 11}, {"text": " "}, {"text": "second part.", "char_start": 90, "char_end": 99}]'),
        ("b", "whole text", "[]"),
        ("c", "whole text", "no json"),
        ("d", " ", "[]"),
        ("e", "x y", None),
    ]
    got = unitize.parse_units(spark.createDataFrame(rows, "id string, text string, raw string")).collect()
    assert sorted((r.id, r.unit_index, r.text, r.char_start, r.char_end, r.error is not None) for r in got) == [
        ("a", 0, "First part.", 0, 11, False), ("a", 2, "second part.", 12, 24, False), ("b", 0, "whole text", 0, 10, False), ("c", 0, "whole text", 0, 10, True), ("e", 0, "x y", 0, 3, True)
    ]


def plain_leaders(vectors, threshold):
    kept, out = [], []
    for i, v in enumerate(vectors):
        sims = [(float(v @ vectors[j]), -j) for j in kept]
        best = max(sims, default=(-2.0, 0))
        if best[0] >= threshold:
            out.append((i, True, -best[1]))
        else:
            kept.append(i)
            out.append((i, False, i))
    return out


def test_leaders_equal_a_scan_in_order(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(150, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v = v.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "seq long, embedding array<float>")
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = similarity.leaders(df, similarity.edges(df, 0.8)).collect()
    assert sorted((r.seq, r.is_duplicate, r.canonical_seq) for r in got) == plain_leaders(v, 0.8)
    assert similarity.edges(df, 0.8, planes=2, tables=40).count() >= 0.9 * similarity.edges(df, 0.8).count()


def test_topics_and_evidence(spark):
    rows = [(1, [1.0, 0.0], "slow login", 0.9), (2, [0.99, 0.1], "login is slow", 0.6), (3, [0.0, 1.0], "new", 0.5)]
    got = {r.seq: r for r in topics.assign_topics(spark.createDataFrame(rows, "seq long, embedding array<float>, label string, confidence double")).collect()}
    assert (got[2].topic_seq, got[2].alias, got[1].suggested_label, got[3].needs_review) == (1, "login is slow", "slow login", True)
    units = spark.createDataFrame([("it is slow", ["slow", "fast"]), ("x", [])], "text string, evidence array<string>")
    assert [(r.ungrounded, r.is_grounded) for r in extract.grounded(units).collect()] == [(["fast"], False), ([], True)]


def test_one_call_for_each_unit(spark):
    units = spark.createDataFrame([("a", "t1", "p1"), ("b", "t2", "p2"), ("c", None, "p3")], "unit_id string, topic_id string, prompt string")
    known = spark.createDataFrame([("t1", "praise", None)], "topic_id string, intent_type string, intent_urgency string")
    answers = [("sentiment", "p1", '{"polarity": 0.5}'), ("combined", "p2", '{"intent": {"intent_type": "question"}}'), ("combined", "p1", "never asked")]
    table = spark.createDataFrame(answers, "kind string, prompt string, raw string").select("kind", F.sha2("prompt", 256).alias("prompt_hash"), "raw")
    got = {r.unit_id: r for r in extract.extract(units, known, Recorded(table)).collect()}
    assert (got["a"].from_cache, got["a"].sentiment.polarity, got["a"].intent.intent_type, got["a"].intent.urgency) == (True, 0.5, "praise", "medium")
    assert (got["b"].from_cache, got["b"].intent.intent_type, got["c"].intent.intent_type) == (False, "question", "complaint")


def test_filters_reach_the_scan(spark):
    plan = explorer.apply(catalog.units(spark, SF), explorer.Filters(account_id=7)).select("unit_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,7)]" in plan and "value" not in plan.split("ReadSchema")[1]


def feedback(n):
    rng = random.Random(4)
    said = ["The app crashes often.", "I love the new screen!", "Please add a dark mode.", "How do I export data?", "I want to cancel my plan."]
    return [{"id": f"r{i:03}", "raw_text": " ".join(rng.choices(said, k=2)) + f" Mail me{i}@acme.io.", "source_channel": "chat"} for i in range(n)]


def run_stream(spark, folder, batches):
    (folder / "in").mkdir(parents=True)
    settings = dataclasses.replace(Settings(), input_path=str(folder / "in"), store_path=str(folder / "store"), checkpoint_path=str(folder / "progress"))
    for k, lines in enumerate(batches):
        (folder / "in" / f"{k}.txt").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
        job.start(spark, settings, once=True).awaitTermination()
    return Store(spark, str(folder / "store"))


def test_stream_redelivery_and_batch_sizes(spark, tmp_path):
    records = feedback(12)
    whole = run_stream(spark, tmp_path / "a", [[*records, "not json", "{}"]])
    parts = run_stream(spark, tmp_path / "b", [records[:6], records[6:], records[:6]])
    view = lambda s: sorted((r.unit_id, r.is_duplicate, r.canonical_id, r.topic_label) for r in s.read("feedback_units").collect())
    assert view(whole) == view(parts) and len(view(whole)) == 36
    assert any(r[1] for r in view(whole)) and not any("@" in r.text for r in whole.read("feedback_units").collect())
    for s in (whole, parts):
        bad = {r.check: r.bad for r in integrity(s.read("feedback_units"), s.read("topics"), s.read("unit_sentiments")).collect()}
        assert set(bad.values()) == {0}, bad
    assert spark.read.parquet(f"{tmp_path}/a/store/rejects").count() == 2
    topics_of = lambda s: sorted((r.label, r.feedback_count) for r in s.read("topics").collect())
    assert topics_of(whole) == topics_of(parts)


def test_stored_units_keep_their_metadata_and_answers(spark, tmp_path):
    said = "The login is slow."
    topic = "LABEL: slow login\nDESCRIPTION: d\nEVIDENCE: login, slow\nCONFIDENCE: 0.9"
    both = {
        "sentiment": {"polarity": -0.5, "emotions": [{"emotion": "anger", "confidence": 0.8}], "aspect_sentiments": [{"aspect": "login", "polarity": -0.5, "evidence": "slow"}]},
        "intent": {"specific_request": "faster", "competitor_mention": "Acme", "churn_indicators": [{"signal": "leaving", "severity": 0.4}]},
    }
    answers = spark.createDataFrame([("topic", said, topic), ("combined", said, json.dumps(both))], "kind string, prompt string, raw string")
    backend = Recorded(answers.select("kind", F.sha2("prompt", 256).alias("prompt_hash"), "raw"))
    lines = [{"id": f"r{i}", "raw_text": said, "source_channel": "chat", "user_metadata": {"segment": "pro"}} for i in range(2)]
    good, _ = adapters.parse_messages(spark.createDataFrame([(json.dumps(x),) for x in lines], "value string"))
    store = Store(spark, str(tmp_path / "store"))
    assert job.process(good, 0, store, backend, Settings())
    units = {r.is_duplicate: r for r in store.read("feedback_units").collect()}
    u, copy = units[False], units[True]
    assert (u.raw_extracted_label, u.evidence_spans, u.specific_request, u.competitor_mention) == ("slow login", ["login", "slow"], "faster", "Acme")
    assert [tuple(c) for c in u.churn_indicators] == [("leaving", 0.4)] and u.created_at is not None
    assert (copy.raw_extracted_label, copy.evidence_spans, copy.churn_indicators) == (None, [], [])
    assert all((r.metadata.source_channel, r.metadata.user_segment) == ("chat", "pro") for r in units.values())
    (s,) = store.read("unit_sentiments").collect()
    assert ([tuple(e) for e in s.emotions], [tuple(a) for a in s.aspect_sentiments]) == ([("anger", 0.8)], [("login", -0.5, "slow")])
    assert s.created_at is not None


def test_review_queue_has_five_reasons(spark):
    rows = [("a", 0.5, True, True, False, None), ("b", 0.9, False, False, True, None), ("c", 0.9, False, None, None, "no array"), ("d", 0.9, False, True, False, None)]
    units = spark.createDataFrame(rows, "unit_id string, confidence double, is_new_topic boolean, is_grounded boolean, sarcasm_flag boolean, error string")
    want = [("a", "low confidence"), ("a", "new theme"), ("b", "sarcasm"), ("b", "ungrounded evidence"), ("c", "ambiguous split")]
    assert sorted((r.unit_id, r.reason) for r in review.queue(units).collect()) == want
    assert sorted((r.unit_id, r.reason) for r in review.queue(units.drop("is_grounded", "sarcasm_flag", "error")).collect()) == want[:2]


def test_every_query_has_rows_or_a_stable_schema(spark):
    for name in ("top_topics_by_intent", "global_search", "stream_windows_session", "review_queue", "conversation_signals"):
        assert catalog.QUERIES[name](spark, SF).columns
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_quoted_numbers_and_what_is_no_number(spark):
    raw = json.dumps({"polarity": "0.5", "confidence": 0.25, "sarcasm": "true", "emotions": [{"emotion": "joy", "confidence": "0.9"}, {"emotion": "calm", "confidence": "much"}]})
    got = one(spark, text.parse_sentiment(F.lit(raw)))
    assert (got.polarity, got.confidence, got.sarcasm_flag) == (0.5, 0.25, True)
    assert [tuple(e) for e in got.emotions] == [("joy", 0.9), ("calm", 0.0)]
    assert one(spark, text.parse_sentiment(F.lit('{"polarity": "bad"}'))).polarity == 0.0


def test_a_failed_call_costs_its_own_item_only(spark):
    def client(kind):
        def ask(prompts):
            if any("bad" in p for p in prompts):
                raise ValueError("no")
            return [p.upper() for p in prompts]

        return ask

    rows = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "bad", "c"])], "unit_id int, prompt string").coalesce(1)
    got = {r.unit_id: (r.raw, r.error) for r in Live(client).complete(rows, "topic").collect()}
    assert got == {0: ("A", None), 1: (None, "topic: ValueError: no"), 2: ("C", None)}


def test_a_model_splits_records_where_it_can(spark, tmp_path):
    said = "The app is slow and the price is fine"
    parts = json.dumps([{"text": "The app is slow", "char_start": 0, "char_end": 15}, {"text": "the price is fine", "char_start": 0, "char_end": 3}])
    answers = spark.createDataFrame([("unitize", said, parts)], "kind string, prompt string, raw string")
    backend = Recorded(answers.select("kind", F.sha2("prompt", 256).alias("prompt_hash"), "raw"), kinds=None)
    good, _ = adapters.parse_messages(spark.createDataFrame([(json.dumps({"id": "r1", "raw_text": said}),)], "value string"))
    store = Store(spark, str(tmp_path / "store"))
    assert job.process(good, 0, store, backend, Settings())
    assert sorted((r.text, r.char_start, r.char_end) for r in store.read("feedback_units").collect()) == [("The app is slow", 0, 15), ("the price is fine", 20, 37)]


def test_parts_of_the_store_join_and_keys_have_one_choice(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for i in range(3):
        good, _ = adapters.parse_messages(spark.createDataFrame([(json.dumps({"id": f"r{i}", "raw_text": f"Word{i} is slow."}),)], "value string"))
        assert job.process(good, i, store, job.rule_backend(), Settings())
    view = lambda: {n: sorted(map(str, store.read(n).collect())) for n in ("topics", "feedback_units", "unit_sentiments", "dedup_index", "topic_index")}
    before = view()
    assert len(before["feedback_units"]) == 3 == len(store.versions())
    store.compact()
    assert view() == before and len(store.versions()) == 1 and store.has(2) and not store.has(3)
    rows = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("c", 9)], "k string, v int")
    old = spark.createDataFrame([("c", 0)], "k string, v int")
    for n in (1, 4):
        assert sorted(map(tuple, insert_ignore(old, rows.repartition(n), "k").collect())) == [("a", 1), ("b", 2), ("c", 0)]


def test_edges_between_equal_a_loop(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(60)]
    df = spark.createDataFrame(vectors, "seq long, embedding array<float>")
    got = {(r.a, r.b) for r in similarity.edges_between(df.where("seq >= 30"), df.where("seq < 40"), 0.6, block=16).collect()}
    m = np.array([v for _, v in vectors])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    assert got == {(a, b) for a in range(40) for b in range(30, 60) if a < b and m[a] @ m[b] >= 0.6} and got


def test_evidence_of_every_length(spark):
    units = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "xtwo three fourx"), (3, None)], "doc_id long, text string")
    told = ["two three four five six seven eight nine ten eleven", "two three four", "hree", "three four", "absent", "", "one two three four five"]
    evidence = spark.createDataFrame(list(enumerate(told)), "item_id int, evidence string")
    got = {r.item_id: r.n_grounded for r in extract.evidence_counts(units, evidence).collect()}
    assert got == {0: 1, 1: 2, 2: 2, 3: 2, 4: 0, 5: 2, 6: 1}


def test_spans_in_long_texts(spark):
    said = "call (555) 867-5309 or mail a.b@cd.org, " * 3000
    docs = spark.createDataFrame([("x", said)], "id string, raw_text string")
    got = pii.redact(docs).head()
    assert got.clean_text == "call [PHONE] or mail [EMAIL], " * 3000 and len(got.pii_spans) == 6000


def test_what_a_pattern_needs_is_in_all_its_matches(spark):
    """Texts are searched for a kind only if they have what it needs; spans are those of the patterns alone."""
    texts = ["a@b.co", "HTTPS://x", "WwW.x", "(555)123-4567 x", "4111111111111111", "1234 5678 1234 5678", "123-45-6789", "10.0.0.1", "Ref: ABC-1234", "#1234567", "no. ABCDEFG", "w.x", "12 34", "", "é@"]
    rows = spark.createDataFrame([(t,) for t in [*texts, " ".join(texts)]], "t string").select("t", pii.regex_spans(F.col("t")).alias("s")).collect()
    assert set(pii.NEEDED) == {k for k, _ in pii.PATTERNS} - {"ACCOUNT_NUM"}
    for r in rows:
        want = [(k, m.start(1) if k == "ACCOUNT_NUM" else m.start(), m.end()) for k, p in pii.PATTERNS for m in re.finditer(p, r.t, re.ASCII)]
        assert [(x.kind, x.start, x.end) for x in r.s] == want
