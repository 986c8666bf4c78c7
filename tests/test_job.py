"""The micro-batch job and its store: failed calls, accounts, evidence, metrics, cells, compaction."""

import dataclasses
import json

import numpy as np
from pyspark.sql import functions as F

from voicegrain.config import Settings
from voicegrain.operators import similarity
from voicegrain.operators.backend import Live, Recorded
from voicegrain.operators.extract import stage_errors
from voicegrain.operators.store import Store, integrity
from voicegrain.plans import review
from voicegrain.sources import adapters
from voicegrain.streaming import job

INDEX = "unit_id string, seq long, embedding array<float>"


def records(spark, lines):
    return adapters.parse_messages(spark.createDataFrame([(json.dumps(x),) for x in lines], "value string"))[0]


def recorded(spark, answers, **more):
    table = spark.createDataFrame(answers, "kind string, prompt string, raw string")
    return Recorded(table.select("kind", F.sha2("prompt", 256).alias("prompt_hash"), "raw"), **more)


def sound(store):
    bad = {r.check: r.bad for r in integrity(store.read("feedback_units"), store.read("topics"), store.read("unit_sentiments")).collect()}
    assert set(bad.values()) == {0}, bad


def test_a_failed_topic_call_founds_no_topic(spark, tmp_path):
    said = ["The app is slow today.", "Export to a file is broken.", "Prices went up again."]
    store = Store(spark, str(tmp_path / "store"))
    backend = recorded(spark, [("topic", said[2], "LABEL: prices\nEVIDENCE: prices, Discount\nCONFIDENCE: 0.9"), ("topic", said[1], "no label at all")])
    assert job.process(records(spark, [{"id": f"r{i}", "raw_text": t} for i, t in enumerate(said)]), 0, store, backend, Settings())
    units = {r.text: r for r in store.read("feedback_units").collect()}
    (topic,) = store.read("topics").collect()
    assert (topic.label, topic.feedback_count) == ("prices", 0)  # its only evidence is half made up
    assert (units[said[0]].topic_id, units[said[0]].errors, units[said[0]].topic_is_new) == (None, ["topic: no label"], None)
    assert units[said[1]].errors == ["topic: no label"] and units[said[2]].errors == []
    assert (units[said[2]].is_grounded, units[said[2]].ungrounded_spans, units[said[2]].topic_label) == (False, ["Discount"], "prices")
    assert {r.stage: r.n for r in stage_errors(store.read("feedback_units")).collect()} == {"topic": 2}
    assert store.read("unit_sentiments").count() == 3
    sound(store)
    queue = sorted((r.unit_id, r.reason) for r in review.of_store(store.read("feedback_units"), store.read("unit_sentiments")).collect())
    assert queue == sorted([(units[said[2]].unit_id, "new theme"), (units[said[2]].unit_id, "ungrounded evidence")])


def test_errors_of_live_calls_and_batch_figures_are_stored(spark, tmp_path):
    def client(kind):
        def ask(prompts):
            if kind in ("topic", "account") and any("slow" in p for p in prompts):
                raise ValueError(f"no {kind}")
            told = {"topic": "LABEL: fine\nDESCRIPTION: \nEVIDENCE: fine\nCONFIDENCE: 0.9", "account": '{"account_name": "acme", "confidence": 0.7}', "unitize": "no array"}
            return [told.get(kind, "{}") for _ in prompts]

        return ask

    store = Store(spark, str(tmp_path / "store"))
    lines = [{"id": "a", "raw_text": "All is fine, says me@acme.io."}, {"id": "b", "raw_text": "It is slow, says you@slow.org."}, {"id": "c", "raw_text": "Quite fine otherwise"}]
    assert job.process(records(spark, lines), 7, store, Live(client), Settings())
    units = {r.parent_cfo_id: r for r in store.read("feedback_units").collect()}
    assert (units["a"].account_name, units["a"].account_method, units["a"].email_domain) == ("acme", "email_domain", "acme.io")
    assert (units["b"].account_name, units["b"].email_domain, units["c"].account_method) == (None, "slow.org", "none")
    assert units["a"].errors == ["unitize: not a JSON array"]
    assert units["b"].errors == ["unitize: not a JSON array", "topic: ValueError: no topic", "account: ValueError: no account"]
    (batch,) = store.read("batches").collect()
    assert (batch.batch_id, batch.total_cfos, batch.total_units, batch.canonical_units, batch.errors) == (7, 3, 3, 3, 5) and batch.processing_ms > 0
    sound(store)


def test_rules_name_accounts_by_their_domain(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    lines = [{"id": "a", "raw_text": "Mail Tom@Acme.io. It crashes."}, {"id": "b", "raw_text": "x@gmail.com is mine."}]
    assert job.process(records(spark, lines), 0, store, job.rule_backend(), Settings())
    got = {(r.parent_cfo_id, r.account_name, r.account_method) for r in store.read("feedback_units").collect()}
    assert got == {("a", "acme.io", "email_domain"), ("b", None, "none")}
    assert not any("@" in r.text for r in store.read("feedback_units").collect())


def vectors(spark, first, n, seed):
    rng = np.random.default_rng(seed)
    m = np.random.default_rng(0).normal(size=(30, 16))[rng.integers(0, 30, n)] + 0.05 * rng.normal(size=(n, 16))
    return spark.createDataFrame([(f"u{first + i}", first + i, [float(np.float32(x)) for x in v]) for i, v in enumerate(m)], INDEX)


def put(store, batch_id, rows):
    spark = store.spark
    empty = {name: store.read(name).limit(0) for name in ("feedback_units", "unit_sentiments")}
    topics = spark.createDataFrame([], "topic_id string, label string, description string, aliases array<string>, delta long, intent_type string, intent_urgency string, at timestamp")
    return store.apply(batch_id, topics, empty["feedback_units"], empty["unit_sentiments"], {"dedup_index": rows})


def test_stored_vectors_are_read_by_cell_and_give_what_a_full_scan_gives(spark, tmp_path, monkeypatch):
    from voicegrain.operators import cells

    monkeypatch.setattr(cells, "CELL", 20)
    store = Store(spark, str(tmp_path / "store"))
    none = spark.createDataFrame([], INDEX)
    assert put(store, 0, none) and store.near("dedup_index", vectors(spark, 0, 3, 1), 0.9)[0].count() == 0
    assert put(store, 1, vectors(spark, 0, 300, 2)) and put(store, 2, vectors(spark, 300, 100, 3)) and not put(store, 2, none)
    batch = vectors(spark, 1000, 4, 4)

    def check(cells_wanted):
        at = store.cells_of("dedup_index")
        assert len(at.sizes) == cells_wanted and at.sizes.sum() == 400
        pairs, held = store.near("dedup_index", batch, 0.95)
        every = similarity.edges_between(batch, store.read("dedup_index"), 0.95, cells=1)
        assert {(r.a, r.b) for r in pairs.collect()} == {(r.a, r.b) for r in every.collect()} != set()
        assert held.count() < 200  # four vectors of thirty groups touch few cells
        assert len(held.inputFiles()) and "PartitionFilters: [" in held._jdf.queryExecution().toString()

    check(15)
    before = sorted(r.unit_id for r in store.read("dedup_index").collect())
    store.compact()
    assert sorted(r.unit_id for r in store.read("dedup_index").collect()) == before and len(store.versions()) == 1
    check(20)
    assert put(store, 3, vectors(spark, 400, 10, 5)) and store.read("dedup_index").count() == 410


def test_the_job_compacts_and_goes_on(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    settings = dataclasses.replace(Settings(), compact_after=1)
    texts = ["The login is slow. Export fails.", "The login is slow!"]
    for i, t in enumerate(texts):
        assert job.process(records(spark, [{"id": f"r{i}", "raw_text": t}]), i, store, job.rule_backend(), settings)
        assert len(store.versions()) <= 1 and store.has(i)
    units = sorted((r.parent_cfo_id, r.is_duplicate) for r in store.read("feedback_units").collect())
    assert units == [("r0", False), ("r0", False), ("r1", True)] and store.read("batches").count() == 2
    sound(store)
