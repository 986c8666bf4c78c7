"""Batches by size or deadline: full batches at once, late ones by the timer without input, state over a restart."""

import json
import os
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from voicegrain.config import Settings
from voicegrain.operators.store import Store
from voicegrain.streaming import flush, job, windows


class Stream:
    """A folder of message files, and the batches that leave; a message's shard is the number before its colon."""

    def __init__(self, spark, home, size, wait_ms):
        self.spark, self.home, self.size, self.wait_ms, self.files = spark, home, size, wait_ms, 0
        (home / "in").mkdir()

    def put(self, *lines):
        part = self.home / f"part{self.files}"
        part.write_text("\n".join(lines) + "\n")
        os.rename(part, self.home / "in" / part.name)
        self.files += 1

    def start(self):
        raw = self.spark.readStream.text(str(self.home / "in"))
        keyed = raw.select(F.split_part("value", F.lit(":"), F.lit(1)).cast("long").alias("shard"), F.col("value").alias("payload"))
        keep = lambda df, i: df.write.mode("overwrite").parquet(str(self.home / "out" / f"batch={i}"))
        out = flush.gathered(keyed, self.size, self.wait_ms).writeStream.foreachBatch(keep).option("checkpointLocation", str(self.home / "state"))
        return out.trigger(processingTime="500 milliseconds").start()

    def sent(self):
        found = defaultdict(list)
        if list(self.home.glob("out/batch=*/*.parquet")):
            for r in self.spark.read.schema(flush.FLUSHED).parquet(str(self.home / "out" / "*")).collect():
                found[r.shard, r.flush, r.reason].append(r.payload)
        return {k: sorted(v) for k, v in found.items()}

    def until(self, wanted, seconds=90):
        end = time.time() + seconds
        while time.time() < end:
            if wanted(self.sent()):
                return self.sent()
            time.sleep(0.3)
        raise AssertionError(self.sent())


def test_full_batches_leave_at_once_and_the_rest_at_its_deadline_without_input(spark, tmp_path):
    s = Stream(spark, tmp_path, size=3, wait_ms=8_000)
    s.put(*[f"1:{i}" for i in range(7)], "2:a", "2:b")
    q = s.start()
    try:
        got = s.until(lambda x: len(x) >= 2)
        assert {k: len(v) for k, v in got.items() if k[2] == "size"} == {(1, 0, "size"): 3, (1, 1, "size"): 3}
        got = s.until(lambda x: len(x) == 4)
        assert got[2, 0, "deadline"] == ["2:a", "2:b"] and len(got[1, 2, "deadline"]) == 1
        s.put("2:c", "2:d", "2:e")  # after the idle time: a batch of its own, whose timer is dropped
        got = s.until(lambda x: len(x) == 5)
        assert got[2, 1, "size"] == ["2:c", "2:d", "2:e"]
    finally:
        q.stop()
    assert sorted(p for v in got.values() for p in v) == sorted([f"1:{i}" for i in range(7)] + [f"2:{c}" for c in "abcde"])


def test_what_waits_survives_a_restart(spark, tmp_path):
    s = Stream(spark, tmp_path, size=4, wait_ms=600_000)
    s.put("5:a", "5:b", "5:c")
    q = s.start()
    s.until(lambda x: q.lastProgress is not None and q.lastProgress["batchId"] >= 1)
    q.stop()
    assert s.sent() == {}
    s.put("5:d", "5:e")
    q = s.start()
    try:
        got = s.until(lambda x: len(x) == 1)[5, 0, "size"]
        assert got[:3] == ["5:a", "5:b", "5:c"] and len(got) == 4  # what came before the restart goes first
    finally:
        q.stop()


def test_by_event_time_the_watermark_ends_the_wait_and_late_messages_go(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, lines in enumerate((["00:00:00 a", "00:00:05 b"], ["00:10:00 c", "00:10:01 d", "00:10:02 e", "00:10:03 f"], ["00:20:00 i"], ["00:00:01 late", "00:10:04 g"], ["01:00:00 h"])):
        path = tmp_path / "in" / f"part{i}"
        path.write_text("".join(f"2024-01-01 {x}\n" for x in lines))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in this order, one a trigger
    raw = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
    told = raw.select(F.lit(None).alias("shard"), F.substring("value", 21, 10).alias("payload"), F.substring("value", 1, 19).cast("timestamp").alias("at"))
    got = defaultdict(list)
    for r in windows.run_to_end(flush.gathered(told.withWatermark("at", "1 minute"), 5, 60_000, "at"), "test", mode="append").collect():
        got[r.shard, r.flush, r.reason].append(r.payload)
    assert {k: sorted(v) for k, v in got.items()} == {(None, 0, "size"): list("abcde"), (None, 1, "deadline"): list("fgi")}  # h waits, late is gone


def test_bounds_are_checked(spark):
    with pytest.raises(ValueError):
        flush.gathered(spark.createDataFrame([], "shard long, payload string"), 0, 5)


def test_the_job_gathers_messages_of_many_files_into_one_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"m{i}").write_text(json.dumps({"id": f"r{i}", "raw_text": f"The export number {i} fails."}) + "\n")
    (tmp_path / "in" / "m3").write_text("no record\n")
    settings = Settings(input_path=str(tmp_path / "in"), store_path=str(tmp_path / "store"), checkpoint_path=str(tmp_path / "progress"), batch_size=4, batch_timeout_ms=600_000)
    q = job.start(spark, settings)
    try:
        end = time.time() + 120
        while time.time() < end and not Store(spark, settings.store_path).versions():
            assert q.exception() is None
            time.sleep(0.5)
    finally:
        q.stop()
    store = Store(spark, settings.store_path)
    (batch,) = store.read("batches").collect()
    assert batch.total_cfos == 3 and store.read("feedback_units").count() == 3
    assert spark.read.parquet(f"{settings.store_path}/rejects").count() == 1
