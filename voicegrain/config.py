"""Settings of the feedback pipeline, with their defaults; every one can be set by an environment variable VOICEGRAIN_<NAME>."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

#: Used only by a session on this machine alone that names no spark.checkpoint.dir, as in tests.
LOCAL_DIR = "/tmp/checkpoints/voicegrain"


@dataclass(frozen=True)
class Settings:
    input_path: str = "feedback-in"
    store_path: str = "feedback-store"
    checkpoint_path: str = "feedback-checkpoint"
    kafka_servers: str = ""
    kafka_topic: str = "feedback"
    batch_size: int = 50
    batch_timeout_ms: int = 5_000
    #: Consumers' worth of gathering: each sends a batch when it is full or timed out. 0: a batch is what a trigger reads.
    gather_shards: int = 1
    compact_after: int = 64
    dedup_threshold: float = 0.95
    topic_threshold: float = 0.82
    suggest_threshold: float = 0.70
    review_threshold: float = 0.70
    drift_threshold: float = 0.80
    emerging_rate: float = 0.15
    anomaly_sigma: float = 2.5

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        given = {}
        for f in fields(cls):
            raw = env.get(f"VOICEGRAIN_{f.name.upper()}")
            if raw is not None:
                given[f.name] = type(f.default)(raw)
        return cls(**given)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; an error on a cluster whose session names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or LOCAL_DIR).rstrip("/")
