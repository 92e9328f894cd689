"""Streaming scoring with the prediction cache (U6, SC2 stream).

Scored requests stream in; a ``transformWithStateInPandas`` processor keyed by
the request hash keeps, per key, the cached price and its expiry.  A request is a
hit when it arrives before the expiry and is answered with the cached price; a
successful miss caches its own price until now + TTL; hits never extend it.  An
event-time timer drops the state once the watermark has passed the expiry, so
state is bounded by the keys of one TTL and watermark.  State lives in the
RocksDB state store, checkpointed with the query.  A request later than the
watermark is dropped by the engine: ``delay`` must cover the disorder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import config as C
from ..operators.scoring import payload_hash

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

OUTPUT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("request_key", T.StringType()),
    T.StructField("request_timestamp", T.TimestampType()),
    T.StructField("cache_hit", T.BooleanType()), T.StructField("computed", T.BooleanType()),
    T.StructField("predicted_price", T.DoubleType()),
])
STATE_SCHEMA = T.StructType([T.StructField("us", T.LongType()), T.StructField("price", T.DoubleType())])


class CacheProcessor(StatefulProcessor):
    """Per-key cached price and expiry; rows of one key inside a micro-batch
    are handled in (time, id) order."""

    def __init__(self, ttl_seconds: int = C.CACHE_TTL_SECONDS):
        self.ttl_us = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", STATE_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        pdf = pdf.sort_values(["t_us", "id"], kind="stable")
        exp, price = self.entry.get() if self.entry.exists() else (None, None)
        before = exp
        hits, computed, prices = [], [], []
        for t, ok, own in zip(pdf["t_us"].tolist(), pdf["succeeded"].tolist(), pdf["predicted_price"].tolist()):
            hit = exp is not None and t < exp
            hits.append(hit)
            computed.append(bool(ok) and not hit)
            if ok and not hit:
                exp, price = t + self.ttl_us, own
            prices.append(price if hit or ok else None)
        if exp != before:
            self.entry.update((exp, price))
            self.handle.registerTimer(-(-exp // 1000))
        yield pd.DataFrame({"id": pdf["id"].astype("int64"), "request_key": pdf["request_key"],
                            "request_timestamp": pdf["request_timestamp"], "cache_hit": hits,
                            "computed": computed, "predicted_price": pd.Series(prices, pdf.index, dtype="float64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists() and self.entry.get()[0] <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.entry.clear()
        yield pd.DataFrame({f.name: pd.Series(dtype="object") for f in OUTPUT_SCHEMA})

    def close(self) -> None:
        pass


def cache_stream(requests: DataFrame, ttl_seconds: int = C.CACHE_TTL_SECONDS, delay: str = "1 day") -> DataFrame:
    """Per streamed request whether it is served from the cache, and the
    price it is answered with (null after a failed computation).

    ``requests`` needs ``id, request_key, request_timestamp, succeeded,
    predicted_price``.  A session on the default state store, which cannot hold
    this operator, is switched to RocksDB; any other choice is kept."""
    conf = requests.sparkSession.conf
    if conf.get(PROVIDER).endswith(".HDFSBackedStateStoreProvider"):
        conf.set(PROVIDER, ROCKSDB)
    base = requests.withWatermark("request_timestamp", delay).select(
        "id", "request_key", "request_timestamp", "succeeded", F.col("predicted_price").cast("double"),
        F.unix_micros("request_timestamp").alias("t_us"))
    return (base.groupBy("request_key")
                .transformWithStateInPandas(statefulProcessor=CacheProcessor(ttl_seconds),
                                            outputStructType=OUTPUT_SCHEMA, outputMode="Append",
                                            timeMode="EventTime"))


def requests_stream(events: DataFrame) -> DataFrame:
    """Prediction requests from the streamed log, keyed by the hash of their
    payload; the logged value stands for the scored price."""
    return events.where(F.col("event_type") != "view").select(
        F.col("event_id").alias("id"), payload_hash("props").alias("request_key"),
        F.col("ts").cast("timestamp").alias("request_timestamp"),
        (F.col("event_type") != "error").alias("succeeded"),
        F.round(F.col("value") * 100, 2).alias("predicted_price"))


def score_requests_stream(model, requests: DataFrame, as_of_year: int,
                          margin: float = C.DEFAULT_ERROR_MARGIN) -> DataFrame:
    """SC2 on a stream: the batch scoring plan (validate, encode, age, model,
    band) applied to a streaming frame of requests; every step is a
    stateless per-row transform, so it runs unchanged under micro-batches."""
    from ..operators.scoring import score_requests
    return score_requests(model, requests, as_of_year, margin)
