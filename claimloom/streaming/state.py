"""Expiring cache, request metrics and keep-first as streams, each with its batch equivalent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: transformWithState keeps its state in this store; set it before the stream starts.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def live_entries(events: DataFrame, ttl_seconds: int, now, key: str = "user_id", value: str = "value", ts: str = "ts") -> DataFrame:
    """Batch: the latest value of each key whose time to live has not run out by `now` (a timestamp column)."""
    latest = events.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col("event_id").desc()))).where("__rn = 1")
    expires = F.col(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_seconds))
    return latest.withColumn("expires_at", expires).where(F.col("expires_at") >= now).select(key, value, "expires_at")


def expiring_cache(stream: DataFrame, ttl_seconds: int, key: str = "user_id", value: str = "value", ts: str = "ts") -> DataFrame:
    """Stream: (key, value, hit, cached): for each request whether a live entry was there, by event time and watermark.

    State is one value per key; it goes when the watermark passes its expiry.
    """
    schema = f"{key} long, {value} double, hit boolean, cached double"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else None
        out = []
        for pdf in batches:
            for t, v in pdf.sort_values(ts)[[ts, value]].itertuples(index=False):
                at = t.timestamp()
                live = now is not None and now[1] >= at
                out.append((k[0], v, live, now[0] if live else None))
                if not live:
                    now = (float(v), at + ttl_seconds)
        if now is not None:
            state.update(now)
            expiry = int(now[1] * 1000)
            if expiry > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(expiry)
        yield pd.DataFrame(out, columns=[key, value, "hit", "cached"])

    return stream.groupBy(key).applyInPandasWithState(step, schema, "v double, expires double", "append", "EventTimeTimeout")


class TtlCache(StatefulProcessor):
    """One value per key with its expiry and the timer that purges it.

    A request finds the key's value if that has not expired, then stores its own with a
    new expiry, as the cache's get and set. What expires is purged once: by the next
    request of its key, or by its timer when the watermark passes.
    """

    def __init__(self, ttl_micros: int) -> None:
        self.ttl = ttl_micros

    def init(self, handle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "value double, expires long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.entry.get() if self.entry.exists() else None
        value, expires, timer = held if held is not None else (None, None, None)
        for r in sorted(rows, key=lambda r: (r["at"], r["nr"])):
            live = expires is not None and expires >= r["at"]
            if expires is not None and not live:
                yield Row(key=key[0], at=expires, kind="purged", value=value)
            yield Row(key=key[0], at=r["at"], kind="hit" if live else "miss", value=value if live else None)
            value, expires = r["value"], r["at"] + self.ttl
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = expires // 1_000 + 1
        self.handle.registerTimer(timer)
        self.entry.update((value, expires, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        value, expires, _ = self.entry.get()
        self.entry.clear()
        yield Row(key=key[0], at=expires, kind="purged", value=value)

    def close(self) -> None:
        pass


def ttl_cache(stream: DataFrame, ttl_seconds: int, key: str = "user_id", value: str = "value", ts: str = "ts", order: str = "event_id", late: str = "0 seconds") -> DataFrame:
    """Stream: (key, at, kind, value): a hit or miss per request and a purge per expired entry; times in microseconds.

    State is one entry per live key: purged keys hold none. Timers run on event time, so
    what a restart or other batches give is the same. Requests older than `late` before
    the latest may be dropped. Null keys are one key; null values may be stored.
    """
    stream.sparkSession.conf.set(*PROVIDER)
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.withWatermark(ts, late).select(F.col(key).alias("key"), ts, F.unix_micros(ts).alias("at"), F.col(order).alias("nr"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").transformWithState(TtlCache(ttl_seconds * 1_000_000), f"key {kind}, at long, kind string, value double", "append", "EventTime")


#: A quantile sketch's size: up to so many values it is exact, beyond its rank error is about 2.3 / KLL to the power 0.9.
KLL = 4_000


def running_state(requests: DataFrame) -> DataFrame:
    """Sums, counts and a mergeable quantile sketch of all requests so far per verdict and backend; on a stream without a window or watermark.

    The state is one row per verdict and backend however many requests came; `snapshot`
    merges its rows.
    """
    flag = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long"))
    sums = [F.count("*").alias("n"), flag("fallback_used").alias("fallbacks"), flag("citation_valid").alias("citation_valids"), F.sum("confidence").alias("confidence"), F.sum("latency_ms").alias("latency_ms")]
    return requests.groupBy("verdict", "backend_used").agg(*sums, F.expr(f"kll_sketch_agg_double(CAST(latency_ms AS DOUBLE), {KLL})").alias("sketch"))


def snapshot(state: DataFrame) -> DataFrame:
    """One row from running_state(): requests, rates, means, approximate p50 and p95, histograms of verdicts and backends; zeros before the first request."""
    n = F.coalesce(F.sum("n"), F.lit(0))
    share = lambda c: F.when(n > 0, F.sum(c) / n).otherwise(0.0)
    whole = state.agg(n.alias("requests"), F.coalesce(F.sum("fallbacks"), F.lit(0)).alias("fallbacks"), share("fallbacks").alias("fallback_rate"), share("confidence").alias("average_confidence"), share("latency_ms").alias("average_latency_ms"), share("citation_valids").alias("citation_valid_rate"), F.expr(f"kll_merge_agg_double(sketch, {KLL})").alias("sketch"))
    quantile = lambda q: F.when(F.col("requests") > 0, F.expr(f"kll_sketch_get_quantile_double(sketch, {q}D)")).otherwise(0.0)
    tally = lambda c: state.where(F.col(c).isNotNull()).groupBy(c).agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(c))
    return whole.withColumn("p50_latency_ms", quantile(0.5)).withColumn("p95_latency_ms", quantile(0.95)).drop("sketch").crossJoin(F.broadcast(tally("verdict").withColumnRenamed("verdict", "verdicts"))).crossJoin(F.broadcast(tally("backend_used").withColumnRenamed("backend_used", "backend_usage_counts")))


def drain(stream: DataFrame, folder: str, path: str | None = None, mode: str = "append", batch=None) -> None:
    """Run a stream until its source is read up, with its checkpoint in `folder`: a later call goes on where this one ended.

    Rows go to Parquet files in `path`, each once, or to batch(df, id).
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    query = writer.format("parquet").option("path", path).start() if batch is None else writer.foreachBatch(batch).start()
    query.awaitTermination()


def slices(df: DataFrame, order: str, files: int) -> list[DataFrame]:
    """`df` cut along `order` into slices of about equal size: what arrives one file after the other."""
    cuts = [None, *df.select(F.percentile_approx(F.col(order), [i / files for i in range(1, files)], 10_000).alias("c")).first()["c"], None]
    lit = lambda v: F.lit(v).cast(df.schema[order].dataType)
    return [df.where((F.lit(True) if a is None else F.col(order) > lit(a)) & (F.lit(True) if b is None else F.col(order) <= lit(b))) for a, b in zip(cuts, cuts[1:], strict=False)]


def table_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_metrics(requests: DataFrame, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests, mean and approximate 95th percentile of latency, fallback rate by event-time window; works on streams and tables."""
    watermarked = requests.withWatermark("ts", late) if requests.isStreaming else requests
    out = watermarked.groupBy(F.window("ts", window).alias("w"), "verdict").agg(F.count("*").alias("n"), F.avg("latency_ms").alias("mean_latency_ms"), F.percentile_approx("latency_ms", 0.95, 1000).alias("p95_latency_ms"), F.avg(F.col("fallback_used").cast("double")).alias("fallback_rate"))
    return out.select(F.col("w.start").alias("window_start"), "verdict", "n", "mean_latency_ms", "p95_latency_ms", "fallback_rate")


def keep_first_stream(stream: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first row of each key, in order of time on a table; state is bounded by the watermark."""
    if not stream.isStreaming:
        return stream.groupBy(*keys).agg(F.min_by(F.struct(*stream.columns), F.struct(ts, *[c for c in stream.columns if c not in (ts, *keys)])).alias("__r")).select("__r.*")
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
