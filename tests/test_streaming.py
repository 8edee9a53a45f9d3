"""Streams over files against their batch equivalents."""

import datetime as dt

import pytest

from claimloom.streaming import state


@pytest.fixture
def events(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=i), i % 3, "SUPPORTED" if i % 2 else "REFUTED", float(i), i % 4 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, verdict string, value double, fallback_used boolean")
    df = df.withColumn("latency_ms", df["value"])
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return df, str(tmp_path / "in")


def drain(stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_windowed_metrics(spark, events):
    df, path = events
    drain(state.windowed_metrics(spark.readStream.schema(df.schema).parquet(path)), "metrics", "complete")
    got = {(r["window_start"], r["verdict"]): r["n"] for r in spark.sql("SELECT * FROM metrics").collect()}
    assert got == {(r["window_start"], r["verdict"]): r["n"] for r in state.windowed_metrics(df).collect()}


def test_keep_first(spark, events):
    df, path = events
    drain(state.keep_first_stream(spark.readStream.schema(df.schema).parquet(path), ["user_id"]), "firsts")
    assert spark.sql("SELECT count(*) FROM firsts").first()[0] == state.keep_first_stream(df, ["user_id"]).count() == 3


def test_expiring_cache(spark, events):
    df, path = events
    stream = spark.readStream.schema(df.schema).parquet(path).withWatermark("ts", "1 minute")
    drain(state.expiring_cache(stream, 600), "cache")
    rows = spark.sql("SELECT user_id, value, hit, cached FROM cache ORDER BY value").collect()
    want, live = {}, {}
    for r in df.orderBy("ts").collect():
        now = r["ts"].timestamp()
        entry = live.get(r["user_id"])
        hit = entry is not None and entry[1] >= now
        want[r["value"]] = (hit, entry[0] if hit else None)
        if not hit:
            live[r["user_id"]] = (r["value"], now + 600)
    assert {r["value"]: (r["hit"], r["cached"]) for r in rows} == want


def test_live_entries(spark, events):
    from pyspark.sql import functions as F

    df, _ = events
    live = state.live_entries(df, 90, F.lit(dt.datetime(2024, 1, 1, 0, 59))).collect()
    assert {r["value"] for r in live} == {58.0, 59.0}


def _expected(rows, ttl, end):
    """The cache by a dictionary: requests in order, entries purged when found expired, the rest by the end's watermark."""
    out, live = [], {}
    for nr, at, key, value in sorted(rows, key=lambda r: (r[1], r[0])):
        if key in live and live[key][1] < at:
            out.append((key, live[key][1], "purged", live.pop(key)[0]))
        out.append((key, at, "hit" if key in live else "miss", live[key][0] if key in live else None))
        live[key] = (value, at + ttl)
    return out + [(k, e, "purged", v) for k, (v, e) in live.items() if e < end]


@pytest.mark.parametrize("cuts", [[60], [7, 20, 33, 60], [1, 2, 59, 60]])
def test_ttl_cache_in_any_batches(spark, events, tmp_path, cuts):
    """The same rows whatever the batches, with a restart after each; purged keys hold no state."""
    df, _ = events
    folder, start = str(tmp_path), 0
    for cut in cuts:
        df.where(f"event_id >= {start} AND event_id < {cut}").coalesce(1).write.mode("append").parquet(f"{folder}/ttl-in")
        stream = state.table_stream(spark, f"{folder}/ttl-in", df.schema)
        state.drain(state.ttl_cache(stream, 150), folder, f"{folder}/out")
        start = cut
    rows = [(r["event_id"], int(r["ts"].timestamp() * 1e6), r["user_id"], r["value"]) for r in df.collect()]
    got = sorted((tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()), key=str)
    assert got == sorted(_expected(rows, 150_000_000, max(r[1] for r in rows)), key=str)


def test_running_metrics(spark, events):
    """Sketches merge: percentiles of a state made in parts equal those of the whole, exact below the sketch's size."""
    df = events[0].withColumnRenamed("verdict", "v").selectExpr("v AS verdict", "latency_ms", "fallback_used", "value / 100 AS confidence", "user_id % 2 = 0 AS citation_valid", "CAST(user_id AS STRING) AS backend_used")
    one = state.snapshot(state.running_state(df)).first()
    parts = state.running_state(df.where("latency_ms < 20")).union(state.running_state(df.where("latency_ms >= 20")))
    two = state.snapshot(parts).first()
    assert one.asDict() == two.asDict()
    assert one["requests"] == 60 and one["verdicts"] == {"REFUTED": 30, "SUPPORTED": 30} and one["p95_latency_ms"] in (56.0, 57.0)
    empty = state.snapshot(state.running_state(df.where("1 = 0"))).collect()
    assert [r["requests"] for r in empty] == [0]


def test_keep_first_is_the_first(spark, events):
    df, _ = events
    assert {(r["user_id"], r["event_id"]) for r in state.keep_first_stream(df, ["user_id"]).collect()} == {(0, 0), (1, 1), (2, 2)}
