import json
from datetime import datetime

from pyspark.sql import functions as F

from sitepulse.config import EngineConfig
from sitepulse.functions.identity import KeySchedule, keyed_id
from sitepulse.operators import behavior
from sitepulse.schema import REQUEST, web_events
from sitepulse.sources.store import EventStore, HotTier
from sitepulse.streaming import ingest


def body(i, **over):
    payload = {"d": "s.example", "n": "pageview", "u": f"https://h/p/{i}"} | over
    return {"body": json.dumps(payload), "user_agent": "Firefox/121.0", "x_forwarded_for": f"1.2.3.{i}", "received": datetime(2024, 1, 15 + i % 2, 10, i).isoformat()}


def running(spark, tmp_path, config=None, salt="0" * 64, hot=False):
    """Take in what is in the folder: the store, refused requests, and the stream."""
    store, refused = EventStore(spark, f"{tmp_path}/out"), ingest.refused_table(spark, f"{tmp_path}/refused")
    into = HotTier(store, config) if hot else store
    query = ingest.start_all(ingest.json_source(spark, f"{tmp_path}/in"), into, refused, f"{tmp_path}/ck", config or EngineConfig(), salt, once=True)
    query.awaitTermination()
    return store, refused


def test_requests_to_stored_events(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps(body(i)) for i in range(4)) + "\n" + json.dumps(body(9, d="")))
    assert running(spark, tmp_path)[0].read().count() == 4
    pixel = {"query": "d=s.example&u=https%3A%2F%2Fh%2Fp%2F7&w=5", "received": "2024-01-17T00:00:00"}
    (folder / "b.json").write_text(json.dumps(body(5)) + "\n" + json.dumps(pixel))
    stored = running(spark, tmp_path)[0].read()  # the first file isn't taken twice
    assert stored.count() == 6 and {str(r.date) for r in stored.collect()} == {"2024-01-15", "2024-01-16", "2024-01-17"}
    assert {r.pathname for r in stored.collect()} == {f"/p/{i}" for i in (0, 1, 2, 3, 5, 7)}


def test_batch_that_comes_again_is_stored_once(spark, tmp_path):
    """The driver dies after the store has taken a batch, before the stream's checkpoint knows."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps(body(i)) for i in range(4)) + "\n" + json.dumps(body(9, d="")))
    running(spark, tmp_path)
    for done in (tmp_path / "ck" / "commits").iterdir():
        done.unlink()
    store, refused = running(spark, tmp_path)
    assert store.read().count() == 4 and refused.read().count() == 1


def test_salts_change_with_the_day(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    one = {"user_agent": "Firefox/121.0", "x_forwarded_for": "1.2.3.4", "body": json.dumps({"d": "s.example", "n": "pageview", "u": "/"})}
    times = ["2024-01-15T23:59:59", "2024-01-15T01:00:00", "2024-01-16T00:00:00", None]
    (folder / "a.json").write_text("\n".join(json.dumps(one | ({"received": t} if t else {})) for t in times[:3]))
    keys = KeySchedule("a secret of the deployment")
    found = [(str(r.date), r.visitor_id) for r in running(spark, tmp_path, salt=keys)[0].read().collect()]
    assert len(set(found)) == 2 and len({v for _, v in found}) == 2
    (folder / "b.json").write_text(json.dumps(one | {"received": "2024-01-17T05:00:00"}))  # the same stream, a day later
    assert len({r.visitor_id for r in running(spark, tmp_path, salt=keys)[0].read().collect()}) == 3
    rows = spark.createDataFrame([("1.2.3.4", "Firefox/121.0", datetime(2024, 1, 15, 1)), ("1.2.3.4", "Firefox/121.0", None)], "ip string, ua string, received timestamp_ntz")
    joined = keys.joined(rows)
    ids = [r[0] for r in joined.select(keyed_id(joined.ip, joined.ua, joined["__inner"], joined["__outer"])).collect()]
    assert dict(found)["2024-01-15"] in ids and all(len(i) == 64 for i in ids)
    for plan in (joined._jdf.queryExecution().toString(), repr(keys)):
        assert "a secret of the deployment" not in plan


def test_rate_limit_is_a_stage(spark, tmp_path):
    """Of good form first; a bot takes a token; the bucket lasts from batch to batch."""
    folder = tmp_path / "in"
    folder.mkdir()
    at = {"received": "2024-01-15T10:00:00"}
    bot = {"user_agent": "Googlebot"}
    lines = [body(1, d="") | at | {"request_id": "0"}, body(2) | at | bot | {"request_id": "1"}, body(3) | at | {"request_id": "2"}, body(4) | at | {"request_id": "3"}, body(5, d="other.example") | at | {"request_id": "4"}]
    (folder / "a.json").write_text("\n".join(map(json.dumps, lines)))
    config = EngineConfig(rate_limit_per_site=2)
    running(spark, tmp_path, config)
    (folder / "b.json").write_text("\n".join(json.dumps(body(6) | {"received": f"2024-01-15T10:00:0{k}", "request_id": f"5{k}"}) for k in (0, 1)))
    store, refused = running(spark, tmp_path, config)
    assert sorted((r.request_id, r.reject_reason) for r in refused.read().collect()) == [("0", "empty"), ("1", "bot"), ("3", "rate"), ("50", "rate")]
    assert sorted(r.pathname for r in store.read().collect()) == ["/p/3", "/p/5", "/p/6"]
    both = spark.read.schema(REQUEST).json(str(folder))
    found = ingest.judged(both, config)
    assert {(r.request_id, r.reject_reason) for r in found.collect() if r.reject_reason} == {("0", "empty"), ("1", "bot"), ("3", "rate"), ("50", "rate")}


def test_a_site_larger_than_a_batch_is_limited_in_parts(spark, tmp_path):
    """No task gathers a site: the plan has Spark's sort and a map over small batches, and buckets go on from where they stood."""
    from sitepulse.operators.ratelimit import limit

    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = spark.createDataFrame([(datetime(2024, 1, 15, 10, 0, k // 4), str(k), "s") for k in range(40)], "received timestamp_ntz, request_id string, site string")
        zero = spark.createDataFrame([("s", 0.0, 0.0)], "site string, tokens double, refilled double")
        allowed = [limit(rows, 1, "site", "received", "request_id", b).where("allowed").count() for b in (None, zero.where("false"))]
        assert allowed == [10, 10]
        again = limit(rows, 1, "site", "received", "request_id", zero.withColumn("refilled", F.unix_timestamp(F.lit("2024-01-15 10:00:00")).cast("double"))).collect()
        assert sum(r.allowed for r in again) == 9 and sorted(r.turn for r in again) == list(range(1, 41))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_refused_requests_are_kept_and_counted(spark, tmp_path):
    import time

    from sitepulse.streaming.counters import Counters, write_text

    folder = tmp_path / "in"
    folder.mkdir()
    lines = [body(1), body(2, d="a..b"), body(3, d=""), body(4, d="x y"), body(5) | {"user_agent": "Googlebot"}, body(6, d="localhost:8080")]
    (folder / "a.json").write_text("\n".join(map(json.dumps, lines)))
    counters = Counters()
    spark.streams.addListener(counters)
    try:
        store, refused = running(spark, tmp_path)
        for _ in range(100):
            if counters.totals["events_ingested_total"] and any("refused" in k for k in counters.totals):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counters)
    assert {r.site_id for r in store.read().collect()} == {"s.example", "localhost:8080"}
    kept = {(r.reject_reason, r.site_id) for r in refused.read().collect()}
    assert kept == {("path", "a..b"), ("empty", None), ("site_id", "x y"), ("bot", "s.example")} or kept == {("path", "a..b"), ("empty", ""), ("site_id", "x y"), ("bot", "s.example")}
    assert counters.totals["events_ingested_total"] == 2 and counters.totals['requests_refused_total{reason="path"}'] == 1
    text = counters.text({"cache_entries": 3})
    assert "# TYPE sitepulse_events_ingested_total counter\nsitepulse_events_ingested_total 2\n" in text and "sitepulse_cache_entries 3\n" in text
    write_text(spark, text, f"{tmp_path}/metrics")
    assert "\n".join(r.value for r in spark.read.text(f"{tmp_path}/metrics").collect()) + "\n" == text


def streamed(spark, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    return web_events(source), web_events(spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*"))


def collected(spark, query, name, mode):
    query.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_live_sessions_equal_batch(spark, sf_dir):
    batch, stream = streamed(spark, sf_dir)
    live = {(r.visitor_id, r.started, r.ended, r.n_events) for r in collected(spark, ingest.live_sessions(stream, "40 days"), "s", "complete").collect()}
    assert live == {(r.visitor_id, r.started, r.ended, r.n_events) for r in behavior.session_rows(batch, tie="event_id").collect()}


def test_live_timeseries(spark, sf_dir):
    batch, stream = streamed(spark, sf_dir)
    live = collected(spark, ingest.live_timeseries(stream, "1 day"), "t", "complete")
    assert live.selectExpr("sum(n_events) n", "sum(pageviews) p").first() == batch.selectExpr("count(*) n", "count_if(event_name = 'pageview') p").first()


def test_deduplicated(spark, sf_dir):
    batch, stream = streamed(spark, sf_dir)
    found = collected(spark, ingest.deduplicated(stream, ["event_id"], "60 days"), "d", "append")
    assert found.count() == batch.count()


def test_rate_limited_equals_batch(spark, sf_dir):
    from sitepulse.operators.ratelimit import limit

    batch, stream = streamed(spark, sf_dir)
    live = {(r.event_id, r.allowed) for r in collected(spark, ingest.rate_limited(stream, 1), "r", "append").collect()}
    assert live == {(r.event_id, r.allowed) for r in limit(batch.select("site_id", "timestamp", "event_id"), 1, tie="event_id").collect()}
