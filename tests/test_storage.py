from datetime import date, datetime

import pytest
from events import events
from pyspark.sql import functions as F

from sitepulse.config import EngineConfig, load, load_secret
from sitepulse.operators import lifecycle
from sitepulse.operators.cache import QueryCache, QueryGate, TooBusy
from sitepulse.operators.ratelimit import limit, take
from sitepulse.schema import EVENT, conform
from sitepulse.sources import ingest, sinks
from sitepulse.sources.store import EventStore, HotTier
from sitepulse.streaming.ingest import refused_table

PV = "pageview"


def filled(spark, path):
    store = EventStore(spark, str(path))
    rows = [("v1", "2024-01-15 10:00", PV, "/"), ("v2", "2024-01-16 10:00", PV, "/"), ("v2", "2020-05-01 10:00", PV, "/")]
    refused = store.append(events(spark, rows, "001").unionByName(events(spark, rows, "b.example")).unionByName(events(spark, rows[:1], "../x")))
    return store, refused


def test_partitions_round_trip(spark, tmp_path):
    store, refused = filled(spark, tmp_path / "t")
    assert refused.count() == 1 and refused.columns == EVENT.names
    assert len(store.partitions()) == 6
    back = store.read()
    assert back.count() == 6 and dict(back.dtypes)["site_id"] == "string" and {r.site_id for r in back.collect()} == {"001", "b.example"}


def test_scan_prunes_partitions(spark, tmp_path):
    store, _ = filled(spark, tmp_path / "t")
    found = store.scan("001", "2024-01-15", "2024-01-16")
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "site_id" in filters and "date" in filters and "PushedFilters: [IsNotNull(timestamp)" in plan


def test_empty_store(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "none"))
    assert store.read().count() == 0 and store.partitions() == [] and lifecycle.cleanup(store, 30) == 0
    hot = events(spark, [("v", "2024-01-15 10:00", PV, "/")])
    assert store.view(hot).count() == 1


def test_view_unites_tiers(spark, tmp_path):
    store, _ = filled(spark, tmp_path / "t")
    store.view(events(spark, [("v", "2024-01-15 10:00", PV, "/")]))
    assert spark.sql("SELECT count(*) n FROM events_all").first().n == 7


def test_cleanup(spark, tmp_path):
    store, _ = filled(spark, tmp_path / "t")
    assert lifecycle.cleanup(store, 0) == 0
    assert lifecycle.cleanup(store, 30, date(2024, 1, 20)) == 2
    assert store.read().count() == 4


def test_erase_and_compact(spark, tmp_path):
    store, _ = filled(spark, tmp_path / "t")
    done = lifecycle.erase(store, "001", "2024-01-15", "2024-01-16")
    assert done["records_deleted"] == 2 and done["partitions_deleted"] == 2
    assert sorted((r.site_id, str(r.date)) for r in store.read().collect()) == [("001", "2020-05-01"), ("b.example", "2020-05-01"), ("b.example", "2024-01-15"), ("b.example", "2024-01-16")]
    store.append(events(spark, [("w", "2024-01-15 11:00", PV, "/")], "b.example"))
    assert lifecycle.compact(store, "b.example", "2024-01-15") == 1
    assert store.read().where("date = DATE '2024-01-15'").count() == 2 and store.read().count() == 5


def test_erase_site_with_port(spark, tmp_path):
    """Spark escapes some characters of a site in the folder's name."""
    store = EventStore(spark, str(tmp_path / "t"))
    rows = [("v1", "2024-01-15 10:00", PV, "/"), ("v2", "2024-01-16 10:00", PV, "/")]
    store.append(events(spark, rows, "localhost:8080").unionByName(events(spark, rows, "localhost%3A8080")).unionByName(events(spark, rows, "a#b=c")))
    assert ("localhost:8080", "2024-01-15") in store.partitions()
    done = lifecycle.erase(store, "localhost:8080", "2024-01-15", "2024-01-15")
    assert (done["records_deleted"], done["partitions_deleted"]) == (1, 1)
    assert sorted((r.site_id, str(r.date)) for r in store.read().collect()) == [("a#b=c", "2024-01-15"), ("a#b=c", "2024-01-16"), ("localhost%3A8080", "2024-01-15"), ("localhost%3A8080", "2024-01-16"), ("localhost:8080", "2024-01-16")]
    assert lifecycle.erase(store, "localhost:8080", "2024-01-15", "2024-01-15")["records_deleted"] == 0
    assert lifecycle.cleanup(store, 1, date(2024, 1, 17)) == 2
    assert store.drop_partition("localhost:8080", "2024-01-16") == 1 and store.drop_partition("localhost:8080", "2024-01-16") == 0


def test_erase_says_what_is_left(spark, tmp_path, monkeypatch):
    store, _ = filled(spark, tmp_path / "t")
    monkeypatch.setattr(store.files, "delete", lambda path: True)
    with pytest.raises(RuntimeError):
        lifecycle.erase(store, "001", "2024-01-15", "2024-01-16")


def test_hot_tier(spark, tmp_path):
    now = [0.0]
    store = EventStore(spark, str(tmp_path / "t"))
    config = EngineConfig(flush_event_count=3, flush_interval_secs=60)
    hot = HotTier(store, config, lambda: now[0])
    one = events(spark, [("v", "2024-01-15 10:00", PV, "/")], "s")
    assert hot.flush() == 0 and hot.push(one) == 0 and hot.push(one) == 0 and store.read().count() == 0 and hot.view().count() == 2
    assert HotTier(store, config).pending == 2  # another driver finds them
    assert hot.push(one.unionByName(events(spark, [("v", "2024-01-15 10:00", PV, "/")], "../x"))) == 3
    assert store.read().count() == 3 and hot.read().count() == 1 and hot.view().count() == 4  # the unsafe one stays
    assert hot.push(one) == 0
    now[0] = 61.0
    assert hot.push(one) == 2 and store.read().count() == 5 and hot.view().count() == 6


def test_push_sorts_nothing(spark, tmp_path):
    """A task that writes both parts of a push holds no rows."""
    hot = HotTier(EventStore(spark, str(tmp_path / "t")), EngineConfig(flush_event_count=9, flush_interval_secs=60))
    rows = [("v", "2024-01-15 10:00", PV, "/")]
    hot.push(events(spark, rows, "../x").unionByName(events(spark, rows, "s")).coalesce(1))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    done = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [p for p in (done.apply(k).physicalPlanDescription() for k in range(done.size())) if str(tmp_path) in p and "InsertIntoHadoopFsRelationCommand" in p]
    assert plans and not any("Sort" in p for p in plans)
    assert hot.read().count() == 2 and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


class Died(Exception):
    pass


def dying(*_):
    raise Died


@pytest.mark.parametrize("step", ["publish", "commit", "stage"])
def test_flush_that_dies(spark, tmp_path, step):
    """Wherever a driver dies, the next one finds each event once."""
    path, config = str(tmp_path / "t"), EngineConfig(flush_event_count=100)
    rows = events(spark, [("v", "2024-01-15 10:00", PV, f"/{i}") for i in range(3)], "s").unionByName(events(spark, [("v", "2024-01-15 10:00", PV, "/x")], "../x"))
    hot = HotTier(EventStore(spark, path), config)
    hot.push(rows)
    setattr(hot.store if step == "stage" else hot.store.log, step, dying)
    with pytest.raises(Died):
        hot.flush()
    store = EventStore(spark, path)
    again = HotTier(store, config)
    assert again.view().count() == 4 and again.pending == (0 if step == "publish" else 3)
    again.flush()
    assert (store.read().count(), again.read().count(), again.view().count()) == (3, 1, 4)
    assert sorted(r.pathname for r in store.read().collect()) == ["/0", "/1", "/2"] and store.files.children("_log") == []
    store.log.sweep()
    assert store.files.children("_staging") == [] and again.view().count() == 4


def test_publish_that_dies_half_way(spark, tmp_path, monkeypatch):
    store = EventStore(spark, str(tmp_path / "t"))
    moves, move = [], store.files.move

    def some(source, target):
        if "_log" not in target and moves:
            raise Died
        if "_log" not in target:
            moves.append(target)
        move(source, target)

    monkeypatch.setattr(store.files, "move", some)
    with pytest.raises(Died):
        store.append(events(spark, [("v", f"2024-01-{d} 10:00", PV, "/") for d in (15, 16, 17)], "s"))
    assert EventStore(spark, store.path).read().count() == 3


def test_batch_of_a_source_is_taken_once(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "t"))
    hot = HotTier(store, EngineConfig(flush_event_count=2))
    one = events(spark, [("v", "2024-01-15 10:00", PV, "/")], "s")
    assert hot.push(one, "a", 0) == 0 and hot.push(one, "a", 0) == 0 and hot.pending == 1
    assert hot.push(one, "a", 1) == 2 and hot.push(one, "a", 1) == 0 and hot.push(one, "a", 0) == 0 and hot.push(one, "b", 0) == 0
    assert hot.view().count() == 3
    store.append(one, "c", 5)
    store.append(one, "c", 5)
    store.append(one, "c", 4)
    assert hot.view().count() == 4


def test_erase_reaches_everything(spark, tmp_path):
    """Stored, pushed, unsafe and refused rows; what is left is flushed as before."""
    store, _ = filled(spark, tmp_path / "t")
    hot = HotTier(store, EngineConfig(flush_event_count=1000))
    rows = [("v1", "2024-01-15 10:00", PV, "/"), ("v2", "2024-01-17 10:00", PV, "/")]
    hot.push(events(spark, rows, "001"), "stream", 3)
    hot.push(events(spark, rows, "b.example"))
    hot.push(events(spark, rows, "a..b"))
    refused = refused_table(spark, str(tmp_path / "refused"))
    bad = spark.createDataFrame([(datetime(2024, 1, d), s, "n", "https://h/secret", str(d), "bot", date(2024, 1, d)) for d in (15, 18) for s in ("001", "b.example")], refused.schema)
    refused.write(bad)
    done = lifecycle.erase(store, "001", "2024-01-15", "2024-01-16", hot, refused)
    assert (done["records_deleted"], done["hot_records_deleted"], done["refused_deleted"], done["partitions_deleted"]) == (3, 1, 1, 2)
    assert hot.pending == 3 and sorted((r.site_id, r.timestamp.day) for r in hot.read().collect()) == [("001", 17), ("a..b", 15), ("a..b", 17), ("b.example", 15), ("b.example", 17)]
    assert sorted((r.site_id, r.received.day) for r in refused.read().collect()) == [("001", 18), ("b.example", 15), ("b.example", 18)]
    assert lifecycle.erase(store, "a..b", "2024-01-15", "2024-01-15", hot, refused)["hot_records_deleted"] == 1
    assert hot.push(events(spark, rows, "001"), "stream", 3) == 0 and hot.pending == 3  # what was erased doesn't come back by a repeated batch
    assert hot.flush() == 3
    assert not store.read().where("site_id = '001' AND date = DATE '2024-01-15'").count() and hot.read().count() == 1


def test_stores_of_streams_can_be_changed(spark, tmp_path):
    """Cleanup and erasure of what a stream has written leave a table that can be read."""
    store = EventStore(spark, str(tmp_path / "t"))
    store.append(events(spark, [("v", "2024-01-15 10:00", PV, "/"), ("v", "2024-02-15 10:00", PV, "/")], "s"), "stream", 0)
    assert lifecycle.cleanup(store, 10, date(2024, 2, 16)) == 1 and store.read().count() == 1
    store.append(events(spark, [("v", "2024-02-16 10:00", PV, "/")], "s"), "stream", 1)
    assert lifecycle.erase(store, "s", "2024-02-15", "2024-02-15")["records_deleted"] == 1 and store.read().count() == 1


def test_migrations(spark, tmp_path):
    store, ran = EventStore(spark, str(tmp_path / "t")), []
    assert store.schema_version() == 0 and store.migrate() == [1] and store.migrate() == [] and store.schema_version() == 1

    def broken(s):
        raise OSError

    with pytest.raises(OSError):
        store.migrate({1: broken, 2: ran.append, 3: broken})
    assert ran == [store] and store.schema_version() == 2 and store.migrate({3: ran.append}) == [3]
    store.append(events(spark, [("v", "2024-01-15 10:00", PV, "/")], "s"))
    assert store.read().count() == 1
    store.create_table("stored_events")
    assert spark.table("stored_events").count() == 1 and "3" in {r.value for r in spark.sql("SHOW TBLPROPERTIES stored_events('schema_version')").collect()}
    spark.sql("DROP TABLE stored_events")


def request(**over):
    row = {"d": "site.example", "n": PV, "u": "https://h/p", "r": None, "w": None, "p": None, "ra": None, "rc": None, "origin": None, "user_agent": "Firefox/121.0", "x_forwarded_for": None, "x_real_ip": None, "received": datetime(2024, 1, 15, 10, 30, 5)}
    return row | over


SCHEMA = "d string, n string, u string, r string, w int, p string, ra double, rc string, origin string, user_agent string, x_forwarded_for string, x_real_ip string, received timestamp_ntz"


@pytest.mark.parametrize(
    "over, reason",
    [
        ({}, None),
        ({"d": ""}, "empty"),
        ({"u": None}, "empty"),
        ({"n": "é" * 129}, "too_long"),
        ({"p": "x" * 4097}, "too_long"),
        ({"d": "a b"}, "site_id"),
        ({"origin": "https://evil.example", "d": ""}, "origin"),
        ({"user_agent": "Googlebot"}, "bot"),
        ({"user_agent": None}, None),
    ],
)
def test_reject_reason(spark, over, reason):
    df = spark.createDataFrame([request(**over)], SCHEMA)
    assert df.select(ingest.reject_reason(EngineConfig(allowed_sites=("site.example",)))).first()[0] == reason


def test_enrich_and_privacy(spark):
    df = spark.createDataFrame([request(r="https://www.google.com/s?q=1", w=800, ra=1.239, rc="EURO", p="{}")], SCHEMA)
    row = ingest.enrich(df, EngineConfig(), "0" * 64).first()
    assert (row.referrer_source, row.referrer, row.device_type, row.screen_size, str(row.revenue_amount), row.revenue_currency) == ("Google", "https://www.google.com/s?q=1", "tablet", "800", "1.24", "EUR")
    assert len(row.visitor_id) == 64 and row.browser_version == "121.0" and row.hostname == row.site_id
    private = ingest.enrich(df, EngineConfig(gdpr_mode=True, suppress_visitor_id=True), "0" * 64).first()
    assert (private.referrer, private.browser_version, private.screen_size, private.device_type, private.timestamp) == ("https://www.google.com/s", None, None, None, datetime(2024, 1, 15, 10))
    assert len(private.visitor_id) == 36


def test_json_and_pixel(spark):
    body = spark.createDataFrame([('{"d":"s","n":"x","u":"/a","w":5}',)], "body string")
    assert ingest.parse_json(body).first().w == 5
    pixel = spark.createDataFrame([("d=s.example&u=https%3A%2F%2Fh%2Fa&w=7",)], "query string")
    row = ingest.parse_pixel(pixel).first()
    assert (row.d, row.n, row.u, row.w) == ("s.example", PV, "https://h/a", 7)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=a", 1), (None, 2)], "name string, n long")
    assert [r.line for r in sinks.csv_lines(df).collect()] == ["\"'=a\",1", '"",2']
    assert [r.json for r in sinks.json_rows(df).collect()] == ['{"name":"=a","n":1}', '{"n":2}']
    sinks.write_csv(df.coalesce(1), str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("part-*")).read_text().splitlines()
    assert text == ["name,n", "\"'=a\",1", '"",2']


def test_rate_limit(spark):
    e = events(spark, [("v", f"10:00:00.{i}", PV, "/") for i in range(3)], "a").unionByName(events(spark, [("v", "10:00:00", PV, "/")], "b"))
    assert [r.allowed for r in limit(e.where("site_id = 'a'"), 2, tie="event_id").orderBy("event_id").collect()] == [True, True, False]
    assert limit(e, 2).where("site_id = 'b' AND allowed").count() == 1
    assert limit(e, 0).where("allowed").count() == 4
    assert take(0.0, 0.0, 0.5, 2) == (0.0, True)


def test_cache_and_gate():
    now = [0.0]
    cache = QueryCache(10, 3, lambda: now[0])
    assert cache.through("main:s:1", lambda: 5) == 5 == cache.through("main:s:1", lambda: 6)
    assert (cache.hits, cache.misses) == (1, 1)
    assert cache.put("b", 1) and cache.put("c", 1) and not cache.put("d", 1)
    now[0] = 11
    assert cache.get("b") is None and cache.put("d", 1)
    cache.put("main:s:2", 1)
    cache.forget("s")
    assert cache.get("main:s:2") is None
    assert not QueryCache(0).put("a", 1)
    gate = QueryGate(1)
    with gate.enter(), pytest.raises(TooBusy), gate.enter():
        pass
    with gate.enter():
        pass


def test_config(tmp_path):
    file = tmp_path / "c.toml"
    file.write_text('filter_bots = false\nallowed_sites = ["a", "b"]\nunknown = 1\n')
    config = load(str(file), {"SITEPULSE_GDPR_MODE": "true", "SITEPULSE_RETENTION_DAYS": "9"})
    assert not config.filter_bots and config.allowed_sites == ("a", "b") and config.retention_days == 9
    assert config.round_timestamps and config.geoip_precision == "country"
    assert EngineConfig(gdpr_mode=True, geoip_precision="region").resolved().geoip_precision == "region"
    secret = load_secret(str(tmp_path / "s"), {})
    assert load_secret(str(tmp_path / "s"), {}) == secret and load_secret("x", {"SITEPULSE_SECRET": "y"}) == "y"


def test_conform_fills_columns(spark):
    assert conform(events(spark, [("v", "10:00", PV, "/")])).schema.names == EVENT.names
    assert conform(spark.range(1).select(F.lit("s").alias("site_id"))).first().visitor_id is None
