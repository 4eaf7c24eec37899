import pytest
from events import SITE, events
from pyspark.sql import functions as F

from sitepulse.operators import behavior, metrics
from sitepulse.params import parse_steps

DAY = (SITE, "2024-01-15", "2024-01-16")
YEAR = (SITE, "2024-01-01", "2025-01-01")
PV = "pageview"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_visitors_pageviews_and_ratio(spark):
    e = events(spark, [("v1", "10:00", PV, "/"), ("v1", "10:05", PV, "/about"), ("v2", "11:00", PV, "/")])
    assert rows(metrics.unique_visitors(e, *DAY)) == [(2,)]
    assert rows(metrics.unique_visitors(e, *DAY, approximate=True)) == [(2,)]
    assert rows(metrics.total_pageviews(e, *DAY)) == [(3,)]
    assert rows(metrics.pages_per_visit(e, *DAY)) == [(1.5,)]


def test_range_is_half_open(spark):
    e = events(spark, [("v1", "2024-01-15 00:00:00", PV, "/"), ("v1", "2024-02-01 00:00:00", PV, "/")])
    assert rows(metrics.total_pageviews(e, SITE, "2024-01-01", "2024-02-01")) == [(1,)]


def test_custom_events_are_no_pageviews(spark):
    e = events(spark, [("v1", "10:00", PV, "/"), ("v1", "10:01", "signup", "/")])
    assert rows(metrics.total_pageviews(e, *DAY)) == [(1,)]


def test_empty_gives_zeros(spark):
    e = events(spark, [])
    assert rows(metrics.core_metrics(e, *DAY)) == [(0, 0, 0.0, 0.0, 0.0)]
    assert rows(metrics.session_metrics(e, *DAY)) == [(0, 0.0, 0.0)]
    assert rows(metrics.bounce_rate(e, *DAY)) == [(0.0,)]
    assert rows(metrics.timeseries(e, *DAY)) == []
    assert rows(metrics.export_daily(e, *DAY)) == []


def test_breakdown_order_null_and_limit(spark):
    e = events(spark, [("v1", "10:00", PV, "/"), ("v1", "10:05", PV, "/about"), ("v2", "11:00", PV, "/", "Chrome")])
    assert rows(metrics.breakdown(e, "pages", *DAY)) == [("/", 2, 2), ("/about", 1, 1)]
    assert rows(metrics.breakdown(e, "pages", *DAY, limit=1)) == [("/", 2, 2)]
    assert rows(metrics.breakdown(e, "browsers", *DAY)) == [("(unknown)", 1, 2), ("Chrome", 1, 1)]


def test_timeseries_labels(spark):
    e = events(spark, [("v1", "10:00", PV, "/"), ("v2", "10:30", PV, "/"), ("v1", "14:00", "signup", "/"), ("v1", "2024-01-16 09:00", PV, "/")])
    assert rows(metrics.timeseries(e, *YEAR)) == [("2024-01-15", 2, 2), ("2024-01-16", 1, 1)]
    assert rows(metrics.timeseries(e, *DAY, by="hour")) == [("2024-01-15 10:00", 2, 2), ("2024-01-15 14:00", 1, 0)]


def test_session_gap_of_exactly_thirty_minutes_joins(spark):
    e = events(spark, [("v1", "10:00:00", PV, "/"), ("v1", "10:30:00", PV, "/"), ("v1", "11:00:01", PV, "/")])
    found = behavior.session_rows(e).orderBy("session").select("n_events", "seconds")
    assert rows(found) == [(2, 1800.0), (1, 0.0)]


def test_bounce(spark):
    e = events(spark, [("s1", "10:00", PV, "/"), ("s1", "10:01", "signup", "/"), ("s2", "10:00", PV, "/"), ("s2", "10:01", PV, "/"), ("s3", "10:00", "signup", "/")])
    assert rows(metrics.bounce_rate(e, *DAY)) == [(pytest.approx(1 / 3),)]
    core = metrics.core_metrics(e, *DAY).first()
    assert core.bounce_rate == pytest.approx(1 / 3) and core.unique_visitors == 3 and core.total_pageviews == 3


STEPS = "page:/a,event:b,page:/c"


@pytest.mark.parametrize(
    "visitor, step",
    [
        ([("10:00", PV, "/a"), ("10:10", "b", "/x"), ("10:20", PV, "/c")], 3),
        ([("10:00", PV, "/a"), ("10:10", "b", "/x"), ("11:00:01", PV, "/c")], 2),
        ([("10:00", PV, "/a"), ("11:00:00", "b", "/x")], 2),  # the window's end counts
        ([("08:00", PV, "/a"), ("10:00", PV, "/a"), ("10:10", "b", "/x")], 2),
        ([("10:00", "b", "/x")], 0),
        ([("10:00", PV, "/x")], 0),
        ([("10:00", "b", "/a")], 1),  # one event takes one step
        ([("10:00", PV, "/a"), ("10:10", "b", "/x"), ("10:50", PV, "/a"), ("11:20", PV, "/c")], 2),
    ],
)
def test_funnel_depth(spark, visitor, step):
    e = events(spark, [("v", *r) for r in visitor])
    assert rows(metrics.funnel(e, parse_steps(STEPS), 3600, *DAY, tie="event_id")) == [(step, 1)]


def test_funnel_of_no_steps_and_cumulative(spark):
    e = events(spark, [("v", "10:00", PV, "/a"), ("w", "10:00", PV, "/a"), ("w", "10:01", "b", "/")])
    assert rows(metrics.funnel(e, [], 60, *DAY)) == []
    assert rows(metrics.funnel_cumulative(e, parse_steps(STEPS), 3600, *DAY)) == [(1, 2), (2, 1), (3, 0)]


def test_funnel_against_brute_force(spark):
    import itertools
    import random
    from datetime import timedelta

    from events import COLUMNS, at

    rng = random.Random(5)
    base, data = at("00:00"), []
    for i in range(400):
        data.append((i, SITE, f"v{rng.randrange(25)}", base + timedelta(seconds=rng.randrange(4000)), rng.choice([PV, "b"]), rng.choice(["/a", "/c", "/x"]), None, None))
    e = spark.createDataFrame(data, COLUMNS)
    found = dict(rows(behavior.funnel_depth(e, parse_steps(STEPS), 900, "event_id")))
    tests = [lambda r: r[5] == "/a", lambda r: r[4] == "b", lambda r: r[5] == "/c"]
    for v in {r[2] for r in data}:
        mine = sorted((r for r in data if r[2] == v), key=lambda r: (r[3], r[0]))
        best = 0
        for k in (1, 2, 3):
            for chain in itertools.combinations(mine, k):
                if all(t(r) for t, r in zip(tests, chain)) and (chain[-1][3] - chain[0][3]).total_seconds() <= 900:
                    best = k
                    break
        assert found[v] == best


def test_sequence(spark):
    e = events(spark, [("m", "10:00", PV, "/a"), ("m", "10:01", PV, "/x"), ("m", "10:02", "b", "/"), ("n", "10:00", "b", "/"), ("n", "10:01", PV, "/a"), ("o", "10:00", PV, "/a")])
    assert rows(metrics.sequence_match(e, parse_steps("page:/a,event:b"), *DAY)) == [(1, 3, pytest.approx(1 / 3))]
    with pytest.raises(ValueError):
        metrics.sequence_match(e, parse_steps("page:/a"), *DAY)


def test_flow(spark):
    e = events(spark, [("v1", "10:00", PV, "X"), ("v1", "10:01", PV, "Y"), ("v2", "10:00", PV, "Y"), ("v2", "10:01", PV, "X"), ("v3", "10:00", PV, "X"), ("v3", "10:01", PV, "X"), ("v3", "10:02", PV, "Y")])
    assert sorted(rows(metrics.flow(e, "X", *DAY))) == [("X", 1), ("Y", 1)]


def test_retention(spark):
    e = events(spark, [("a", "2024-01-15 10:00", PV, "/"), ("a", "2024-01-23 10:00", PV, "/"), ("b", "2024-01-16 10:00", PV, "/"), ("c", "2024-01-02 10:00", PV, "/"), ("c", "2024-01-16 10:00", PV, "/")])
    kept = rows(metrics.retention(e, SITE, "2024-01-15", "2024-02-01", 3))
    assert kept == [("2024-01-01", [False, False, False]), ("2024-01-15", [True, True, False])]
    counts = rows(metrics.retention_counts(e, SITE, "2024-01-15", "2024-02-01", 2))
    assert counts == [("2024-01-01", 0, 0), ("2024-01-01", 1, 0), ("2024-01-15", 0, 2), ("2024-01-15", 1, 1)]
    assert rows(metrics.retention(e, SITE, "2024-01-15", "2024-02-01", 0)) == []


def test_windows_share_one_exchange(spark):
    e = events(spark, [("v", "10:00", PV, "/a")])
    plan = behavior.funnel_depth(e, parse_steps(STEPS), 60, "event_id")._jdf.queryExecution().executedPlan().toString()
    before_join = plan.split("Window")[-1]
    assert before_join.count("Exchange hashpartitioning(visitor_id") == 1


@pytest.mark.parametrize("partitions", ["1", "13"])
def test_sessions_of_a_very_large_visitor(spark, partitions):
    """Most events are one visitor's; its sessions go over borders of tasks, of which none holds all."""
    import random

    rng, rows, at = random.Random(4), [], 0
    for i in range(4000):
        at += rng.choice([1, 60, 1800, 1801, 4000])
        rows.append((i, "big" if rng.random() < 0.8 else f"v{rng.randrange(30)}", at, rng.choice(["pageview", "click"])))
    e = spark.createDataFrame(rows, "event_id long, visitor_id string, s long, event_name string").select("event_id", "visitor_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("timestamp"), "event_name")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for tie in ("event_id", None):
            assert sorted(map(tuple, behavior.sessionize_by_range(e, tie=tie).select("event_id", "session").collect())) == sorted(map(tuple, behavior.sessionize(e, tie=tie).select("event_id", "session").collect()))
        parts = e.repartitionByRange("visitor_id", "timestamp").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert parts <= 4000 / int(partitions) * 1.6
        assert sorted(map(tuple, behavior.session_rows(e, by_range=True).collect())) == sorted(map(tuple, behavior.session_rows(e).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert behavior.session_rows(e.limit(0), by_range=True).count() == 0


def test_rollup_unites_days(spark, tmp_path):
    from sitepulse.operators import rollups

    e = events(spark, [(f"v{i % 40}", f"2024-01-{15 + i % 3} 10:00", "pageview" if i % 2 else "click", f"/{i % 4}") for i in range(400)])
    table = rollups.table(spark, str(tmp_path / "r"))
    for k in range(2):
        assert table.write(rollups.daily(e.where(f"event_id % 2 = {k}")), "s", k)
    assert not table.write(rollups.daily(e), "s", 1)
    for found in (table.read(), rollups.compacted(table.read())):
        whole = rollups.breakdown(found, SITE, "2024-01-15", "2024-01-17").where("dimension = 'all'").first()
        exact = e.where("timestamp < TIMESTAMP_NTZ '2024-01-17 00:00:00'")
        assert (whole.n_events, whole.pageviews) == (exact.count(), exact.where("event_name = 'pageview'").count())
        assert abs(whole.visitors - exact.select("visitor_id").distinct().count()) <= 1
        assert rollups.breakdown(found, SITE, "2024-01-15", "2024-01-18").where("dimension = 'pages'").count() == 4


@pytest.mark.parametrize("partitions", ["1", "13"])
def test_funnel_of_a_very_large_visitor(spark, partitions):
    """Chains go over borders of tasks; windows end before, at and after them."""
    import random

    rng, rows, at = random.Random(9), [], 0
    for i in range(1500):
        at += rng.choice([0, 1, 5, 60])
        rows.append((i, "big" if rng.random() < 0.6 else f"v{rng.randrange(60)}", at, rng.choice("abcdx")))
    e = spark.createDataFrame(rows, "event_id long, visitor_id string, s long, event_name string").select("event_id", "visitor_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("timestamp"), "event_name")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for names, window in (("abcd", 3), ("abcd", 60), ("aab", 10), ("dcba", 400), ("a", 5)):
            steps = [F.col("event_name") == x for x in names]
            got = [sorted(map(tuple, behavior.funnel_depth(e, steps, window, "event_id", by_range).collect())) for by_range in (True, False)]
            assert got[0] == got[1] and len(got[0]) == len({r[1] for r in rows})
        steps = [F.col("event_name") == x for x in "dxcbadxcba"]
        assert sorted(map(tuple, behavior.sequence_reached(e, steps, "event_id", True).collect())) == sorted(map(tuple, behavior.sequence_reached(e, steps, "event_id").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
