"""Registered queries over the driver's tables, and the same in SQL, written independently where an algorithm is ours."""

from __future__ import annotations

import time
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitepulse.config import EngineConfig
from sitepulse.functions import geo, identity, mmdb, text, url, useragent
from sitepulse.functions import sql as sql_functions
from sitepulse.operators import behavior, lifecycle, metrics, ratelimit, rollups
from sitepulse.params import check_limit, parse_interval, parse_steps, resolve_period, site_id_valid
from sitepulse.plans import sql
from sitepulse.plans.places import database
from sitepulse.schema import REQUEST, web_events
from sitepulse.session import scratch_folder as _folder
from sitepulse.sources.commits import Files
from sitepulse.sources.ingest import enrich, parse_pixel, reject_reason
from sitepulse.sources.sinks import csv_lines, json_rows
from sitepulse.sources.store import EventStore, HotTier
from sitepulse.streaming import ingest as streaming
from sitepulse.streaming.counters import Counters, write_text

SITE, START, END = "site-1.example", "2024-01-08", "2024-01-22"
RANGE = (SITE, START, END)
FUNNEL = "page:/p/1,event:signup,event:purchase"
FUNNEL_SECONDS = parse_interval("2 days")
SEQUENCE = "page:/p/1,event:signup,page:/p/2"
PAGE = "/p/3"
TODAY = date(2024, 1, 31)
KEEP_DAYS = 14
SALT_SECRET, SALT_DAYS = "example-secret", [date(2024, 1, 15), date(2024, 1, 16)]
#: Of the stored sites: a character that Spark escapes in a folder's name.
PORT = ":8080"
#: A day's salt as the engine would make it for this secret.
SALT = identity.daily_salt("example-secret", date(2024, 1, 15))
CONFIG = EngineConfig(allowed_sites=("site-0.example", "site-1.example"))

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _dealt(df: DataFrame) -> DataFrame:
    """A table in fewer partitions than there are cores, dealt out to all; large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _store(e: DataFrame) -> EventStore:
    """The events in a store of their own, under sites with a port."""
    store = EventStore(e.sparkSession, _folder(e.sparkSession, "store"))
    store.append(e.withColumn("site_id", F.concat("site_id", F.lit(PORT))))
    return store


def _census(e: DataFrame) -> DataFrame:
    return metrics.partition_census(e).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")


def query(oracle: str | None = None, source=_events):
    """Register a function of the source's DataFrame under its name."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(source(spark, sf_dir))
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# metrics


@query(sql.UNIQUE_VISITORS)
def unique_visitors(e):
    return metrics.unique_visitors(e, *RANGE)


@query(sql.TOTAL_PAGEVIEWS)
def total_pageviews(e):
    return metrics.total_pageviews(e, *RANGE)


@query(sql.PAGES_PER_VISIT)
def pages_per_visit(e):
    return rounded(metrics.pages_per_visit(e, *RANGE), "pages_per_visit")


@query(sql.CORE_METRICS)
def core_metrics(e):
    return rounded(metrics.core_metrics(e, *RANGE, tie="event_id"), "bounce_rate", "avg_visit_duration_secs", "pages_per_visit")


@query(sql.BOUNCE_RATE)
def bounce_rate(e):
    return rounded(metrics.bounce_rate(e, *RANGE, tie="event_id"), "bounce_rate")


@query(sql.SESSIONS)
def sessions(e):
    return rounded(metrics.session_metrics(e, *RANGE, tie="event_id"), "avg_session_duration_secs", "avg_pages_per_session")


@query(sql.SESSION_ROWS)
def session_rows(e):
    rows = behavior.session_rows(metrics.in_range(e, *RANGE), tie="event_id")
    return rounded(rows.select("visitor_id", F.col("session").cast("long").alias("session"), "started", "ended", "n_events", "pageviews", "seconds"), "seconds")


@query(sql.SESSION_ROWS)
def session_rows_by_range(e):
    """The same where a visitor's events may lie in many tasks."""
    rows = behavior.session_rows(metrics.in_range(e, *RANGE), tie="event_id", by_range=True)
    return rounded(rows.select("visitor_id", F.col("session").cast("long").alias("session"), "started", "ended", "n_events", "pageviews", "seconds"), "seconds")


@query(sql.SESSION_WINDOWS)
def session_window_sessions(e):
    return streaming.live_sessions(metrics.in_range(e, *RANGE))


@query(sql.timeseries("day"))
def timeseries_day(e):
    return metrics.timeseries(e, *RANGE, by="day")


@query(sql.timeseries("hour"))
def timeseries_hour(e):
    return metrics.timeseries(e, *RANGE, by="hour")


for _name in metrics.DIMENSIONS:
    QUERIES[f"breakdown_{_name}"] = lambda spark, sf_dir, d=_name: metrics.breakdown(_events(spark, sf_dir), d, *RANGE, limit=5)
    ORACLE_SQL[f"breakdown_{_name}"] = sql.breakdown(metrics.DIMENSIONS[_name], 5)


@query(sql.ROLLUP, _raw)
def rollup_breakdowns(e):
    """A stream keeps daily sketches; breakdowns of a range come from them alone: exact pageviews, visitors within the bound."""
    spark, path = e.sparkSession, _folder(e.sparkSession, "rollup")
    for k in range(2):
        e.where(f"event_id % 2 = {k}").coalesce(1).write.mode("append").parquet(f"{path}/in")
    table = rollups.table(spark, f"{path}/daily")
    arriving = web_events(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"))
    streaming.start_rollup(arriving, table, f"{path}/checkpoint", CONFIG, once=True).awaitTermination()
    found = rollups.breakdown(table.read(), *RANGE)
    exact = metrics.in_range(web_events(e), *RANGE)
    dims = [F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(c), F.lit(metrics.UNKNOWN)).alias("value")) for d, c in metrics.DIMENSIONS.items()]
    counts = exact.select("visitor_id", F.explode(F.array(*dims)).alias("x")).groupBy("x.dimension", "x.value").agg(F.countDistinct("visitor_id").alias("exact"))
    close = F.abs(F.col("visitors") - F.col("exact")) <= F.greatest(F.lit(1.0), rollups.ERROR * F.col("exact"))
    return found.where(F.col("dimension") != "all").join(counts, ["dimension", "value"], "full").select("dimension", "value", "n_events", "pageviews", close.alias("close"))


@query(sql.breakdown(metrics.DIMENSIONS["browsers"], 10))
def breakdown_default_limit(e):
    """As many rows as a query gives that names no limit."""
    return metrics.breakdown(e, "browsers", *RANGE, limit=check_limit(None))


# behaviour


@query(sql.FUNNEL)
def funnel(e):
    return metrics.funnel(e, parse_steps(FUNNEL), FUNNEL_SECONDS, *RANGE, tie="event_id")


@query(sql.FUNNEL_CUMULATIVE)
def funnel_cumulative(e):
    return metrics.funnel_cumulative(e, parse_steps(FUNNEL), FUNNEL_SECONDS, *RANGE, tie="event_id")


@query(sql.SEQUENCE)
def sequence_match(e):
    return rounded(metrics.sequence_match(e, parse_steps(SEQUENCE, 2), *RANGE, tie="event_id"), "conversion_rate")


@query(sql.FUNNEL)
def funnel_by_range(e):
    """The same where a visitor's events may lie in many tasks."""
    return metrics.funnel(e, parse_steps(FUNNEL), FUNNEL_SECONDS, *RANGE, tie="event_id", by_range=True)


@query(sql.SEQUENCE)
def sequence_by_range(e):
    return rounded(metrics.sequence_match(e, parse_steps(SEQUENCE, 2), *RANGE, tie="event_id", by_range=True), "conversion_rate")


@query(sql.FLOW)
def flow_next_page(e):
    return metrics.flow(e, PAGE, *RANGE, tie="event_id")


@query(sql.RETENTION)
def retention(e):
    kept = metrics.retention(e, SITE, "2024-01-01", "2024-01-29", 4)
    return kept.select("cohort_week", F.posexplode("retained").alias("week", "retained"))


@query(sql.RETENTION_COUNTS)
def retention_counts(e):
    return metrics.retention_counts(e, SITE, "2024-01-01", "2024-01-29", 4)


# export, storage, lifecycle


@query(sql.EXPORT)
def export_daily(e):
    return metrics.export_daily(e, *RANGE)


@query(sql.EXPORT_CSV)
def export_csv_escaped(e):
    return csv_lines(metrics.export_daily(e, *RANGE))


@query(sql.EXPORT_JSON)
def export_json(e):
    return json_rows(metrics.timeseries(e, *RANGE, by="day"))


@query(sql.CENSUS)
def partition_census(e):
    return _census(e)


@query(sql.UNION)
def events_all_union(e):
    """Three pushes into the hot tier, of which the second makes it flush, and both tiers as one."""
    store = EventStore(e.sparkSession, _folder(e.sparkSession, "store"))
    first, second = e.where("event_id % 3 = 0"), e.where("event_id % 3 = 1")
    hot = HotTier(store, EngineConfig(flush_event_count=first.count() + 1, flush_interval_secs=86_400))
    for part in (first, second, e.where("event_id % 3 = 2")):
        hot.push(part)
    both = hot.view().withColumn("tier", F.lit("all")).unionByName(hot.read().withColumn("tier", F.lit("hot")))
    return both.groupBy("tier", "site_id", "event_name").agg(F.count("*").alias("n"), F.countDistinct("visitor_id").alias("visitors"))


@query(sql.SCAN)
def store_scan(e):
    """One site's range of stored events, through the partitions of both; the period's dates are worked out."""
    start, end = resolve_period("7d", today=date(2024, 1, 20))
    found = _store(e).scan(SITE + PORT, start, end)
    return found.groupBy(F.date_format("date", "yyyy-MM-dd").alias("date"), "event_name").agg(F.count("*").alias("n"))


@query(sql.UNSAFE)
def path_guard(e):
    """Events whose site can't name a folder are given back, the others stored."""
    odd = F.when(F.col("event_id") % 10 == 0, "a/../b").when(F.col("event_id") % 10 == 1, "").when(F.col("event_id") % 10 == 2, F.repeat(F.lit("é"), 129)).when(F.col("event_id") % 10 == 3, "a\\b")
    store = EventStore(e.sparkSession, _folder(e.sparkSession, "store"))
    back = store.append(e.withColumn("site_id", F.coalesce(odd, "site_id")))
    each = store.read().select("site_id", F.lit(True).alias("stored")).unionByName(back.select("site_id", F.lit(False).alias("stored")))
    return each.groupBy("site_id", "stored").agg(F.count("*").alias("n"))


@query(sql.CLEANUP)
def retention_cleanup(e):
    store = _store(e)
    lifecycle.cleanup(store, KEEP_DAYS, TODAY)
    return _census(store.read())


@query(sql.ERASE)
def erase_range(e):
    store = _store(e)
    lifecycle.erase(store, SITE + PORT, "2024-01-10", "2024-01-12")
    return _census(store.read())


@query(sql.CENSUS)
def migrated_table(e):
    """A store brought to the latest version, and its table for SQL users."""
    store = EventStore(e.sparkSession, _folder(e.sparkSession, "store"))
    store.migrate()
    store.append(e)
    e.sparkSession.sql("DROP TABLE IF EXISTS sitepulse_example")  # an earlier run's, whose files stay
    store.create_table("sitepulse_example")
    return e.sparkSession.sql("SELECT site_id, date_format(date, 'yyyy-MM-dd') AS date, count(*) AS n FROM sitepulse_example GROUP BY ALL ORDER BY ALL")


@query(sql.ERASE)
def erase_hot(e):
    """Half of the events are stored, half only pushed; one erasure reaches both, and what is left is flushed."""
    store = _store(e.where("event_id % 2 = 0"))
    hot = HotTier(store, EngineConfig(flush_event_count=1 << 40, flush_interval_secs=86_400))
    for k in (1, 3):
        hot.push(e.where(f"event_id % 4 = {k}").withColumn("site_id", F.concat("site_id", F.lit(PORT))))
    lifecycle.erase(store, SITE + PORT, "2024-01-10", "2024-01-12", hot)
    hot.flush()
    return _census(store.read())


class _Died(Exception):
    pass


def _dying(*_):
    raise _Died


@query(sql.CENSUS)
def flush_once(e):
    """Flushes whose driver dies after their commit, and before it: each event is stored once."""
    path, config = _folder(e.sparkSession, "store"), EngineConfig(flush_event_count=1 << 40, flush_interval_secs=86_400)
    for k, step in enumerate(("publish", "commit", None)):
        hot = HotTier(EventStore(e.sparkSession, path), config)  # as a driver that starts anew finds it
        hot.push(e.where(f"event_id % 3 = {k}"))
        if step:
            setattr(hot.store.log, step, _dying)
        try:
            hot.flush()
        except _Died:
            continue
    return _census(EventStore(e.sparkSession, path).read())


@query(sql.COMPACTED)
def compact_partition(e):
    """A partition of several files, before and after: the rows are the same, in one file."""
    store = _store(e.where("event_id % 2 = 0"))
    store.append(e.where("event_id % 2 = 1").withColumn("site_id", F.concat("site_id", F.lit(PORT))))
    lifecycle.compact(store, SITE + PORT, "2024-01-10")
    day = store.read().where((F.col("site_id") == SITE + PORT) & (F.col("date") == F.lit("2024-01-10").cast("date"))).withColumn("file", F.input_file_name())
    return day.agg(F.count("*").alias("n"), F.countDistinct("visitor_id").alias("visitors"), F.countDistinct("file").alias("files"))


# functions over URLs


@query(sql.PATHNAME, _pages)
def url_pathname(p):
    return p.select("page_id", url.pathname(F.col("url")).alias("pathname"))


@query(sql.UTM, _pages)
def url_utm(p):
    return p.select("page_id", *(url.utm(F.col("url"), name).alias(name) for name in url.UTM))


@query(sql.REFERRER, _pages)
def referrer_source(p):
    r = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("https://www.google.com/q?"), "url")).when(F.col("page_id") % 5 == 1, F.lit("https://t.co:443/x")).when(F.col("page_id") % 5 == 2, F.lit("")).otherwise(F.col("url"))
    return p.select("page_id", url.referrer_source(r).alias("source"))


@query(sql.STRIP, _pages)
def strip_url(p):
    return p.select("page_id", url.strip_query(F.col("url")).alias("url"), url.origin_of(F.col("url")).alias("origin"))


@query(sql.CLIENT_IP, _pages)
def client_ip(p):
    forwarded = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" 10.0.0."), F.col("page_id") % 250, F.lit(", 5.6.7.8")))
    real = F.when(F.col("page_id") % 3 == 1, F.lit("9.9.9.9"))
    ip = url.client_ip(forwarded, real)
    return p.select("page_id", ip.alias("ip"), text.anonymize_ip(ip).alias("anonymous"))


def _agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with a user agent of the corpus, in turn."""
    corpus = F.broadcast(spark.createDataFrame(list(enumerate(sql.AGENTS)), "i int, ua string"))  # a fixed few
    return _dealt(_raw(spark, sf_dir)).join(corpus, F.col("event_id") % len(sql.AGENTS) == F.col("i")).drop("i")


@query(sql.UA_PARSE, _agents)
def ua_parse(a):
    return a.select("event_id", useragent.user_agent(F.col("ua")).alias("x")).select("event_id", "x.browser", "x.browser_version", "x.os", "x.os_version")


@query(sql.IS_BOT, _agents)
def is_bot(a):
    return a.select("event_id", useragent.is_bot(F.col("ua")).alias("is_bot"))


@query(sql.DEVICE, _raw)
def device_class(e):
    width = F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise((F.col("event_id") * 37 % 2000).cast("int"))
    return e.select("event_id", useragent.device(width).alias("device_type"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


@query(sql.SANITIZE, _texts)
def sanitize_string(d):
    return d.select("doc_id", F.md5(text.sanitize_string(F.col("text"), 256).cast("binary")).alias("h"))


@query(sql.CSV_FIELD, _pages)
def csv_escape(p):
    field = F.concat(F.get(F.array(*map(F.lit, ("=", "+", "-", "@", '"', ""))), (F.col("page_id") % 6).cast("int")), F.col("url"), F.lit('"x'))
    return p.select("page_id", text.csv_field(field).alias("field"))


@query(sql.ROUND_HOUR, _raw)
def round_to_hour(e):
    return e.select("event_id", text.round_to_hour(F.col("ts")).alias("hour"))


@query(sql.visitor_hmac(SALT), _raw)
def visitor_id_hmac(e):
    ip = F.concat(F.lit("10.0.0."), F.col("user_id") % 250)
    return e.select("event_id", identity.visitor_id(ip, F.concat(F.lit("agent/"), F.col("user_id") % 7), SALT).alias("visitor_id"))


@query(sql.SUPPRESSED, _raw)
def suppressed_visitor_id(e):
    """Random ids can't equal SQL's: how many there are, how many differ, and how many have the form of a UUID."""
    ids = e.select(identity.suppressed_id().alias("v"))
    shape = F.col("v").rlike("^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return ids.agg(F.count("*").alias("n"), F.countDistinct("v").alias("n_distinct"), F.count_if(shape).alias("n_shaped"))


@query(sql.KEY_HASH, _raw)
def api_key_hash(e):
    return e.select("event_id", text.hash_api_key(F.concat(F.lit("key-"), "user_id")).alias("h"))


@query(sql.daily_salts(SALT_DAYS, SALT_SECRET), _raw)
def daily_salt(e):
    """Visitor ids under each day's salt: they last a day."""
    day = F.to_date("ts")
    ids = [identity.visitor_id(F.lit("10.0.0.1"), F.concat(F.lit("agent/"), F.col("user_id") % 7), identity.daily_salt(SALT_SECRET, d)) for d in SALT_DAYS]
    found = e.where(day.isin(SALT_DAYS)).select("user_id", day.alias("d"), F.coalesce(*(F.when(day == F.lit(d), v) for d, v in zip(SALT_DAYS, ids))).alias("visitor_id"))
    return found.groupBy(F.date_format("d", "yyyy-MM-dd").alias("date"), "visitor_id").agg(F.count("*").alias("n"))


@query(sql.GEO, _raw)
def geo_range_lookup(e):
    spark = e.sparkSession
    ranges = spark.createDataFrame(sql.RANGES, "ip_start long, ip_end long, country_code string, region string, city string")
    ip = F.concat_ws(".", F.lit("81"), F.col("user_id") % 4, F.col("event_id") % 256, F.lit("7"))
    return geo.locate(e.select("event_id", F.when(F.col("event_id") % 9 == 0, F.lit("192.168.1.1")).otherwise(ip).alias("ip")), ranges, "ip")


def _addresses(n):
    six = F.concat(F.lit("2001:db8:"), F.lower(F.hex(n % 4)), F.lit("::"), F.lower(F.hex(n % 7)))
    wide = F.concat(F.lit("2A0"), n % 3, F.lit(":0:0:0:0:0:0:"), F.lower(F.hex(n % 500)))
    return F.when(n % 5 == 0, six).when(n % 5 == 1, wide).when(n % 5 == 2, F.lit("fe80::1")).when(n % 5 == 3, F.concat(F.lit("::ffff:81.2."), n % 256, F.lit(".9"))).otherwise(F.lit("not an address"))


@query(sql.GEO6, _raw)
def geo_network_lookup(e):
    """IPv6 and IPv4 addresses in the networks of an address database that was exported as CSV."""
    spark, path = e.sparkSession, _folder(e.sparkSession, "places")
    spark.createDataFrame(sql.NETWORKS, "network string, country_code string, region string, city string").coalesce(1).write.option("header", True).csv(path)
    return geo.locate(e.select("event_id", _addresses(F.col("event_id")).alias("ip")), geo.read_ranges(spark, path), "ip")


@query(sql.GEO6, _raw)
def geo_database_lookup(e):
    """The same places from the binary file."""
    spark, folder = e.sparkSession, _folder(e.sparkSession, "places")
    Files(spark, folder).put("places.mmdb", database([(n, c, r or None, t or None) for n, c, r, t in sql.NETWORKS]))
    return geo.locate(e.select("event_id", _addresses(F.col("event_id")).alias("ip")), mmdb.read_database(spark, f"{folder}/places.mmdb"), "ip")


@query(sql.PATHNAME, _pages)
def sql_pathname(p):
    """The same by the function that SQL users call."""
    sql_functions.register(p.sparkSession)
    return p.select("page_id", F.expr("sp_url_pathname(url)").alias("pathname"))


@query(sql.UTM, _pages)
def sql_utm(p):
    sql_functions.register(p.sparkSession)
    return p.select("page_id", *(F.expr(f"sp_url_{name}(url)").alias(name) for name in url.UTM))


@query(sql.UA_PARSE, _agents)
def sql_agents(a):
    sql_functions.register(a.sparkSession)
    return a.select("event_id", *(F.expr(f"sp_ua_{name}(ua)").alias(name) for name in ("browser", "browser_version", "os", "os_version")))


# ingestion


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made of the events: some that fail each check."""
    e = _agents(spark, sf_dir)
    n = F.col("event_id")
    return e.select(
        "event_id",
        F.when(n % 13 == 0, "bad site").when(n % 13 == 1, "").otherwise(F.concat(F.lit("site-"), n % 3, F.lit(".example"))).alias("d"),
        F.when(F.col("event_type") == "view", "pageview").otherwise(F.col("event_type")).alias("n"),
        F.concat(F.lit("https://h.example/p/"), n % 10, F.lit("?utm_source=s"), n % 4, F.lit("&utm_medium=&x=1#f")).alias("u"),
        F.when(n % 4 == 0, "https://www.bing.com/search?q=1").when(n % 17 == 0, F.repeat(F.lit("r"), 2049)).alias("r"),
        F.when(n % 5 != 0, (n * 37 % 2000).cast("int")).alias("w"),
        F.col("props").alias("p"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("ra"),
        F.when(F.col("event_type") == "purchase", F.lit("EURO")).alias("rc"),
        F.when(n % 7 == 0, "https://evil.example").when(n % 7 == 1, "https://site-1.example:8080").when(n % 7 == 2, "http://site-0.example").alias("origin"),
        F.col("ua").alias("user_agent"),
        F.concat(F.lit("10.0.0."), F.col("user_id") % 250).alias("x_forwarded_for"),
        F.lit(None).cast("string").alias("x_real_ip"),
        F.col("ts").alias("received"),
    )


@query(sql.INGEST_VALIDATE, _requests)
def ingest_validate(r):
    return r.select("event_id", reject_reason(CONFIG).alias("reject_reason"))


@query(sql.ORIGIN, _requests)
def origin_allowed(r):
    return r.select("event_id", url.origin_allowed(F.col("origin"), CONFIG.allowed_sites).alias("allowed"))


@query(sql.SITE_VALID, _requests)
def site_id_is_valid(r):
    return r.select("event_id", site_id_valid(F.col("d")).alias("valid"))


KEPT = "site_id visitor_id timestamp event_name pathname referrer_source utm_source utm_medium browser os device_type screen_size revenue_amount revenue_currency".split()


@query(sql.enrich(SALT), _requests)
def enrich_pipeline(r):
    taken = r.where(reject_reason(CONFIG).isNull())
    return enrich(taken, CONFIG, SALT).groupBy(*KEPT).agg(F.count("*").alias("n"))


@query(sql.enrich_private(SALT), _requests)
def enrich_private(r):
    """The same under the privacy bundle."""
    private = replace(CONFIG, gdpr_mode=True).resolved()
    found = enrich(r.where(reject_reason(private).isNull()), private, SALT)
    return found.groupBy("site_id", "visitor_id", "timestamp", "referrer", "browser", "browser_version", "os", "os_version", "device_type", "screen_size").agg(F.count("*").alias("n"))


@query(sql.PRECISION, _requests)
def place_precision(r):
    """Enriched events know the country alone, though the ranges have regions and cities."""
    ranges = r.sparkSession.createDataFrame(sql.RANGES, "ip_start long, ip_end long, country_code string, region string, city string")
    n = F.col("event_id")
    ip = F.concat_ws(".", F.lit("81"), n % 4, n % 256, F.lit("7"))
    found = enrich(r.withColumn("x_forwarded_for", ip), replace(CONFIG, geoip_precision="country"), SALT, ranges)
    return found.groupBy("country_code", "region", "city").agg(F.count("*").alias("n"))


@query(sql.PIXEL, _raw)
def pixel_requests(e):
    n = F.col("event_id")
    text_of = F.concat(F.lit("d=site-"), n % 3, F.lit(".example"), F.when(n % 2 == 0, F.lit("&n=sign%20up")).otherwise(""), F.lit("&u=https%3A%2F%2Fh.example%2Fp%2F"), n % 10, F.lit("&w="), F.when(n % 4 == 0, F.lit("x")).otherwise((n % 2000).cast("string")))
    return parse_pixel(e.select("event_id", text_of.alias("query"))).select("event_id", "d", "n", "u", "w")


@query(sql.RATE_LIMIT)
def rate_limit(e):
    return ratelimit.limit(e.select("site_id", "timestamp", "event_id"), 1, tie="event_id").select("event_id", "allowed")


def _written_requests(r: DataFrame, path: str, pixels: bool = False) -> None:
    """Requests as JSON files; with ``pixels`` every other one has a query string in place of a body."""
    body = F.to_json(F.struct("d", "n", "u", "r", "w", "p", "ra", "rc"))
    pairs = F.concat_ws("&", *(F.concat(F.lit(f"{c}="), F.url_encode(F.col(c).cast("string"))) for c in "dnurw"))
    odd = F.lit(pixels) & (F.col("event_id") % 2 == 1)
    row = [F.when(~odd, body).alias("body"), F.when(odd, pairs).alias("query"), *(F.col(c) for c in ("origin", "user_agent", "x_forwarded_for", "x_real_ip"))]
    r.select(*row, F.lpad(F.col("event_id").cast("string"), 20, "0").alias("request_id"), "received").write.mode("append").json(path)


def _streamed(requests: DataFrame, config: EngineConfig, salt, parts: int = 1, pixels: bool = False) -> tuple[EventStore, DataFrame]:
    """Requests through a stream, to the end: stored events and refused requests.  In parts: the stream is started anew for each."""
    spark, path = requests.sparkSession, _folder(requests.sparkSession, "requests")
    store, refused = EventStore(spark, f"{path}-events"), streaming.refused_table(spark, f"{path}-refused")
    for k in range(parts):
        _written_requests(requests.where(F.col("event_id") % parts == k) if parts > 1 else requests, path, pixels)
        streaming.start_all(streaming.json_source(spark, path), store, refused, f"{path}-checkpoint", config, salt, once=True).awaitTermination()
    return store, refused.read()


@query(sql.COUNTERS, _requests)
def stream_counters(r):
    """What the streams of a session count, in the text form for a scraper, read back."""
    spark, counters = r.sparkSession, Counters()
    spark.streams.addListener(counters)
    try:
        _streamed(r, CONFIG, SALT)
        expected, until = r.count(), time.monotonic() + 30
        while sum(v for k, v in counters.totals.items() if k.startswith(("events_", "requests_"))) < expected and time.monotonic() < until:
            time.sleep(0.1)  # the listener hears of a batch a little later
    finally:
        spark.streams.removeListener(counters)
    path = _folder(spark, "metrics")
    write_text(spark, counters.text(), path)
    lines = spark.read.text(path).where("value NOT LIKE '#%'")
    return lines.select(F.substring_index("value", " ", 1).alias("name"), F.substring_index("value", " ", -1).cast("long").alias("n")).where("n > 0")


@query(sql.enrich(SALT), _requests)
def stream_enrich(r):
    """Requests as JSON files, streamed into stored events."""
    return _streamed(r, CONFIG, SALT)[0].read().groupBy(*KEPT).agg(F.count("*").alias("n"))


@query(sql.REFUSED, _requests)
def stream_refused(r):
    """The requests that the same stream refuses, by reason."""
    return _streamed(r, CONFIG, SALT)[1].groupBy("reject_reason", "site_id").agg(F.count("*").alias("n"))


@query(sql.both_kinds(SALT), _requests)
def stream_both_kinds(r):
    """Bodies and query strings in one stream, which is stopped and started again."""
    return _streamed(r, CONFIG, SALT, parts=2, pixels=True)[0].read().groupBy(*KEPT).agg(F.count("*").alias("n"))


@query(sql.salts_by_day(SALT_SECRET), _requests)
def stream_daily_salt(r):
    """A stream over many days: each request's visitor id is made under its own day's salt."""
    stored = _streamed(r, CONFIG, identity.KeySchedule(SALT_SECRET))[0].read()
    return stored.groupBy(F.date_format("date", "yyyy-MM-dd").alias("date"), "visitor_id").agg(F.count("*").alias("n"))


@query(sql.RATE_REFUSED, _requests)
def stream_rate_limit(r):
    """A token a second for each site, between the checks of form and of bots, where many requests come at one time."""
    limited = replace(CONFIG, rate_limit_per_site=1)
    return _streamed(r.withColumn("received", F.date_trunc("hour", "received").cast("timestamp_ntz")), limited, SALT)[1].groupBy("reject_reason", "site_id").agg(F.count("*").alias("n"))


@query(sql.RATE_REFUSED, _requests)
def ingest_rate_limit(r):
    """The same in a batch."""
    path = _folder(r.sparkSession, "requests")
    _written_requests(r.withColumn("received", F.date_trunc("hour", "received").cast("timestamp_ntz")), path)
    found = streaming.judged(r.sparkSession.read.schema(REQUEST).json(path), replace(CONFIG, rate_limit_per_site=1))
    return found.where("reject_reason IS NOT NULL").groupBy("reject_reason", F.col("d").alias("site_id")).agg(F.count("*").alias("n"))


@query(sql.CENSUS, _raw)
def stream_census(e):
    """Finished events through a stream that writes a table by site and date, and the table's census."""
    spark, path = e.sparkSession, _folder(e.sparkSession, "stream")
    e.write.parquet(f"{path}/in")
    store = EventStore(spark, f"{path}/events")
    streaming.start(web_events(spark.readStream.schema(e.schema).parquet(f"{path}/in")), store, f"{path}/checkpoint", CONFIG, once=True).awaitTermination()
    return _census(store.read())


@query(sql.UNION, _raw)
def stream_flush_by_count(e):
    """A stream of three batches into the hot tier, of which the second makes it flush."""
    spark, path = e.sparkSession, _folder(e.sparkSession, "stream")
    for k in range(3):
        e.where(f"event_id % 3 = {k}").coalesce(1).write.mode("append").parquet(f"{path}/in")
    hot = HotTier(EventStore(spark, f"{path}/events"), EngineConfig(flush_event_count=e.where("event_id % 3 = 0").count() + 1, flush_interval_secs=86_400))
    arriving = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    streaming.start(web_events(arriving), hot, f"{path}/checkpoint", CONFIG, once=True).awaitTermination()
    both = hot.view().withColumn("tier", F.lit("all")).unionByName(hot.read().withColumn("tier", F.lit("hot")))
    return both.groupBy("tier", "site_id", "event_name").agg(F.count("*").alias("n"), F.countDistinct("visitor_id").alias("visitors"))


@query(sql.VISITOR_SERIES)
def live_visitors(e):
    return streaming.live_visitors(e, "1 day")


@query(sql.VISITOR_SERIES, _raw)
def stream_visitors(e):
    """The same in a stream; one event long after the others, of another site, lets all their windows end."""
    spark, path = e.sparkSession, _folder(e.sparkSession, "stream")
    e.write.parquet(f"{path}/in")
    last = e.orderBy("ts").limit(1).withColumns({"ts": F.lit("2100-01-01").cast(e.schema["ts"].dataType), "user_id": F.lit(-1).cast(e.schema["user_id"].dataType)})
    last.write.mode("append").parquet(f"{path}/in")
    arriving = web_events(spark.readStream.schema(e.schema).parquet(f"{path}/in"))
    running = streaming.live_visitors(arriving, "1 day").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
    running.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").where("bucket < TIMESTAMP_NTZ '2100-01-01 00:00:00'")
