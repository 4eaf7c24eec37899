"""The registered queries in SQL for DuckDB."""

from __future__ import annotations

import hmac
from datetime import date, timedelta

from sitepulse.functions.identity import BLOCK
from sitepulse.schema import web_events_sql

AGENTS = (
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.6099.130 Safari/537.36",
    "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.2 Safari/605.1.15",
    "Mozilla/5.0 (Windows NT 10.0) AppleWebKit/537.36 Chrome/120.0.0.0 Safari/537.36 Edg/120.0.2210.91",
    "Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537.36 Chrome/120.0.6099.144 Mobile Safari/537.36",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_2_1 like Mac OS X) AppleWebKit/605.1.15 Version/17.2 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (compatible; Googlebot/2.1)",
    "curl/8.4.0",
    "SomeRandom/1.0",
    "",
    "Mozilla/5.0 (Linux; Android 13) SamsungBrowser/23.0 Chrome/115.0.0.0 Mobile Safari/537.36",
    "Mozilla/5.0 (X11; CrOS x86_64) Chrome/119.0 Safari/537.36 Vivaldi/6.5",
    "Mozilla/5.0 (iPad; CPU OS 17_2 like Mac OS X) Version/17.2 Safari/604.1",
    "Opera/9.80 (Windows NT 6.1) Brave",
)
#: (first, last, country, region, city) of addresses in 81.0.0.0/14.
RANGES = [(81 << 24, (81 << 24) + (1 << 16) - 1, "DE", "Bavaria", "Munich"), ((81 << 24) + (1 << 16), (81 << 24) + (1 << 16) + 32767, "FR", "Normandy", None), ((81 << 24) + (2 << 16) + 100 * 256, (81 << 24) + (3 << 16) + 99, "US", None, None)]

_WEB = f"web AS ({web_events_sql()})"
_IN = "site_id = 'site-1.example' AND \"timestamp\" >= TIMESTAMP '2024-01-08' AND \"timestamp\" < TIMESTAMP '2024-01-22'"
_E = f"WITH {_WEB}, e AS (SELECT * FROM web WHERE {_IN})"
_PV = "CAST(count(*) FILTER (WHERE event_name = 'pageview') AS BIGINT)"

UNIQUE_VISITORS = f"{_E} SELECT count(DISTINCT visitor_id) AS unique_visitors FROM e"
TOTAL_PAGEVIEWS = f"{_E} SELECT {_PV} AS total_pageviews FROM e"
PAGES_PER_VISIT = f"{_E} SELECT round(coalesce({_PV}::DOUBLE / nullif(count(DISTINCT visitor_id), 0), 0), 6) AS pages_per_visit FROM e"

_S = (
    _E
    + """, g AS (SELECT *, CASE WHEN epoch_us("timestamp") - epoch_us(lag("timestamp") OVER (PARTITION BY visitor_id ORDER BY "timestamp")) > 1800000000 THEN 1 ELSE 0 END AS fresh FROM e),
n AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY visitor_id ORDER BY "timestamp" ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g),
s AS (SELECT visitor_id, session, min("timestamp") AS started, max("timestamp") AS ended, count(*) AS n_events,
  CAST(count(*) FILTER (WHERE event_name = 'pageview') AS BIGINT) AS pageviews, (epoch_us(max("timestamp")) - epoch_us(min("timestamp")))::DOUBLE / 1000000 AS seconds FROM n GROUP BY visitor_id, session)"""
)
SESSION_ROWS = _S + " SELECT visitor_id, session, started, ended, n_events, pageviews, round(seconds, 6) AS seconds FROM s"
SESSION_WINDOWS = _S + " SELECT 'site-1.example' AS site_id, visitor_id, started, ended, n_events, pageviews FROM s"
SESSIONS = _S + " SELECT count(*) AS total_sessions, round(coalesce(avg(seconds), 0), 6) AS avg_session_duration_secs, round(coalesce(avg(pageviews::DOUBLE), 0), 6) AS avg_pages_per_session FROM s"
BOUNCE_RATE = _S + " SELECT round(coalesce((count(*) FILTER (WHERE pageviews = 1))::DOUBLE / nullif(count(*), 0), 0), 6) AS bounce_rate FROM s"
CORE_METRICS = (
    _S
    + f""" SELECT (SELECT count(DISTINCT visitor_id) FROM e) AS unique_visitors, (SELECT {_PV} FROM e) AS total_pageviews,
round(coalesce((count(*) FILTER (WHERE pageviews = 1))::DOUBLE / nullif(count(*), 0), 0), 6) AS bounce_rate, round(coalesce(avg(seconds), 0), 6) AS avg_visit_duration_secs,
round(coalesce((SELECT {_PV}::DOUBLE / nullif(count(DISTINCT visitor_id), 0) FROM e), 0), 6) AS pages_per_visit FROM s"""
)


def timeseries(by: str) -> str:
    label = {"day": "%Y-%m-%d", "hour": "%Y-%m-%d %H:00"}[by]
    return f"{_E} SELECT strftime(date_trunc('{by}', \"timestamp\"), '{label}') AS bucket, count(DISTINCT visitor_id) AS visitors, {_PV} AS pageviews FROM e GROUP BY 1 ORDER BY 1"


def breakdown(column: str, limit: int) -> str:
    return f"{_E} SELECT coalesce({column}, '(unknown)') AS value, count(DISTINCT visitor_id) AS visitors, {_PV} AS pageviews FROM e GROUP BY 1 ORDER BY visitors DESC, value LIMIT {limit}"


# Chains from each start: the earliest next step after it, and so on; the deepest within the window.
_FUNNEL = (
    _E
    + """, a AS (SELECT visitor_id, "timestamp" AS t1 FROM e WHERE pathname = '/p/1'),
b AS (SELECT a.visitor_id, a.t1, min(x."timestamp") AS t2 FROM a LEFT JOIN e x ON x.visitor_id = a.visitor_id AND x.event_name = 'signup' AND x."timestamp" > a.t1 GROUP BY 1, 2),
c AS (SELECT b.visitor_id, b.t1, b.t2, min(x."timestamp") AS t3 FROM b LEFT JOIN e x ON x.visitor_id = b.visitor_id AND x.event_name = 'purchase' AND x."timestamp" > b.t2 GROUP BY 1, 2, 3),
d AS (SELECT visitor_id, max(CASE WHEN t3 - t1 <= INTERVAL 2 DAY THEN 3 WHEN t2 - t1 <= INTERVAL 2 DAY THEN 2 ELSE 1 END) AS step FROM c GROUP BY 1),
v AS (SELECT DISTINCT visitor_id FROM e), f AS (SELECT v.visitor_id, CAST(coalesce(step, 0) AS INT) AS step FROM v LEFT JOIN d USING (visitor_id))"""
)
FUNNEL = _FUNNEL + " SELECT step, count(*) AS visitors FROM f GROUP BY step ORDER BY step"
FUNNEL_CUMULATIVE = _FUNNEL + " SELECT CAST(k AS INT) AS step, (SELECT count(*) FROM f WHERE f.step >= k) AS visitors FROM (VALUES (1), (2), (3)) AS t(k)"
SEQUENCE = (
    _E
    + """, a AS (SELECT visitor_id, min("timestamp") AS t FROM e WHERE pathname = '/p/1' GROUP BY 1),
b AS (SELECT e.visitor_id, min(e."timestamp") AS t FROM e JOIN a ON a.visitor_id = e.visitor_id AND e."timestamp" > a.t WHERE event_name = 'signup' GROUP BY 1),
c AS (SELECT e.visitor_id FROM e JOIN b ON b.visitor_id = e.visitor_id AND e."timestamp" > b.t WHERE pathname = '/p/2' GROUP BY 1)
SELECT (SELECT count(*) FROM c) AS converting_visitors, count(DISTINCT visitor_id) AS total_visitors, round(coalesce((SELECT count(*) FROM c)::DOUBLE / nullif(count(DISTINCT visitor_id), 0), 0), 6) AS conversion_rate FROM e"""
)
FLOW = (
    _E
    + """, l AS (SELECT visitor_id, pathname, lead(pathname) OVER w AS next_page, row_number() OVER w AS r FROM e WINDOW w AS (PARTITION BY visitor_id ORDER BY "timestamp")),
f AS (SELECT visitor_id, arg_min(coalesce(next_page, ''), r) AS next_page FROM l WHERE pathname = '/p/3' GROUP BY 1)
SELECT next_page, count(*) AS visitors FROM f WHERE next_page <> '' GROUP BY 1 ORDER BY visitors DESC, next_page LIMIT 10"""
)
_RETAIN = f"""WITH {_WEB}, s AS (SELECT * FROM web WHERE site_id = 'site-1.example'), f AS (SELECT visitor_id, date_trunc('week', min("timestamp")) AS cohort FROM s GROUP BY 1),
r AS (SELECT visitor_id, cohort, date_trunc('week', "timestamp") AS wk FROM s JOIN f USING (visitor_id) WHERE "timestamp" >= TIMESTAMP '2024-01-01' AND "timestamp" < TIMESTAMP '2024-01-29'),
k AS (SELECT unnest(range(0, 4)) AS week)"""
RETENTION = (
    _RETAIN
    + """ SELECT strftime(cohort, '%Y-%m-%d') AS cohort_week, CAST(week AS INT) AS week, bool_or(wk = cohort) AND bool_or(wk = cohort + to_days(CAST(7 * week AS INT))) AS retained FROM r, k GROUP BY cohort, week ORDER BY 1, 2"""
)
RETENTION_COUNTS = (
    _RETAIN
    + """ SELECT strftime(cohort, '%Y-%m-%d') AS cohort_week, CAST(week AS INT) AS week, count(DISTINCT visitor_id) FILTER (WHERE wk = cohort + to_days(CAST(7 * week AS INT))) AS visitors FROM r, k GROUP BY cohort, week ORDER BY 1, 2"""
)
_EXPORT = (
    _E
    + f""", d AS (SELECT strftime("timestamp", '%Y-%m-%d') AS date, count(DISTINCT visitor_id) AS visitors, {_PV} AS pageviews FROM e GROUP BY 1),
p AS (SELECT pathname AS top_page FROM e GROUP BY 1 ORDER BY count(DISTINCT visitor_id) DESC, 1 LIMIT 1),
q AS (SELECT coalesce(referrer_source, '(unknown)') AS top_source FROM e GROUP BY 1 ORDER BY count(DISTINCT visitor_id) DESC, 1 LIMIT 1)"""
)
EXPORT = _EXPORT + " SELECT d.*, top_page, top_source FROM d, p, q ORDER BY date"
EXPORT_CSV = _EXPORT + """ SELECT '"' || date || '",' || visitors || ',' || pageviews || ',"' || top_page || '","' || top_source || '"' AS line FROM d, p, q"""


EXPORT_JSON = f"{_E}, d AS (SELECT strftime(\"timestamp\", '%Y-%m-%d') AS bucket, count(DISTINCT visitor_id) AS visitors, {_PV} AS pageviews FROM e GROUP BY 1) SELECT '{{\"bucket\":\"' || bucket || '\",\"visitors\":' || visitors || ',\"pageviews\":' || pageviews || '}}' AS json FROM d"


def _census(where: str = "true", port: str = "") -> str:
    return f"WITH {_WEB} SELECT site_id || '{port}' AS site_id, strftime(\"timestamp\", '%Y-%m-%d') AS date, count(*) AS n FROM web WHERE {where} GROUP BY 1, 2 ORDER BY 1, 2"


CENSUS = _census()
CLEANUP = _census("CAST(\"timestamp\" AS DATE) >= DATE '2024-01-17'", ":8080")
ERASE = _census("NOT (site_id = 'site-1.example' AND CAST(\"timestamp\" AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12')", ":8080")
UNION = f"""WITH {_WEB}, t AS (SELECT 'all' AS tier, * FROM web UNION ALL SELECT 'hot', * FROM web WHERE event_id % 3 = 2)
SELECT tier, site_id, event_name, count(*) AS n, count(DISTINCT visitor_id) AS visitors FROM t GROUP BY 1, 2, 3"""
SCAN = f"WITH {_WEB} SELECT strftime(\"timestamp\", '%Y-%m-%d') AS date, event_name, count(*) AS n FROM web WHERE site_id = 'site-1.example' AND \"timestamp\" >= TIMESTAMP '2024-01-13' AND \"timestamp\" < TIMESTAMP '2024-01-21' GROUP BY 1, 2"
UNSAFE = f"WITH {_WEB} SELECT CASE event_id % 10 WHEN 0 THEN 'a/../b' WHEN 1 THEN '' WHEN 2 THEN repeat('é', 129) WHEN 3 THEN 'a\\b' ELSE site_id END AS site_id, event_id % 10 > 3 AS stored, count(*) AS n FROM web GROUP BY 1, 2"
COMPACTED = f"WITH {_WEB} SELECT count(*) AS n, count(DISTINCT visitor_id) AS visitors, CAST(1 AS BIGINT) AS files FROM web WHERE site_id = 'site-1.example' AND CAST(\"timestamp\" AS DATE) = DATE '2024-01-10'"

_BARE = "regexp_replace(url, '^https?://', '')"
PATHNAME = f"SELECT page_id, '/' || regexp_extract(substr({_BARE}, CASE WHEN strpos({_BARE}, '/') = 0 THEN length({_BARE}) + 1 ELSE strpos({_BARE}, '/') + 1 END), '^[^?#]*') AS pathname FROM pages"


def _utm(name: str) -> str:
    query = "substr(url, CASE WHEN strpos(url, '?') = 0 THEN length(url) + 1 ELSE strpos(url, '?') + 1 END)"
    mine = f"list_filter(string_split({query}, '&'), lambda p: starts_with(p, '{name}=') AND length(p) > {len(name) + 1})"
    return f"substr({mine}[-1], {len(name) + 2}) AS {name}"


UTM = f"SELECT page_id, {', '.join(_utm(n) for n in ('utm_source', 'utm_medium', 'utm_campaign', 'utm_content', 'utm_term'))} FROM pages"
_HOST = "regexp_extract(regexp_replace(r, '^https?://', ''), '^[^/:]*')"
REFERRER = f"""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://www.google.com/q?' || url WHEN 1 THEN 'https://t.co:443/x' WHEN 2 THEN '' ELSE url END AS r FROM pages),
h AS (SELECT page_id, {_HOST} AS host FROM p)
SELECT page_id, CASE WHEN host = '' THEN NULL WHEN contains(host, 'google') THEN 'Google' WHEN contains(host, 'bing') THEN 'Bing' WHEN contains(host, 'yahoo') THEN 'Yahoo'
WHEN contains(host, 'duckduckgo') THEN 'DuckDuckGo' WHEN contains(host, 'twitter') OR host = 't.co' THEN 'Twitter' WHEN contains(host, 'facebook') OR contains(host, 'fb.com') THEN 'Facebook'
WHEN contains(host, 'linkedin') THEN 'LinkedIn' WHEN contains(host, 'reddit') THEN 'Reddit' WHEN contains(host, 'github') THEN 'GitHub' ELSE host END AS source FROM h"""
STRIP = "SELECT page_id, regexp_extract(url, '^[^?#]*') AS url, nullif(regexp_extract(url, '^https?://[^/]*'), '') AS origin FROM pages"
CLIENT_IP = """WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '10.0.0.' || (page_id % 250) WHEN 1 THEN '9.9.9.9' ELSE 'unknown' END AS ip FROM pages)
SELECT page_id, ip, CASE page_id % 3 WHEN 0 THEN '10.0.0.x' WHEN 1 THEN '9.9.9.x' ELSE '?.?.?.x' END AS anonymous FROM p"""

_VALUES = ", ".join(f"({i}, '{ua}')" for i, ua in enumerate(AGENTS))
_UA = f"WITH u AS (SELECT * FROM (VALUES {_VALUES}) AS t(i, ua)), a AS (SELECT event_id, ua FROM events JOIN u ON event_id % {len(AGENTS)} = i)"


def _after(prefix: str, signs: str) -> str:
    return f"nullif(regexp_extract(ua, '{prefix}([{signs}]*)', 1), '')"


_BROWSER = """CASE WHEN contains(ua, 'Edg/') OR contains(ua, 'Edge/') THEN 'Edge' WHEN contains(ua, 'OPR/') OR contains(ua, 'Opera') THEN 'Opera' WHEN contains(ua, 'Vivaldi/') THEN 'Vivaldi'
WHEN contains(ua, 'Brave') THEN 'Brave' WHEN contains(ua, 'SamsungBrowser/') THEN 'Samsung Internet' WHEN contains(ua, 'UCBrowser/') OR contains(ua, 'UCWEB/') THEN 'UC Browser'
WHEN contains(ua, 'Chrome/') AND NOT contains(ua, 'Chromium/') THEN 'Chrome' WHEN contains(ua, 'Safari/') AND NOT contains(ua, 'Chrome/') THEN 'Safari' WHEN contains(ua, 'Firefox/') THEN 'Firefox' END"""
_OS = """CASE WHEN contains(ua, 'Windows') THEN 'Windows' WHEN contains(ua, 'iPhone') OR contains(ua, 'iPad') OR contains(ua, 'iOS') THEN 'iOS' WHEN contains(ua, 'Mac OS X') OR contains(ua, 'macOS') THEN 'macOS'
WHEN contains(ua, 'Android') THEN 'Android' WHEN contains(ua, 'Linux') THEN 'Linux' WHEN contains(ua, 'CrOS') THEN 'Chrome OS' END"""
_VERSION = f"coalesce({', '.join(_after(p, '0-9.') for p in ('Edg/', 'Edge/', 'OPR/', 'Vivaldi/', 'SamsungBrowser/', 'UCBrowser/', 'Chrome/', 'Firefox/', 'Version/'))})"
_OS_VERSION = f"""CASE WHEN contains(ua, 'Windows NT') THEN {_after('Windows NT ', '0-9._')} WHEN contains(ua, 'iPhone OS') THEN replace({_after('iPhone OS ', '0-9._')}, '_', '.')
WHEN contains(ua, 'Mac OS X') THEN replace({_after('Mac OS X ', '0-9._')}, '_', '.') WHEN contains(ua, 'Android') THEN {_after('Android ', '0-9._')} END"""
UA_PARSE = f"{_UA} SELECT event_id, {_BROWSER} AS browser, {_VERSION} AS browser_version, {_OS} AS os, {_OS_VERSION} AS os_version FROM a"
_BOT = "(regexp_matches(lower(ua), 'bot|crawler|spider|slurp|fetch|headless|phantom|lighthouse|pingdom|wget|whatsapp|sogou') OR regexp_matches(lower(ua), '^(curl|libwww|lwp-|scrapy)'))"
IS_BOT = f"{_UA} SELECT event_id, {_BOT} AS is_bot FROM a"
DEVICE = "WITH w AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN event_id * 37 % 2000 END AS w FROM events) SELECT event_id, CASE WHEN w < 768 THEN 'mobile' WHEN w < 1024 THEN 'tablet' WHEN w IS NOT NULL THEN 'desktop' END AS device_type FROM w"
SANITIZE = r"SELECT doc_id, md5(substr(regexp_replace(text, '\p{Cc}', '', 'g'), 1, 256)) AS h FROM documents"
CSV_FIELD = """WITH f AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' WHEN 4 THEN '"' ELSE '' END || url || '"x' AS f FROM pages)
SELECT page_id, '"' || CASE WHEN substr(f, 1, 1) IN ('=', '+', '-', '@') THEN '''' ELSE '' END || replace(f, '"', '""') || '"' AS field FROM f"""
ROUND_HOUR = "SELECT event_id, date_trunc('hour', ts) AS hour FROM events"


def _hmac(message: str, salt: str) -> str:
    key = salt.encode().ljust(BLOCK, b"\0")
    inner, outer = (bytes(b ^ pad for b in key).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


def visitor_hmac(salt: str) -> str:
    message = "'10.0.0.' || (user_id % 250) || '|agent/' || (user_id % 7)"
    return f"SELECT event_id, {_hmac(message, salt)} AS visitor_id FROM events"


SUPPRESSED = "SELECT count(*) AS n, count(*) AS n_distinct, count(*) AS n_shaped FROM events"
KEY_HASH = "SELECT event_id, sha256('key-' || user_id) AS h FROM events"


def daily_salts(days: list, secret: str) -> str:
    """The salt is an HMAC of secret and day under a fixed key, the id one under the salt."""
    salts = {d: hmac.new(b"sitepulse-visitor-salt", f"{secret}:{d}".encode(), "sha256").hexdigest() for d in days}
    message = "'10.0.0.1|agent/' || (user_id % 7)"
    each = " ".join(f"WHEN DATE '{d}' THEN {_hmac(message, salt)}" for d, salt in salts.items())
    return f"SELECT strftime(ts, '%Y-%m-%d') AS date, CASE CAST(ts AS DATE) {each} END AS visitor_id, count(*) AS n FROM events WHERE CAST(ts AS DATE) IN ({', '.join(f"DATE '{d}'" for d in days)}) GROUP BY 1, 2"


#: (network, country, region, city); the second is wider than 32 bits.
NETWORKS = [("2001:db8:1::/48", "DE", "Bavaria", "Munich"), ("2a00::/15", "NL", "", ""), ("2001:db8:8::/46", "SE", "", ""), ("81.2.0.0/17", "GB", "England", "London")]
GEO6 = """WITH i AS (SELECT event_id, event_id % 5 AS k, CASE event_id % 5 WHEN 0 THEN '2001:db8:' || (event_id % 4) || '::' || (event_id % 7)
  WHEN 1 THEN '2A0' || (event_id % 3) || ':0:0:0:0:0:0:' || printf('%x', event_id % 500) WHEN 2 THEN 'fe80::1' WHEN 3 THEN '::ffff:81.2.' || (event_id % 256) || '.9' ELSE 'not an address' END AS ip FROM events),
c AS (SELECT event_id, ip, CASE WHEN k = 0 AND event_id % 4 = 1 THEN 'DE' WHEN k = 1 AND event_id % 3 < 2 THEN 'NL' WHEN k = 3 AND event_id % 256 < 128 THEN 'GB' END AS country_code FROM i)
SELECT event_id, ip, country_code, CASE country_code WHEN 'DE' THEN 'Bavaria' WHEN 'GB' THEN 'England' END AS region, CASE country_code WHEN 'DE' THEN 'Munich' WHEN 'GB' THEN 'London' END AS city FROM c"""

_RANGE_ROWS = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in RANGES)
GEO = f"""WITH g AS (SELECT * FROM (VALUES {_RANGE_ROWS}) AS t(a, b, country_code, region, city)),
i AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '192.168.1.1' ELSE '81.' || (user_id % 4) || '.' || (event_id % 256) || '.7' END AS ip,
  CASE WHEN event_id % 9 <> 0 THEN 81 * 16777216 + (user_id % 4) * 65536 + (event_id % 256) * 256 + 7 END AS n FROM events)
SELECT event_id, ip, country_code, region, city FROM i LEFT JOIN g ON n BETWEEN a AND b"""

_REQUESTS = f"""WITH u AS (SELECT * FROM (VALUES {_VALUES}) AS t(i, ua)),
r AS (SELECT event_id, CASE event_id % 13 WHEN 0 THEN 'bad site' WHEN 1 THEN '' ELSE 'site-' || (event_id % 3) || '.example' END AS d,
  CASE WHEN event_type = 'view' THEN 'pageview' ELSE event_type END AS n, event_id % 10 AS page, event_id % 4 AS src,
  CASE WHEN event_id % 4 = 0 THEN 31 WHEN event_id % 17 = 0 THEN 2049 ELSE 0 END AS r_len, CASE WHEN event_id % 5 <> 0 THEN event_id * 37 % 2000 END AS w,
  CASE WHEN event_type = 'purchase' THEN value END AS ra, CASE event_id % 7 WHEN 0 THEN 'https://evil.example' WHEN 1 THEN 'https://site-1.example:8080' WHEN 2 THEN 'http://site-0.example' END AS origin,
  ua, '10.0.0.' || (user_id % 250) AS ip, ts FROM events JOIN u ON event_id % {len(AGENTS)} = i),
j AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN 'origin' WHEN d = '' THEN 'empty' WHEN r_len > 2048 THEN 'too_long' WHEN contains(d, ' ') THEN 'site_id' WHEN {_BOT} THEN 'bot' END AS reject_reason FROM r)"""
INGEST_VALIDATE = _REQUESTS + " SELECT event_id, reject_reason FROM j"
ORIGIN = _REQUESTS + " SELECT event_id, event_id % 7 <> 0 AS allowed FROM j"
SITE_VALID = _REQUESTS + " SELECT event_id, d <> '' AND NOT contains(d, ' ') AS valid FROM j"


def enrich(salt: str) -> str:
    visitor = _hmac("ip || '|' || ua", salt)
    columns = f"""d AS site_id, {visitor} AS visitor_id, date_trunc('second', ts) AS "timestamp", n AS event_name, '/p/' || page AS pathname,
CASE WHEN r_len = 31 THEN 'Bing' END AS referrer_source, 's' || src AS utm_source, CAST(NULL AS VARCHAR) AS utm_medium, {_BROWSER} AS browser, {_OS} AS os,
CASE WHEN w < 768 THEN 'mobile' WHEN w < 1024 THEN 'tablet' WHEN w IS NOT NULL THEN 'desktop' END AS device_type, CAST(w AS VARCHAR) AS screen_size,
CAST(ra AS DECIMAL(12, 2)) AS revenue_amount, CASE WHEN ra IS NOT NULL THEN 'EUR' END AS revenue_currency"""
    return f"{_REQUESTS}, x AS (SELECT {columns} FROM j WHERE reject_reason IS NULL) SELECT *, count(*) AS n FROM x GROUP BY ALL"


def enrich_private(salt: str) -> str:
    """Times by the hour, no versions, widths and queries of referrers; systems and browsers stay."""
    columns = f"""d AS site_id, {_hmac("ip || '|' || ua", salt)} AS visitor_id, date_trunc('hour', ts) AS "timestamp", CASE WHEN r_len = 31 THEN 'https://www.bing.com/search' END AS referrer,
{_BROWSER} AS browser, CAST(NULL AS VARCHAR) AS browser_version, {_OS} AS os, CAST(NULL AS VARCHAR) AS os_version, CAST(NULL AS VARCHAR) AS device_type, CAST(NULL AS VARCHAR) AS screen_size"""
    return f"{_REQUESTS}, x AS (SELECT {columns} FROM j WHERE reject_reason IS NULL) SELECT *, count(*) AS n FROM x GROUP BY ALL"


def both_kinds(salt: str) -> str:
    """``enrich``'s rows, where requests of odd numbers are pixels, which say nothing of revenue."""
    return enrich(salt).replace("WHEN event_type = 'purchase' THEN value END AS ra", "WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN value END AS ra")


def salts_by_day(secret: str, first: str = "2024-01-01", days: int = 400) -> str:
    """Events by day and the visitor's id under that day's salt."""
    rows = []
    for k in range(days):
        day = date.fromisoformat(first) + timedelta(k)
        key = hmac.new(b"sitepulse-visitor-salt", f"{secret}:{day}".encode(), "sha256").hexdigest().encode().ljust(BLOCK, b"\0")
        inner, outer = (bytes(b ^ pad for b in key).hex() for pad in (0x36, 0x5C))
        rows.append(f"(DATE '{day}', '{inner}', '{outer}')")
    return f"""{_REQUESTS}, s AS (SELECT * FROM (VALUES {", ".join(rows)}) AS t(day, inner_key, outer_key))
SELECT strftime(ts, '%Y-%m-%d') AS date, sha256(unhex(outer_key) || unhex(sha256(unhex(inner_key) || encode(ip || '|' || ua)))) AS visitor_id, count(*) AS n
FROM j JOIN s ON CAST(ts AS DATE) = day WHERE reject_reason IS NULL GROUP BY 1, 2"""


REFUSED = _REQUESTS + " SELECT reject_reason, d AS site_id, count(*) AS n FROM j WHERE reject_reason IS NOT NULL GROUP BY 1, 2"
PIXEL = """SELECT event_id, 'site-' || (event_id % 3) || '.example' AS d, CASE WHEN event_id % 2 = 0 THEN 'sign up' ELSE 'pageview' END AS n, 'https://h.example/p/' || (event_id % 10) AS u,
CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 2000 AS INT) END AS w FROM events"""
#: A site's requests one after the other: what was left, filled up at one token a second, up to one.
RATE_LIMIT = f"""WITH RECURSIVE {_WEB}, o AS (SELECT site_id, event_id, epoch_us("timestamp") / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY site_id ORDER BY "timestamp", event_id) AS r FROM web),
f AS (SELECT site_id, event_id, r, t, CAST(0 AS DOUBLE) AS tokens, TRUE AS allowed FROM o WHERE r = 1
  UNION ALL SELECT site_id, event_id, r, t, CASE WHEN filled >= 1 THEN filled - 1 ELSE filled END, filled >= 1
  FROM (SELECT o.*, least(CAST(1 AS DOUBLE), f.tokens + (o.t - f.t)) AS filled FROM f JOIN o ON o.site_id = f.site_id AND o.r = f.r + 1))
SELECT event_id, allowed FROM f"""
#: Requests of good form, one after the other in each site, take a token; bots are refused after that.
RATE_REFUSED = _REQUESTS.replace("WITH u AS", "WITH RECURSIVE u AS", 1).replace(", ts FROM events", ", date_trunc('hour', ts) AS ts FROM events") + f""",
k AS (SELECT *, CASE WHEN reject_reason = 'bot' THEN NULL ELSE reject_reason END AS form, reject_reason = 'bot' AS bot FROM j),
o AS (SELECT event_id, d, epoch_us(ts) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY d ORDER BY ts, event_id) AS r FROM k WHERE form IS NULL),
f AS (SELECT d, event_id, r, t, CAST(0 AS DOUBLE) AS tokens, TRUE AS allowed FROM o WHERE r = 1
  UNION ALL SELECT d, event_id, r, t, CASE WHEN filled >= 1 THEN filled - 1 ELSE filled END, filled >= 1
  FROM (SELECT o.*, least(CAST(1 AS DOUBLE), f.tokens + (o.t - f.t)) AS filled FROM f JOIN o ON o.d = f.d AND o.r = f.r + 1)),
z AS (SELECT k.d AS site_id, CASE WHEN form IS NOT NULL THEN form WHEN NOT allowed THEN 'rate' WHEN bot THEN 'bot' END AS reject_reason FROM k LEFT JOIN f USING (event_id))
SELECT reject_reason, site_id, count(*) AS n FROM z WHERE reject_reason IS NOT NULL GROUP BY 1, 2"""
VISITOR_SERIES = f"""WITH {_WEB} SELECT site_id, date_trunc('day', "timestamp") AS bucket, count(*) AS n_events, {_PV} AS pageviews, count(DISTINCT visitor_id) AS visitors FROM web GROUP BY 1, 2"""
ROLLUP = f"""{_E}, x AS (SELECT *, unnest([{", ".join(f"{{'dimension': '{d}', 'value': coalesce({c}, '(unknown)')}}" for d, c in (("pages", "pathname"), ("sources", "referrer_source"), ("countries", "country_code"), ("browsers", "browser"), ("os", "os"), ("devices", "device_type")))}]) AS k FROM e)
SELECT k.dimension AS dimension, k.value AS value, count(*) AS n_events, {_PV} AS pageviews, TRUE AS close FROM x GROUP BY 1, 2"""
COUNTERS = _REQUESTS + """ SELECT 'sitepulse_events_ingested_total' AS name, count(*) AS n FROM j WHERE reject_reason IS NULL
UNION ALL SELECT 'sitepulse_requests_refused_total{reason="' || reject_reason || '"}', count(*) FROM j WHERE reject_reason IS NOT NULL GROUP BY reject_reason"""
PRECISION = f"""WITH g AS (SELECT * FROM (VALUES {_RANGE_ROWS}) AS t(a, b, country_code, region, city)),
i AS (SELECT 81 * 16777216 + (event_id % 4) * 65536 + (event_id % 256) * 256 + 7 AS n FROM events)
SELECT country_code, CAST(NULL AS VARCHAR) AS region, CAST(NULL AS VARCHAR) AS city, count(*) AS n FROM i LEFT JOIN g ON i.n BETWEEN a AND b GROUP BY 1"""
