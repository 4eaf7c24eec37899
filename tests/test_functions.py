import hashlib
import hmac
from datetime import date, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitepulse.functions import geo, identity, text, url, useragent
from sitepulse.params import ParameterError, check_limit, check_site_id, check_weeks, hourly, parse_interval, parse_steps, resolve_period
from sitepulse.plans.sql import AGENTS


def each(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


def test_pathname(spark):
    given_urls = ["https://example.com/about?ref=1#section", "https://example.com/", "https://example.com/blog/post/123", "about", "/about", "https://h?x=/y", "http://h/a\x00b", "https://h"]
    assert each(spark, url.pathname, given_urls) == ["/about", "/", "/blog/post/123", "/", "/about", "/y", "/ab", "/"]


def test_utm(spark):
    whole = "https://h/?utm_source=google&utm_medium=cpc&utm_campaign=winter&utm_content=banner&utm_term=analytics"
    assert tuple(each(spark, url.utm_struct, [whole])[0]) == ("google", "cpc", "winter", "banner", "analytics")
    source = lambda u: url.utm(u, "utm_source")
    assert each(spark, source, ["https://h/", "?utm_source=a&utm_source=b", "?utm_source=a&utm_source=", "?utm_source=a#f", "?utm_source=a=b", None]) == [None, "b", "a", "a#f", "a=b", None]


def test_referrer(spark):
    urls = ["https://www.google.com/search", "https://t.co/abc", "https://m.facebook.com/", "https://reddit.com", "https://github.com/x", "https://www.linkedin.com", "https://duckduckgo.com", "https://myblog.com/post", "", None, "https://host:8080/x"]
    assert each(spark, url.referrer_source, urls) == ["Google", "Twitter", "Facebook", "Reddit", "GitHub", "LinkedIn", "DuckDuckGo", "myblog.com", None, None, "host"]


def test_origin(spark):
    allowed = lambda o: url.origin_allowed(o, ("example.com",))
    assert each(spark, allowed, ["https://example.com", "https://example.com:8080", "https://example.com.evil.com", None]) == [True, True, False, True]
    assert each(spark, lambda o: url.origin_allowed(o, ()), ["https://x"]) == [True]
    assert each(spark, url.origin_of, ["https://a.b/c", "http://a", "ftp://a"]) == ["https://a.b", "http://a", None]
    assert each(spark, url.strip_query, ["/a?q=1", "/a#s", "/a?q#s", "/a"]) == ["/a"] * 4


def test_client_ip(spark):
    df = spark.createDataFrame([("1.2.3.4, 5.6.7.8", "9.9.9.9"), (None, "9.9.9.9"), (None, None)], "f string, r string")
    assert [r[0] for r in df.select(url.client_ip(F.col("f"), F.col("r"))).collect()] == ["1.2.3.4", "9.9.9.9", "unknown"]
    assert each(spark, text.anonymize_ip, ["1.2.3.4", "2001:db8::1", "x"]) == ["1.2.3.x", "2001:...", "?.?.?.x"]


def test_text(spark):
    assert each(spark, text.sanitize_string, ["a" * 500, "hello\x00world\x01test"]) == ["a" * 256, "helloworldtest"]
    assert each(spark, text.csv_field, ["/about", 'a"b', "=1", "+1", "-1", "@x", None]) == ['"/about"', '"a""b"', "\"'=1\"", "\"'+1\"", "\"'-1\"", "\"'@x\"", '""']
    assert each(spark, text.round_to_hour, [datetime(2024, 3, 15, 14, 37, 22)], "timestamp_ntz") == [datetime(2024, 3, 15, 14)]
    assert each(spark, text.hash_api_key, ["k"]) == [hashlib.sha256(b"k").hexdigest()]


def test_device(spark):
    assert each(spark, useragent.device, [375, 767, 768, 1023, 1024, 1920, None], "int") == ["mobile", "mobile", "tablet", "tablet", "desktop", "desktop", None]


def test_user_agents(spark):
    found = [tuple(x) for x in each(spark, useragent.user_agent, AGENTS)]
    assert found[0] == ("Chrome", "120.0.6099.130", "Windows", "10.0", False)
    assert found[1] == ("Firefox", "121.0", "Linux", None, False)
    assert found[2] == ("Safari", "17.2", "macOS", "10.15.7", False)
    assert found[3][:2] == ("Edge", "120.0.2210.91")
    assert found[4] == ("Chrome", "120.0.6099.144", "Android", "14", False)
    assert found[5][2:4] == ("iOS", "17.2.1")
    assert found[6][4] and found[7][4]
    assert found[8] == found[9] == (None, None, None, None, False)
    assert found[10][0] == "Samsung Internet" and found[11][0] == "Vivaldi"
    assert found[12][2] == "iOS" and found[13][0] == "Opera"
    bots = ["bingbot", "python-requests/2", "Slackbot", "facebookexternalhit/1.1", "CURL/8", "my-curl"]
    assert each(spark, useragent.is_bot, bots) == [True, True, True, True, True, False]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=40), st.text(max_size=80)), min_size=1, max_size=20), st.text(alphabet="0123456789abcdef", min_size=64, max_size=64))
def test_visitor_id_is_an_hmac(spark, pairs, salt):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, ip string, ua string")
    found = [r.x for r in df.select("i", identity.visitor_id(F.col("ip"), F.col("ua"), salt).alias("x")).orderBy("i").collect()]
    assert found == [hmac.new(salt.encode(), f"{a}|{b}".encode(), hashlib.sha256).hexdigest() for a, b in pairs]


def test_salt_rotates():
    a, b = identity.daily_salt("s", date(2024, 1, 1)), identity.daily_salt("s", date(2024, 1, 2))
    assert len(a) == 64 and a != b and a == identity.daily_salt("s", date(2024, 1, 1)) != identity.daily_salt("t", date(2024, 1, 1))


def test_geo(spark):
    ranges = spark.createDataFrame([(1 << 24, (1 << 24) + 70000, "DE", "BY", "M")], "ip_start long, ip_end long, country_code string, region string, city string")
    e = spark.createDataFrame([("1.0.0.5",), ("1.1.0.1",), ("1.2.0.0",), ("10.0.0.1",), ("x",), ("1.0.0.256",), (None,)], "ip string")
    found = [tuple(r) for r in geo.locate(e, ranges).collect()]
    assert found[:2] == [("1.0.0.5", "DE", "BY", "M"), ("1.1.0.1", "DE", "BY", "M")] and all(r[1] is None for r in found[2:])
    assert tuple(geo.locate(e.limit(1), ranges, precision="country").first())[1:] == ("DE", None, None)


def test_parameters():
    today = date(2024, 3, 10)
    assert resolve_period("day", today=today) == ("2024-03-10", "2024-03-11")
    assert resolve_period("7d", today=today) == ("2024-03-03", "2024-03-11")
    assert resolve_period("7d", "2024-01-01", "2024-02-01", today) == ("2024-01-01", "2024-02-01")
    assert resolve_period("today", "2024-01-01", None, today) == ("2024-03-10", "2024-03-11")
    assert hourly("day") and not hourly("7d")
    for bad in ({"period": "invalid"}, {"start": "2024-02-01", "end": "2024-01-01"}, {"start": "1990-01-01", "end": "2024-01-01"}, {"start": "x", "end": "2024-01-01"}):
        with pytest.raises(ParameterError):
            resolve_period(**bad)
    assert [parse_interval(x) for x in ("1 day", "2 hours", "30 minutes", "7 days", "1 week")] == [86400, 7200, 1800, 604800, 604800]
    for bad in ("1", "day", "0 days", "1 day; DROP TABLE", "999 days", ""):
        with pytest.raises(ParameterError):
            parse_interval(bad)
    for good in ("example.com", "my-site.co.uk", "localhost:8080", "my_analytics_site"):
        assert check_site_id(good) == good
    for bad in ("", "a" * 257, "a/b", "a b", "a\0"):
        with pytest.raises(ParameterError):
            check_site_id(bad)
    for check, bad in ((check_limit, 0), (check_limit, 1001), (check_weeks, 53)):
        with pytest.raises(ParameterError):
            check(bad)


def test_steps(spark):
    assert len(parse_steps(" page:/pricing ,event:signup,page:/it's")) == 3
    for bad in ("invalid", "sql:DROP TABLE", "page:", "", "page:" + "x" * 257):
        with pytest.raises(ParameterError):
            parse_steps(bad)


def test_addresses_of_both_kinds(spark):
    import ipaddress

    from sitepulse.functions import geo

    ips = "1.2.3.4 255.255.255.255 256.1.1.1 ::1 :: 2001:db8::1 2001:DB8:0:0:0:0:2:1 ::ffff:1.2.3.4 1:: 1:2:3:4:5:6:7:8 1:2:3:4:5:6:7 1:2:3:4:5:6:7:8:9 abc 1:2:3:4:5:6:7:: 1:2:3:4:5:6:7:8:: a:::b 1::2::3 g::1 12345::1 64:ff9b::8.8.8.8 1.2.3 :1:2:3:4:5:6:7 ::256.1.1.1".split()
    networks = "81.2.0.0/16 2001:db8::/32 2001:db8::/29 2a00::/12 1.2.3.4 ::/0 0.0.0.0/0 2001:db8::1/128 bad/3 1.2.3.0/33".split()
    key = lambda a: f"{int(a) if a.version == 6 else int(a) + (0xFFFF << 32):032x}"

    def want(make, text):
        try:
            return make(text)
        except ValueError:
            return None

    found = spark.createDataFrame([(x,) for x in ips], "x string").select("x", geo.ip_key(F.col("x")).alias("k")).collect()
    assert [(r.x, r.k) for r in found] == [(x, want(lambda t: key(ipaddress.ip_address(t)), x)) for x in ips]
    found = spark.createDataFrame([(x,) for x in networks], "x string").select("x", geo.network_range(F.col("x")).alias("k")).collect()
    assert [(r.x, r.k) for r in found] == [(x, want(lambda t: [key(ipaddress.ip_network(t)[0]), key(ipaddress.ip_network(t)[-1])], x)) for x in networks]


def test_place_of_missing_database(spark, tmp_path):
    from sitepulse.functions import geo

    assert geo.read_ranges(spark, str(tmp_path / "none")) is None
    none = spark.createDataFrame([], "ip_start string, ip_end string, country_code string, region string, city string")
    row = geo.locate(spark.createDataFrame([("2001:db8::1",)], "ip string"), none).first()
    assert row.ip == "2001:db8::1" and row.country_code is None
