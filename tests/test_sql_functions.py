"""The SQL forms give what the column functions give."""

from pyspark.sql import functions as F

from sitepulse.functions import identity, sql, text, url, useragent
from sitepulse.params import site_id_valid
from sitepulse.plans.sql import AGENTS

URLS = ["https://h.example/a/b?utm_source=x&utm_source=&utm_medium=m&utm_term=t%20u#f", "http://h?x=/y", "about", "", "https://www.google.com/q", "t.co/1", "https://fb.com:8/x", None, "=1+2", "-\"x\"", "a\x00b\x07", "10.0.0.1, 5.6.7.8", "a.b-c_d:1"]


def test_sql_forms(spark):
    names = sql.register(spark)
    assert len(names) == len(sql.FUNCTIONS)
    rows = [(u, ua, w, "2024-03-15 14:37:22") for u, ua, w in zip(URLS + [None], AGENTS, [375, 768, 1023, 1024, None] * 3)]
    df = spark.createDataFrame(rows, "u string, ua string, w int, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    u, ua, salt = F.col("u"), F.col("ua"), "5" * 40 + "é"
    forms = {
        "sanitize_string(u, 4)": text.sanitize_string(u, 4),
        "url_pathname(u)": url.pathname(u),
        **{f"url_{name}(u)": url.utm(u, name) for name in url.UTM},
        "referrer_source(u)": url.referrer_source(u),
        "strip_query(u)": url.strip_query(u),
        "origin_of(u)": url.origin_of(u),
        "client_ip(u, ua)": url.client_ip(u, ua),
        "is_bot(ua)": useragent.is_bot(ua),
        "ua_browser(ua)": useragent.browser(ua),
        "ua_browser_version(ua)": useragent.browser_version(ua),
        "ua_os(ua)": useragent.system(ua),
        "ua_os_version(ua)": useragent.system_version(ua),
        "device_type(w)": useragent.device(F.col("w")),
        f"visitor_id(u, ua, '{salt}')": identity.visitor_id(u, ua, salt),
        "round_to_hour(t)": text.round_to_hour(F.col("t")),
        "csv_field(u)": text.csv_field(u),
        "site_id_valid(u)": site_id_valid(u),
        "hash_api_key(u)": text.hash_api_key(u),
    }
    assert {f.partition("(")[0] for f in forms} == set(sql.FUNCTIONS)
    found = df.select(*(F.expr(f"sp_{f}").alias(f"s{i}") for i, f in enumerate(forms)), *(c.alias(f"c{i}") for i, c in enumerate(forms.values())))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sp_" not in plan
    for row in found.collect():
        for i, f in enumerate(forms):
            assert row[f"s{i}"] == row[f"c{i}"], f
