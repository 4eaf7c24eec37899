"""The column functions for SQL users, as temporary functions whose bodies Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from sitepulse.functions.identity import BLOCK
from sitepulse.functions.url import SOURCES, UTM
from sitepulse.functions.useragent import BOT_STARTS, BOT_WORDS, BROWSERS, SYSTEMS, VERSIONS
from sitepulse.params import SITE_ID

_NO_SCHEME = "regexp_replace({0}, r'^(?:https://|http://)', '')"


def _has(words, of: str = "ua") -> str:
    return "(" + " OR ".join(f"contains({of}, '{w}')" for w in words) + ")"


def _case(named, more: str = "") -> str:
    return "CASE " + " ".join(f"WHEN {_has(words)} THEN '{name}'" for words, name in named) + f" {more} END"


def _after(prefix: str, signs: str) -> str:
    rest = f"substring(ua, locate('{prefix}', ua) + {len(prefix)})"
    return f"CASE WHEN contains(ua, '{prefix}') THEN nullif(left({rest}, length({rest}) - length(ltrim('{signs}', {rest}))), '') END"


def _clean(text: str, longest: int) -> str:
    return rf"substring(regexp_replace({text}, r'\p{{Cc}}', ''), 1, {longest})"


def _utm(name: str) -> str:
    value = f"regexp_extract(url, r'(?s)^[^?]*\\?(?:.*&)?{name}=([^&]+)', 1)"
    return f"CASE WHEN contains(url, '{name}=') AND {value} <> '' THEN {_clean(value, 256)} END"


def _hmac(message: str) -> str:
    """HMAC-SHA256 under a salt of up to 64 bytes, which may be a column: the key is padded, and XORed digit by digit through translate."""
    digits = "0123456789abcdef"
    key = f"rpad(lower(hex(salt)), {2 * BLOCK}, '0')"

    def pad(byte: int) -> str:  # both hex digits of 0x36 and 0x5c differ, so first digits and second digits are mapped apart
        high, low = ("".join(f"{d ^ nibble:x}" for d in range(16)) for nibble in (byte >> 4, byte & 15))
        pairs = f"transform(sequence(1, {2 * BLOCK}, 2), i -> concat(translate(substring({key}, i, 1), '{digits}', '{high}'), translate(substring({key}, i + 1, 1), '{digits}', '{low}')))"
        return f"unhex(array_join({pairs}, ''))"

    return f"sha2(concat({pad(0x5C)}, unhex(sha2(concat({pad(0x36)}, cast({message} AS BINARY)), 256))), 256)"


_SIGNS = "0123456789._"
#: Name to (parameters, type of the result, body).
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "sanitize_string": ("text STRING, longest INT", "STRING", r"substring(regexp_replace(text, r'\p{Cc}', ''), 1, longest)"),
    "url_pathname": ("url STRING", "STRING", _clean(f"concat('/', regexp_extract({_NO_SCHEME.format('url')}, r'(?s)/([^?#]*)', 1))", 2048)),
    **{f"url_{name}": ("url STRING", "STRING", _utm(name)) for name in UTM},
    "referrer_source": (
        "referrer STRING",
        "STRING",
        "CASE WHEN coalesce({0}, '') = '' THEN NULL ".format(host := f"regexp_extract({_NO_SCHEME.format('referrer')}, r'^([^/:]*)', 1)") + " ".join(f"WHEN {host} RLIKE r'{pattern}' THEN '{name}'" for pattern, name in SOURCES) + f" ELSE {host} END",
    ),
    "strip_query": ("url STRING", "STRING", "regexp_replace(url, r'(?s)[?#].*$', '')"),
    "origin_of": ("referrer STRING", "STRING", "nullif(regexp_extract(referrer, r'^(https?://[^/]*)', 1), '')"),
    "client_ip": ("forwarded_for STRING, real_ip STRING", "STRING", "coalesce(trim(substring_index(forwarded_for, ',', 1)), real_ip, 'unknown')"),
    "is_bot": ("ua STRING", "BOOLEAN", f"coalesce({_has(BOT_WORDS, 'lower(ua)')} OR {' OR '.join(f"startswith(lower(ua), '{w}')" for w in BOT_STARTS)}, false)"),
    "ua_browser": (
        "ua STRING",
        "STRING",
        _case(BROWSERS, f"WHEN {_has(['Chrome/'])} AND NOT {_has(['Chromium/'])} THEN 'Chrome' WHEN {_has(['Safari/'])} AND NOT {_has(['Chrome/'])} THEN 'Safari' WHEN {_has(['Firefox/'])} THEN 'Firefox'"),
    ),
    "ua_browser_version": ("ua STRING", "STRING", f"coalesce({', '.join(_after(p, '0123456789.') for p in VERSIONS)})"),
    "ua_os": ("ua STRING", "STRING", _case(SYSTEMS)),
    "ua_os_version": (
        "ua STRING",
        "STRING",
        f"CASE WHEN {_has(['Windows NT'])} THEN {_after('Windows NT ', _SIGNS)} WHEN {_has(['iPhone OS'])} THEN replace({_after('iPhone OS ', _SIGNS)}, '_', '.') "
        f"WHEN {_has(['Mac OS X'])} THEN replace({_after('Mac OS X ', _SIGNS)}, '_', '.') WHEN {_has(['Android'])} THEN {_after('Android ', _SIGNS)} END",
    ),
    "device_type": ("width INT", "STRING", "CASE WHEN width < 768 THEN 'mobile' WHEN width < 1024 THEN 'tablet' WHEN width IS NOT NULL THEN 'desktop' END"),
    "visitor_id": ("ip STRING, ua STRING, salt STRING", "STRING", _hmac("concat(ip, '|', coalesce(ua, ''))")),
    "round_to_hour": ("ts TIMESTAMP_NTZ", "TIMESTAMP_NTZ", "cast(date_trunc('hour', ts) AS TIMESTAMP_NTZ)"),
    "csv_field": ("text STRING", "STRING", """concat('"', CASE WHEN coalesce(text, '') RLIKE r'^[=+\\-@]' THEN "'" ELSE '' END, replace(coalesce(text, ''), '"', '""'), '"')"""),
    "site_id_valid": ("site STRING", "BOOLEAN", f"coalesce(site RLIKE r'{SITE_ID}', false)"),
    "hash_api_key": ("api_key STRING", "STRING", "sha2(api_key, 256)"),
}


def register(spark: SparkSession, prefix: str = "sp_") -> list[str]:
    """Make the functions callable in this session's SQL as ``sp_<name>``; their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {body}")
    return [prefix + name for name in FUNCTIONS]
