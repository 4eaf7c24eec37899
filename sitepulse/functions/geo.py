"""Address ranges to places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitepulse.functions.text import let

#: A table of ranges of up to this many rows is sent to all; beyond, it's dealt out by prefix, and Spark splits a skewed one.
BROADCAST_ROWS = 1_000_000
#: What an IPv4 address has before its 8 hex digits as an IPv6 one.
V4 = "00000000000000000000ffff"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
QUAD = rf"{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}"


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    parts = F.split(ip, r"\.")
    number = sum((F.get(parts, F.lit(i)).try_cast("long") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0))
    return F.when(ip.rlike(f"^{QUAD}$"), number)


def _hex(number: Column, digits: int) -> Column:
    return F.lower(F.lpad(F.hex(number), digits, "0"))


def _expanded(text: Column) -> Column:
    """An IPv6 address without a quad as 32 hex digits; null for anything else."""
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")

    def joined(halves):
        left, right = groups(F.get(halves, F.lit(0))), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
        missing = 8 - F.size(left) - F.size(right)
        whole = F.when(F.size(halves) == 2, F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)).otherwise(left)
        fits = F.when(F.size(halves) == 2, missing > 0).otherwise(missing == 0)
        return F.when(fits, F.lower(F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), "")))

    part = "(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?"
    return F.when(text.rlike(f"^{part}(?:::{part})?$"), let(F.split(text, "::"), joined))


def ip_key(ip: Column) -> Column:
    """An IPv4 or IPv6 address as 32 hex digits, in the order of addresses; null for anything else."""

    def six(address):
        tail = _hex(ip_number(F.substring_index(address, ":", -1)), 8)
        pairs = F.concat(F.regexp_replace(address, r"[^:]*$", ""), F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4))
        return let(F.coalesce(pairs, address), _expanded)  # pairs are null where the last group is no quad

    return F.when(ip.rlike(f"^{QUAD}$"), F.concat(F.lit(V4), _hex(ip_number(ip), 8))).when(F.contains(ip, F.lit(":")), let(ip, six))


#: Keys of private, loopback and link-local addresses.
PRIVATE = rf"^(?:0{{31}}1|fe[89ab]|f[cd]|{V4}(?:0a|7f|ac1|c0a8|a9fe))"


def _edge(name: str, dtypes: dict[str, str]) -> Column:
    """The key of a range's end, which is a number (IPv4) or text."""
    return ip_key(F.col(name)) if dtypes[name] == "string" else F.concat(F.lit(V4), _hex(F.col(name).cast("long"), 8))


def network_range(network: Column) -> Column:
    """First and last key of a network such as 81.2.0.0/16 or 2001:db8::/32, as an array; null for anything else."""
    given = F.when(F.contains(network, F.lit("/")), F.substring_index(network, "/", -1).try_cast("int"))

    def of(x):
        key, bits = x["key"], x["bits"]
        whole, rest = F.floor(bits / 4).cast("int"), bits % 4
        low = F.lit(16) - F.pow(F.lit(2), 4 - rest).cast("int")  # the network's bits of a digit
        digit = F.conv(F.substring(key, whole + 1, F.lit(1)), 16, 10).cast("int")

        def edge(of_digit: Column, fill: str) -> Column:
            return F.rpad(F.concat(F.substring(key, F.lit(1), whole), F.when(rest > 0, F.lower(F.hex(of_digit))).otherwise("")), 32, fill)

        return F.when(key.isNotNull() & bits.between(0, 128), F.array(edge(digit.bitwiseAND(low), "0"), edge(digit.bitwiseOR(F.lit(15) - low), "f")))

    quad = F.contains(network, F.lit(".")) & ~F.contains(network, F.lit(":"))
    bits = F.coalesce(given + F.when(quad, 96).otherwise(0), F.when(~F.contains(network, F.lit("/")), F.lit(128)))
    return let(F.struct(ip_key(F.substring_index(network, "/", 1)).alias("key"), bits.alias("bits")), of)


def read_ranges(spark: SparkSession, path: str, format: str = "csv") -> DataFrame | None:
    """The ranges of an address database that was exported as a table, for ``locate``; None if there's no such path.

    Columns: country_code, region, city, and either network or ip_start and ip_end (text or numbers).
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    reader = spark.read.option("header", True) if format == "csv" else spark.read
    table = reader.format(format).load(path)
    if "network" in table.columns:
        both = table.withColumn("__both", network_range(F.col("network")))
        table = both.withColumns({"ip_start": F.get("__both", F.lit(0)), "ip_end": F.get("__both", F.lit(1))})
    else:
        kinds = dict(table.dtypes)
        number = lambda c: F.when(F.col(c).rlike(r"^\d+$"), F.concat(F.lit(V4), _hex(F.col(c).try_cast("long"), 8))).otherwise(ip_key(F.col(c)))
        table = table.withColumns({c: number(c) if kinds[c] == "string" else _edge(c, kinds) for c in ("ip_start", "ip_end")})
    empty = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")).alias(c)
    keys = [F.col(c).alias(c) for c in ("ip_start", "ip_end")]
    return table.where("ip_start <= ip_end").select(*keys, *map(empty, ("country_code", "region", "city")))


def locate(events: DataFrame, ranges: DataFrame, ip_col: str = "ip", precision: str = "city") -> DataFrame:
    """``events`` with country_code, region and city of the range that holds the address; null for none.

    ``ranges``: ip_start, ip_end (inclusive, not overlapping; numbers for IPv4, addresses or keys
    as text), country_code, region, city.  Both sides meet on the first 16 bits of an IPv4
    address, ranges in each prefix they touch; on the first 32 of an IPv6 one, and wider IPv6
    ranges, of which there are few, on the first 16.
    """
    kinds = dict(ranges.dtypes)
    as_key = lambda c: let(F.col(c), lambda x: F.when(x.rlike("^[0-9a-f]{32}$"), x).otherwise(ip_key(x))) if kinds[c] == "string" else _edge(c, kinds)
    keyed = ranges.select(as_key("ip_start").alias("__start"), as_key("ip_end").alias("__end"), F.struct("country_code", "region", "city").alias("__place"))
    v4 = F.col("__start").startswith(V4)
    four = keyed.where(v4).select(F.explode(F.sequence(*(F.conv(F.substring(c, 25, 4), 16, 10).cast("int") for c in ("__start", "__end")))).alias("n"), "*")
    same = F.substring("__start", 1, 8) == F.substring("__end", 1, 8)
    narrow = four.select(F.concat(F.lit(V4), _hex(F.col("n"), 4)).alias("__meet"), "__start", "__end", "__place").union(
        keyed.where(~v4 & same).select(F.substring("__start", 1, 8).alias("__meet"), "__start", "__end", "__place")
    )
    wide = keyed.where(~v4 & ~same).select(F.explode(F.sequence(*(F.conv(F.substring(c, 1, 4), 16, 10).cast("int") for c in ("__start", "__end")))).alias("n"), "*")
    wide = wide.select(_hex(F.col("n"), 4).alias("__meet"), "__start", "__end", "__place")
    key = ip_key(F.col(ip_col))
    found = events.withColumn("__key", let(key, lambda k: F.when(~k.rlike(PRIVATE), k)))
    prefix = F.when(F.col("__key").startswith(V4), F.substring("__key", 1, 28)).otherwise(F.substring("__key", 1, 8))
    places = []
    for name, side, meet in (("__narrow", narrow, prefix), ("__wide", wide, F.substring("__key", 1, 4))):
        rows = side.limit(BROADCAST_ROWS + 1).count()
        if not rows:
            continue
        side = side.select(F.col("__meet").alias(f"{name}_meet"), F.col("__start").alias(f"{name}_start"), F.col("__end").alias(f"{name}_end"), F.col("__place").alias(name))
        if rows <= BROADCAST_ROWS:
            side = F.broadcast(side)
        on = (meet == F.col(f"{name}_meet")) & F.col("__key").between(F.col(f"{name}_start"), F.col(f"{name}_end"))
        found = found.join(side, on, "left")
        places.append(F.col(name))
    level = ("none", "country", "region", "city").index(precision)
    none = F.lit(None).cast("string")
    shown = {"country_code": 1, "region": 2, "city": 3}
    own = [c for c in events.columns if c not in shown]
    place = F.coalesce(*places) if places else None
    return found.select(*own, *((place[c] if places and level >= at else none).alias(c) for c, at in shown.items()))
