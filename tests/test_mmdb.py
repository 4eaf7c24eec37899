"""The binary address file against its networks."""

import ipaddress

import pytest

from sitepulse.functions import geo, mmdb
from sitepulse.plans import sql
from sitepulse.plans.places import database

NETWORKS = [
    ("81.2.0.0/17", "GB", "England", "London"),
    ("81.2.128.0/17", "GB", None, None),
    ("9.0.0.0/8", "US", None, None),
    ("10.1.2.3/32", "FR", "Région", "Été"),
    ("2001:db8:1::/48", "DE", "Bavaria", "M" * 300),
    ("2a00::/15", "NL", None, None),
    ("fe00::/7", "XX", None, None),
]


def key(address):
    ip = ipaddress.ip_address(address)
    return f"{int(ip):032x}" if ip.version == 6 else f"{geo.V4}{int(ip):08x}"


@pytest.mark.parametrize("bits", [24, 28, 32])
def test_ranges_of_a_file(spark, tmp_path, bits):
    path = tmp_path / "places.mmdb"
    path.write_bytes(database(NETWORKS, bits))
    found = sorted(tuple(r) for r in mmdb.read_database(spark, str(path)).collect())
    want = []
    for network, *place in NETWORKS:
        net = ipaddress.ip_network(network)
        first, last = int(net[0]), int(net[-1])
        shift = net.max_prefixlen - mmdb.PREFIX_BITS  # ranges end where tasks' prefixes do
        for p in range(first >> shift, (last >> shift) + 1):
            ends = (max(first, p << shift), min(last, ((p + 1) << shift) - 1))
            want.append((*(key(str(type(net[0])(x))) for x in ends), *place))
    assert found == sorted(want)


def test_file_of_four_only(spark, tmp_path):
    path = tmp_path / "places.mmdb"
    path.write_bytes(database(NETWORKS[:2], version=4))
    assert {(r.ip_start[-8:], r.ip_end[-8:], r.city) for r in mmdb.read_database(spark, str(path)).collect()} == {("51020000", "51027fff", "London"), ("51028000", "5102ffff", None)}


def test_missing_and_broken_files(spark, tmp_path):
    assert mmdb.read_database(spark, str(tmp_path / "none.mmdb")) is None
    (tmp_path / "x.mmdb").write_bytes(b"nothing of that kind")
    with pytest.raises(ValueError):
        mmdb.read_database(spark, str(tmp_path / "x.mmdb"))


def test_same_places_as_the_exported_table(spark, tmp_path):
    networks = [(n, c, r or None, t or None) for n, c, r, t in sql.NETWORKS]
    (tmp_path / "places.mmdb").write_bytes(database(networks))
    spark.createDataFrame(networks, "network string, country_code string, region string, city string").coalesce(1).write.option("header", True).csv(str(tmp_path / "csv"))
    ips = ["81.2.0.1", "81.2.200.1", "::ffff:81.2.3.4", "2001:db8:1::5", "2a01::1", "2b00::", "x", "10.0.0.1"]
    rows = spark.createDataFrame([(x,) for x in ips], "ip string")
    both = [geo.locate(rows, ranges, "ip").orderBy("ip").collect() for ranges in (mmdb.read_database(spark, str(tmp_path / "places.mmdb")), geo.read_ranges(spark, str(tmp_path / "csv")))]
    assert both[0] == both[1] and sum(r.country_code is not None for r in both[0]) == 4
