"""Ranges against the address library, over every kind of notation."""

import ipaddress
import random

import pytest

from tidemark.operators import addresses

RANGES = [*addresses.PRIVATE, "10.1.0.0/16", "10.1.2.0/23", "10.1.2.3", "2001:db8::/33", "2001:db8:8000::/33", "::ffff:8.8.8.0/120", "0.0.0.0/0", "1.2.3.4/40", "none", "1.2.3/8"]
ODD = [None, "", "1.2.3", "256.1.1.1", "1.2.3.4.5", ":::", "1::2::3", "12345::", "g::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "::300.1.1.1", "host"]
GOOD = ["[::1]", "::", "FE80::1%eth0", "::ffff:10.1.2.3", "::FFFF:0a01:0203", "10.1.3.255", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:1.2.3.4", "::8", "10.1.2.3"]


def plain(text):
    text = text.strip("[]").split("%")[0]
    x = ipaddress.ip_address(text)
    return int(x) + (0xFFFF << 32) if x.version == 4 else int(x)


def span(r):
    net = ipaddress.ip_network(r, strict=False)
    n = net.prefixlen + (96 if net.version == 4 else 0)
    return plain(str(net.network_address)) >> (128 - n), n


def test_longest_range(spark):
    rng = random.Random(4)
    some = [str(ipaddress.ip_address(rng.randrange(2**32))) for _ in range(150)] + [str(ipaddress.ip_address((0x20010DB8 << 96) + rng.randrange(2**96))) for _ in range(80)]
    some += [f"10.1.{k}.{rng.randrange(256)}" for k in range(6)] + [f"::ffff:8.8.{k}.8" for k in (7, 8, 9)]
    rows = [(k, x, k) for k, x in enumerate(ODD + GOOD + some + ["10.1.2.3"] * 400)]
    spans = [(*span(r), r) for r in RANGES if r not in ("1.2.3.4/40", "none", "1.2.3/8")]
    want = []
    for k, x, _ in rows:
        held = [(n, r) for base, n, r in spans if x not in ODD and plain(x) >> (128 - n) == base]
        want.append((k, max(held)[1] if held else None))
    got = addresses.held_by(spark.createDataFrame(rows, "k int, address string, _range int"), "address", spark.createDataFrame([(r,) for r in RANGES], "range string")).collect()
    assert sorted((r["k"], r["range"]) for r in got) == want and all(r["_range"] == r["k"] for r in got)


def test_no_ranges_and_no_rows(spark):
    rows = spark.createDataFrame([("10.0.0.1",)], "address string")
    none = spark.createDataFrame([("x",)], "range string")
    assert addresses.held_by(rows, "address", none).first()["range"] is None
    assert addresses.held_by(rows.limit(0), "address", addresses.private_ranges(spark)).count() == 0
    with pytest.raises(ValueError, match="already"):
        addresses.held_by(rows, "address", none, name="address")
