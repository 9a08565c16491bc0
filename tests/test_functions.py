import datetime
import ipaddress
import random

from pyspark.sql import functions as F

from evidra.functions.forms import form_of, promote
from evidra.functions.net import canonical_address, is_address
from evidra.functions.times import day_number, micros, nanos_of_day, show_seconds


def plain(text):
    try:
        a = ipaddress.ip_address(text)
    except ValueError:
        return None
    return str(a.ipv4_mapped) if a.version == 6 and a.ipv4_mapped else str(a)


def test_addresses_like_the_standard_library(spark):
    rng = random.Random(3)
    cases = ["::", "::1", "1::", "0:0:1:0:0:0:1:0", "1:0:2:0:3:0:4:0", "::ffff:0a01:0203", "64:ff9b::1.2.3.4", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8:9", ":1::2", "1:::2", "1::2::3", "256.1.1.1", "01.2.3.4", "1.2.3", "x", "::1.2.3.256", "12345::"]
    for _ in range(300):
        groups = [rng.choice([0, 0, 0, 1, 0xFFFF, rng.randrange(65536)]) for _ in range(8)]
        cases.append(rng.choice([":".join(f"{g:x}" for g in groups), ":".join(f"{g:04X}" for g in groups), ipaddress.IPv6Address(b"".join(g.to_bytes(2, "big") for g in groups)).compressed]))
        cases.append(".".join(str(rng.randrange(300)) for _ in range(4)))
    rows = spark.createDataFrame([(c,) for c in cases], "c string").select("c", canonical_address(F.col("c")).alias("a"), is_address(F.col("c")).alias("is")).collect()
    for r in rows:
        assert (r["a"], r["is"]) == (plain(r["c"]), plain(r["c"]) is not None), r["c"]


def test_client_spellings(spark):
    same = {"[2001:DB8::1]:80": "2001:db8::1", " 10.0.0.1 ": "10.0.0.1", "10.0.0.1:443": "10.0.0.1", "10.0.0.1, 10.0.0.2": "10.0.0.1", "::FFFF:10.0.0.1": "10.0.0.1", "fe80::1%eth0": "fe80::1", "": None, "-": None, "unknown": None, ",10.0.0.1": None, "9" * 5000: None}
    rows = spark.createDataFrame([(c,) for c in [*same, None]], "c string").select("c", canonical_address(F.col("c")).alias("a")).collect()
    assert {r["c"]: r["a"] for r in rows} == same | {None: None}


def test_times_and_forms(spark):
    rows = spark.createDataFrame([("2026-02-28", "23:59:59.1234567"), ("2026/02/28", "00:00"), ("28.02.2026", "24:00:00"), ("20260230", "aa"), (None, None), ("", "1:02:03")], "d string, t string")
    got = rows.select(day_number(F.col("d")), nanos_of_day(F.col("t"))).collect()
    day = (datetime.date(2026, 2, 28) - datetime.date(1970, 1, 1)).days
    assert [tuple(r) for r in got] == [(day, 86399123456700), (day, 0), (day, None), (None, None), (None, None), (None, None)]
    values = {"12": "whole", "-3": "whole", "1.5": "decimal", "0x1F": "hexadecimal", "7.4MB": "unit", "20260119": "date_compact", "2026-01-19": "date_ymd", "19.01.2026": "date_dmy", "10.0.0.1": "word", "build01": "word", "-": None, "": None, None: None, "٤": "word"}
    got = spark.createDataFrame([(x,) for x in values], "v string").select("v", form_of(F.col("v")).alias("f")).collect()
    assert {r["v"]: r["f"] for r in got} == values
    assert (promote("whole", "decimal"), promote("whole", "hexadecimal"), promote(None, "unit"), promote("unit", "unit")) == ("decimal", "word", "unit", "unit")
    df = spark.sql("select timestamp_ntz'2026-01-05 00:00:01.5' as a, timestamp'2026-01-05 00:00:01.5' as b")
    df = df.select(micros(df, "a").alias("a"), micros(df, "b").alias("b"))
    assert [tuple(r) for r in df.select("a", "b", show_seconds("a")).collect()] == [(1767571201500000, 1767571201500000, "2026-01-05 00:00:01")]
