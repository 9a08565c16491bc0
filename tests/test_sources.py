import io
import json
import os
import random
import sqlite3
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from evidra.operators.integrity import file_hashes, parse_manifest, reconcile
from evidra.sources import files, records, rule_files, sinks


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(text)
    return str(path)


def test_csv_with_ragged_rows(spark, tmp_path):
    p = put(tmp_path / "x" / "a.csv", 'a,b,c\n1,2,3\nSHORT,ROW\n4,,"x ""y"", z"\n5,6,7,8\n"","-",\n')
    strict = [tuple(r) for r in files.read_csv(spark, p).collect()]
    assert strict == [("1", "2", "3"), ("4", "", 'x "y", z'), ("5", "6", "7"), ("", "-", "")]
    assert files.short_rows(spark, p) == 1 and files.read_csv(spark, p, strict=False).count() == 5
    q = put(tmp_path / "x" / "b.csv", "C,d\n9,8\n")
    both = files.read_source(spark, str(tmp_path), ["x/*.csv", "x/a.csv", "x/none.csv"])
    assert both.count() == 5 and {r["source_file"] for r in both.collect()} == {"a.csv", "b.csv"} and files.read_source(spark, str(tmp_path), ["no/*.csv"]) is None
    assert {*files.artifact_tables(spark, str(tmp_path))} == {"x/a", "x/b"} and q


def test_csv_with_line_breaks_in_cells_and_other_headers(spark, tmp_path):
    p = put(tmp_path / "y" / "a.csv", 'a,b,c\n1,"x\ny",3\n4,5,6\n')
    assert sorted(tuple(r) for r in files.read_csv(spark, p).collect()) == [("1", "x\ny", "3"), ("4", "5", "6")] and files.short_rows(spark, p) == 0
    q = put(tmp_path / "y" / "b.csv", "c,a,d\n7,8,9\n")
    assert sorted(tuple(r) for r in files.read_csv(spark, [p, q]).collect()) == [("1", "x\ny", "3", ""), ("4", "5", "6", ""), ("8", "", "7", "9")]


def test_stix_bundles_are_whole_and_the_same_each_time(spark, tmp_path):
    from evidra.operators import ioc

    rows = [("b", "url", "http://x/a'b\\c", "later", 90), ("a", "url", "http://x/a'b\\c", "first", 90), ("a", "file", "0" * 32, "h", 50), ("a", "email", "x@y", "", 1)]
    found = spark.createDataFrame(rows, "source_file string, type string, value string, context string, confidence int")
    for parts in (1, 5):
        objects = ioc.stix_objects(found.repartition(parts), "2026-01-05T00:00:00.000Z")
        got = {o["pattern"]: o for o in (json.loads(r[0]) for r in objects.collect())}
        assert {k: o["description"] for k, o in got.items()} == {"[url:value = 'http://x/a\\'b\\\\c']": "first", "[file:hashes.MD5 = '" + "0" * 32 + "']": "h"}
        assert all(o["created"] == o["modified"] == o["valid_from"] == "2026-01-05T00:00:00.000Z" for o in got.values())
    sinks.write_stix(objects, str(tmp_path / "out"), "r")
    bundles = [json.loads(p.read_text()) for p in (tmp_path / "out").glob("part-*")]
    assert sum(len(b["objects"]) for b in bundles) == 2 and all(b["type"] == "bundle" and b["id"].startswith("bundle--") for b in bundles)
    assert files.read_stix(spark, str(tmp_path / "out")).count() == 2


def test_lines_channels_and_lists(spark, tmp_path):
    p = put(tmp_path / "l" / "u.log", "#Fields: a\r\n1\n\nlast")
    rows = files.read_lines(spark, {"S": [p]}).orderBy("line_no").collect()
    assert [tuple(r) for r in rows] == [("S", "u.log", 1, "#Fields: a"), ("S", "u.log", 2, "1"), ("S", "u.log", 3, ""), ("S", "u.log", 4, "last")] and files.read_lines(spark, {}).collect() == []
    df = spark.createDataFrame([("/a/Microsoft-X%4Op.evtx", 1), ("/b/Microsoft-X%4Op.evtx", 2), ("/b/System.evtx", 3)], "path string, n int")
    assert sorted(r["n"] for r in files.first_of_channel(df).collect()) == [1, 3]
    text = "Name : one\nQuery : SELECT *\n    FROM x\n\n\nName: two\r\nEmpty :\n\njunk\n"
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(files.format_list(F.col("t"))).collect()
    assert [r[0] for r in got] == [[{"Name": "one", "Query": "SELECT *FROM x"}, {"Name": "two", "Empty": ""}], [], None]


def test_downloads_of_firefox(spark, tmp_path):
    places, old = str(tmp_path / "places.sqlite"), str(tmp_path / "downloads.sqlite")
    db = sqlite3.connect(places)
    db.executescript("create table moz_places(id,url); create table moz_annos(place_id,anno_attribute_id,content,dateAdded); create table moz_anno_attributes(id,name);")
    db.executemany("insert into moz_places values(?,?)", [(1, "http://a/x.zip"), (2, None), (3, "http://c")])
    db.executemany("insert into moz_anno_attributes values(?,?)", [(7, "downloads/destinationFileURI"), (8, "downloads/metaData")])
    db.executemany("insert into moz_annos values(?,?,?,?)", [(1, 7, "file:///C:/Users/x.zip", 1700000000000000), (1, 8, "{}", 1), (2, 7, "FILE:///C:/y", 0), (3, 8, "{}", 1)])
    db.commit()
    db.close()
    db = sqlite3.connect(old)
    db.execute("create table moz_downloads(source,target,startTime,state,totalBytes)")
    db.executemany("insert into moz_downloads values(?,?,?,?,?)", [("http://d", "C:\\d", 1700000000000000, 0, 5), ("http://e", "file:///C:/e", None, 3, None), ("http://f", None, -1, 9, 0)])
    db.commit()
    db.close()
    rows = files.browser_downloads(spark, [], [places, old, str(tmp_path / "absent")]).collect()
    assert sorted((r["url"], r["target_path"], r["start_time_utc"] and r["start_time_utc"].isoformat(), r["total_bytes"], r["state"], r["path"]) for r in rows) == [
        ("", "C:\\y", None, 0, "complete", places), ("http://a/x.zip", "C:\\Users\\x.zip", "2023-11-14T22:13:20", 0, "complete", places),
        ("http://d", "C:\\d", "2023-11-14T22:13:20", 5, "in progress", old), ("http://e", "C:\\e", None, None, "failed", old), ("http://f", "", None, 0, "unknown", old),
    ]


def test_browsers(spark, tmp_path):
    c, f = str(tmp_path / "History"), str(tmp_path / "places.sqlite")
    db = sqlite3.connect(c)
    db.executescript("create table urls(url,title,visit_count,last_visit_time); create table downloads(id,target_path,start_time,received_bytes,total_bytes,state); create table downloads_url_chains(id,chain_index,url);")
    db.execute("insert into urls values('http://a','A',2,13350000000000000)")
    db.executemany("insert into downloads values(?,?,13350000000000000,1,1,?)", [(1, "C:\\x.zip", 1), (2, "y", 4)])
    db.executemany("insert into downloads_url_chains values(1,?,?)", [(1, "http://second"), (0, "http://first")])
    db.commit()
    db.close()
    db = sqlite3.connect(f)
    db.execute("create table moz_places(url,title,visit_count,last_visit_date)")
    db.executemany("insert into moz_places values(?,?,?,?)", [("http://b", None, 1, 1700000000000000), ("http://never", "x", 0, None)])
    db.commit()
    db.close()
    rows = files.browser_history(spark, [c, str(tmp_path / "absent")], [f]).orderBy("url").collect()
    assert [(r["browser"], r["url"], r["title"], r["last_visit_utc"].isoformat()) for r in rows] == [("Chromium", "http://a", "A", "2024-01-17T21:20:00"), ("Firefox", "http://b", "", "2023-11-14T22:13:20")]
    assert sorted((r["target_path"], r["url"], r["state"]) for r in files.browser_downloads(spark, [c]).collect()) == [("C:\\x.zip", "http://first", "complete"), ("y", "", "interrupted")]
    assert files.browser_cookies(spark, [], []).collect() == []


def test_stix_and_reports(spark, tmp_path):
    good = {"type": "bundle", "objects": [{"type": "indicator", "id": "i1", "name": "n", "pattern": "[ipv4-addr:value = '1.2.3.4']"}, {"type": "indicator", "id": "i2", "pattern": ""}, {"type": "malware", "pattern": "x"}]}
    put(tmp_path / "p" / "a.json", json.dumps(good, indent=1))
    put(tmp_path / "p" / "b.json", "{broken")
    assert [(r["id"], r["type"], r["value"]) for r in files.read_stix(spark, str(tmp_path / "p")).collect()] == [("i1", "ipv4-addr", "1.2.3.4")]
    put(tmp_path / "r" / "t.txt", "one\ntwo")
    assert [tuple(r) for r in files.read_report(spark, str(tmp_path / "r")).collect()] == [("t.txt", "one\ntwo")]


TICKS = 133485408000000000  # 2024-01-01


def mft(name, broken=False):
    buf = bytearray(1024)
    buf[:4] = b"FILE"
    struct.pack_into("<H", buf, 20, 56)
    struct.pack_into("<II", buf, 56, 0x10, 72)
    struct.pack_into("<H", buf, 56 + 20, 24)
    struct.pack_into("<4Q", buf, 56 + 24, *[TICKS + i * 10_000_000 for i in range(4)])
    raw = name.encode("utf-16-le")
    size = 24 + 66 + len(raw)
    struct.pack_into("<II", buf, 128, 0x30, 5000 if broken else size)
    struct.pack_into("<H", buf, 128 + 20, 24)
    buf[128 + 24 + 64] = len(name)
    buf[128 + 24 + 66 : 128 + 24 + 66 + len(raw)] = raw
    struct.pack_into("<I", buf, 128 + size, 0xFFFFFFFF)
    return bytes(buf)


def usn(name, reason):
    raw = name.encode("utf-16-le")
    size = (60 + len(raw) + 7) // 8 * 8
    head = struct.pack("<IHH", size, 2, 0) + b"\1" * 24 + struct.pack("<QI", TICKS, reason) + b"\0" * 12 + struct.pack("<HH", len(raw), 60)
    return (head + raw).ljust(size, b"\0")


def test_binary_records_whatever_the_split(spark, tmp_path, monkeypatch):
    records.register(spark)
    path = str(tmp_path / "mft")
    with open(path, "wb") as f:
        f.write(mft("a.txt") + b"\0" * 1024 + mft("ü.exe") + mft("bad", True) + mft("cut")[:500])
    rows = spark.read.format("mft").load(path).orderBy("mft_record").collect()
    assert [(r["mft_record"], r["filename"], r["creation_time"].isoformat(), r["accessed_time"].second) for r in rows] == [(0, "a.txt", "2024-01-01T00:00:00", 3), (2, "ü.exe", "2024-01-01T00:00:00", 3)]
    rng = random.Random(8)
    names = [f"file{i}_{'x' * rng.randrange(30)}" for i in range(400)]
    data = b"\0" * 8192 + b"".join(usn(n, 0x100 + i) + (b"\xff" * 16 if i % 50 == 0 else b"") for i, n in enumerate(names)) + usn("cut", 1)[:40]
    path = str(tmp_path / "J")
    with open(path, "wb") as f:
        f.write(data)
    for split in (1024, 4096, 1 << 20):
        got = spark.read.format("usn").option("split", split).load(path).collect()
        assert sorted((r["filename"], r["reason_mask"]) for r in got) == sorted((n, 0x100 + i) for i, n in enumerate(names)), split
    empty = str(tmp_path / "none")
    open(empty, "w").close()
    assert spark.read.format("usn").load(empty).count() == 0 == spark.read.format("mft").load(empty).count()


def test_codecs():
    assert records.xor_codec(records.xor_codec(b"hello world", b"key", 5), b"key", 5) == b"hello world" and records.xor_codec(b"", b"k") == b""
    assert records.userassist_value(b"\0" * 4 + struct.pack("<III", 3, 2, 500) + b"\0" * 44 + struct.pack("<Q", TICKS) + b"\0" * 4)[:3] == (3, 2, 500) and records.userassist_value(b"x") is None
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("d/a.aspx", "eval(")
    assert [*records.zip_entries(z.getvalue())] == [("d/a.aspx", b"eval(")] and [*records.zip_entries(b"no zip")] == []


RULES = """# rules
rules:
  - id: X-1
    title: "A 'quoted' # title"
    severity: HIGH
    sources:
      - evtx/Security.csv
      - evtx/System.csv
    match:
      all:
        - field: event_id
          in: ['1102', "104"]   # ids
        - not:
            field: event_data
            contains_any: [a b, "c,d", 'it''s']
        - any:
          - field: x
            equals: ''
          - field: y
            regex: 'a{2}\\d'
    evidence: "ID {event_id}: {event_data}"
    enabled: true
  - id: X-2
    title: two
    severity: LOW
    source: s
    notes: |
      text
      more
"""


def test_rule_files(tmp_path):
    first = rule_files.parse_simple(RULES)["rules"][0]
    assert first["title"] == "A 'quoted' # title" and first["sources"] == ["evtx/Security.csv", "evtx/System.csv"] and first["enabled"] is True
    assert first["match"]["all"][0]["in"] == ["1102", "104"] and first["match"]["all"][1]["not"]["contains_any"] == ["a b", "c,d", "it's"]
    assert first["match"]["all"][2]["any"] == [{"field": "x", "equals": None if first["match"]["all"][2]["any"][0]["equals"] is None else ""}, {"field": "y", "regex": "a{2}\\d"}]
    put(tmp_path / "r" / "a.yml", RULES)
    put(tmp_path / "r" / "b.yaml", "rules: nothing")
    put(tmp_path / "r" / "c.json", json.dumps({"rules": [{"id": "X-1", "title": "t", "severity": "HIGH", "source": "s", "enabled": False}]}))
    rules, warnings = rule_files.load_rules(str(tmp_path / "r"))
    assert rules == [] and len(warnings) == 2
    with pytest.raises(ValueError):
        rule_files.parse_rules("{broken")


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([("2026-01-02 00:00:00.000000", "=cmd"), ("2026-01-01 00:00:00.000000", None)], "datetime string, short string")
    sinks.write_timeline(t, str(tmp_path / "t"))
    sinks.write_timeline(t, str(tmp_path / "t"))
    assert sorted(x for x in os.listdir(tmp_path / "t") if x.startswith("day")) == ["day=2026-01-01", "day=2026-01-02"] and spark.read.parquet(str(tmp_path / "t")).count() == 2
    sinks.export_csv(t, str(tmp_path / "c"))
    assert {r["short"] for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()} == {"'=cmd", None}
    put(tmp_path / "e" / "f.txt", "abc")
    hashes = file_hashes(spark.read.format("binaryFile").load(str(tmp_path / "e")), str(tmp_path / "e"))
    sinks.write_manifest(hashes, str(tmp_path / "m"))
    assert [(r["path"], r["status"]) for r in reconcile(parse_manifest(spark.read.text(str(tmp_path / "m"))), hashes).collect()] == [("f.txt", "ok")]
    tags = str(tmp_path / "tags.json")
    assert sinks.read_tags(tags) == []
    sinks.write_tags([{"id": "1", "note": "x", "more": 1}], tags)
    assert sinks.read_tags(tags) == [{"id": "1", "event_data": "", "note": "x"}]


def test_json_documents(spark, tmp_path):
    put(tmp_path / "j" / "case.json", '{"id": "c1",\n "findings": [{"severity": "HIGH"}]}')
    put(tmp_path / "j" / "broken.json", '{"id": ')
    rows = files.read_json_documents(spark, str(tmp_path / "j")).where("id is not null").collect()
    assert [(r["id"], r["findings"][0]["severity"], r["path"].endswith("case.json")) for r in rows] == [("c1", "HIGH", True)]
