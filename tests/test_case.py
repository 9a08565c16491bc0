import json
import os
import struct

from evidra.case import Case
from evidra.sources import memory
from evidra.sources.sinks import write_manifest

RULES = {"rules": [{"id": "B-1", "title": "Runs a shell", "severity": "HIGH", "mitre": "T1059", "sources": ["evtx/*.csv", "none.csv"], "match": {"field": "event_data", "contains": "cmd.exe"}, "evidence": "{source_file}: {event_data}"}]}


def test_a_case_from_end_to_end(spark, tmp_path):
    case, out, rules = tmp_path / "case", tmp_path / "out", tmp_path / "rules"
    for folder in (case / "evtx", out, rules):
        folder.mkdir(parents=True)
    head = "time_created_utc,event_id,provider,channel,computer,level,event_data\n"
    (case / "evtx" / "Security.csv").write_text(head + '2026-01-01T00:00:01Z,4688,P,Security,PC,4,"{""TargetUserName"":""ann"",""Cmd"":""CMD.EXE""}"\nSHORT,ROW\n')
    (case / "evtx" / "System.csv").write_text(head + "2026-01-01T00:00:00.5Z,7045,P,System,PC,4,{}\n")
    (case / "shimcache.csv").write_text("control_set,entry_index,path,last_modified_utc,execution_flag\nC,0,C:\\x\\a.exe,2026-01-01T00:00:02Z,1\n")
    (rules / "r.json").write_text(json.dumps(RULES))
    c = Case(spark, str(case))
    summary = c.analyze(str(out), str(rules))
    assert summary == {"tables": {"evtx/Security": 2, "evtx/System": 1, "shimcache": 1}, "hits": 1, "warnings": []} and os.path.exists(out / "analyzer_result.json")
    rows = spark.read.parquet(str(out / "timeline")).orderBy("datetime").collect()
    assert [(r["sourcetype"], r["user_name"], r["short"]) for r in rows] == [("System", "", "Evtx: ID 7045 (P)"), ("Security", "ann", "Evtx: ID 4688 (P)"), ("ShimCache", "", "ShimCache: a.exe"), ("DetectionEngine", "SYSTEM", "[HIGH] Runs a shell (B-1)")]
    c.register()
    assert spark.sql("select count(*) from evtx_security").first()[0] == 2
    write_manifest(c.hashes(), str(tmp_path / "m"))
    assert {r["status"] for r in c.verify(str(tmp_path / "m")).collect()} == {"ok"}
    (case / "shimcache.csv").write_text("changed")
    assert sorted(r["status"] for r in c.verify(str(tmp_path / "m")).collect()) == ["mismatch", "ok", "ok"]


def test_regions(spark):
    image = bytearray(b"MZ".ljust(0x80, b"\0"))
    struct.pack_into("<I", image, 0x3C, 0x40)
    image[0x40:0x44] = b"PE\0\0"
    struct.pack_into("<H", image, 0x44, 0x8664)
    struct.pack_into("<H", image, 0x56, 0x2000)
    image = bytes(image.ljust(0x100, b"\0"))
    data = b"noise MZ" + image + b"\0http://bad.example/x\0" + "\\\\srv\\share VirtualAllocEx".encode("utf-16-le") + b"\0 1.2.3.4 999.1.1.1"
    assert [(o, m, d) for o, m, d, _ in memory.images(data)] == [(8, "x64", True)] and memory.images(b"") == [] and memory.images(b"MZ" * 1000) == []
    regions = spark.createDataFrame([(1, "a", "PAGE_EXECUTE_READWRITE", None), (2, "b", "PAGE_READONLY", "p1"), (3, "c", None, "p2"), (4, "d", "PAGE_READONLY", "absent")], "pid int, name string, protect string, blob_path string")
    blobs = spark.createDataFrame([("p1", bytearray(data)), ("p2", bytearray(b"just http://x.example and text"))], "path string, content binary")
    got = {r["pid"]: (r["tier"], r["n_images"], r["hits"]) for r in memory.scan_regions(regions, blobs).collect()}
    assert got == {1: ("HIGH", 0, 0), 2: ("HIGH", 1, 4), 3: ("NOTABLE", 0, 1), 4: ("LOW", 0, 0)}


def test_every_image_of_a_region_counts(spark):
    image = bytearray(b"MZ".ljust(0x100, b"\0"))
    struct.pack_into("<I", image, 0x3C, 0x40)
    image[0x40:0x46] = b"PE\0\0" + struct.pack("<H", 0x14C)
    regions = spark.createDataFrame([(1, "a", "PAGE_READONLY", "p")], "pid int, name string, protect string, blob_path string")
    blobs = spark.createDataFrame([("p", bytearray(bytes(image) * 40))], "path string, content binary")
    assert [(r["n_images"], r["tier"]) for r in memory.scan_regions(regions, blobs).collect()] == [(40, "HIGH")]
