import hashlib
import io
import struct
import zipfile

import pytest

from evidra.operators.tasks import scheduled_tasks
from evidra.operators.timeline import build_timeline
from evidra.sources import traces
from evidra.sources.lzxpress import decompress

SECOND = 10_000_000
TICKS = (11_644_473_600 + 1_767_571_201) * SECOND  # 2026-01-05 00:00:01


def wide(text):
    return text.encode("utf-16-le")


def prefetch(version=30, times=2, newer=True):
    files = "".join(x + "\0" for x in (r"\VOLUME{1}\WINDOWS\SYSTEM32\NTDLL.DLL", r"\VOLUME{1}\WINDOWS\SYSTEM32\CMD.EXE"))
    head = bytearray(320)
    struct.pack_into("<I4sII", head, 0, version, b"SCCA", 17, 5000)
    head[16 : 16 + 14] = wide("CMD.EXE")
    struct.pack_into("<I", head, 76, 0x4A81B364)
    struct.pack_into("<I", head, 84, 296 if newer else 304)
    struct.pack_into("<II", head, 100, 320, len(wide(files)))
    at, count, n = {17: (120, 144, 1), 23: (128, 152, 1), 26: (128, 208, 8), 30: (128, 200 if newer else 208, 8), 31: (128, 200, 8)}[version]
    for i in range(min(n, times)):
        struct.pack_into("<Q", head, at + 8 * i, TICKS - i * SECOND)
    struct.pack_into("<I", head, count, 7)
    return bytes(head) + wide(files)


def packed(data, bits=9):
    """Every symbol has a code of nine bits; runs of one byte become matches of up to 17 bytes, one back."""
    out, at = "", 0
    body = b""
    while at < len(data):
        run = 0
        while at and at % 65536 and run < 17 and at + run < len(data) and (at + run) % 65536 and data[at + run] == data[at - 1]:
            run += 1
        if run >= 3:
            out += f"{256 + run - 3:09b}"
            at += run
        else:
            out += f"{data[at]:09b}"
            at += 1
        if at % 65536 == 0 or at == len(data):
            out += "0" * (-len(out) % 16)
            words = [int(out[i : i + 16], 2) for i in range(0, len(out), 16)]
            body += b"\x99" * 256 + struct.pack(f"<{len(words)}H", *words)
            out = ""
    return body


def test_decompression_undoes_compression():
    for data in (b"abcabc", bytes(range(256)) * 9, b"a" * 1000 + b"xyz" + b"\0" * 50):
        assert decompress(packed(data), len(data)) == data
    for bad in (b"", b"\x00" * 300, b"\x99" * 256, b"\x99" * 256 + b"\xff" * 40):
        with pytest.raises(ValueError):
            decompress(bad, 100)


def test_prefetch_files(spark, tmp_path):
    plain = prefetch()
    cases = {"CMD.EXE-4A81B364.pf": plain, "Z.pf": b"MAM\x04" + struct.pack("<I", len(plain)) + packed(plain), "OLD.pf": prefetch(17), "V.pf": prefetch(30, 8, False), "NONE.pf": prefetch(26, 0), "cut.pf": plain[:90], "junk.pf": b"junk", "empty.pf": b""}
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    rows = traces.prefetch_files(spark, str(tmp_path)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["prefetch_filename"], []).append(r)
    assert {k: len(v) for k, v in by.items()} == {"CMD.EXE-4A81B364.pf": 2, "Z.pf": 2, "OLD.pf": 1, "V.pf": 8, "NONE.pf": 1}
    r = min(by["Z.pf"], key=lambda x: x["run_index"])
    assert (r["executable"], r["path"], r["hash"], r["run_count"], r["files_accessed_count"], r["is_baseline"], str(r["run_time_utc"])) == ("CMD.EXE", r"\VOLUME{1}\WINDOWS\SYSTEM32\CMD.EXE", "4A81B364", 7, 2, True, "2026-01-05 00:00:01")
    assert (by["NONE.pf"][0]["run_index"], by["NONE.pf"][0]["run_time_utc"]) == (-1, None)
    events = build_timeline({"prefetch": traces.prefetch_files(spark, str(tmp_path))})
    assert events.where("datetime = '2026-01-05 00:00:01.000000' and short = 'Run: CMD.EXE'").count() == 4


def link(path="C:\\a\\b.txt", arguments="-x"):
    info = struct.pack("<7I", 28 + len(path) + 1, 28, 1, 0, 28, 0, 0) + path.encode() + b"\0"
    return traces._LINK_SIGN + struct.pack("<II3Q", 2 | 32 | 128, 0, TICKS, TICKS + SECOND, TICKS + 2 * SECOND) + b"\0" * 24 + info + struct.pack("<H", len(arguments)) + wide(arguments)


def compound(streams):
    """Streams below 4096 bytes go to the small stream, others to sectors of their own."""
    small, small_fat, big, entries = b"", [], [], []
    for name, data in streams.items():
        if len(data) < 4096:
            start, n = len(small_fat), -(-len(data) // 64)
            small += data.ljust(n * 64, b"\0")
            small_fat += [*range(start + 1, start + n), 0xFFFFFFFE]
            entries.append((name, 2, ("small", start), len(data)))
        else:
            entries.append((name, 2, ("big", data), len(data)))
    sectors, fat = [], []

    def put(data):
        start, n = len(sectors), max(1, -(-len(data) // 512))
        sectors.extend(data[i * 512 : (i + 1) * 512].ljust(512, b"\0") for i in range(n))
        fat.extend([*range(start + 1, start + n), 0xFFFFFFFE])
        return start

    starts = {name: put(where[1]) if where[0] == "big" else where[1] for name, _, where, _ in entries}
    root = put(small)
    small_fat_at = put(struct.pack(f"<{len(small_fat)}I", *small_fat).ljust(512, b"\xff"))
    rows = [("Root Entry", 5, root, len(small))] + [(name, kind, starts[name], size) for name, kind, _, size in entries]
    directory = put(b"".join(wide(n).ljust(64, b"\0") + struct.pack("<HB", len(wide(n)) + 2, k) + b"\0" * 49 + struct.pack("<IQ", s, z) for n, k, s, z in rows))
    fat_at = len(sectors)
    fat.append(0xFFFFFFFD)
    sectors.append(struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff"))
    head = bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIII", 0, 1, directory, 0, 4096, small_fat_at, 1, 0xFFFFFFFE, 0)
    return head + struct.pack("<109I", fat_at, *[0xFFFFFFFF] * 108) + b"".join(sectors)


def listed(version, entries):
    out = struct.pack("<II", version, len(entries)) + b"\0" * 24
    for entry, path, pin in entries:
        head = bytearray(112 if version < 3 else 128)
        struct.pack_into("<I8xQI", head, 88, entry, TICKS, pin)
        if version >= 3:
            struct.pack_into("<I", head, 112, 3)
        out += bytes(head) + struct.pack("<H", len(path)) + wide(path) + b"\0" * 4
    return out


def test_jump_lists(spark, tmp_path):
    user = tmp_path / "S-1-5-21-1"
    user.mkdir()
    many = [(i, f"C:\\f{i}", 0xFFFFFFFF) for i in range(40)]
    (user / "a1.automaticDestinations-ms").write_bytes(compound({"DestList": listed(3, [(26, "D:\\x.doc", 0), (27, "", 0xFFFFFFFF)]), "1a": link(), "1b": link("E:\\y")}))
    (user / "b2.automaticDestinations-ms").write_bytes(compound({"DestList": listed(1, many), "5": b"broken"}))
    (user / "c3.customDestinations-ms").write_bytes(b"head" + link("C:\\t", "") + b"between" + link() + traces._LINK_SIGN)
    (user / "d4.automaticDestinations-ms").write_bytes(b"no compound file")
    (user / "e5.automaticDestinations-ms").write_bytes(compound({"1": link()}))
    rows = traces.jump_lists(spark, str(tmp_path)).collect()
    by = {(r["app_id"], r["entry_id"]): r for r in rows}
    assert len(rows) == len(by) == 2 + 40 + 2 and {r["sid"] for r in rows} == {"S-1-5-21-1"}
    first = by["a1", "26"]
    assert (first["path"], first["arguments"], first["pinned"], first["access_count"], str(first["last_accessed_utc"]), str(first["lnk_created_utc"]), str(first["lnk_modified_utc"])) == ("D:\\x.doc", "-x", True, 3, "2026-01-05 00:00:01", "2026-01-05 00:00:01", "2026-01-05 00:00:03")
    assert (by["a1", "27"]["path"], by["a1", "27"]["pinned"]) == ("E:\\y", False) and by["b2", "5"]["lnk_created_utc"] is None and by["b2", "39"]["path"] == "C:\\f39"
    assert [by["c3", str(i)]["path"] for i in (0, 1)] == ["C:\\t", "C:\\a\\b.txt"] and by["c3", "0"]["type"] == "custom"
    assert build_timeline({"jump_lists": traces.jump_lists(spark, str(tmp_path))}).count() == 4 * 2 + 40 + 3 * 2


def test_web_files(spark, tmp_path):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("1/up/x.aspx", "<% cmd.exe %>")
        z.writestr("1/readme.txt", "cmd.exe")
        z.writestr("1/e.PHP", "")
    (tmp_path / "web" / "2").mkdir(parents=True)
    (tmp_path / "box.dat").write_bytes(box.getvalue())
    key = b"key!"
    (tmp_path / "web" / "2" / "y.asp.qtn").write_bytes(traces.xor_codec(b"harmless", key))
    (tmp_path / "web" / "2" / "z.jsp").write_bytes(b"one two")
    (tmp_path / "broken").write_bytes(b"PKbroken")
    rows = {r["relative_path"]: r for r in traces.web_files(spark, str(tmp_path), ("cmd.exe",), ("one", "two"), key=key).collect()}
    assert {p: (r["extension"], r["size_bytes"], r["triage"], r["indicators"]) for p, r in rows.items()} == {"1/up/x.aspx": (".aspx", 13, "HIGH", "cmd.exe"), "1/e.PHP": (".php", 0, "INFO", ""), "2/y.asp": (".asp", 8, "INFO", ""), "2/z.jsp": (".jsp", 7, "NOTABLE", "one|two")}
    assert rows["2/y.asp"]["sha256"] == hashlib.sha256(b"harmless").hexdigest()


def test_scheduled_tasks(spark):
    text = """<Tasks xmlns="u"><Task><RegistrationInfo><URI>\\A</URI><Author>me</Author></RegistrationInfo><Settings><Enabled>false</Enabled></Settings><Triggers><LogonTrigger/><BootTrigger/><BootTrigger/></Triggers>
 <Principals><Principal id="x"><UserId>u1</UserId></Principal><Principal><UserId>u0</UserId><GroupId>g</GroupId></Principal></Principals>
 <Actions><Exec><Command>b</Command><Arguments>-1</Arguments></Exec><ComHandler><ClassId>{c}</ClassId><Data/></ComHandler><Exec/><Exec><Command>a</Command></Exec></Actions></Task><Task/></Tasks>"""
    df = spark.createDataFrame([(1, text), (1, text), (2, "<Task><Actions><Exec><Command>x</Command></Exec></Actions></Task>"), (3, None), (4, "<Task>"), (5, "<Other/>")], "id long, x string")
    rows = {(r["id"], r["task_no"]): r for r in scheduled_tasks(df, "id", "x").collect()}
    assert {*rows} == {(1, 1), (1, 2), (2, 1)}
    r = rows[1, 1]
    assert (r["task_name"], r["enabled"], r["triggers"], r["action_type"], r["command"], r["arguments"], r["class_id"], r["com_data"], r["user_id"], r["group_id"], r["author"], r["description"]) == ("\\A", False, "BootTrigger, LogonTrigger", "Multiple", "b ;  ; a", "-1", "{c}", "", "u1", "", "me", "")
    assert (rows[1, 2]["triggers"], rows[1, 2]["action_type"], rows[1, 2]["enabled"]) == ("None", "None", True) and rows[2, 1]["command"] == "x"
    assert scheduled_tasks(df.limit(0), "id", "x").collect() == []
