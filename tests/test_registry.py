import struct

from evidra.operators import registry
from evidra.sources import records

TICKS = 133485408000000000  # 2024-01-01


class Writer:
    """A small hive: nested {key: (values, keys)}, values (name, type, data)."""

    def __init__(self):
        self.cells = bytearray(b"hbin".ljust(32, b"\0"))

    def cell(self, body):
        at = len(self.cells)
        size = (len(body) + 4 + 7) // 8 * 8
        self.cells += struct.pack("<i", -size) + body.ljust(size - 4, b"\0")
        return at

    def value(self, name, kind, data):
        raw = name.encode("latin-1")
        if len(data) <= 4:
            size, at = len(data) | 0x80000000, struct.unpack("<I", data.ljust(4, b"\0"))[0]
        elif len(data) > 16344:
            parts = [self.cell(data[i : i + 16344] + b"\0" * 4) for i in range(0, len(data), 16344)]
            listed = self.cell(struct.pack(f"<{len(parts)}I", *parts))
            size, at = len(data), self.cell(b"db" + struct.pack("<HI", len(parts), listed))
        else:
            size, at = len(data), self.cell(data)
        return self.cell(b"vk" + struct.pack("<HIIIHH", len(raw), size, at, kind, 1, 0) + raw)

    def key(self, name, values, keys):
        below = [self.key(n, *v) for n, v in keys.items()]
        own = [self.value(*v) for v in values]
        lists = self.cell(b"lh" + struct.pack("<H", len(below)) + b"".join(struct.pack("<II", k, 0) for k in below)) if below else 0xFFFFFFFF
        listed = self.cell(struct.pack(f"<{len(own)}I", *own)) if own else 0xFFFFFFFF
        raw = name.encode("latin-1")
        head = b"nk" + struct.pack("<HQIIIIIIII", 0x20, TICKS, 0, 0, len(below), 0, lists, 0xFFFFFFFF, len(own), listed)
        return self.cell(head.ljust(72, b"\0") + struct.pack("<HH", len(raw), 0) + raw)

    def save(self, path, keys):
        root = self.key("ROOT", [], keys)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes((b"regf" + b"\0" * 32 + struct.pack("<I", root)).ljust(4096, b"\0") + bytes(self.cells))
        return str(path)


def nest(path, values=(), keys=None):
    out = (list(values), keys or {})
    for part in reversed(path.split("\\")[1:]):
        out = ([], {part: out})
    return {path.split("\\")[0]: out}


def utf(s):
    return s.encode("utf-16-le") + b"\0\0"


def item(kind, body):
    data = bytes([kind]) + body
    return struct.pack("<H", len(data) + 2) + data


def file_item(short, long):
    ext = struct.pack("<HHHH", 0, 3, 4, 0xBEEF).ljust(28, b"\0") + utf(long)
    ext = struct.pack("<H", len(ext)) + ext[2:]
    head = b"\0" * 11 + short.encode() + b"\0"
    head += b"\0" if (len(head) + 3) % 2 else b""
    return item(0x31, head + ext)


def test_tables_from_hives(spark, tmp_path):
    records.register(spark)
    counter = b"\0" * 4 + struct.pack("<III", 3, 2, 500) + b"\0" * 44 + struct.pack("<Q", TICKS) + b"\0" * 4
    user = nest("Software\\Microsoft\\Windows\\CurrentVersion\\Explorer\\UserAssist\\{CEBFF5CD-ACE2-4F4F-9178-9926F41749EA}\\Count", [("P:\\gbby.rkr", 3, counter), ("HRZR_k", 3, counter), ("fubeg", 3, b"\0" * 8)])
    bags = ([("0", 3, item(0x1F, b"\0" + bytes.fromhex("E04FD020EA3A6910A2D808002B30309D")) + b"\0\0"), ("MRUListEx", 3, b"\0" * 8)], {"0": ([("1", 3, item(0x2F, b"C:\\\0") + b"\0\0")], {"1": ([("0", 3, file_item("LONGNA~1", "Long Name") + b"\0\0"), ("x", 3, b"1"), ("7", 3, b"\xff\xff")], {})})})
    user["Software"][1]["Classes"] = ([], {"BagMRU": bags, "CLSID": ([], {"{aa}": ([], {"InprocServer32": ([("", 1, utf("C:\\x.dll"))], {})})})})
    Writer().save(tmp_path / "users" / "S-1-5-21-1" / "NTUSER.DAT", user)
    shim = struct.pack("<I", 52).ljust(52, b"\0")
    for name in ("C:\\a.exe", "D:\\" + "b" * 9000):
        body = struct.pack("<H", len(name) * 2) + name.encode("utf-16-le") + struct.pack("<QII", TICKS, 4, 1)
        shim += b"10ts" + b"\0" * 4 + struct.pack("<I", len(body)) + body
    system = {"ControlSet001": ([], nest("Services\\bam\\State\\UserSettings\\S-1-5-18", [("\\device\\harddiskvolume3\\w.exe", 3, struct.pack("<Q", TICKS) + b"\0" * 8), ("Version", 4, b"\1\0\0\0"), ("x", 3, b"\0" * 8)]) | nest("Control\\Session Manager\\AppCompatCache", [("AppCompatCache", 3, shim)]))}
    Writer().save(tmp_path / "SYSTEM", system)
    Writer().save(tmp_path / "SAM", nest("SAM\\Domains\\Account\\Users\\Names", keys={"Administrator": ([("", 500, b"")], {}), "eve": ([("", 1001, b"")], {})}))
    Writer().save(tmp_path / "Amcache.hve", nest("Root\\InventoryApplicationFile", keys={"a|1": ([("Name", 1, utf("a.exe")), ("LowerCaseLongPath", 1, utf("c:\\a.exe")), ("Size", 11, struct.pack("<Q", 7)), ("Usn", 4, b"\5\0\0\0"), ("FileId", 3, b"\xab\xcd")], {}), "empty": ([], {})}))
    (tmp_path / "none").write_bytes(b"junk")
    read = lambda p: spark.read.format("hive_file").load(str(tmp_path / p))

    rows = registry.userassist(read("users/*/NTUSER.DAT")).orderBy("decoded_path").collect()
    assert [(r["sid"], r["category"], r["decoded_path"], r["run_count"], r["focus_time_ms"], str(r["last_run_utc"])) for r in rows] == [("S-1-5-21-1", "Executable", "C:\\tool.exe", 3, 500, "2024-01-01 00:00:00"), ("S-1-5-21-1", "Executable", "short", 0, 0, "None")]
    assert sorted((r["mru_path"], r["folder_path"]) for r in registry.shellbags(read("users/**/NTUSER.DAT")).collect()) == [("BagMRU\\0", "My Computer"), ("BagMRU\\0\\1", "My Computer\\C:"), ("BagMRU\\0\\1\\0", "My Computer\\C:\\Long Name")]
    assert [(r["clsid"], r["wow64"], r["module_path"]) for r in registry.com_servers(read("users/*/NTUSER.DAT")).collect()] == [("{AA}", False, "C:\\x.dll")]
    assert [(r["source"], r["sid"], r["user_type"], r["normalized_path"], str(r["last_execution_utc"])) for r in registry.bam(read("SYSTEM")).collect()] == [("BAM", "S-1-5-18", "SYSTEM", "\\Device\\HarddiskVolume3\\w.exe", "2024-01-01 00:00:00")]
    assert [(r["entry_index"], len(r["path"]), r["execution_flag"]) for r in registry.shimcache(read("SYSTEM")).orderBy("entry_index").collect()] == [(0, 8, 1), (1, 9003, 1)]
    assert sorted(tuple(r) for r in registry.local_accounts(read("SAM")).collect()) == [("Administrator", 500, "built-in"), ("eve", 1001, "local (created on host)")]
    assert [(r["name"], r["path"], r["size"], r["usn"], r["file_id"], r["source_key"]) for r in registry.amcache(read("Amcache.hve"), "files").collect()] == [("a.exe", "c:\\a.exe", "7", "5", "abcd", "Root\\InventoryApplicationFile\\a|1")]
    assert registry.amcache(read("Amcache.hve"), "drivers").collect() == [] and read("none").collect() == [] and read("absent*").collect() == []
