import struct

from evidra.sources import records

TICKS = 133485408000000000


def utf(s):
    return s.encode("utf-16-le")


class Log:
    """One chunk with records of a shared template."""

    def __init__(self):
        self.data = bytearray(b"ElfChnk\0".ljust(512, b"\0"))

    def name(self, s):
        return struct.pack("<IHH", 0, 0, len(s)) + utf(s) + b"\0\0"

    def start(self, at, name, attributes=False):
        head = bytes([0x41 if attributes else 0x01]) + struct.pack("<HI", 0, 0) + struct.pack("<I", at + 11) + self.name(name)
        return head + (struct.pack("<I", 0) if attributes else b"")

    def template(self, at):
        out = b"\x0f\x01\x01\x00"
        add = lambda x: x
        out += self.start(at + len(out), "Event") + b"\x02"
        out += self.start(at + len(out), "System") + b"\x02"
        out += self.start(at + len(out), "Provider", True)
        out += b"\x06" + struct.pack("<I", at + len(out) + 5) + self.name("Name") + b"\x05\x01" + struct.pack("<H", 4) + utf("Prov") + b"\x03"
        for i, tag in enumerate(("EventID", "Level", "Channel", "Computer")):
            out += self.start(at + len(out), tag) + b"\x02" + b"\x0e" + struct.pack("<HB", i, (6, 4, 1, 1)[i]) + b"\x04"
        out += b"\x04"
        out += self.start(at + len(out), "EventData") + b"\x02"
        for i, label in ((4, "User"), (5, "Id")):
            out += self.start(at + len(out), "Data", True)
            out += b"\x06" + struct.pack("<I", at + len(out) + 5) + self.name("Name") + b"\x05\x01" + struct.pack("<H", len(label)) + utf(label) + b"\x02"
            out += b"\x0d" + struct.pack("<HB", i, 1) + b"\x04"
        return add(out) + b"\x04\x04\x00"

    def record(self, number, values, where=None):
        begin = len(self.data)
        at = begin + 24 + 4
        body = b"\x0f\x01\x01\x00" + b"\x0c\x01" + struct.pack("<I", 7)
        if where is None:
            where = at + 10
            inner = self.template(where + 24)
            body += struct.pack("<I", where) + struct.pack("<I16sI", 0, b"g" * 16, len(inner)) + inner
        else:
            body += struct.pack("<I", where)
        body += struct.pack("<I", len(values)) + b"".join(struct.pack("<HBB", len(v), k, 0) for k, v in values) + b"".join(v for _, v in values) + b"\0"
        size = 24 + len(body) + 4
        self.data += struct.pack("<IIQQ", 0x2A2A, size, number, TICKS + number * 10_000_000) + body + struct.pack("<I", size)
        return where

    def chunk(self):
        struct.pack_into("<I", self.data, 48, len(self.data))
        return bytes(self.data.ljust(65536, b"\0"))


def test_events_of_good_and_broken_chunks(spark, tmp_path):
    records.register(spark)
    log = Log()
    value = lambda user, n: [(6, struct.pack("<H", 4624)), (4, b"\4"), (1, utf("Security")), (1, utf("PC-1")), (1, utf(user)), (0x13, bytes([1, 2, 0, 0, 0, 0, 0, 5]) + struct.pack("<II", 32, n))]
    where = log.record(1, value("ann", 544))
    log.record(2, value("bö & co", 545), where)
    broken = Log()
    broken.record(3, value("lost", 1), 60_000)
    body = b"ElfFile\0".ljust(4096, b"\0") + log.chunk() + b"x" * 65536 + broken.chunk() + log.chunk()[:30000]
    (tmp_path / "Security.evtx").write_bytes(body)
    (tmp_path / "none.evtx").write_bytes(b"junk" * 5000)
    rows = spark.read.format("evtx").load(str(tmp_path / "*.evtx")).collect()
    assert sorted((r["record_id"], str(r["time_created_utc"]), r["event_id"], r["provider"], r["channel"], r["computer"], r["level"], r["event_data"]) for r in rows) == sorted([
        (1, "2024-01-01 00:00:01", "4624", "Prov", "Security", "PC-1", "4", '{"User":"ann","Id":"S-1-5-32-544"}'), (2, "2024-01-01 00:00:02", "4624", "Prov", "Security", "PC-1", "4", '{"User":"bö & co","Id":"S-1-5-32-545"}'),
    ] * 2)
    assert spark.read.format("evtx").load(str(tmp_path / "absent")).count() == 0
