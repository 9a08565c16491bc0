"""Binary event logs, chunk by chunk."""

from __future__ import annotations

import datetime
import glob
import json
import os
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from evidra.sources.registry_names import guid_text, sid_text

CHUNK, HEAD = 65536, 4096
#: Chunks that one task reads; they don't refer to each other.
CHUNKS_A_TASK = 512
SCHEMA = "path string, record_id long, time_created_utc timestamp, event_id string, provider string, channel string, computer string, level string, event_data string"
_EPOCH = datetime.datetime(1601, 1, 1, tzinfo=datetime.timezone.utc)
_NUMBERS = {3: "<b", 4: "<B", 5: "<h", 6: "<H", 7: "<i", 8: "<I", 9: "<q", 10: "<Q", 11: "<f", 12: "<d"}


class Broken(ValueError):
    """Bytes that are no record."""


def moment(ticks: int) -> datetime.datetime:
    return _EPOCH + datetime.timedelta(microseconds=ticks // 10)


class Element:
    """A name, attributes, and contents: texts and elements."""

    def __init__(self, name: str):
        self.name, self.attributes, self.inside = name, {}, []

    def text(self) -> str:
        return "".join(x for x in self.inside if isinstance(x, str))

    def child(self, *names: str) -> Element | None:
        at = self
        for name in names:
            at = next((x for x in at.inside if isinstance(x, Element) and x.name == name), None)
            if at is None:
                return None
        return at


class Chunk:
    """The records of one chunk, whose names and templates are shared by offset."""

    def __init__(self, data: bytes):
        if data[:8] != b"ElfChnk\0":
            raise Broken("no chunk")
        self.data = data
        self.free = min(struct.unpack_from("<I", data, 48)[0], len(data))

    def unpack(self, form: str, at: int) -> tuple:
        if at < 0 or at + struct.calcsize(form) > len(self.data):
            raise Broken("past the end")
        return struct.unpack_from(form, self.data, at)

    def name(self, at: int) -> tuple[str, int]:
        """A name and how many bytes it takes."""
        n = self.unpack("<H", at + 6)[0]
        return self.data[at + 8 : at + 8 + 2 * n].decode("utf-16-le", "replace"), 10 + 2 * n

    def value(self, kind: int, at: int, size: int, level: int) -> list:
        """What a value of a type stands for, as contents of an element."""
        raw = self.data[at : at + size]
        if kind & 0x80:
            if kind == 0x81:
                return [", ".join(x for x in raw.decode("utf-16-le", "replace").split("\0") if x)]
            step = struct.calcsize(_NUMBERS.get(kind & 0x7F, "<B"))
            return [", ".join("".join(self.value(kind & 0x7F, at + i, step, level)) for i in range(0, size - step + 1, step))]
        if kind == 0 or not size:
            return []
        if kind == 1:
            return [raw.decode("utf-16-le", "replace").rstrip("\0")]
        if kind == 2:
            return [raw.decode("latin-1").rstrip("\0")]
        if kind in _NUMBERS and size >= struct.calcsize(_NUMBERS[kind]):
            return [str(struct.unpack_from(_NUMBERS[kind], raw)[0])]
        if kind == 13:
            return ["true" if any(raw) else "false"]
        if kind == 15 and size >= 16:
            return [guid_text(raw)]
        if kind == 17 and size >= 8:
            return [moment(struct.unpack_from("<Q", raw)[0]).isoformat().replace("+00:00", "Z")]
        if kind == 19 and size >= 8:
            return [sid_text(raw)]
        if kind in (16, 20, 21):
            return [hex(int.from_bytes(raw, "little"))]
        if kind == 33:
            return self.fragment(at, at + size, level + 1)[0]
        return [raw.hex()]

    def fragment(self, at: int, stop: int, level: int = 0, values: list | None = None) -> tuple[list, int]:
        """The contents that a stretch of tokens makes, and where it ends; `values` fill the places of a template."""
        if level > 32:
            raise Broken("nested too deep")
        root = Element("")
        stack = [root]
        attribute: str | None = None

        def put(x) -> None:
            nonlocal attribute
            if attribute is not None:
                stack[-1].attributes[attribute] = stack[-1].attributes.get(attribute, "") + (x if isinstance(x, str) else "")
            else:
                stack[-1].inside.append(x)

        while at < stop:
            token = self.unpack("<B", at)[0]
            kind = token & 0x0F if token != 0x0F else 0x0F
            at += 1
            if kind == 0x00:
                break
            if kind == 0x01:
                where = self.unpack("<I", at + 6)[0]
                at += 10
                name, size = self.name(where)
                at += size if where == at else 0
                at += 4 if token & 0x40 else 0
                attribute = None
                made = Element(name)
                stack[-1].inside.append(made)
                stack.append(made)
            elif kind == 0x02:
                attribute = None
            elif kind in (0x03, 0x04):
                attribute = None
                if len(stack) > 1:
                    stack.pop()
            elif kind == 0x05:
                value_kind, n = self.unpack("<BH", at)
                at += 3
                put(self.data[at : at + 2 * n].decode("utf-16-le", "replace") if value_kind == 1 else "")
                at += 2 * n
            elif kind == 0x06:
                where = self.unpack("<I", at)[0]
                at += 4
                attribute, size = self.name(where)
                at += size if where == at else 0
                stack[-1].attributes.setdefault(attribute, "")
            elif kind == 0x07:
                n = self.unpack("<H", at)[0]
                put(self.data[at + 2 : at + 2 + 2 * n].decode("utf-16-le", "replace"))
                at += 2 + 2 * n
            elif kind == 0x08:
                put(chr(self.unpack("<H", at)[0]))
                at += 2
            elif kind == 0x09:
                where = self.unpack("<I", at)[0]
                at += 4
                entity, size = self.name(where)
                at += size if where == at else 0
                put({"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}.get(entity, f"&{entity};"))
            elif kind == 0x0C:
                where = self.unpack("<I", at + 5)[0]
                at += 9
                size = self.unpack("<I", where + 20)[0]
                if where == at:
                    at += 24 + size
                count = self.unpack("<I", at)[0]
                at += 4
                if count > 65536:
                    raise Broken("too many values")
                heads = [self.unpack("<HB", at + 4 * i) for i in range(count)]
                at += 4 * count
                filled = []
                for n, value_kind in heads:
                    filled.append(self.value(value_kind, at, n, level))
                    at += n
                for x in self.fragment(where + 24, where + 24 + size, level + 1, filled)[0]:
                    put(x)
            elif kind in (0x0D, 0x0E):
                i = self.unpack("<H", at)[0]
                at += 3
                for x in values[i] if values and i < len(values) else ():
                    put(x)
            elif kind == 0x0F:
                at += 3
            else:
                raise Broken(f"token {token:#x}")
        return root.inside, at

    def records(self) -> Iterator[tuple[int, int, Element]]:
        """(record id, ticks, event); a record that is broken is passed over, and ends the chunk if its length is."""
        at = 512
        while at + 28 <= self.free:
            mark, size, number, ticks = self.unpack("<IIQQ", at)
            if mark != 0x2A2A or size < 28 or at + size > len(self.data):
                return
            try:
                made, _ = self.fragment(at + 24, at + size - 4)
                event = next((x for x in made if isinstance(x, Element)), None)
                if event is not None:
                    yield number, ticks, event
            except (Broken, struct.error):
                pass
            at += size


def event_data(event: Element) -> str:
    """What an event carries, as a JSON object: named data by name, others in a list, user data as nested objects."""
    out: dict = {}
    carried = event.child("EventData")
    for x in carried.inside if carried else ():
        if isinstance(x, Element):
            if "Name" in x.attributes:
                out[x.attributes["Name"]] = x.text()
            else:
                out.setdefault(x.name, []).append(x.text())

    def tree(e: Element):
        below = [x for x in e.inside if isinstance(x, Element)]
        return {x.name: tree(x) for x in below} if below else e.text()

    user = event.child("UserData")
    if user is not None:
        out |= tree(user) if isinstance(tree(user), dict) else {"UserData": tree(user)}
    return json.dumps(out, ensure_ascii=False, separators=(",", ":"))


def event_row(number: int, ticks: int, event: Element) -> tuple:
    """The row of one event."""
    text = lambda *names: x.text() if (x := event.child("System", *names)) is not None else ""
    attribute = lambda name, a: x.attributes.get(a, "") if (x := event.child("System", name)) is not None else ""
    return number, moment(ticks), text("EventID"), attribute("Provider", "Name"), text("Channel"), text("Computer"), text("Level"), event_data(event)


class Chunks(InputPartition):
    """Some chunks of one log."""

    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class EventLogSource(DataSource):
    """`spark.read.format("evtx").load(pattern)`: the events of the logs that a path or pattern names. Chunks stand alone, so a large log is read by several tasks; broken chunks and files give no rows."""

    @classmethod
    def name(cls) -> str:
        return "evtx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        pattern = self.options["path"]

        class Reader(DataSourceReader):
            def partitions(self) -> list[Chunks]:
                out = []
                for p in sorted(glob.glob(pattern, recursive=True)):
                    n = max(0, -(-(os.path.getsize(p) - HEAD) // CHUNK))
                    out += [Chunks(p, i, min(i + CHUNKS_A_TASK, n)) for i in range(0, n, CHUNKS_A_TASK)]
                return out or [Chunks("", 0, 0)]

            def read(self, part: Chunks) -> Iterator[tuple]:
                if not part.path:
                    return
                with open(part.path, "rb") as f:
                    if f.read(8) != b"ElfFile\0":
                        return
                    f.seek(HEAD + part.first * CHUNK)
                    for _ in range(part.first, part.last):
                        try:
                            chunk = Chunk(f.read(CHUNK))
                        except (Broken, struct.error):
                            continue
                        for record in chunk.records():
                            yield (part.path, *event_row(*record))

        return Reader()
