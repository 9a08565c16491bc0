"""Registry hives as one flat table of keys and values."""

from __future__ import annotations

import glob
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from evidra.sources.records import _time

_BINS = 4096
#: Keys nested deeper, and values longer, than these are broken pointers rather than data.
DEEPEST, LONGEST = 512, 64 << 20
SCHEMA = "path string, key_path string, last_write timestamp, value_name string, value_type long, data binary"


class Hive:
    """A hive in memory; broken cells have no keys and values."""

    def __init__(self, data: bytes):
        if data[:4] != b"regf" or len(data) < _BINS:
            raise ValueError("not a hive")
        self.data = data
        self.root = struct.unpack_from("<I", data, 36)[0]

    def cell(self, offset: int) -> bytes:
        at = _BINS + offset
        if offset == 0xFFFFFFFF or at + 4 > len(self.data):
            return b""
        size = abs(struct.unpack_from("<i", self.data, at)[0])
        return self.data[at + 4 : at + size] if 8 <= size <= LONGEST else b""

    def children(self, offset: int, level: int = 0) -> Iterator[int]:
        """The keys of a list of keys: an index (lf, lh, li), or an index of such (ri)."""
        c = self.cell(offset)
        kind = c[:2]
        if kind not in (b"lf", b"lh", b"li", b"ri") or level > 4:
            return
        step = 8 if kind in (b"lf", b"lh") else 4
        for i in range(struct.unpack_from("<H", c, 2)[0]):
            if 4 + i * step + 4 > len(c):
                return
            below = struct.unpack_from("<I", c, 4 + i * step)[0]
            if kind == b"ri":
                yield from self.children(below, level + 1)
            else:
                yield below

    def content(self, size: int, offset: int, raw: bytes) -> bytes:
        """The data of a value: inside of its offset, in a cell, or in the segments of a large one."""
        if size & 0x80000000:
            return raw[: min(size & 0x7FFFFFFF, 4)]
        c = self.cell(offset)
        if size > 16344 and c[:2] == b"db":
            segments = self.cell(struct.unpack_from("<I", c, 4)[0])
            n = min(struct.unpack_from("<H", c, 2)[0], len(segments) // 4)
            return b"".join(self.cell(struct.unpack_from("<I", segments, 4 * i)[0])[:16344] for i in range(n))[:size]
        return c[:size]

    def rows(self) -> Iterator[tuple]:
        """(key_path, last_write ticks, value_name, value_type, data), a row without value for each key as well; the root's own name is left out of paths."""
        stack = [(self.root, "", 0)]
        seen: set[int] = set()
        while stack:
            offset, path, depth = stack.pop()
            c = self.cell(offset)
            if c[:2] != b"nk" or len(c) < 76 or depth > DEEPEST or offset in seen:
                continue
            seen.add(offset)
            flags, written = struct.unpack_from("<H", c, 2)[0], struct.unpack_from("<Q", c, 4)[0]
            n_keys, keys, n_values, values = struct.unpack_from("<I", c, 20)[0], struct.unpack_from("<I", c, 28)[0], *struct.unpack_from("<II", c, 36)
            name = c[76 : 76 + struct.unpack_from("<H", c, 72)[0]].decode("latin-1" if flags & 0x20 else "utf-16-le", "replace")
            if depth:
                path = f"{path}\\{name}" if path else name
            yield path, written, None, None, None
            listed = self.cell(values) if n_values else b""
            for i in range(min(n_values, len(listed) // 4)):
                v = self.cell(struct.unpack_from("<I", listed, 4 * i)[0])
                if v[:2] != b"vk" or len(v) < 20:
                    continue
                size, at, kind, ascii_name = *struct.unpack_from("<III", v, 4), struct.unpack_from("<H", v, 16)[0] & 1
                own = v[20 : 20 + struct.unpack_from("<H", v, 2)[0]].decode("latin-1" if ascii_name else "utf-16-le", "replace")
                yield path, written, own, kind, self.content(size, at, v[8:12])
            if n_keys:
                stack += [(k, path, depth + 1) for k in reversed([*self.children(keys)])]


class HiveFile(InputPartition):
    """One hive."""

    def __init__(self, path: str):
        self.path = path


class HiveSource(DataSource):
    """`spark.read.format("hive_file").load(pattern)`: all keys and values of the hives that a path or pattern names. One task reads one hive, whose pointers go anywhere; files that are none give no rows."""

    @classmethod
    def name(cls) -> str:
        return "hive_file"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        pattern = self.options["path"]

        class Reader(DataSourceReader):
            def partitions(self) -> list[HiveFile]:
                return [HiveFile(p) for p in sorted(glob.glob(pattern, recursive=True))] or [HiveFile("")]

            def read(self, part: HiveFile) -> Iterator[tuple]:
                if not part.path:
                    return
                try:
                    with open(part.path, "rb") as f:
                        hive = Hive(f.read())
                except (OSError, ValueError):
                    return
                for path, ticks, name, kind, data in hive.rows():
                    yield part.path, path, _time(ticks), name, kind, data

        return Reader()
