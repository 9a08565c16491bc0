"""Binary records of fixed or self-described length, as Python data sources that plan byte ranges."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MFT_RECORD = 1024
#: Bytes that one task reads.
SPLIT = 64 << 20
#: Fixed value: microseconds between 1601 and 1970.
_EPOCH = 11_644_473_600_000_000


class Range(InputPartition):
    """A stretch of a file."""

    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


def _ranges(path: str, split: int) -> list[Range]:
    size = os.path.getsize(path)
    return [Range(path, a, min(a + split, size)) for a in range(0, size, split)] or [Range(path, 0, 0)]


def _time(ticks: int):
    import datetime

    if not ticks or ticks // 10 - _EPOCH > 253_402_300_799_000_000:
        return None
    return datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(microseconds=ticks // 10 - _EPOCH)


def mft_record(buf: bytes) -> tuple | None:
    """filename and four times of one file record; None if it is none or has no name. Lengths that point outside of the record end it."""
    if buf[:4] != b"FILE":
        return None
    at = struct.unpack_from("<H", buf, 20)[0]
    name, times = "", (None,) * 4
    while at < MFT_RECORD - 8:
        kind, size = struct.unpack_from("<II", buf, at)
        if kind == 0xFFFFFFFF or size == 0 or at + size > MFT_RECORD:
            break
        if kind in (0x10, 0x30) and at + 22 <= MFT_RECORD:
            c = at + struct.unpack_from("<H", buf, at + 20)[0]
            if kind == 0x10 and c + 32 <= MFT_RECORD:
                times = tuple(map(_time, struct.unpack_from("<4Q", buf, c)))
            elif kind == 0x30 and c + 66 <= MFT_RECORD and c + 66 + buf[c + 64] * 2 <= MFT_RECORD:
                name = buf[c + 66 : c + 66 + buf[c + 64] * 2].decode("utf-16-le", "replace")
        at += size
    return (name, *times) if name else None


class MftSource(DataSource):
    """`spark.read.format("mft").load(path)`: the named records of a master file table. Records have a fixed length, so a file is split anywhere between them."""

    @classmethod
    def name(cls) -> str:
        return "mft"

    def schema(self) -> str:
        return "mft_record long, filename string, creation_time timestamp, modified_time timestamp, mft_modified_time timestamp, accessed_time timestamp"

    def reader(self, schema) -> DataSourceReader:
        path = self.options["path"]

        class Reader(DataSourceReader):
            def partitions(self) -> list[Range]:
                return _ranges(path, SPLIT // MFT_RECORD * MFT_RECORD)

            def read(self, part: Range) -> Iterator[tuple]:
                with open(part.path, "rb") as f:
                    f.seek(part.start)
                    for i in range(part.start // MFT_RECORD, part.stop // MFT_RECORD):
                        found = mft_record(f.read(MFT_RECORD))
                        if found:
                            yield (i, *found)

        return Reader()


def usn_records(data: bytes, start: int, stop: int) -> Iterator[tuple]:
    """(ticks, filename, reason mask) of the version-2 change-journal records that begin in [start, stop) of `data`; what is no record is passed over, eight bytes at a time, empty pages as a whole."""
    at = start
    while at < stop and at + 60 <= len(data):
        size, major = struct.unpack_from("<IH", data, at)
        if not size and data[at : at + 4096].count(0) == len(data[at : at + 4096]):
            at += 4096 - at % 4096
            continue
        if major != 2 or size < 60 or size > 65536 or size % 8 or at + size > len(data):
            at += 8
            continue
        ticks, reason = struct.unpack_from("<Q", data, at + 32)[0], struct.unpack_from("<I", data, at + 40)[0]
        length, offset = struct.unpack_from("<HH", data, at + 56)
        if offset < 60 or offset + length > size:
            at += 8
            continue
        yield ticks, data[at + offset : at + offset + length].decode("utf-16-le", "replace"), reason
        at += size


class UsnSource(DataSource):
    """`spark.read.format("usn").load(path)`: timestamp, filename and reason mask of a change journal. A task looks for the first record of its stretch itself; records begin at multiples of eight."""

    @classmethod
    def name(cls) -> str:
        return "usn"

    def schema(self) -> str:
        return "timestamp timestamp, filename string, reason_mask long"

    def reader(self, schema) -> DataSourceReader:
        path, split = self.options["path"], int(self.options.get("split", SPLIT)) // 8 * 8

        class Reader(DataSourceReader):
            def partitions(self) -> list[Range]:
                return _ranges(path, split)

            def read(self, part: Range) -> Iterator[tuple]:
                with open(part.path, "rb") as f:
                    # a record that began before may reach in: read from where one as long as may be could begin
                    lead = min(part.start, 65536)
                    f.seek(part.start - lead)
                    data = f.read(part.stop - part.start + lead + 65536)
                for ticks, name, reason in usn_from(data, lead, lead + part.stop - part.start):
                    yield _time(ticks), name, reason

        return Reader()


def usn_from(data: bytes, start: int, stop: int) -> Iterator[tuple]:
    """The records that begin in [start, stop), not those that only look like one inside a record that began before."""
    at = 0
    while at < start and at + 60 <= len(data):
        size, major = struct.unpack_from("<IH", data, at)
        at += size if major == 2 and 60 <= size <= 65536 and not size % 8 and at + size <= len(data) else 8
    yield from usn_records(data, max(at, start), stop)


def userassist_value(data: bytes) -> tuple | None:
    """(run_count, focus_count, focus_time_ms, last run) of the binary value of a shell counter; None if it is too short."""
    if len(data) < 68:
        return None
    runs, focus, ms = struct.unpack_from("<III", data, 4)
    return runs, focus, ms, _time(struct.unpack_from("<Q", data, 60)[0])


def xor_codec(data: bytes, key: bytes, offset: int = 0) -> bytes:
    """Bytes under a repeating key, from a place in it; the same call undoes it."""
    if not key:
        return data
    reps = key[offset % len(key) :] + key * (len(data) // len(key) + 1)
    return bytes(a ^ b for a, b in zip(data, reps))


def zip_entries(content: bytes, password: bytes | None = None) -> Iterator[tuple[str, bytes]]:
    """The files of a zip archive, also of an encrypted one; an archive that is none has none."""
    import io
    import zipfile

    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    yield info.filename, z.read(info, password)
    except (zipfile.BadZipFile, RuntimeError):
        return


def register(spark) -> None:
    """Make the formats mft, usn, hive_file and evtx known to a session."""
    from evidra.sources.event_logs import EventLogSource
    from evidra.sources.hives import HiveSource

    for source in (MftSource, UsnSource, HiveSource, EventLogSource):
        spark.dataSource.register(source)
