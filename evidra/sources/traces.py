"""Execution traces and recent documents: prefetch files, jump lists and collected web files, read through Spark's file systems."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators.correlate import SCRIPT_EXTENSIONS
from evidra.operators.triage import STRONG_TOKENS, WEAK_TOKENS, web_file_triage
from evidra.sources.lzxpress import decompress
from evidra.sources.records import _time, xor_codec, zip_entries


def _decoded(spark: SparkSession, paths: str | Sequence[str], decode, schema: str, columns: list[str]) -> DataFrame:
    """The rows that `decode(path, content)` gives for each file; a file is read by one task, wherever it is stored. Files that can't be decoded give none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows = list(decode(path, bytes(content)))
                except (ValueError, struct.error, IndexError):
                    continue
                if rows:
                    yield pd.DataFrame(rows, columns=columns, dtype=object)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths if isinstance(paths, str) else [*paths])
    return files.select("path", "content").mapInPandas(read, schema)


def _text(data: bytes) -> str:
    """UTF-16 text up to its end mark."""
    return data[: len(data) // 2 * 2].decode("utf-16-le", "replace").split("\0")[0]


# --- prefetch -----------------------------------------------------------------------------------------------------

#: Fixed values of each version: its name, where run times and the run count stand, and how many times there are.
PREFETCH_VERSIONS = {17: ("WinXP (17)", 120, 144, 1), 23: ("Vista (23)", 128, 152, 1), 26: ("Win8.1 (26)", 128, 208, 8), 30: ("Win10 (30)", 128, 208, 8), 31: ("Win11 (31)", 128, 200, 8)}
#: Fixed list: folders of programs that belong to the system.
BASELINE_FOLDERS = ("\\WINDOWS\\SYSTEM32\\", "\\WINDOWS\\SYSWOW64\\", "\\WINDOWS\\WINSXS\\", "\\WINDOWS\\SERVICING\\")
_PREFETCH = ["prefetch_filename", "executable", "path", "hash", "version", "file_size", "run_count", "files_accessed", "run_times"]


def prefetch_record(name: str, data: bytes) -> tuple:
    """One prefetch file, compressed or not; ValueError for any other file."""
    if data[:3] == b"MAM":
        start = 12 if data[3] & 0xF0 else 8  # with a checksum or without
        data = decompress(data[start:], struct.unpack_from("<I", data, 4)[0])
    version, sign, _, size = struct.unpack_from("<I4sII", data, 0)
    if sign != b"SCCA" or version not in PREFETCH_VERSIONS:
        raise ValueError("no prefetch file")
    label, at, count_at, n = PREFETCH_VERSIONS[version]
    if version == 30 and struct.unpack_from("<I", data, 84)[0] == 296:
        count_at = 200  # the later of two layouts
    executable = _text(data[16:76])
    strings, length = struct.unpack_from("<II", data, 100)
    files = [x for x in data[strings : strings + length // 2 * 2].decode("utf-16-le", "replace").split("\0") if x]
    path = next((x for x in files if x.rpartition("\\")[2].upper() == executable.upper()), "")
    times = [t for t in map(_time, struct.unpack_from(f"<{n}Q", data, at)) if t is not None]
    return name, executable, path, f"{struct.unpack_from('<I', data, 76)[0]:X}", label, size, struct.unpack_from("<I", data, count_at)[0], files, times


def prefetch_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Prefetch files, a row for each run time: prefetch_filename, executable, path, hash, version, file_size, run_count,
    files_accessed_count, files_accessed, run_index (-1 and no time if there is none), run_time_utc, is_baseline.

    Files that are no prefetch files, or are cut off, give no rows.
    """

    def decode(path: str, content: bytes) -> Iterator[tuple]:
        yield prefetch_record(path.rpartition("/")[2], content)

    kind = "prefetch_filename string, executable string, path string, hash string, version string, file_size long, run_count long, files_accessed array<string>, run_times array<timestamp>"
    rows = _decoded(spark, paths, decode, kind, _PREFETCH)
    rows = rows.select("*", F.posexplode_outer("run_times").alias("i", "run_time_utc"))
    system = F.lit(False)
    for x in BASELINE_FOLDERS:
        system = system | F.contains(F.upper("path"), F.lit(x))
    return rows.select(
        "prefetch_filename", "executable", "path", "hash", "version", "file_size", "run_count", F.size("files_accessed").alias("files_accessed_count"),
        F.array_join("files_accessed", "|").alias("files_accessed"), F.coalesce("i", F.lit(-1)).alias("run_index"), "run_time_utc", system.alias("is_baseline"),
    )


# --- jump lists ---------------------------------------------------------------------------------------------------

_LINK_SIGN = bytes.fromhex("4c000000 01140200 00000000 c0000000 00000046")
_END = 0xFFFFFFFA  # sector numbers from here on are none


def compound_streams(data: bytes) -> dict[str, bytes]:
    """The streams of an OLE compound file by name, in lower case; ValueError for any other file."""
    if data[:8] != bytes.fromhex("d0cf11e0a1b11ae1"):
        raise ValueError("no compound file")
    shift, small_shift = struct.unpack_from("<HH", data, 30)
    directory = struct.unpack_from("<I", data, 48)[0]
    cutoff, small_fat_at, _, more_at = struct.unpack_from("<4I", data, 56)
    size = 1 << shift
    sector = lambda n: data[(n + 1) << shift : (n + 2) << shift]
    numbers = lambda raw: struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])

    parts, at, seen = list(struct.unpack_from("<109I", data, 76)), more_at, set()
    while at < _END and at not in seen:
        seen.add(at)
        own = numbers(sector(at))
        parts, at = parts + list(own[:-1]), own[-1] if own else _END
    fat = [x for p in parts if p < _END for x in numbers(sector(p))]

    def chain(at: int, table: Sequence[int], piece) -> bytes:
        out, seen = [], set()
        while at < len(table) and at not in seen:
            seen.add(at)
            out.append(piece(at))
            at = table[at]
        return b"".join(out)

    entries = chain(directory, fat, sector)
    found, small, small_fat = {}, b"", numbers(chain(small_fat_at, fat, sector))
    for i in range(0, len(entries) - 127, 128):
        length, kind = struct.unpack_from("<HB", entries, i + 64)
        start, n = struct.unpack_from("<IQ", entries, i + 116)
        n &= 0xFFFFFFFF if size == 512 else 0xFFFFFFFFFFFFFFFF
        if kind == 5:
            small = chain(start, fat, sector)
        elif kind == 2:
            found[entries[i : i + max(0, length - 2)].decode("utf-16-le", "replace").lower()] = (start, n)
    piece = lambda n: small[n << small_shift : (n + 1) << small_shift]
    return {name: (chain(start, small_fat, piece) if n < cutoff else chain(start, fat, sector))[:n] for name, (start, n) in found.items()}


def shell_link(data: bytes) -> dict:
    """Times, path and arguments of a shell link; ValueError for any other data."""
    if data[:20] != _LINK_SIGN or len(data) < 76:
        raise ValueError("no shell link")
    flags = struct.unpack_from("<I", data, 20)[0]
    out = dict(zip(("created", "accessed", "modified"), map(_time, struct.unpack_from("<3Q", data, 28))))
    at, path = 76, ""
    if flags & 1:
        at += 2 + struct.unpack_from("<H", data, at)[0]
    if flags & 2:
        size, head, kinds = struct.unpack_from("<III", data, at)
        info = data[at : at + size]
        if kinds & 1:
            place = struct.unpack_from("<I", info, 16)[0]
            path = info[place:].split(b"\0")[0].decode("latin-1")
            if head >= 0x24:
                path = _text(info[struct.unpack_from("<I", info, 28)[0] :]) or path
        at += size
    strings = {}
    for bit, name in ((4, "name"), (8, "relative"), (16, "folder"), (32, "arguments"), (64, "icon")):
        if flags & bit:
            n = struct.unpack_from("<H", data, at)[0] * (2 if flags & 128 else 1)
            raw = data[at + 2 : at + 2 + n]
            strings[name] = raw.decode("utf-16-le", "replace") if flags & 128 else raw.decode("latin-1")
            at += 2 + n
    return out | {"path": path or strings.get("relative", ""), "arguments": strings.get("arguments", "")}


def _safe_link(data: bytes) -> dict:
    try:
        return shell_link(data)
    except (ValueError, struct.error):
        return {}


_JUMP = ["sid", "type", "app_id", "entry_id", "path", "arguments", "access_count", "pinned", "last_accessed_utc", "lnk_created_utc", "lnk_modified_utc", "lnk_accessed_utc"]


def automatic_entries(data: bytes) -> Iterator[tuple]:
    """The entries of an automatic jump list, each with the link stream that its id names in hexadecimal; what follows a cut is left out."""
    streams = compound_streams(data)
    listed = streams.get("destlist", b"")
    if len(listed) < 32:
        return
    version, total = struct.unpack_from("<II", listed, 0)
    # where the length of the path stands, by version
    at, head = 32, 112 if version in (1, 2) else 128
    for _ in range(total if version else 0):
        if at + head + 2 > len(listed):
            return
        entry, ticks, pin = struct.unpack_from("<I8xQI", listed, at + 88)
        count = struct.unpack_from("<I", listed, at + 112)[0] if version > 1 else None
        size = struct.unpack_from("<H", listed, at + head)[0] * 2
        if at + head + 2 + size > len(listed):
            return
        path = listed[at + head + 2 : at + head + 2 + size].decode("utf-16-le", "replace")
        link = _safe_link(streams.get(f"{entry:x}", b""))
        yield str(entry), path or link.get("path", ""), link.get("arguments", ""), count, pin != 0xFFFFFFFF, _time(ticks), link.get("created"), link.get("modified"), link.get("accessed")
        at += head + 2 + size + 4


def custom_entries(data: bytes) -> Iterator[tuple]:
    """The links of a custom jump list, wherever their signature stands."""
    links = [x for m in re.finditer(re.escape(_LINK_SIGN), data) if (x := _safe_link(data[m.start() :]))]
    for i, x in enumerate(links):
        yield str(i), x["path"], x["arguments"], None, False, None, x["created"], x["modified"], x["accessed"]


def jump_lists(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Recent documents of automatic and custom jump lists: sid (the folder above, if it is one), type, app_id (from the file's name), entry_id, path,
    arguments, access_count, pinned, last_accessed_utc, lnk_created_utc, lnk_modified_utc, lnk_accessed_utc. Files of neither kind give no rows."""

    def decode(path: str, content: bytes) -> Iterator[tuple]:
        app, _, end = path.rpartition("/")[2].partition(".")
        sid = next((x for x in reversed(path.split("/")[:-1]) if x.startswith("S-1-")), "")
        kind, entries = ("automatic", automatic_entries) if end.lower().startswith("automatic") else ("custom", custom_entries)
        for entry, target, arguments, count, pinned, last, *times in entries(content):
            yield sid, kind, app, entry, target, arguments, count, pinned, last, *times

    kind = "sid string, type string, app_id string, entry_id string, path string, arguments string, access_count long, pinned boolean, last_accessed_utc timestamp, lnk_created_utc timestamp, lnk_modified_utc timestamp, lnk_accessed_utc timestamp"
    return _decoded(spark, paths, decode, kind, _JUMP)


# --- web files ----------------------------------------------------------------------------------------------------


def web_files(spark: SparkSession, paths: str | Sequence[str], strong: Sequence[str] = STRONG_TOKENS, weak: Sequence[str] = WEAK_TOKENS, password: bytes | None = None, key: bytes = b"", suffix: str = ".qtn", below: str = "web") -> DataFrame:
    """Collected scripts of web servers, triaged by tokens: relative_path, filename, extension, size_bytes, sha256, triage, strong_indicators, weak_indicators, indicators.

    They come from zip containers, encrypted with `password` or not, and from loose files in a folder named `below`, those
    that end in `suffix` under a repeating `key`. Sizes and hashes are those of the original files; whole files are
    searched. Files that aren't scripts, and containers that can't be opened, give no rows.
    """

    def decode(path: str, content: bytes) -> Iterator[tuple]:
        parts = path.split("/")
        if content[:2] == b"PK" and not path.endswith(suffix):
            entries = zip_entries(content, password)
        else:
            inside = parts[len(parts) - parts[::-1].index(below) :] if below in parts[:-1] else parts[-1:]
            name = "/".join(inside)
            entries = [(name.removesuffix(suffix), xor_codec(content, key) if name.endswith(suffix) else content)]
        for name, data in entries:
            base = name.rpartition("/")[2]
            extension = base[base.rfind(".") :].lower() if "." in base else ""
            if extension in SCRIPT_EXTENSIONS:
                yield name, base, extension, len(data), hashlib.sha256(data).hexdigest(), data.decode("latin-1")

    columns = ["relative_path", "filename", "extension", "size_bytes", "sha256", "text"]
    rows = _decoded(spark, paths, decode, "relative_path string, filename string, extension string, size_bytes long, sha256 string, text string", columns)
    found = web_file_triage(rows, "text", strong, weak)
    return found.select(*columns[:-1], "triage", F.col("strong").alias("strong_indicators"), F.col("weak").alias("weak_indicators"), "indicators")
