"""Dumped memory regions: images, strings and indicators inside."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.operators.triage import memory_tier

#: The shortest string, the machines of images.
SHORTEST = 6
MACHINES = {0x14C: "x86", 0x8664: "x64", 0x1C0: "arm", 0x1C4: "armnt", 0xAA64: "arm64"}
#: Fixed patterns and list: indicators in strings.
URL, QUAD, SHARE = r"https?://[^\s\"'<>|]+", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", r"\\\\[A-Za-z0-9._$-]+\\[^\s\"'<>|]+"
CALLS = (
    "VirtualAlloc", "VirtualProtect", "WriteProcessMemory", "ReadProcessMemory", "CreateRemoteThread", "NtCreateThreadEx", "QueueUserAPC", "SetWindowsHookEx", "LoadLibrary", "GetProcAddress", "GetModuleHandle",
    "WinExec", "ShellExecute", "CreateProcess", "NtUnmapViewOfSection", "RtlMoveMemory", "RtlCopyMemory", "NtAllocateVirtualMemory", "NtWriteVirtualMemory", "NtProtectVirtualMemory", "ResumeThread",
)
_ASCII = re.compile(rb"[\x20-\x7e]{%d,}" % SHORTEST)
_WIDE = re.compile(rb"(?:[\x20-\x7e]\x00){%d,}" % SHORTEST)


def images(data: bytes) -> list[tuple[int, str, bool, int]]:
    """(offset, machine, is a library, size) of each program image; what lies inside of one is not looked at."""
    out: list[tuple[int, str, bool, int]] = []
    at = data.find(b"MZ")
    while at >= 0:
        step = 1
        if at + 0x40 <= len(data):
            head = at + struct.unpack_from("<I", data, at + 0x3C)[0]
            if head > at and head + 24 <= len(data) and data[head : head + 4] == b"PE\0\0":
                machine, flags = struct.unpack_from("<H", data, head + 4)[0], struct.unpack_from("<H", data, head + 22)[0]
                if machine in MACHINES:
                    size = struct.unpack_from("<I", data, head + 80)[0] if head + 84 <= len(data) else 0
                    out.append((at, MACHINES[machine], bool(flags & 0x2000), size))
                    step = max(1, size)
        at = data.find(b"MZ", at + step)
    return out


def strings(data: bytes) -> tuple[list[str], list[str]]:
    """The runs of printable characters, one byte and two bytes wide."""
    return [m[0].decode("ascii") for m in _ASCII.finditer(data)], [m[0].decode("utf-16-le") for m in _WIDE.finditer(data)]


def indicators(texts: list[str]) -> dict[str, set[str]]:
    """Distinct addresses, quads, shares and calls; a text counts for the first kind that has it."""
    found: dict[str, set[str]] = {"urls": set(), "ips": set(), "unc": set(), "apis": set()}
    seen: set[str] = set()
    for t in texts:
        quads = [q for q in re.findall(QUAD, t, re.ASCII) if all(int(x) < 256 for x in q.split("."))]
        for kind, values in (("urls", re.findall(URL, t)), ("ips", quads), ("unc", re.findall(SHARE, t)), ("apis", [c for c in CALLS if c in t])):
            for v in values:
                if v not in seen:
                    seen.add(v)
                    found[kind].add(v)
    return found


def scan_regions(regions: DataFrame, blobs: DataFrame) -> DataFrame:
    """Regions (pid, name, base_addr, protect, blob_path and others) with what is in their blobs (path, content): n_images, n_strings, urls, ips, unc, apis, hits, tier. Regions without blob have none."""
    kind = "n_images int, n_strings int, urls array<string>, ips array<string>, unc array<string>, apis array<string>"

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for data in batch:
                one, two = strings(data or b"")
                found = indicators(one + two)
                rows.append((len(images(data or b"")), len(one) + len(two), *(sorted(found[k]) for k in ("urls", "ips", "unc", "apis"))))
            yield pd.DataFrame(rows, columns=["n_images", "n_strings", "urls", "ips", "unc", "apis"])

    scanned = blobs.select(F.col("path").alias("blob_path"), F.pandas_udf(scan, kind)("content").alias("s")).select("blob_path", "s.*")
    rows = regions.join(scanned, "blob_path", "left").na.fill(0, ["n_images", "n_strings"])
    hits = sum((F.size(F.coalesce(c, F.array().cast("array<string>"))) for c in ("urls", "ips", "unc", "apis")), F.lit(0))
    writable = F.upper(F.coalesce("protect", F.lit(""))).rlike("EXECUTE_(READWRITE|WRITECOPY)|RWX")
    return rows.withColumn("hits", hits).withColumn("tier", memory_tier(writable, F.col("n_images"), F.col("hits")))
