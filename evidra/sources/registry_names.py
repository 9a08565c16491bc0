"""Identifiers in their usual spelling."""

from __future__ import annotations

import struct


def guid_text(data: bytes) -> str:
    """A GUID of sixteen bytes."""
    a, b, c = struct.unpack_from("<IHH", data)
    tail = data[8:16].hex().upper()
    return f"{a:08X}-{b:04X}-{c:04X}-{tail[:4]}-{tail[4:]}"


def sid_text(data: bytes) -> str:
    """A security identifier."""
    n = min(data[1], (len(data) - 8) // 4)
    return "-".join(["S", str(data[0]), str(int.from_bytes(data[2:8], "big")), *map(str, struct.unpack_from(f"<{n}I", data, 8))])
