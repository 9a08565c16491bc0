"""Decompression of the Xpress Huffman format (MS-XCA 2.2), in which newer prefetch files are stored."""

from __future__ import annotations

import struct

_CHUNK, _SYMBOLS, _DEEPEST = 65536, 512, 15


def _decoder(lengths: list[int]) -> list[int]:
    """The symbol of every possible next 15 bits, by canonical codes: shorter codes first, of equal length the lesser symbol."""
    table: list[int] = []
    for size in range(1, _DEEPEST + 1):
        for symbol, own in enumerate(lengths):
            if own == size:
                table += [symbol] * (1 << (_DEEPEST - size))
    if len(table) != 1 << _DEEPEST:
        raise ValueError("code lengths don't fill the code space")
    return table


def decompress(data: bytes, size: int) -> bytes:
    """The `size` bytes that were compressed; ValueError for data that isn't of this format or ends too early."""
    out = bytearray()
    at = 0
    try:
        while len(out) < size:
            lengths = [n for b in data[at : at + _SYMBOLS // 2] for n in (b & 15, b >> 4)]
            decode = _decoder(lengths)
            at += _SYMBOLS // 2
            high, low = struct.unpack_from("<HH", data, at)
            at += 4
            bits, spare = high << 16 | low, 16

            def drop(n: int) -> None:
                nonlocal bits, spare, at
                bits = bits << n & 0xFFFFFFFF
                spare -= n
                if spare < 0:
                    # past the end of the last chunk only zeros are read
                    word = struct.unpack_from("<H", data, at)[0] if at + 2 <= len(data) else 0
                    bits |= word << -spare
                    at += 2
                    spare += 16

            until = min(size, len(out) + _CHUNK)
            while len(out) < until:
                symbol = decode[bits >> 17]
                drop(lengths[symbol])
                if symbol < 256:
                    out.append(symbol)
                    continue
                length, places = symbol & 15, symbol - 256 >> 4
                if length == 15:
                    length = data[at] + 15
                    at += 1
                    if length == 255 + 15:
                        length = struct.unpack_from("<H", data, at)[0]
                        at += 2
                        if not length:
                            length = struct.unpack_from("<I", data, at)[0]
                            at += 4
                offset = (bits >> (32 - places) if places else 0) + (1 << places)
                drop(places)
                if offset > len(out):
                    raise ValueError("a match before the beginning")
                for _ in range(min(length + 3, size - len(out))):
                    out.append(out[-offset])
    except (struct.error, IndexError) as e:
        raise ValueError("compressed data end too early") from e
    return bytes(out)
