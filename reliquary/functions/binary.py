"""Fixed-width numbers in byte strings: plain readers, and Catalyst expressions for columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def be(data: bytes, at: int, size: int) -> int:
    return int.from_bytes(data[at : at + size], "big")


def le(data: bytes, at: int, size: int) -> int:
    return int.from_bytes(data[at : at + size], "little")


def signed(value: int, bits: int) -> int:
    return value - (1 << bits) if value >> (bits - 1) else value


def padded(data: bytes, block: int) -> bytes:
    return data + b"\0" * (-len(data) % block)


def mac_roman(data: bytes) -> str:
    return data.decode("mac_roman")


def pascal_string(data: bytes, at: int, most: int = 255) -> str:
    """A length byte and so many MacRoman characters; what lies beyond the data is missing."""
    if at >= len(data):
        return ""
    return mac_roman(data[at + 1 : at + 1 + min(data[at], most)])


def col_slice(data: Column, at: int, size: int) -> Column:
    return F.substring(data, at + 1, size)


def col_be(data: Column, at: int, size: int) -> Column:
    """Unsigned big-endian number; null where the data are too short."""
    return F.when(F.octet_length(data) >= at + size, F.conv(F.hex(col_slice(data, at, size)), 16, 10).cast("long"))


def col_le(data: Column, at: int, size: int) -> Column:
    pieces = [F.hex(col_slice(data, at + i, 1)) for i in reversed(range(size))]
    return F.when(F.octet_length(data) >= at + size, F.conv(F.concat(*pieces), 16, 10).cast("long"))


def col_starts(data: Column, magic: bytes, at: int = 0) -> Column:
    return F.coalesce(col_slice(data, at, len(magic)) == F.lit(magic), F.lit(False))


def col_crc16(data: Column, size: int) -> Column:
    """CRC-16/XMODEM of the first bytes, eight bits a step; null where the data are too short."""
    def step(crc: Column, at: Column) -> Column:
        mixed = F.shiftright(crc, 8).bitwiseXOR(F.conv(F.hex(F.substring(data, at, F.lit(1))), 16, 10).cast("int"))
        mixed = mixed.bitwiseXOR(F.shiftright(mixed, 4))
        return F.shiftleft(crc, 8).bitwiseXOR(F.shiftleft(mixed, 12)).bitwiseXOR(F.shiftleft(mixed, 5)).bitwiseXOR(mixed).bitwiseAND(0xFFFF)

    return F.when(F.octet_length(data) >= size, F.aggregate(F.sequence(F.lit(1), F.lit(size)), F.lit(0), step))


def col_padded_size(size: Column, block: int = 128) -> Column:
    return (F.floor((size + (block - 1)) / block) * block).cast("long")


#: Latin-1 shows byte n as code point n; the upper half then maps to what MacRoman has there.
_HIGH = "".join(map(chr, range(128, 256)))
_MAC_HIGH = bytes(range(128, 256)).decode("mac_roman")


def col_mac_roman(data: Column) -> Column:
    return F.translate(F.decode(data, "ISO-8859-1"), _HIGH, _MAC_HIGH)
