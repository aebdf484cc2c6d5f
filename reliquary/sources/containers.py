"""Two-fork container formats: readers and writers of whole files as bytes.

A reader gives files as dicts with the keys of FILE; what is out of range ends it with what it has.
"""

from __future__ import annotations

import struct
from datetime import datetime, timedelta

import numpy as np

from ..functions.binary import be, le, mac_roman, padded, pascal_string
from ..functions.codecs import crc16, repeat, unrepeat, unsqueeze

FILE = {"name": "", "data_fork": b"", "rsrc_fork": b"", "type_code": None, "creator_code": None, "finder_flags": 0, "created": None, "modified": None}
EPOCH = datetime(1970, 1, 1)
MAC_EPOCH, Y2K = 2082844800, 946684800


class ContainerError(ValueError):
    """kind: invalid format, corrupted data or unsupported format."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


def file(**known) -> dict:
    return FILE | known


def mac_date(seconds: int) -> datetime | None:
    return EPOCH + timedelta(seconds=seconds - MAC_EPOCH) if seconds else None


def mac_seconds(when: datetime | None) -> int:
    return int((when - EPOCH).total_seconds()) + MAC_EPOCH if when else 0


def prodos_date(value: int, time: int, hours: int = 0xFF, minutes: int = 0xFF) -> datetime | None:
    """Years under 40 are 20xx; day and month are clamped, and a day past the month's end rolls over."""
    if not value:
        return None
    y, m, d = value >> 9, min(max(value >> 5 & 15, 1), 12), min(max(value & 31, 1), 31)
    day = datetime(2000 + y if y < 40 else 1900 + y, m, 1) + timedelta(days=d - 1)
    return day + timedelta(hours=min(time >> 8 & hours, 23), minutes=min(time & minutes, 59))


# MacBinary


def is_macbinary(data: bytes) -> bool:
    if len(data) < 128 or data[0] or data[74] or data[82] or not 1 <= data[1] <= 63:
        return False
    size, rsrc = be(data, 83, 4), be(data, 87, 4)
    if not size + rsrc or size >= 1 << 31 or rsrc >= 1 << 31:
        return False
    pad = lambda n: n + -n % 128
    expected = 128 + pad(be(data, 120, 2)) + pad(size) + pad(rsrc)
    return expected - 127 <= len(data) <= expected + 8192


def is_empty_macbinary(data: bytes) -> bool:
    """A file without forks, which is_macbinary takes for chance: version II or III, with the checksum that its header asks for."""
    if len(data) < 128 or data[0] or data[74] or data[82] or any(data[83:91]) or not 1 <= data[1] <= 63:
        return False
    expected = 128 + be(data, 120, 2) + -be(data, 120, 2) % 128
    return expected - 127 <= len(data) <= expected + 8192 and data[122] in (0x81, 0x82) and be(data, 124, 2) == crc16(data[:124])


def _is_macbinary_or_empty(data: bytes) -> bool:
    return is_macbinary(data) or is_empty_macbinary(data)


def macbinary_version(data: bytes) -> int | None:
    return {0x82: 3, 0x81: 2}.get(data[122], 1) if _is_macbinary_or_empty(data) else None


def read_macbinary(data: bytes) -> dict:
    if not _is_macbinary_or_empty(data):
        raise ContainerError("invalid format", "not a MacBinary file")
    size, rsrc, at = be(data, 83, 4), be(data, 87, 4), 128 + be(data, 120, 2) + -be(data, 120, 2) % 128
    second = at + size + -size % 128
    return file(
        name=pascal_string(data, 1, 63), data_fork=data[at : at + size], rsrc_fork=data[second : second + rsrc], type_code=mac_roman(data[65:69]), creator_code=mac_roman(data[69:73]),
        finder_flags=data[73] << 8 | data[101], created=mac_date(be(data, 91, 4)), modified=mac_date(be(data, 95, 4)),
    )


def write_macbinary(f: dict, version: int = 2) -> bytes:
    head = bytearray(128)
    name = f["name"].encode("mac_roman", "replace")[:63]
    code = lambda c: (c or "").encode("mac_roman", "replace")[:4].ljust(4, b"\0")
    head[1 : 2 + len(name)] = bytes([len(name)]) + name
    head[65:73] = code(f["type_code"]) + code(f["creator_code"])
    head[73], head[101] = f["finder_flags"] >> 8 & 255, f["finder_flags"] & 255
    struct.pack_into(">IIII", head, 83, len(f["data_fork"]), len(f["rsrc_fork"]), mac_seconds(f["created"]), mac_seconds(f["modified"]))
    head[122] = {1: 0, 2: 0x81, 3: 0x82}[version]
    head[123] = 0x81 if version > 1 else 0
    struct.pack_into(">H", head, 124, crc16(bytes(head[:124])))
    return bytes(head) + padded(f["data_fork"], 128) + padded(f["rsrc_fork"], 128)


# BinHex 4.0

BINHEX_MARK = b"(This file must be converted with BinHex"
#: The 64 characters in order.
BINHEX = b"!\"#$%&'()*+,-012345689@ABCDEFGHIJKLMNPQRSTUVXYZ[`abcdefhijklmpqr"
_FROM_BINHEX = np.full(256, 64, np.uint8)
_FROM_BINHEX[np.frombuffer(BINHEX, np.uint8)] = np.arange(64)


def is_binhex(data: bytes) -> bool:
    head = data[:256]
    return head.isascii() and BINHEX_MARK in head


def read_binhex(data: bytes) -> dict:
    if not is_binhex(data):
        raise ContainerError("invalid format", "no BinHex marker")
    start = data.find(b":", data.find(BINHEX_MARK) + len(BINHEX_MARK))
    end = data.find(b":", start + 1)
    if start < 0:
        raise ContainerError("corrupted data", "no BinHex text")
    values = _FROM_BINHEX[np.frombuffer(data[start + 1 : end if end > 0 else len(data)], np.uint8)]
    values = values[values < 64]
    bits = np.unpackbits(values[:, None], axis=1)[:, 2:].reshape(-1)
    raw = unrepeat(np.packbits(bits[: len(bits) // 8 * 8]).tobytes())
    if not raw or len(raw) < 2 + raw[0] + 20:
        raise ContainerError("corrupted data", "BinHex header ends early")
    at = 2 + raw[0]
    size, rsrc = be(raw, at + 10, 4), be(raw, at + 14, 4)
    first = at + 20
    second = first + size + 2
    if first + size > len(raw):
        raise ContainerError("corrupted data", "BinHex data fork ends early")
    fork = raw[second : second + rsrc]
    return file(name=pascal_string(raw, 0), data_fork=raw[first : first + size], rsrc_fork=fork if len(fork) == rsrc else b"", type_code=mac_roman(raw[at : at + 4]), creator_code=mac_roman(raw[at + 4 : at + 8]), finder_flags=be(raw, at + 8, 2))


def write_binhex(f: dict) -> bytes:
    name = f["name"].encode("mac_roman", "replace")[:63]
    code = lambda c: (c or "").encode("mac_roman", "replace")[:4].ljust(4, b"\0")
    head = bytes([len(name)]) + name + b"\0" + code(f["type_code"]) + code(f["creator_code"]) + struct.pack(">HII", f["finder_flags"], len(f["data_fork"]), len(f["rsrc_fork"]))
    raw = b"".join(part + struct.pack(">H", crc16(part)) for part in (head, f["data_fork"], f["rsrc_fork"]))
    raw = repeat(raw)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8))
    sixes = np.pad(bits, (0, -len(bits) % 6)).reshape(-1, 6)
    values = np.packbits(sixes, axis=1)[:, 0] >> 2
    text = b":" + np.frombuffer(BINHEX, np.uint8)[values].tobytes() + b":"
    return BINHEX_MARK + b" 4.0)\n\n" + b"\n".join(text[i : i + 64] for i in range(0, len(text), 64)) + b"\n"


# AppleSingle and AppleDouble

SINGLE, DOUBLE = 0x00051600, 0x00051607


def apple_order(data: bytes) -> str | None:
    """Byte order of an AppleSingle or AppleDouble file; its version counts for big-endian ones only."""
    if len(data) < 26:
        return None
    if be(data, 0, 4) in (SINGLE, DOUBLE):
        return "big" if be(data, 4, 4) in (0x00010000, 0x00020000) else None
    return "little" if le(data, 0, 4) in (SINGLE, DOUBLE) else None


def read_apple(data: bytes) -> dict:
    order = apple_order(data)
    if not order:
        raise ContainerError("invalid format", "neither AppleSingle nor AppleDouble")
    number = lambda at, size: int.from_bytes(data[at : at + size], order)
    out = file()
    for i in range(number(24, 2)):
        at = 26 + 12 * i
        if at + 12 > len(data):
            break
        kind, start, size = (number(at + 4 * k, 4) for k in range(3))
        if start + size > len(data):
            continue
        part = data[start : start + size]
        if kind == 1:
            out["data_fork"] = part
        elif kind == 2:
            out["rsrc_fork"] = part
        elif kind == 3:
            out["name"] = mac_roman(part)
        elif kind == 8 and size >= 8:
            when = lambda k: EPOCH + timedelta(seconds=Y2K + int.from_bytes(part[k : k + 4], order, signed=True))  # noqa: B023, E731
            out["created"], out["modified"] = when(0), when(4)
        elif kind == 9 and size >= 10:
            out["type_code"], out["creator_code"], out["finder_flags"] = mac_roman(part[:4]), mac_roman(part[4:8]), be(part, 8, 2)
    return out


def write_apple_single(f: dict, order: str = "big", magic: int = SINGLE) -> bytes:
    mark = ">" if order == "big" else "<"
    seconds = lambda d: int((d - EPOCH).total_seconds()) - Y2K
    code = lambda c: (c or "").encode("mac_roman", "replace")[:4].ljust(4, b"\0")
    parts = [(3, f["name"].encode("mac_roman", "replace")), (9, code(f["type_code"]) + code(f["creator_code"]) + struct.pack(">H", f["finder_flags"]) + b"\0" * 22)]
    if f["created"] and f["modified"]:
        parts.append((8, struct.pack(mark + "4i", seconds(f["created"]), seconds(f["modified"]), 0, 0)))
    parts += [(1, f["data_fork"]), (2, f["rsrc_fork"])]
    at, table, body = 26 + 12 * len(parts), b"", b""
    for kind, part in parts:
        table += struct.pack(mark + "III", kind, at + len(body), len(part))
        body += part
    return struct.pack(mark + "II16xH", magic, 0x00020000, len(parts)) + table + body


# Binary II

BINARY_II = b"\x0aGL"


def is_binary_ii(data: bytes) -> bool:
    return len(data) >= 128 and data[:3] == BINARY_II and data[18] == 2


def read_binary_ii(data: bytes) -> list[dict]:
    if not is_binary_ii(data):
        raise ContainerError("invalid format", "not a Binary II file")
    out, at = [], 0
    while is_binary_ii(data[at : at + 128]):
        h = data[at : at + 128]
        size, n = le(h, 20, 3), min(h[23], 64)
        part = data[at + 128 : at + 128 + size]
        directory = h[4] == 0x0F or h[7] == 0x0D
        if size and not directory:
            if len(part) < size:
                break
            out.append(file(
                name=(h[24 : 24 + n]).decode("latin-1"), data_fork=part, type_code=f"${h[4]:02X}", creator_code=f"${le(h, 5, 2):04X}",
                created=prodos_date(le(h, 14, 2), le(h, 16, 2)), modified=prodos_date(le(h, 10, 2), le(h, 12, 2)),
            ))
        at += 128 + size + -size % 128
    return out


def write_binary_ii(files: list[tuple[str, int, int, bytes]]) -> bytes:
    """(name, ProDOS type, aux type, data); type 0x0F is a directory."""
    out = b""
    for i, (name, kind, aux, data) in enumerate(files):
        h = bytearray(128)
        raw = name.encode("latin-1", "replace")[:64]
        h[0:3], h[3], h[4], h[18] = BINARY_II, 0xC3, kind, 2
        h[5:7] = struct.pack("<H", aux)
        h[20:23] = len(data).to_bytes(3, "little")
        h[23], h[24 : 24 + len(raw)], h[127] = len(raw), raw, len(files) - 1 - i
        out += bytes(h) + padded(data, 128)
    return out


# AppleLink packages

LINK_RECORD = 0x36


def is_apple_link(data: bytes) -> bool:
    return len(data) >= 20 and data[4:9] == b"fZink" and data[9] == 1


def read_apple_link(data: bytes) -> list[dict]:
    """Records of 0x36 bytes, each followed by its name, resource fork and data fork; stored and
    squeezed forks are read, directories and files without any content are left out."""
    if not is_apple_link(data):
        raise ContainerError("invalid format", "not an AppleLink package")
    out, at = [], 20
    for number in range(le(data, 0, 2)):
        r = data[at : at + LINK_RECORD]
        name_end = at + LINK_RECORD + le(r, 0x32, 2)
        sizes = [le(r, 0x0E, 4), le(r, 0x12, 4)]
        if len(r) < LINK_RECORD or name_end + sum(sizes) > len(data):
            break
        name = data[at + LINK_RECORD : name_end].decode("latin-1") or f"file_{number}"
        forks, at = [], name_end
        for method, packed, size in zip(r[:2], sizes, (le(r, 0x22, 4), le(r, 0x26, 4)), strict=True):
            part, at = data[at : at + packed], at + packed
            forks.append(part if method == 0 else unsqueeze(part)[0][:size] if method == 3 else b"")
        if any(forks) and le(r, 0x20, 2) != 0x0D:
            out.append(file(
                name=name, data_fork=forks[1], rsrc_fork=forks[0], type_code=f"${r[0x18]:02X}", creator_code=f"${le(r, 0x1A, 2):04X}",
                created=prodos_date(le(r, 0x2A, 2), le(r, 0x2C, 2)), modified=prodos_date(le(r, 0x2E, 2), le(r, 0x30, 2)),
            ))
    return out


def write_apple_link(files: list[tuple[str, int, int, bytes, bytes]]) -> bytes:
    """(name, type, aux type, data fork, resource fork), stored."""
    out = bytearray(20)
    out[0:2], out[4:9], out[9] = struct.pack("<H", len(files)), b"fZink", 1
    for name, kind, aux, data, rsrc in files:
        raw, r = name.encode("latin-1", "replace"), bytearray(LINK_RECORD)
        struct.pack_into("<II", r, 0x0E, len(rsrc), len(data))
        r[0x18], r[0x1A:0x1C] = kind, struct.pack("<H", aux)
        struct.pack_into("<II", r, 0x22, len(rsrc), len(data))
        struct.pack_into("<H", r, 0x32, len(raw))
        out += bytes(r) + raw + rsrc + data
    return bytes(out)


# Recognition

FORMATS = ("macbinary", "applesingle", "binhex", "binary_ii", "applelink")
BY_EXTENSION = {"bin": "macbinary", "hqx": "binhex", "bny": "binary_ii", "bqy": "binary_ii", "acu": "applelink"}


def identify(data: bytes, name: str = "") -> str | None:
    """The container's format by content, in fixed order, else by the name's extension."""
    for kind, probe in zip(FORMATS, (_is_macbinary_or_empty, apple_order, is_binhex, is_binary_ii, is_apple_link), strict=True):
        if probe(data):
            return kind
    return BY_EXTENSION.get(name.rpartition(".")[2].lower() if "." in name else "")


def unwrap(data: bytes, name: str = "") -> list[dict]:
    """All files in a container; [] if it is none."""
    kind = identify(data, name)
    if kind is None:
        return []
    if kind == "applesingle":
        out = read_apple(data)
        return [out | {"created": None, "modified": None, "name": out["name"] or name}]
    reader = {"macbinary": read_macbinary, "binhex": read_binhex, "binary_ii": read_binary_ii, "applelink": read_apple_link}[kind]
    out = reader(data)
    return out if isinstance(out, list) else [out]
