"""Disk images and partition maps."""

from __future__ import annotations

import struct
from collections import namedtuple

from ..functions.binary import be, le, mac_roman, padded
from ..functions.codecs import rotating_checksum, undart_rle, unlzhuf
from .containers import ContainerError
from .volumes import filesystem_of

BLOCK = 512
DART_DATA, DART_CHUNK = 512 * 40, (512 + 12) * 40


def is_dart(data: bytes) -> bool:
    if len(data) <= 84 or data[0] > 2:
        return False
    sizes = (400, 800) if 1 <= data[1] <= 3 else (720, 1440) if 16 <= data[1] <= 18 else ()
    return be(data, 2, 2) in sizes


def is_disk_copy(data: bytes) -> bool:
    return len(data) > 84 and data[82:84] == b"\x01\0" and 1 <= data[0] <= 63 and be(data, 64, 4) > 0 and 84 + be(data, 64, 4) <= len(data) + 84


def image_format(data: bytes) -> str:
    """dart, 2img, woz, moof, apm, mac_ts, diskcopy, udif, hybrid, iso, ndif, raw or unknown: the first that fits."""
    if len(data) <= 84:
        return "unknown"
    if is_dart(data):
        return "dart"
    if data[:4] == b"2IMG":
        return "2img"
    if data[:3] == b"WOZ":
        return "woz"
    if data[:4] == b"MOOF":
        return "moof"
    if is_apm(data):
        return "apm"
    if is_mac_ts(data):
        return "mac_ts"
    if is_disk_copy(data):
        return "diskcopy"
    if data[-512:-508] == b"koly":
        return "udif"
    if data[32769:32774] == b"CD001":
        return "hybrid" if data[1024:1026] == b"BD" or (data[:2] == b"ER" and data[2048:2050] == b"PM") else "iso"
    if data[:4] in (b"bcem", b"ndif") or b"bcem" in data[:84]:
        return "ndif"
    return "raw" if len(data) > 1026 else "unknown"


def undart(data: bytes) -> bytes:
    """The user data of a DART archive; the tags behind each chunk's first 20480 bytes are dropped."""
    method, size = data[0], be(data, 2, 2)
    chunks = 40 if size <= 800 else 72
    at, out = 4 + 2 * chunks, bytearray()
    if len(data) < at:
        raise ContainerError("corrupted data", "DART table ends early")
    for i in range(min(size // 20, chunks)):
        n = be(data, 4 + 2 * i, 2)
        if not n:
            break
        stored = n == 0xFFFF or method == 2
        part = data[at : at + (DART_CHUNK if stored else 2 * n if method == 0 else n)]
        at += len(part)
        if not part:
            raise ContainerError("corrupted data", "DART chunk is missing")
        chunk = part if stored else undart_rle(part) if method == 0 else unlzhuf(part, DART_CHUNK, 0)
        if len(chunk) >= DART_DATA:
            out += chunk[:DART_DATA]
    return bytes(out)


def write_dart(data: bytes, size: int = 400) -> bytes:
    """A stored DART archive of 400 or 800 KB."""
    chunks = [padded(data[i : i + DART_DATA], DART_DATA) + bytes(480) for i in range(0, max(len(data), 1), DART_DATA)][: size // 20]
    table = b"\xff\xff" * len(chunks) + b"\0\0" * (40 - len(chunks))
    return bytes([2, 1]) + struct.pack(">H", size) + table + b"".join(chunks)


def disk_copy(data: bytes) -> dict:
    """Header of a DiskCopy 4.2 image; its tag checksum leaves out the first 12 bytes."""
    if not is_disk_copy(data):
        raise ContainerError("invalid format", "not a DiskCopy 4.2 image")
    size, tags = be(data, 64, 4), be(data, 68, 4)
    body, tag = data[84 : 84 + size], data[84 + size : 84 + size + tags]
    kinds = {0: "400K GCR", 1: "800K GCR", 2: "720K MFM", 3: "1440K MFM"}
    return {
        "name": mac_roman(data[1 : 1 + data[0]]), "data_size": size, "tag_size": tags, "disk_type": kinds.get(data[80], f"type {data[80]}"),
        "data_ok": rotating_checksum(body) == be(data, 72, 4), "tag_ok": not tags or rotating_checksum(tag[12:]) == be(data, 76, 4), "raw": body, "tags": tag,
    }


def write_disk_copy(name: str, data: bytes, tags: bytes = b"") -> bytes:
    raw = name.encode("mac_roman", "replace")[:63]
    head = bytes([len(raw)]) + raw.ljust(63, b"\0") + struct.pack(">IIIIBBH", len(data), len(tags), rotating_checksum(data), rotating_checksum(tags[12:]), 1, 0x22, 0x0100)
    return head + data + tags


def two_img(data: bytes) -> dict:
    if data[:4] != b"2IMG" or len(data) < 64:
        raise ContainerError("invalid format", "not a 2IMG image")
    at, size = le(data, 24, 4), le(data, 28, 4) or 512 * le(data, 20, 4)
    order = {0: "DOS 3.3 sector order", 1: "ProDOS block order", 2: "Nibble data"}.get(le(data, 12, 4), f"Unknown ({le(data, 12, 4)})")
    return {"creator": data[4:8].decode("latin-1"), "order": order, "data_size": size, "raw": data[at : at + size]}


def write_two_img(data: bytes, order: int = 1, creator: bytes = b"RELQ", sized: bool = True) -> bytes:
    return struct.pack("<4s4sHHIIIIIIIII16x", b"2IMG", creator, 64, 1, order, 0, len(data) // 512, 64, len(data) if sized else 0, 0, 0, 0, 0) + data


def nibble_image(data: bytes) -> dict | None:
    """What the head of a WOZ or MOOF image says; its sectors aren't decoded."""
    if data[:3] == b"WOZ":
        return {"format": "woz", "disk_type": f"WOZ v{chr(data[3])} (nibble-level)", "data_size": len(data)}
    return {"format": "moof", "disk_type": "MOOF (Mac flux image)", "data_size": len(data)} if data[:4] == b"MOOF" else None


def sector_order(data: bytes, name: str) -> str:
    extension = name.rpartition(".")[2].lower() if "." in name else ""
    if extension in ("po", "do"):
        return {"po": "prodos", "do": "dos"}[extension]
    return "dos" if len(data) == 143_360 and filesystem_of(data) not in ("hfs", "hfs+") else "prodos"


def raw_sectors(data: bytes) -> tuple[str, bytes, dict]:
    """Format, raw sectors and what the image says of itself."""
    kind = image_format(data)
    if kind == "dart":
        return kind, undart(data), {}
    if kind == "diskcopy":
        info = disk_copy(data)
        return kind, info["raw"], {k: v for k, v in info.items() if k not in ("raw", "tags")}
    if kind == "2img":
        info = two_img(data)
        return kind, info["raw"], {k: v for k, v in info.items() if k != "raw"}
    if kind in ("apm", "mac_ts"):
        best = best_partition(data)
        if best is None:
            raise ContainerError("unsupported format", f"no usable partition in the {kind} map")
        return kind, best[1], {"name": best[0].name, "partitions": len(partitions(data))}
    if kind in ("raw", "hybrid"):
        return kind, data, {}
    raise ContainerError("unsupported format", f"{kind} images have no reader here")


# Partition maps

Partition = namedtuple("Partition", "ordinal scheme name type start_block block_count block_size")


def is_apm(data: bytes) -> bool:
    return len(data) >= 1024 and data[:2] == b"ER" and data[512:514] == b"PM"


def is_mac_ts(data: bytes) -> bool:
    return len(data) >= 1024 and data[:2] == b"ER" and data[512:514] == b"TS"


def _text(data: bytes) -> str:
    return mac_roman(data.split(b"\0")[0])


def apm_partitions(data: bytes, block: int = BLOCK) -> list[Partition]:
    out, count = [], be(data, block + 4, 4)
    if not 0 < count <= 256:
        return []
    for i in range(1, count + 1):
        e = data[i * block : i * block + 80]
        if len(e) < 80 or e[:2] != b"PM":
            break
        start, size, total = be(e, 8, 4), be(e, 12, 4), len(data) // block
        out.append(Partition(len(out), "apm", _text(e[16:48]), _text(e[48:80]), start, max(0, min(size, total - start)), block))
    return out


def ts_partitions(data: bytes) -> list[Partition]:
    out, total = [], len(data) // BLOCK
    for at in range(BLOCK + 4, 2 * BLOCK - 11, 12):
        start, size, kind = be(data, at, 4), be(data, at + 4, 4), data[at + 8 : at + 12]
        if not start:
            break
        if start < total:
            out.append(Partition(len(out), "mac_ts", "", kind.rstrip(b"\0").decode("latin-1"), start, min(size, total - start), BLOCK))
    return out


def hard_disk_partitions(data: bytes) -> list[Partition]:
    """FocusDrive and MicroDrive maps in block 1."""
    scheme = "focusdrive" if data[512:526] == b"Parsons Engin." else "microdrive" if data[512:523] == b"Micro Drive" else None
    if not scheme or len(data) < 1024 or not 0 < data[527] <= 8:
        return []
    out, total = [], len(data) // BLOCK
    for i in range(data[527]):
        e = data[544 + 48 * i : 592 + 48 * i]
        if len(e) < 48:
            break
        start = le(e, 0, 4)
        if 0 < start < total:
            name = e[16:48].decode("latin-1").strip(" \t\r\n\0")
            out.append(Partition(len(out), scheme, name, "ProDOS", start, min(le(e, 4, 4), total - start), BLOCK))
    return out


def cffa_partitions(data: bytes) -> list[Partition]:
    """Slices of 65536 blocks, of which those with a known filesystem count."""
    if len(data) <= 65536 * BLOCK:
        return []
    total = len(data) // BLOCK
    slices = [(at, min(65536, total - at)) for at in range(0, total, 65536)]
    kinds = [(at, n, filesystem_of(data[at * BLOCK : (at + n) * BLOCK])) for at, n in slices]
    return [Partition(i, "cffa", f"Partition {at // 65536 + 1}", kind, at, n, BLOCK) for i, (at, n, kind) in enumerate(x for x in kinds if x[2] != "unknown")]


def partitions(data: bytes) -> list[Partition]:
    if is_apm(data):
        return apm_partitions(data)
    if is_mac_ts(data):
        return ts_partitions(data)
    return hard_disk_partitions(data) or cffa_partitions(data)


def partition_bytes(data: bytes, p: Partition) -> bytes:
    return data[p.start_block * p.block_size : (p.start_block + p.block_count) * p.block_size]


#: Partition types by what they hold, lower case.
HOLDS = {"hfs": ("apple_hfs", "apple_hfsx"), "mfs": ("apple_mfs",), "prodos": ("apple_prodos",), "free": ("apple_free", "apple_scratch"), "map": ("apple_partition_map",)}


def partition_holds(kind: str) -> str:
    kind = kind.lower()
    return next((k for k, names in HOLDS.items() if kind in names), "driver" if kind.startswith("apple_driver") else "other")


def best_partition(data: bytes) -> tuple[Partition, bytes] | None:
    """HFS before MFS before ProDOS, by type or else by content; in a TS map, else the first."""
    rank, found = {"hfs": 0, "hfs+": 0, "mfs": 1, "prodos": 2}, []
    for p in partitions(data):
        part = partition_bytes(data, p)
        kind = partition_holds(p.type) if p.scheme == "apm" else filesystem_of(part)
        if kind in rank:
            found.append((rank[kind], p.ordinal, p, part))
        elif p.scheme == "mac_ts":
            found.append((9, p.ordinal, p, part))
    return min(found)[2:] if found else None


def write_apm(parts: list[tuple[str, str, bytes]]) -> bytes:
    """(name, type, content) behind a driver block and the map."""
    at, head, body = 1 + len(parts), b"ER" + struct.pack(">HI", BLOCK, 0) + bytes(504), b""
    for name, kind, content in parts:
        content = padded(content, BLOCK)
        head += (b"PM\0\0" + struct.pack(">III", len(parts), at, len(content) // BLOCK) + name.encode("mac_roman")[:31].ljust(32, b"\0") + kind.encode("ascii")[:31].ljust(32, b"\0")).ljust(BLOCK, b"\0")
        body += content
        at += len(content) // BLOCK
    return head + body


def write_mac_ts(parts: list[tuple[bytes, bytes]]) -> bytes:
    at, table, body = 2, b"TS\0\0", b""
    for kind, content in parts:
        content = padded(content, BLOCK)
        table += struct.pack(">II4s", at, len(content) // BLOCK, kind)
        body += content
        at += len(content) // BLOCK
    return (b"ER" + struct.pack(">H", BLOCK)).ljust(BLOCK, b"\0") + table.ljust(BLOCK, b"\0") + body


def write_hard_disk(signature: bytes, parts: list[tuple[str, bytes]]) -> bytes:
    at, body = 2, b""
    table = signature.ljust(15, b"\0") + bytes([len(parts)]) + bytes(16)
    for name, content in parts:
        content = padded(content, BLOCK)
        table += struct.pack("<II8x", at, len(content) // BLOCK) + name.encode("latin-1")[:32].ljust(32, b"\0")
        body += content
        at += len(content) // BLOCK
    return bytes(BLOCK) + table.ljust(BLOCK, b"\0") + body
