"""Filesystems of vintage volumes: readers of raw sectors, and writers of small volumes.

Readers give files as containers do. Chains are followed for a bounded number of steps, so a
damaged volume with a cycle ends. HFS and HFS+ are recognised only.
"""

from __future__ import annotations

import struct

from ..functions.binary import be, le, mac_roman, padded
from .containers import ContainerError, file, mac_date, prodos_date

BLOCK, SECTOR = 512, 256


def _block(data: bytes, n: int, size: int = BLOCK) -> bytes:
    return data[n * size : (n + 1) * size]


def _seven_bit(raw: bytes) -> str:
    return bytes(b & 0x7F for b in raw).decode("ascii").strip(" \0")


def _dealt(files: list[dict], room: int, most: int, unit: int, cost) -> list[list[dict]]:
    """Files dealt to disks of `room` sectors and `most` files each, in order. A file that no disk
    holds goes on as the first of the next disk, under the same name. cost(n): the sectors that n
    sectors of `unit` bytes take."""
    out, left = [[]], room
    for f in files:
        rest, first = f["data_fork"], True
        while rest or first:
            n = -(-len(rest) // unit)
            if out[-1] and (cost(n) > left or len(out[-1]) == most):
                out, left = [*out, []], room
            while cost(n) > left:
                n -= 1
            out[-1].append(f | {"data_fork": rest[: n * unit]})
            rest, left, first = rest[n * unit :], left - cost(n), False
    return out


# MFS


def is_mfs(data: bytes) -> bool:
    return data[1024:1026] == b"\xd2\xd7"


def mfs_volume(data: bytes) -> dict:
    if not is_mfs(data) or len(data) < 1088:
        raise ContainerError("invalid format", "not an MFS volume")
    h = data[1024:1088]
    return {"name": mac_roman(h[37 : 37 + min(h[36], 27)]), "files": be(h, 12, 2), "dir_start": be(h, 14, 2), "dir_blocks": be(h, 16, 2), "alloc_blocks": be(h, 18, 2), "alloc_size": be(h, 20, 4), "first_block": be(h, 28, 2)}


def twelve_bits(data: bytes) -> list[int]:
    """Three bytes make two entries."""
    return [be(data, 3 * (i // 2) + i % 2, 2) >> (0 if i % 2 else 4) & 0xFFF for i in range(2 * len(data) // 3)]


def read_mfs(data: bytes) -> list[dict]:
    v = mfs_volume(data)
    chain = twelve_bits(data[1088 : 1088 + (3 * v["alloc_blocks"] + 1) // 2 + 1])

    def fork(first: int, size: int) -> bytes:
        out, n = bytearray(), first
        for _ in range(10_000):
            if n < 2 or n - 2 >= len(chain) or len(out) >= size:
                break
            at = v["first_block"] * BLOCK + (n - 2) * v["alloc_size"]
            out += data[at : at + v["alloc_size"]]
            n = chain[n - 2]
            if n <= 1:
                break
        return bytes(out[:size])

    out = []
    for b in range(v["dir_start"], v["dir_start"] + v["dir_blocks"]):
        block, at = _block(data, b), 0
        while at + 51 <= len(block) and block[at] & 0x80:
            e = block[at:]
            name = mac_roman(e[51 : 51 + e[50]])
            out.append(file(
                name=name, data_fork=fork(be(e, 22, 2), be(e, 24, 4)), rsrc_fork=fork(be(e, 32, 2), be(e, 34, 4)), type_code=mac_roman(e[2:6]), creator_code=mac_roman(e[6:10]),
                finder_flags=be(e, 10, 2), created=mac_date(be(e, 42, 4)), modified=mac_date(be(e, 46, 4)),
            ))
            at += 51 + e[50]
            at += at & 1
    return out


def write_mfs(name: str, files: list[dict], alloc_size: int = 1024) -> bytes:
    chain, body, entries = [], b"", b""

    def store(content: bytes) -> int:
        nonlocal body
        if not content:
            return 0
        n = -(-len(content) // alloc_size)
        first = len(chain) + 2
        chain.extend([*range(first + 1, first + n), 1])
        body += padded(content, alloc_size)
        return first

    blocks, current = [], b""
    for i, f in enumerate(files):
        raw = f["name"].encode("mac_roman", "replace")[:255]
        code = lambda c: (c or "").encode("mac_roman", "replace")[:4].ljust(4)
        e = bytes([0x80, 0]) + code(f["type_code"]) + code(f["creator_code"]) + struct.pack(">H6xI", f["finder_flags"], i + 1)
        for fork in (f["data_fork"], f["rsrc_fork"]):
            e += struct.pack(">HII", store(fork), len(fork), len(fork) + -len(fork) % alloc_size)
        e += struct.pack(">IIB", 0, 0, len(raw)) + raw
        e += b"\0" * (len(e) & 1)
        if len(current) + len(e) > BLOCK:
            blocks.append(current.ljust(BLOCK, b"\0"))
            current = b""
        current += e
    entries = b"".join([*blocks, current.ljust(BLOCK, b"\0")])
    bits = chain + [0] * (len(chain) & 1)
    packed = b"".join((bits[i] << 12 | bits[i + 1]).to_bytes(3, "big") for i in range(0, len(bits), 2))
    head_blocks = -(-(64 + len(packed) + 2) // BLOCK)
    dir_start, first = 2 + head_blocks, 2 + head_blocks + len(entries) // BLOCK
    raw = name.encode("mac_roman")[:27]
    head = b"\xd2\xd7" + struct.pack(">II", 0, 0) + bytes(2) + struct.pack(">HHHHIIHIH", len(files), dir_start, len(entries) // BLOCK, len(chain), alloc_size, alloc_size, first, len(files) + 1, 0) + bytes([len(raw)]) + raw
    return bytes(1024) + padded(head.ljust(64, b"\0") + packed + b"\0\0", BLOCK) + entries + body


# ProDOS

SEEDLING, SAPLING, TREE, EXTENDED, DIRECTORY = 1, 2, 3, 5, 13


def is_prodos(data: bytes) -> bool:
    return len(data) >= 6 * BLOCK and data[2 * BLOCK + 4] >> 4 == 15


def _pointers(data: bytes, n: int) -> list[int]:
    b = _block(data, n)
    return [b[i] | b[256 + i] << 8 for i in range(256)] if len(b) == BLOCK else []


def _prodos_fork(data: bytes, storage: int, key: int, size: int) -> bytes:
    if not size or not key:
        return b""
    if storage == SEEDLING:
        return _block(data, key)[:size]
    out = bytearray()
    indexes = [key] if storage == SAPLING else _pointers(data, key) if storage == TREE else []
    for index in indexes:
        for p in _pointers(data, index) if index else [0] * 256:
            if len(out) >= size:
                return bytes(out[:size])
            out += _block(data, p) if p else bytes(BLOCK)
    return bytes(out[:size])


def _extended(data: bytes, key: int) -> dict:
    b = _block(data, key)
    if len(b) < BLOCK:
        return {}
    out = {name: _prodos_fork(data, b[at], le(b, at + 1, 2), le(b, at + 3, 3)) for name, at in (("data_fork", 0), ("rsrc_fork", 256))}
    if b[18] == 1:
        out |= {"type_code": mac_roman(b[26:30]), "creator_code": mac_roman(b[30:34])}
    return out


def read_prodos(data: bytes, depth: int = 64) -> list[dict]:
    """Files with their paths from the volume directory; a directory is read once, so cycles end."""
    if not is_prodos(data):
        raise ContainerError("invalid format", "not a ProDOS volume")
    out, seen = [], set()

    def walk(block: int, path: str, level: int) -> None:
        first = True
        for _ in range(500):
            if not block or block in seen or level > depth:
                return
            seen.add(block)
            b = _block(data, block)
            if len(b) < BLOCK:
                return
            for i in range(13):
                e = b[4 + 39 * i : 43 + 39 * i]
                storage, n = e[0] >> 4, e[0] & 15
                if (first and not i) or not storage or not n:
                    continue
                name = path + e[1 : 1 + n].decode("latin-1")
                if storage == DIRECTORY:
                    walk(le(e, 17, 2), name + "/", level + 1)
                    continue
                f = file(
                    name=name, type_code=f"${e[16]:02X}", creator_code=f"${le(e, 31, 2):04X}", created=prodos_date(le(e, 24, 2), le(e, 26, 2), 0x1F, 0x3F), modified=prodos_date(le(e, 33, 2), le(e, 35, 2), 0x1F, 0x3F),
                )
                f |= _extended(data, le(e, 17, 2)) if storage == EXTENDED else {"data_fork": _prodos_fork(data, storage, le(e, 17, 2), le(e, 21, 3))}
                out.append(f)
            first, block = False, le(b, 2, 2)

    walk(2, "", 0)
    return out


def write_prodos(name: str, files: list[dict], blocks: int = 280) -> bytes:
    """Files of any storage kind in the volume directory and in one level of folders ('Folder/File');
    those with a resource fork are extended. Blocks of zeros are left out, as sparse."""
    disk = {i: bytes(BLOCK) for i in range(6)}
    free = [6]

    def take(content: bytes = b"") -> int:
        n, free[0] = free[0], free[0] + 1
        disk[n] = content.ljust(BLOCK, b"\0")
        return n

    def index(pointers: list[int]) -> int:
        pointers = pointers + [0] * (256 - len(pointers))
        return take(bytes(p & 255 for p in pointers) + bytes(p >> 8 for p in pointers))

    def store(content: bytes) -> tuple[int, int]:
        parts = [content[i : i + BLOCK] for i in range(0, len(content), BLOCK)]
        if len(parts) <= 1:
            return SEEDLING, take(content)
        places = [take(p) if p.strip(b"\0") else 0 for p in parts]
        if len(parts) <= 256:
            return SAPLING, index(places)
        return TREE, index([index(places[i : i + 256]) if any(places[i : i + 256]) else 0 for i in range(0, len(places), 256)])

    def entry(storage, label, kind, key, size, aux) -> bytes:
        raw = label.encode("latin-1", "replace")[:15]
        return bytes([storage << 4 | len(raw)]) + raw.ljust(15, b"\0") + bytes([kind]) + struct.pack("<HH", key, 1) + size.to_bytes(3, "little") + struct.pack("<HHBBBHHHH", 0, 0, 0, 0, 0xE3, aux, 0, 0, 2)

    def file_entry(f: dict) -> bytes:
        kind, aux = int((f["type_code"] or "$06")[1:], 16) if (f["type_code"] or "$").startswith("$") else 0, int((f["creator_code"] or "$0000")[1:], 16) if (f["creator_code"] or "$").startswith("$") else 0
        label = f["name"].rpartition("/")[2]
        if f["rsrc_fork"]:
            block = bytearray(BLOCK)
            for at, fork in ((0, f["data_fork"]), (256, f["rsrc_fork"])):
                storage, key = store(fork)
                block[at : at + 6] = bytes([storage]) + struct.pack("<H", key) + len(fork).to_bytes(3, "little")
            if f["type_code"] and not f["type_code"].startswith("$"):
                block[17:34] = bytes([18, 1]) + bytes(7) + f["type_code"].encode("mac_roman")[:4].ljust(4) + (f["creator_code"] or "").encode("mac_roman")[:4].ljust(4)
            return entry(EXTENDED, label, kind, take(bytes(block)), BLOCK, aux)
        storage, key = store(f["data_fork"])
        return entry(storage, label, kind, key, len(f["data_fork"]), aux)

    def directory(rows: list[bytes], head: bytes, first: int | None) -> int:
        rows = [head, *rows]
        places = [first if first is not None and i == 0 else take() for i in range(-(-len(rows) // 13))]
        for i, place in enumerate(places):
            links = struct.pack("<HH", places[i - 1] if i else 0, places[i + 1] if i + 1 < len(places) else 0)
            disk[place] = (links + b"".join(rows[13 * i : 13 * i + 13])).ljust(BLOCK, b"\0")
        return places[0]

    def header(storage: int, label: str, count: int) -> bytes:
        return entry(storage, label, 0x75, 0, 0, 0)[:31] + struct.pack("<BBHHH", 39, 13, count, 6, blocks)

    top, folders = [], {}
    for f in files:
        if "/" in f["name"]:
            folders.setdefault(f["name"].split("/")[0], []).append(file_entry(f))
        else:
            top.append(file_entry(f))
    top += [entry(DIRECTORY, label, 0x0F, directory(rows, header(14, label, len(rows)), None), BLOCK, 0) for label, rows in folders.items()]
    directory(top, header(15, name, len(top)), 2)
    return b"".join(disk.get(i, bytes(BLOCK)) for i in range(max(blocks, free[0])))


# DOS 3.2 and 3.3


def is_dos(data: bytes, per_track: int = 16) -> bool:
    at = 17 * per_track * SECTOR
    v = data[at : at + SECTOR]
    return len(v) == SECTOR and len(data) in (35 * per_track * SECTOR, 40 * per_track * SECTOR, 50 * 32 * SECTOR) and v[1] == 17 and 0 < v[2] < 32 and v[0x34] in (35, 40, 50) and v[0x35] in (13, 16, 32)


def read_dos(data: bytes) -> list[dict]:
    """Whole sectors of each file, in the order of its track/sector lists; pairs of zeros are skipped."""
    per_track = next((n for n in (16, 13) if is_dos(data, n)), None)
    if per_track is None:
        raise ContainerError("invalid format", "not a DOS 3.x volume")
    sector = lambda t, s: data[(t * per_track + s) * SECTOR : (t * per_track + s + 1) * SECTOR]

    def content(t: int, s: int) -> bytes:
        out = bytearray()
        for _ in range(500):
            lists = sector(t, s)
            if len(lists) < SECTOR:
                break
            for i in range(122):
                dt, ds = lists[12 + 2 * i], lists[13 + 2 * i]
                if dt or ds:
                    out += sector(dt, ds)
            t, s = lists[1], lists[2]
            if not t:
                break
        return bytes(out)

    kinds, out = {0: "T", 1: "I", 2: "A", 4: "B", 8: "S", 16: "R", 32: "A", 64: "B"}, []
    v = sector(17, 0)
    t, s = v[1], v[2]
    for _ in range(100):
        b = sector(t, s)
        if not t or len(b) < SECTOR:
            break
        for i in range(7):
            e = b[11 + 35 * i : 46 + 35 * i]
            if e[0] in (0, 0xFF):
                continue
            name, body = _seven_bit(e[3:33]), content(e[0], e[1])
            if name and body:
                out.append(file(name=name, data_fork=body, type_code=kinds.get(e[2] & 0x7F, "?"), creator_code="LOCK" if e[2] & 0x80 else f"DOS{33 if per_track == 16 else 32}"))
        t, s = b[1], b[2]
    return out


def dos_disks(files: list[dict], per_track: int = 16) -> list[bytes]:
    """As many disks as the files need."""
    dealt = _dealt(files, 31 * per_track, 7 * (per_track - 1), SECTOR, lambda n: n + max(1, -(-n // 122)))
    return [write_dos(f, per_track) for f in dealt]


def write_dos(files: list[dict], per_track: int = 16) -> bytes:
    lists = [max(1, -(-len(f["data_fork"]) // (122 * SECTOR))) for f in files]
    if len(files) > 7 * (per_track - 1) or sum(-(-len(f["data_fork"]) // SECTOR) for f in files) + sum(lists) > 31 * per_track:
        raise ContainerError("unsupported format", "the files need several disks")
    disk = bytearray(35 * per_track * SECTOR)
    free = [(t, s) for t in [*range(18, 35), *range(3, 17)] for s in range(per_track)]
    put = lambda t, s, b: disk.__setitem__(slice((t * per_track + s) * SECTOR, (t * per_track + s + 1) * SECTOR), b.ljust(SECTOR, b"\0"))
    entries = []
    for f in files:
        places = []
        for i in range(0, len(f["data_fork"]), SECTOR):
            places.append(free.pop(0))
            put(*places[-1], f["data_fork"][i : i + SECTOR])
        lists = [free.pop(0) for _ in range(max(1, -(-len(places) // 122)))]
        for i, (t, s) in enumerate(lists):
            after = lists[i + 1] if i + 1 < len(lists) else (0, 0)
            put(t, s, bytes([0, *after]) + bytes(9) + bytes(x for p in places[122 * i : 122 * i + 122] for x in p))
        kind = {"T": 0, "I": 1, "A": 2, "B": 4}.get(f["type_code"], 4) | (0x80 if f["creator_code"] == "LOCK" else 0)
        name = bytes(b | 0x80 for b in f["name"].encode("ascii", "replace")[:30].ljust(30))
        entries.append(bytes([*lists[0], kind]) + name + struct.pack("<H", len(places) + len(lists)))
    last = per_track - 1
    groups = [entries[i : i + 7] for i in range(0, len(entries), 7)] or [[]]
    for i, g in enumerate(groups):
        after = (17, last - i - 1) if i + 1 < len(groups) else (0, 0)
        put(17, last - i, bytes([0, *after]) + bytes(8) + b"".join(g))
    v = bytearray(SECTOR)
    v[1], v[2], v[3], v[0x27], v[0x34], v[0x35] = 17, last, 3, 122, 35, per_track
    put(17, 0, bytes(v))
    return bytes(disk)


def read_dual_dos(data: bytes, interleaved: bool = False) -> list[dict]:
    """Two DOS volumes on an 800K disk, side by side or in alternate sectors."""
    if len(data) != 819_200:
        raise ContainerError("invalid format", "not an 800K disk")
    halves = [b"".join(data[i : i + SECTOR] for i in range(k * SECTOR, len(data), 2 * SECTOR)) for k in (0, 1)] if interleaved else [data[:409_600], data[409_600:]]
    return [f for h in halves for f in read_dos(h[: 40 * 16 * SECTOR] if not is_dos(h) else h)]


# CP/M


def _cpm_layout(data: bytes) -> tuple[int, int, int, int] | None:
    """Directory offset, number of entries, block size, offset of block 0."""
    return {143_360: (12_288, 64, 1024, 12_288), 819_200: (16_384, 256, 2048, 0)}.get(len(data))


def is_cpm(data: bytes) -> bool:
    if not (layout := _cpm_layout(data)):
        return False
    heads = [data[layout[0] + 32 * i : layout[0] + 32 * i + 16] for i in range(8)]
    live = [h for h in heads if h[0] != 0xE5]
    named = [h for h in live if 0x20 <= h[1] & 0x7F < 0x7F]
    return all(h[0] <= 31 for h in live) and bool(named) and all(_cpm_entry(h) for h in named if h[0] <= 15)


def _cpm_entry(head: bytes) -> bool:
    """Whether a file's entry has a whole name and numbers in their ranges, which text has not."""
    return all(0x20 <= b & 0x7F < 0x7F for b in head[1:12]) and head[12] <= 31 and head[14] <= 63 and head[15] <= 128


def cpm_extents(data: bytes) -> list[tuple[int, str, str, int, int, list[int]]]:
    """(user, name, extension, extent number, records, blocks) of each live directory entry."""
    layout, out = _cpm_layout(data), []
    if not layout:
        raise ContainerError("invalid format", "not a CP/M volume")
    wide = layout[2] > 1024
    for i in range(layout[1]):
        e = data[layout[0] + 32 * i : layout[0] + 32 * i + 32]
        if len(e) < 32 or e[0] > 31:
            continue
        name, extension = _seven_bit(e[1:9]), _seven_bit(e[9:12])
        blocks = [le(e, 16 + 2 * k, 2) for k in range(8)] if wide else list(e[16:32])
        if name:
            out.append((e[0], name, extension, e[12] & 31 | (e[14] & 63) << 5, e[15], [b for b in blocks if b]))
    return out


def read_cpm(data: bytes) -> list[dict]:
    files: dict[tuple, list] = {}
    for user, name, extension, number, records, blocks in cpm_extents(data):
        files.setdefault((user, name, extension), []).append((number, records, blocks))
    _, _, size, origin = _cpm_layout(data)
    out = []
    for (user, name, extension), extents in sorted(files.items()):
        extents.sort()
        body = b"".join(data[origin + b * size : origin + (b + 1) * size] for x in extents for b in x[2])
        body = body[: 128 * sum(x[1] for x in extents)]
        if body:
            out.append(file(name=f"{name}.{extension}" if extension else name, data_fork=body, type_code="CP/M", creator_code="CPM", finder_flags=0))
    return out


def cpm_disks(files: list[dict]) -> list[bytes]:
    """As many disks as the files need: 60 files of 126 blocks take 64 entries at most."""
    return [write_cpm(f) for f in _dealt(files, 126, 60, 1024, lambda n: n)]


def write_cpm(files: list[dict]) -> bytes:
    """A 140K volume; content is filled to records of 128 bytes with 1A."""
    if sum(-(-len(f["data_fork"]) // 16_384) for f in files) > 64 or sum(-(-len(f["data_fork"]) // 1024) for f in files) > 126:
        raise ContainerError("unsupported format", "the files need several disks")
    disk, entries, block = bytearray(b"\xe5" * 143_360), [], 2
    for f in files:
        name, _, extension = f["name"].partition(".")
        body = f["data_fork"] + b"\x1a" * (-len(f["data_fork"]) % 128)
        for number, at in enumerate(range(0, len(body), 16_384)):
            part = body[at : at + 16_384]
            places = list(range(block, block + -(-len(part) // 1024)))
            block += len(places)
            disk[12_288 + 1024 * places[0] : 12_288 + 1024 * places[0] + len(part)] = part
            entries.append(bytes([0]) + name.encode("ascii")[:8].ljust(8) + extension.encode("ascii")[:3].ljust(3) + bytes([number, 0, 0, len(part) // 128]) + bytes(places).ljust(16, b"\0"))
    disk[12_288 : 12_288 + 32 * len(entries)] = b"".join(entries)
    return bytes(disk)


# Apple Pascal


def is_pascal(data: bytes) -> bool:
    return len(data) >= 6 * BLOCK and le(data, 1028, 2) == 0 and 1 <= data[1030] <= 7 and all(0x20 < b < 0x7F for b in data[1031 : 1031 + data[1030]])


def has_pascal_header(data: bytes) -> bool:
    """Whether all of the first entry is in order: blocks 0 to 6, a name, the volume's blocks and a number of files."""
    return is_pascal(data) and le(data, 1024, 2) == 0 and le(data, 1026, 2) == 6 < le(data, 1038, 2) <= len(data) // BLOCK and le(data, 1040, 2) <= 77


def read_pascal(data: bytes) -> list[dict]:
    if not is_pascal(data):
        raise ContainerError("invalid format", "not a Pascal volume")
    kinds = {1: "BAD", 2: "CODE", 3: "TEXT", 4: "INFO", 5: "DATA", 6: "GRAF", 7: "FOTO", 8: "SDIR"}
    out = []
    for i in range(min(le(data, 1024 + 16, 2), 77)):
        e = data[1024 + 26 * (i + 1) : 1024 + 26 * (i + 2)]
        if len(e) < 26 or not 1 <= e[6] <= 15:
            continue
        first, after, used = le(e, 0, 2), le(e, 2, 2), le(e, 22, 2)
        body = data[first * BLOCK : after * BLOCK]
        if used and after > first:
            body = body[: (after - first - 1) * BLOCK + used]
        if body:
            out.append(file(name=e[7 : 7 + e[6]].decode("latin-1"), data_fork=body, type_code=kinds.get(le(e, 4, 2) & 15, "DATA"), creator_code="PASC"))
    return out


def pascal_disks(name: str, files: list[dict], blocks: int = 280) -> list[bytes]:
    """As many disks as the files need."""
    return [write_pascal(name, f, blocks) for f in _dealt(files, blocks - 6, 77, BLOCK, lambda n: n)]


def write_pascal(name: str, files: list[dict], blocks: int = 280) -> bytes:
    if len(files) > 77 or sum(-(-len(f["data_fork"]) // BLOCK) for f in files) > blocks - 6:
        raise ContainerError("unsupported format", "the files need several disks")
    raw = name.encode("ascii")[:7]
    rows, body, at = [struct.pack("<HHHB", 0, 6, 0, len(raw)) + raw.ljust(7, b"\0") + struct.pack("<HHH", blocks, len(files), 0) + bytes(6)], b"", 6
    for f in files:
        label, n = f["name"].encode("latin-1")[:15], -(-len(f["data_fork"]) // BLOCK)
        used = (len(f["data_fork"]) - 1) % BLOCK + 1
        rows.append(struct.pack("<HHHB", at, at + n, 3 if f["type_code"] == "TEXT" else 5, len(label)) + label.ljust(15, b"\0") + struct.pack("<HH", used, 0))
        body += padded(f["data_fork"], BLOCK)
        at += n
    return (bytes(1024) + b"".join(r.ljust(26, b"\0") for r in rows).ljust(4 * BLOCK, b"\0") + body).ljust(blocks * BLOCK, b"\0")


# RDOS


def is_rdos(data: bytes) -> bool:
    return any(any(mark in bytes(b & 0x7F for b in data[n * SECTOR : n * SECTOR + 24]) for mark in (b"RDOS", b"SSI")) for n in (16, 13))


def has_rdos_header(data: bytes) -> bool:
    """Whether the directory begins where a disk of this size has it, with the system's whole name."""
    if not (per_track := {143_360: 16, 116_480: 13}.get(len(data))):
        return False
    head = bytes(b & 0x7F for b in data[per_track * SECTOR : per_track * SECTOR + 24])
    return (b"RDOS" in head or b"SSI" in head) and all(0x20 <= b < 0x7F for b in head)


def read_rdos(data: bytes) -> list[dict]:
    if not is_rdos(data):
        raise ContainerError("invalid format", "not an RDOS volume")
    per_track = 13 if len(data) == 116_480 else 16
    start, out = per_track * SECTOR, []
    for at in range(start, start + (11 if per_track == 13 else 16) * SECTOR, 32):
        e = data[at : at + 32]
        if len(e) < 32 or e[0] in (0, 0x80):
            continue
        name = _seven_bit(e[:24])
        if not name or "RDOS" in name or "SSI" in name:
            continue
        first = le(e, 30, 2) * SECTOR
        body = data[first : first + e[25] * SECTOR]
        size = le(e, 28, 2)
        body = body[:size] if size else body
        if body:
            kind = chr(e[24] & 0x7F)
            out.append(file(name=name, data_fork=body, type_code=kind if kind in "ABTS" else "?", creator_code="RDOS"))
    return out


def rdos_disks(files: list[dict]) -> list[bytes]:
    """As many disks as the files need; a file has 255 sectors at most."""
    return [write_rdos(f) for f in _dealt(files, 528, 127, SECTOR, lambda n: n if n <= 255 else 529)]


def write_rdos(files: list[dict]) -> bytes:
    sectors = [-(-len(f["data_fork"]) // SECTOR) for f in files]
    if len(files) > 127 or sum(sectors) > 528 or max(sectors, default=0) > 255:
        raise ContainerError("unsupported format", "the files need several disks")
    disk, at = bytearray(143_360), 32
    high = lambda s, n: bytes(b | 0x80 for b in s.encode("ascii")[:n].ljust(n))
    rows = [high("RDOS 3.3 SYSTEM", 24) + bytes([0xD3, 1, 0, 0, 0, 0, 0, 0])]
    for f in files:
        n = -(-len(f["data_fork"]) // SECTOR)
        disk[at * SECTOR : at * SECTOR + len(f["data_fork"])] = f["data_fork"]
        rows.append(high(f["name"], 24) + high(f["type_code"] or "B", 1) + struct.pack("<BHHH", n, 0, len(f["data_fork"]), at))
        at += n
    disk[16 * SECTOR : 16 * SECTOR + 32 * len(rows)] = b"".join(rows)
    return bytes(disk)


# Gutenberg


def is_gutenberg(data: bytes) -> bool:
    at = (17 * 16 + 7) * SECTOR
    return len(data) >= at + SECTOR and bytes(b & 0x7F for b in data[at + 16 : at + 19]) == b"DIR"


def read_gutenberg(data: bytes) -> list[dict]:
    """Files are chains of sectors with 6 bytes of links and 250 of content."""
    if not is_gutenberg(data):
        raise ContainerError("invalid format", "not a Gutenberg volume")
    sector = lambda t, s: data[(t * 16 + s) * SECTOR : (t * 16 + s + 1) * SECTOR]

    def chain(t: int, s: int, most: int):
        for _ in range(most):
            b = sector(t, s)
            if len(b) < SECTOR:
                return
            yield b
            t, s = b[4] & 0x7F, b[5] & 0x7F
            if b[4] & 0x80 or not (t or s):
                return

    out = []
    for b in chain(17, 7, 50):
        for i in range(15):
            e = b[16 + 16 * i : 32 + 16 * i]
            name = _seven_bit(e[:12])
            if not name or name == "DIR":
                continue
            t, s = ((x & 0x7F) % 0x40 if (x & 0x7F) == 0x40 else x & 0x7F for x in e[13:15])
            body = b"".join(x[6:] for x in chain(t, s, 2000))
            if body:
                out.append(file(name=name, data_fork=body, type_code="PRG" if chr(e[12] & 0x7F) in "PM" else "DOC", creator_code="GTNB"))
    return out


#: Sectors of track 17 that hold a Gutenberg directory, in the order of its chain.
_GUTENBERG_DIRECTORY = [*range(7, 16), *range(7)]


def gutenberg_disks(files: list[dict]) -> list[bytes]:
    """As many disks as the files need."""
    return [write_gutenberg(f) for f in _dealt(files, 17 * 16, 15 * len(_GUTENBERG_DIRECTORY) - 1, 250, lambda n: max(1, n))]


def write_gutenberg(files: list[dict]) -> bytes:
    if len(files) >= 15 * len(_GUTENBERG_DIRECTORY) or sum(max(1, -(-len(f["data_fork"]) // 250)) for f in files) > 17 * 16:
        raise ContainerError("unsupported format", "the files need several disks")
    disk, free = bytearray(143_360), [(t, s) for t in range(18, 35) for s in range(16)]
    high = lambda s, n: bytes(b | 0x80 for b in s.encode("ascii")[:n].ljust(n))
    rows = [high("DIR", 12) + bytes([0xA0, 17 | 0x80, 7 | 0x80, 0xA0])]
    for f in files:
        parts = [f["data_fork"][i : i + 250].ljust(250, b"\0") for i in range(0, max(1, len(f["data_fork"])), 250)]
        places = [free.pop(0) for _ in parts]
        for i, (p, (t, s)) in enumerate(zip(parts, places, strict=True)):
            after = places[i + 1] if i + 1 < len(places) else (0x80 | places[0][0], places[0][1])
            disk[(t * 16 + s) * SECTOR : (t * 16 + s + 1) * SECTOR] = bytes([*places[i - 1], t, s, *after]) + p
        t, s = places[0]
        rows.append(high(f["name"], 12) + bytes([0xA0 if f["type_code"] != "PRG" else 0xD0, t | 0x80, (s or 0x40) | 0x80, 0xA0]))
    groups = [rows[i : i + 15] for i in range(0, len(rows), 15)]
    chain = _GUTENBERG_DIRECTORY[: len(groups)]
    for i, (s, g) in enumerate(zip(chain, groups, strict=True)):
        after = (17, chain[i + 1]) if i + 1 < len(chain) else (17 | 0x80, chain[0])
        at = (17 * 16 + s) * SECTOR
        disk[at : at + SECTOR] = bytes([17, chain[i - 1], 17, s, *after]) + bytes(10) + b"".join(g).ljust(240, b"\xa0")
    return bytes(disk)


# Recognition


def filesystem_of(data: bytes) -> str:
    """hfs, mfs, hfs+, prodos, dos33, cpm, pascal, gutenberg, rdos or unknown: the first that fits. Whole
    headers of RDOS and Pascal go before what a file's content can look like."""
    if len(data) <= 1026:
        return "unknown"
    if (kind := {b"BD": "hfs", b"\xd2\xd7": "mfs", b"H+": "hfs+"}.get(data[1024:1026])) is not None:
        return kind
    if is_prodos(data):
        return "prodos"
    headed = has_pascal_header(data)
    if not headed and has_rdos_header(data):
        return "rdos"
    if is_dos(data, 16) or is_dos(data, 13):
        return "dos33"
    if headed:
        return "pascal"
    for kind, probe in (("cpm", is_cpm), ("pascal", is_pascal), ("gutenberg", is_gutenberg), ("rdos", is_rdos)):
        if probe(data):
            return kind
    return "unknown"


READERS = {"mfs": read_mfs, "prodos": read_prodos, "dos33": read_dos, "cpm": read_cpm, "pascal": read_pascal, "gutenberg": read_gutenberg, "rdos": read_rdos}


def read_volume(data: bytes) -> list[dict]:
    kind = filesystem_of(data)
    if kind not in READERS:
        raise ContainerError("unsupported format", f"{kind} volumes have no reader here")
    return READERS[kind](data)


def read_hybrid(data: bytes) -> list[dict]:
    """What DOS, ProDOS, Pascal and CP/M readers all find on one 140K disk."""
    out = []
    for probe, reader in ((is_dos, read_dos), (is_prodos, read_prodos), (is_pascal, read_pascal), (is_cpm, read_cpm)):
        if probe(data):
            out += reader(data)
    return out
