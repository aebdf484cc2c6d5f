"""Resource forks: the map of a fork, and decoders of single resources, as functions of bytes.

Decoders return None where the data are too short for their fixed part.
"""

from __future__ import annotations

import struct
import zlib
from collections import namedtuple

import numpy as np

from .binary import be, mac_roman, pascal_string, signed

Resource = namedtuple("Resource", "ordinal type_code resource_id name attributes data_offset data_length")


def parse_fork(fork: bytes) -> list[Resource]:
    """The resources of a fork in map order; [] if it isn't one."""
    if len(fork) < 16:
        return []
    data_at, map_at, data_size, map_size = struct.unpack_from(">4I", fork)
    if map_size < 28 or map_at + map_size > len(fork) or data_at + data_size > len(fork):
        return []
    types_at, names_at = map_at + be(fork, map_at + 24, 2), map_at + be(fork, map_at + 26, 2)
    if types_at + 2 > len(fork):
        return []
    out = []
    for t in range((be(fork, types_at, 2) + 1) & 0xFFFF):
        at = types_at + 2 + 8 * t
        if at + 8 > len(fork):
            break
        code, refs = mac_roman(fork[at : at + 4]), types_at + be(fork, at + 6, 2)
        for r in range(be(fork, at + 4, 2) + 1):
            ref = refs + 12 * r
            if ref + 12 > len(fork):
                break
            name_at, start = be(fork, ref + 2, 2), data_at + be(fork, ref + 5, 3)
            if start + 4 > len(fork):
                continue
            name = None if name_at == 0xFFFF or names_at + name_at >= len(fork) else pascal_string(fork, names_at + name_at)
            out.append(Resource(len(out), code, signed(be(fork, ref, 2), 16), name, fork[ref + 4], start + 4, be(fork, start, 4)))
    return out


def build_fork(resources: list[tuple[str, int, str | None, bytes]]) -> bytes:
    """A fork of (type, id, name, data)."""
    kinds: dict[str, list] = {}
    data, names = b"", b""
    for code, number, name, content in resources:
        at = 0xFFFF if name is None else len(names)
        if name is not None:
            raw = name.encode("mac_roman", "replace")[:255]
            names += bytes([len(raw)]) + raw
        kinds.setdefault(code, []).append(struct.pack(">hH", number, at) + struct.pack(">I", len(data)) + b"\0" * 4)
        data += struct.pack(">I", len(content)) + content
    types, refs, at = struct.pack(">H", (len(kinds) - 1) & 0xFFFF), b"", 2 + 8 * len(kinds)
    for code, rows in kinds.items():
        types += code.encode("mac_roman").ljust(4)[:4] + struct.pack(">HH", len(rows) - 1, at + len(refs))
        refs += b"".join(rows)
    lists = types + refs
    size = 28 + len(lists) + len(names)
    head = struct.pack(">4I", 16, 16 + len(data), len(data), size)
    return head + data + head + b"\0" * 8 + struct.pack(">HH", 28, 28 + len(lists)) + lists + names


def resource_data(fork: bytes, r: Resource) -> bytes | None:
    out = fork[r.data_offset : r.data_offset + r.data_length]
    return out if r.data_length and len(out) == r.data_length else None


def describe(r: Resource) -> str:
    """TYPE #id 'name' (n bytes) [attrs: 0x..]"""
    name = f" '{r.name}'" if r.name else ""
    attributes = f" [attrs: 0x{r.attributes:02X}]" if r.attributes else ""
    return f"{r.type_code} #{r.resource_id}{name} ({r.data_length} bytes){attributes}"


def overview(resources: list[Resource], most: int = 10) -> str:
    """Each type with its count and first resources, ids rising."""
    lines = []
    for code in sorted({r.type_code for r in resources}):
        rows = sorted((r for r in resources if r.type_code == code), key=lambda r: r.resource_id)
        lines.append(f"{code} ({len(rows)})")
        lines += [f"  #{r.resource_id}{f' {r.name}' if r.name else ''} ({r.data_length} bytes)" for r in rows[:most]]
        if len(rows) > most:
            lines.append(f"  ... and {len(rows) - most} more")
    return "\n".join(lines)


#: Resource types and what they hold.
RESOURCE_TYPES = {
    "ICON": "32×32 black & white icon", "ICN#": "32×32 icon with mask", "icl4": "32×32 4-bit color icon", "icl8": "32×32 8-bit color icon",
    "ics#": "16×16 icon with mask", "ics4": "16×16 4-bit color icon", "ics8": "16×16 8-bit color icon", "cicn": "Color icon with palette",
    "snd ": "Sound resource", "SND ": "Sound resource (System 6)",
    "STR ": "String resource", "STR#": "String list resource", "TEXT": "Plain text", "styl": "Styled text formatting",
    "MENU": "Menu definition", "MBAR": "Menu bar", "MDEF": "Menu definition procedure", "DLOG": "Dialog template", "DITL": "Dialog item list",
    "ALRT": "Alert template", "CNTL": "Control template", "WIND": "Window template",
    "FOND": "Font family", "FONT": "Bitmap font", "NFNT": "New bitmap font", "sfnt": "TrueType/OpenType font", "FREF": "File reference (bundle)", "BNDL": "Bundle (file type associations)",
    "CODE": "68K code segment", "CDEF": "Control definition function", "WDEF": "Window definition function", "LDEF": "List definition function", "PACK": "Package code", "DRVR": "Desk accessory / driver", "cfrg": "Code Fragment (PowerPC)",
    "PICT": "QuickDraw picture", "PNTG": "MacPaint image", "CURS": "Cursor (16×16 B&W)", "crsr": "Color cursor", "PAT ": "Pattern (8×8 B&W)", "PAT#": "Pattern list", "ppat": "Pixel pattern (color)", "clut": "Color lookup table", "pltt": "Palette", "SICN": "Small icon list (16×16 B&W)",
    "vers": "Version information", "SIZE": "Application size/flags", "kind": "Finder kind string",
    "TMPL": "Resource template", "actb": "Alert color table", "cctb": "Control color table", "dctb": "Dialog color table", "wctb": "Window color table", "ictb": "Item color table", "mctb": "Menu color table", "PREF": "Preferences", "KCHR": "Keyboard mapping", "KMAP": "Key mapping", "INTL": "International resource", "itl0": "Script formatting", "itl1": "Script sorting",
}


def version(data: bytes) -> dict | None:
    if len(data) < 7:
        return None
    stage = {0x20: "development", 0x40: "alpha", 0x60: "beta"}.get(data[2], "release")
    short = pascal_string(data, 6)
    return {"major": data[0], "minor": data[1] >> 4, "fix": data[1] & 15, "stage": stage, "short": short, "long": pascal_string(data, 7 + data[6])}


def string(data: bytes) -> str | None:
    return pascal_string(data, 0) if data and len(data) > data[0] else None


def strings(data: bytes) -> list[str] | None:
    if len(data) < 2:
        return None
    out, at = [], 2
    for _ in range(be(data, 0, 2)):
        if at >= len(data) or at + 1 + data[at] > len(data):
            break
        out.append(pascal_string(data, at))
        at += 1 + data[at]
    return out


def menu(data: bytes) -> dict | None:
    if len(data) < 15:
        return None
    items, at = [], 15 + data[14]
    while at < len(data) and data[at]:
        end = at + 1 + data[at]
        if end + 4 > len(data):
            break
        text = pascal_string(data, at)
        items.append({"title": text, "key": mac_roman(data[end + 1 : end + 2]) if data[end + 1] else None, "separator": text == "-"})
        at = end + 4
    return {"menu_id": signed(be(data, 0, 2), 16), "title": pascal_string(data, 14), "items": items}


def dialog_items(data: bytes) -> list[dict] | None:
    if len(data) < 2:
        return None
    kinds = {0: "userItem", 4: "button", 5: "checkbox", 6: "radioButton", 7: "control", 8: "staticText", 16: "editText", 32: "icon", 64: "picture"}
    out, at = [], 2
    for _ in range((be(data, 0, 2) + 1) & 0xFFFF):
        if at + 14 > len(data):
            break
        top, left, bottom, right = struct.unpack_from(">4h", data, at + 4)
        kind, n = data[at + 12] & 0x7F, data[at + 13]
        text = mac_roman(data[at + 14 : at + 14 + n]) if at + 14 + n <= len(data) else ""
        out.append({"kind": kinds.get(kind, f"item({kind})"), "top": top, "left": left, "bottom": bottom, "right": right, "text": text})
        at += 14 + n + (n & 1)
    return out or None


def font(data: bytes, compat: bool = True) -> dict | None:
    """Metrics of a FONT or NFNT. compat: at the places where catalogs made so far have them
    (ascent at 10, descent at 12, leading at 14, row words at 16, height at 22); else where the
    public format has them."""
    if len(data) < 26:
        return None
    v = struct.unpack_from(">13h", data)
    kind, first, last, widest = v[:4]
    ascent, descent, leading, words, tall = (v[5], v[6], v[7], v[8], v[11]) if compat else (v[9], v[10], v[11], v[12], v[7])
    return {"kind": kind, "first": first, "last": last, "widest": widest, "ascent": ascent, "descent": descent, "leading": leading, "row_words": words & 0xFFFF, "height": tall, "rect_width": v[6]}


def font_text(f: dict) -> str:
    return "\n".join([f"Characters: {f['first']}-{f['last']}", f"Max width: {f['widest']}", f"Ascent: {f['ascent']}", f"Descent: {f['descent']}", f"Leading: {f['leading']}", f"Height: {f['height']}"])


def bdf(data: bytes, name: str) -> str | None:
    """A bitmap font in BDF; each glyph's own bits, found through the location table."""
    f = font(data, compat=False)
    if not f:
        return None
    row, height = 2 * f["row_words"], f["height"]
    bits, table = data[26 : 26 + row * height], 26 + row * height
    chars = []
    for i in range(f["last"] - f["first"] + 1):
        if table + 2 * i + 4 > len(data):
            break
        left, right = struct.unpack_from(">HH", data, table + 2 * i)
        width = right - left
        lines = []
        for y in range(height):
            value = be(bits, y * row, row) if row else 0
            piece = value >> max(0, 8 * row - right) & ((1 << width) - 1) if width > 0 else 0
            size = max(1, (width + 7) // 8)
            lines.append(f"{piece << (8 * size - max(width, 0)):0{2 * size}X}")
        code = f["first"] + i
        chars += [f"STARTCHAR char{code}", f"ENCODING {code}", f"DWIDTH {width} 0", f"BBX {width} {height} 0 {-f['descent']}", "BITMAP", *lines, "ENDCHAR"]
    count = sum(c.startswith("STARTCHAR") for c in chars)
    return "\n".join(["STARTFONT 2.1", f"FONT {name}", f"SIZE {f['height']} 72 72", f"FONTBOUNDINGBOX {f['rect_width']} {height} 0 {-f['descent']}", f"CHARS {count}", *chars, "ENDFONT"])


def code(data: bytes) -> dict | None:
    return {"first": be(data, 0, 2), "count": be(data, 2, 2)} if len(data) >= 4 else None


def bundle(data: bytes) -> dict | None:
    if len(data) < 10:
        return None
    out, at = [], 8
    for _ in range((be(data, 6, 2) + 1) & 0xFFFF):
        if at + 6 > len(data):
            break
        kind, n = mac_roman(data[at : at + 4]), be(data, at + 4, 2) + 1
        at += 6
        for _ in range(n):
            if at + 4 > len(data):
                break
            out.append({"type_code": kind, "local_id": be(data, at, 2), "resource_id": signed(be(data, at + 2, 2), 16)})
            at += 4
    return {"signature": mac_roman(data[:4]), "entries": out}


def color_table(data: bytes) -> list[dict] | None:
    if len(data) < 8:
        return None
    n = (be(data, 6, 2) + 1) & 0xFFFF
    return [dict(zip(("index", "r", "g", "b"), struct.unpack_from(">4H", data, 8 + 8 * i), strict=True)) for i in range(n) if 16 + 8 * i <= len(data)]


def sound(data: bytes) -> dict | None:
    """Header of a 'snd ' resource, formats 1 and 2; where its samples are."""
    if len(data) < 6:
        return None
    kind, at, channels = be(data, 0, 2), 4, 1
    if kind == 1:
        at = 4 + 6 * be(data, 2, 2)
    elif kind != 2:
        return None
    commands = be(data, at, 2)
    for i in range(commands):
        c = at + 2 + 8 * i
        if c + 8 > len(data):
            return None
        if be(data, c, 2) & 0x7FFF in (80, 81):
            head = be(data, c + 4, 4)
            if head + 22 > len(data):
                return None
            encoding, size, bits, start = data[head + 20], be(data, head + 4, 4), 8, head + 22
            if encoding == 0xFF and head + 64 <= len(data):
                channels, bits, start = size, be(data, head + 48, 2), head + 64
                size = be(data, head + 22, 4) * channels * bits // 8
            return {"format": kind, "rate": be(data, head + 8, 4) >> 16, "bits": bits, "channels": channels, "compressed": encoding not in (0, 0xFF), "start": start, "size": min(size, len(data) - start)}
    return None


def sound_samples(data: bytes) -> bytes | None:
    s = sound(data)
    return data[s["start"] : s["start"] + s["size"]] if s and not s["compressed"] else None


def envelope(samples: bytes, buckets: int) -> list[tuple[int, int]]:
    """Least and largest 8-bit sample of each bucket."""
    step = max(1, len(samples) // max(1, buckets))
    return [(min(p), max(p)) for i in range(0, len(samples), step) if (p := samples[i : i + step])][:buckets]


# Images are (width, height, RGBA bytes).
BLACK, WHITE, CLEAR = b"\0\0\0\xff", b"\xff\xff\xff\xff", b"\0\0\0\0"
_PIXELS = np.frombuffer(WHITE + BLACK + CLEAR, np.uint8).reshape(3, 4)


def one_bit(data: bytes, width: int, height: int, mask: bytes | None = None) -> tuple | None:
    row = (width + 7) // 8
    if len(data) < row * height:
        return None
    if mask is not None and len(mask) < row * height:
        raise IndexError("mask ends early")
    bits = lambda b: np.unpackbits(np.frombuffer(b, np.uint8, row * height).reshape(height, row), axis=1)[:, :width]
    kinds = bits(data) if mask is None else np.where(bits(mask) == 0, 2, bits(data))
    return width, height, _PIXELS[kinds].tobytes()


#: The 16-colour palette as RGB.
PALETTE_16 = (
    (255, 255, 255), (252, 243, 5), (255, 100, 2), (221, 8, 6), (242, 8, 132), (70, 0, 165), (0, 0, 211), (2, 171, 234),
    (31, 183, 20), (0, 100, 17), (86, 44, 5), (144, 113, 58), (192, 192, 192), (128, 128, 128), (64, 64, 64), (0, 0, 0),
)


def palette_256() -> list[bytes]:
    """215 colours of a 6x6x6 cube from white on, blue fastest; ten shades each of red, green, blue and grey; black."""
    steps = [255, 204, 153, 102, 51, 0]
    cube = [bytes([r, g, b]) for r in steps for g in steps for b in steps][:-1]
    shades = [238, 221, 187, 170, 136, 119, 85, 68, 34, 17]
    ramps = [bytes(v if i in on else 0 for i in range(3)) for on in ((0,), (1,), (2,), (0, 1, 2)) for v in shades]
    return [*cube, *ramps, b"\0\0\0"]


def indexed(data: bytes, width: int, height: int, bits: int) -> tuple | None:
    if len(data) < width * height * bits // 8:
        return None
    if bits == 4:
        colors = [bytes(c) for c in PALETTE_16]
        values = [v for b in data[: width * height // 2] for v in (b >> 4, b & 15)]
    else:
        colors, values = palette_256(), data[: width * height]
    return width, height, b"".join(colors[v] + b"\xff" for v in values)


def color_icon(data: bytes) -> tuple | None:
    """cicn: its one-bit picture and mask."""
    if len(data) < 82:
        return None
    top, left, bottom, right = struct.unpack_from(">4h", data, 6)
    width, height = right - left, bottom - top
    if not (0 < width <= 256 and 0 < height <= 256):
        return None
    row = be(data, 54, 2) & 0x3FFF
    bit_row = be(data, 68, 2) & 0x3FFF
    start = 82 + row * height
    exact = (width + 7) // 8
    take = lambda at, r: b"".join(data[at + y * r : at + y * r + exact].ljust(exact, b"\0") for y in range(height))
    if start + bit_row * height > len(data):
        return None
    return one_bit(take(start, bit_row), width, height, take(82, row))


def render(type_code: str, data: bytes) -> tuple | None:
    """The image of an icon-like resource, or None."""
    pair = lambda n: (data[:n], data[n : 2 * n] if len(data) >= 2 * n else None)
    if type_code == "ICON":
        return one_bit(data, 32, 32)
    if type_code == "ICN#":
        return one_bit(pair(128)[0], 32, 32, pair(128)[1])
    if type_code == "ics#":
        return one_bit(pair(32)[0], 16, 16, pair(32)[1])
    if type_code == "CURS":
        return one_bit(data[:32], 16, 16, data[32:64]) if len(data) >= 64 else None
    if type_code == "PAT ":
        return one_bit(data, 8, 8)
    if type_code == "SICN":
        return one_bit(data, 16, 16)
    if type_code in ("icl4", "icl8", "ics4", "ics8"):
        side = 32 if type_code[2] == "l" else 16
        return indexed(data, side, side, int(type_code[3]))
    if type_code == "cicn":
        return color_icon(data)
    return None


BEST_ICONS = ("icl8", "icl4", "ICN#", "ICON", "cicn", "ics8", "ics4", "ics#")


def best_icon(fork: bytes) -> tuple | None:
    """The first that renders, by kind, then by map order."""
    resources = parse_fork(fork)
    for kind in BEST_ICONS:
        for r in resources:
            if r.type_code == kind and (image := render(kind, resource_data(fork, r) or b"")):
                return image
    return None


def mac_paint(data: bytes) -> tuple | None:
    from .codecs import unpack_bits

    if len(data) < 513:
        return None
    return one_bit(unpack_bits(data[512:], 51840).ljust(51840, b"\0"), 576, 720)


def png(image: tuple) -> bytes:
    width, height, rgba = image
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + rgba[4 * width * y : 4 * width * (y + 1)] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def scaled(image: tuple, side: int = 128) -> tuple:
    """Nearest pixels, within side x side."""
    width, height, rgba = image
    w, h = (side, max(1, height * side // width)) if width >= height else (max(1, width * side // height), side)
    pixels = np.frombuffer(rgba, np.uint8, 4 * width * height).reshape(height, width, 4)
    return w, h, pixels[np.arange(h) * height // h][:, np.arange(w) * width // w].tobytes()


def waveform(samples: bytes, side: int = 128) -> tuple:
    """A picture of the envelope."""
    rows = [bytearray(WHITE * side) for _ in range(side)]
    for x, (low, high) in enumerate(envelope(samples, side)):
        for y in range(side - 1 - high * side // 256, side - low * side // 256):
            rows[max(0, min(side - 1, y))][4 * x : 4 * x + 4] = BLACK
    return side, side, b"".join(rows)
