"""Legacy codecs as plain functions of bytes. All are lenient: input that ends early, or turns
invalid, gives what was decoded so far."""

from __future__ import annotations

import binascii
import re
import struct
from bisect import bisect_left
from functools import lru_cache

import numpy as np

from .binary import be, le


def crc16(data: bytes) -> int:
    """CRC-16/XMODEM."""
    return binascii.crc_hqx(data, 0)


def unpack_bits(data: bytes, most: int | None = None) -> bytes:
    """PackBits; most: stop at so many bytes."""
    out, at = bytearray(), 0
    while at < len(data) and (most is None or len(out) < most):
        n, at = data[at], at + 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out if most is None else out[:most])


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while run < 128 and data[at + run : at + run + 1] == data[at : at + 1]:
            run += 1
        if run > 2:
            out += bytes([257 - run, data[at]])
            at += run
            continue
        end = at + 1
        while end < len(data) and end - at < 128 and not data[end] == data[end - 1] == data[min(end + 1, len(data) - 1)]:
            end += 1
        out += bytes([end - at - 1]) + data[at:end]
        at = end
    return bytes(out)


LZW_CHUNK, LZW_CLEAR, LZW_CODES = 4096, 256, 4096


_LZW_FIRST = [bytes([i]) for i in range(256)] + [b""]


def _lzw_chunk(data: bytes, at: int, most: int, growing: bool) -> tuple[bytes, int]:
    out, size, end, first = [], 0, len(data), 9 if growing else 12
    words, width, before = _LZW_FIRST[:], first, None
    held = count = 0  # bits read and not yet taken, lowest first
    while size < most:
        while count < width and at < end:
            held |= data[at] << count
            at, count = at + 1, count + 8
        if count < width:
            break
        code = held & (1 << width) - 1
        held, count = held >> width, count - width
        if code == LZW_CLEAR:
            words, width, before = _LZW_FIRST[:], first, None
            continue
        if code < len(words):
            word = words[code]
        elif code == len(words) and before is not None:
            word = before + before[:1]
        else:
            break
        out.append(word)
        size += len(word)
        if before is not None and len(words) < LZW_CODES:
            words.append(before + word[:1])
            if growing and len(words) >= 1 << width and width < 12:
                width += 1
        before = word
    return b"".join(out)[:most], at


def unlzw(data: bytes, size: int, version: int = 1) -> bytes:
    """LZW in chunks of 4096 bytes. Version 1: 12-bit codes throughout. Version 2: 9 to 12 bits, and
    a byte before each chunk, 0 for stored bytes after a little-endian length."""
    out, at = bytearray(), 0
    while len(out) < size and at < len(data):
        if version == 2:
            flag, at = data[at], at + 1
            if not flag:
                if at + 1 >= len(data):
                    break
                n = le(data, at, 2)
                out += data[at + 2 : at + 2 + n]
                at += 2 + n
                continue
        chunk, now = _lzw_chunk(data, at, min(LZW_CHUNK, size - len(out)), version == 2)
        if now == at and not chunk:
            break
        out, at = out + chunk, now
    return bytes(out[:size])


_ESCAPE = re.compile(rb"\x90(.?)", re.DOTALL)
_RUN = re.compile(rb"([^\x90])\1{3,254}|\x90", re.DOTALL)


def unrepeat(data: bytes) -> bytes:
    """Run lengths behind 0x90: a count repeats the byte before so often in all; 0 is 0x90 itself."""
    out, at = bytearray(), 0
    for m in _ESCAPE.finditer(data):
        out += data[at : m.start()]
        at, n = m.end(), m[1]
        if n == b"\0":
            out.append(0x90)
        elif n and out:
            out += out[-1:] * (n[0] - 1)
    return bytes(out + data[at:])


def repeat(data: bytes) -> bytes:
    return _RUN.sub(lambda m: m[1] + bytes([0x90, len(m[0])]) if m[1] else b"\x90\0", data)


@lru_cache(4)
def _squeeze_steps(tree: tuple[int, ...]) -> tuple[dict, ...]:
    """For each node, filled as bytes are met: a byte to the values that it ends and the node it leads to, or None at the end."""
    return tuple({} for _ in range(len(tree) // 2))


def _squeeze_step(tree: tuple[int, ...], node: int, byte: int) -> tuple[bytes, int | None]:
    out = bytearray()
    for i in range(8):
        node = tree[2 * node + (byte >> i & 1)]
        if node < 0:
            if -(node + 1) == 256:
                return bytes(out), None
            out.append(-(node + 1) & 255)
            node = 0
        elif node >= len(tree) // 2:
            return bytes(out), None
    return bytes(out), node


def unsqueeze(data: bytes) -> tuple[bytes, str | None]:
    """Squeeze: an optional header 76 FF with checksum and name, a tree of at most 511 nodes, bits
    lowest first; leaves are -(value + 1), 256 ends; then run lengths."""
    at, name = 0, None
    if data[:2] == b"\x76\xff":
        end = data.find(b"\0", 4)
        end = len(data) if end < 0 else end
        name, at = data[4:end].decode("latin-1"), end + 1
    nodes = le(data, at, 2)
    at += 2
    if not 0 < nodes < 512 or at + 4 * nodes > len(data):
        return b"", name
    tree = struct.unpack_from(f"<{2 * nodes}h", data, at)
    steps, node, out = _squeeze_steps(tree), 0, []
    for byte in data[at + 4 * nodes :]:
        step = steps[node].get(byte)
        if step is None:
            step = steps[node][byte] = _squeeze_step(tree, node, byte)
        out.append(step[0])
        node = step[1]
        if node is None:
            break
    return unrepeat(b"".join(out)), name


class AdaptiveTree:
    """The adaptive Huffman tree of LZHUF: 314 symbols, halved when the root's count reaches 32768.

    Nodes are kept in rising order of their counts; a symbol's path is from the root, 1 for the
    upper child of a pair.
    """

    SYMBOLS = 256 - 2 + 60

    def __init__(self):
        n = self.SYMBOLS
        self.root = 2 * n - 2
        self.count = [1] * n + [0] * (n - 1)
        self.leaf = list(range(n)) + [None] * (n - 1)  # symbol of a node, if it is one
        self.low = [None] * (2 * n - 1)  # the lower of a node's two neighbouring children
        self.up = [0] * (2 * n - 1)
        self.place = list(range(n))  # node of a symbol
        for i in range(n - 1):
            self._join(n + i, 2 * i)
        self.up[self.root] = None

    def _join(self, node: int, low: int) -> None:
        self.count[node] = self.count[low] + self.count[low + 1]
        self.low[node], self.leaf[node] = low, None
        self.up[low] = self.up[low + 1] = node

    def _halve(self) -> None:
        leaves = [(self.leaf[i], (self.count[i] + 1) // 2) for i in range(self.root + 1) if self.leaf[i] is not None]
        nodes = [(c, s, None) for s, c in leaves]
        made = 0
        while len(nodes) < self.root + 1:  # pairs in order; a sum goes behind all that are not larger
            c = nodes[made][0] + nodes[made + 1][0]
            at = len(nodes)
            while nodes[at - 1][0] > c:
                at -= 1
            nodes.insert(at, (c, None, made))
            made += 2
        for i, (c, s, low) in enumerate(nodes):
            self.count[i], self.leaf[i], self.low[i] = c, s, low
            if s is not None:
                self.place[s] = i
            else:
                self.up[low] = self.up[low + 1] = i
        self.up[self.root] = None

    def _swap(self, a: int, b: int) -> None:
        leaf, low = self.leaf, self.low
        leaf[a], leaf[b] = leaf[b], leaf[a]
        low[a], low[b] = low[b], low[a]
        for node in (a, b):
            if (symbol := leaf[node]) is not None:
                self.place[symbol] = node
            else:
                child = low[node]
                self.up[child] = self.up[child + 1] = node

    def add(self, symbol: int) -> None:
        root, count, up = self.root, self.count, self.up
        if count[root] >= 0x8000:
            self._halve()
        node = self.place[symbol]
        while node != root:
            c = count[node] = count[node] + 1
            if count[node + 1] < c:  # nodes are in rising order, and a parent has no less than its child had
                last = bisect_left(count, c, node + 1, root + 1) - 1
                count[node], count[last] = count[last], c
                self._swap(node, last)
                node = last
                if node == root:
                    return
            node = up[node]
        count[root] += 1

    def path(self, symbol: int) -> list[int]:
        """Pairs of children start at even nodes."""
        node, root, up, out = self.place[symbol], self.root, self.up, []
        while node != root:
            out.append(node & 1)
            node = up[node]
        return out[::-1]


def position_codes() -> list[tuple[int, int]]:
    """(code, length) of the upper six bits of a position: 1, 3, 8, 12, 24 and 16 codes of 3 to 8
    bits, handed out in order as a prefix code."""
    out, code, before = [], 0, 3
    for length, count in zip(range(3, 9), (1, 3, 8, 12, 24, 16), strict=True):
        for _ in range(count):
            code <<= length - before
            before = length
            out.append((code, length))
            code += 1
    return out


LZH_WINDOW, LZH_LONGEST, LZH_LEAST = 4096, 60, 2


def lzh_symbols(tree: AdaptiveTree, bits: bytes, at: int, most: int, size: int) -> tuple[list[int], list[int]]:
    """Symbols for so many bytes from a bit on, and the place of each that is a match, else 0."""
    symbols, places, root, leaf, low = [], [], tree.root, tree.leaf, tree.low
    codes = {(c, n): i for i, (c, n) in enumerate(position_codes())}
    while size > 0 and at <= most:
        node = root
        while (symbol := leaf[node]) is None:
            node = low[node] + bits[at]
            at += 1
        tree.add(symbol)
        symbols.append(symbol)
        if symbol < 256:
            places.append(0)
            size -= 1
            continue
        code, n = 0, 0
        while (code, n) not in codes and n < 9:
            code, n = code << 1 | bits[at], n + 1
            at += 1
        place = 0
        for b in bits[at : at + 6]:
            place = place << 1 | b
        at += 6
        places.append(codes.get((code, n), 0) << 6 | place)
        size -= symbol - 255 + LZH_LEAST
    return symbols, places


def lzh_bytes(symbols: np.ndarray, places: np.ndarray, size: int, fill: int) -> bytes:
    """Literals, and matches in the window behind, which is filled at first."""
    out, literal, done = bytearray([fill]) * LZH_WINDOW, symbols.astype(np.uint8).tobytes(), 0
    matches = np.flatnonzero(symbols > 255)
    for i, n, back in zip(matches.tolist(), (symbols[matches] - 255 + LZH_LEAST).tolist(), (places[matches] + 1).tolist(), strict=True):
        out += literal[done:i]
        done, start = i + 1, len(out) - back
        out += out[start : start + n] if back >= n else (out[start:] * (n // back + 1))[:n]
    out += literal[done:]
    return bytes(out[LZH_WINDOW : LZH_WINDOW + size])


def unlzhuf(data: bytes, size: int, fill: int = 0x20) -> bytes:
    """LZHUF: adaptive Huffman over a 4096-byte window; bits past the end read as zero."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8)).tobytes() + bytes(1024)  # more than a symbol takes
    symbols, places = lzh_symbols(AdaptiveTree(), bits, 0, 8 * (len(data) + 8), size)
    return lzh_bytes(np.array(symbols, np.int64), np.array(places, np.int64), size, fill)


def undart_rle(data: bytes, size: int | None = None) -> bytes:
    """Runs of 16-bit words: a positive count of literal words, or a negative count of one word's copies."""
    out, at = bytearray(), 0
    while at + 2 <= len(data) and (size is None or len(out) < size):
        n = struct.unpack_from(">h", data, at)[0]
        at += 2
        if n > 0:
            out += data[at : at + 2 * n]
            at += 2 * n
        elif n < 0:
            out += data[at : at + 2] * -n
            at += 2
        else:
            break
    return bytes(out if size is None else out[:size])


def rotating_checksum(data: bytes) -> int:
    """Add each big-endian word, then rotate right by one bit, in 32 bits; words of zero only rotate."""
    words = np.frombuffer(data, ">u2", len(data) // 2)
    places = np.flatnonzero(words)
    total, done = 0, 0
    for i, w in zip(places.tolist(), words[places].tolist(), strict=True):
        if i > done:
            total = _rotated(total, i - done)
        total = total + w & 0xFFFFFFFF
        total = total >> 1 | (total & 1) << 31
        done = i + 1
    return _rotated(total, len(words) - done)


def _rotated(value: int, by: int) -> int:
    by %= 32
    return (value >> by | value << 32 - by) & 0xFFFFFFFF


def wav(samples: bytes, rate: int, bits: int = 8, channels: int = 1) -> bytes:
    frame = channels * bits // 8
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * frame, frame, bits, b"data", len(samples))
    return head + samples


def apple_double(rsrc: bytes, type_code: str | None, creator: str | None, flags: int = 0, always: bool = False) -> bytes:
    """An AppleDouble header file. always: Finder info and fork entries in any case, codes cut or
    padded to four bytes; else only what there is, and codes of exactly four characters."""

    def code(c):
        if always:
            return (c or "").encode()[:4].ljust(4, b" ")
        raw = (c or "").encode("mac_roman", "replace")
        return raw if len(raw) == 4 else b"\0" * 4

    entries = []
    if always or type_code or creator:
        entries.append((9, code(type_code) + code(creator) + struct.pack(">H", flags) + b"\0" * 22))
    if always or rsrc:
        entries.append((2, rsrc))
    at = 26 + 12 * len(entries)
    table = body = b""
    for kind, content in entries:
        table += struct.pack(">III", kind, at + len(body), len(content))
        body += content
    return struct.pack(">II16xH", 0x00051607, 0x00020000, len(entries)) + table + body


