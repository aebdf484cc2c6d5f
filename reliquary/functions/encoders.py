"""Compressors for the legacy codecs, for round trips; the codecs themselves are in `codecs`."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

from .codecs import AdaptiveTree, position_codes, repeat


def lzhuf(data: bytes, reach: int = 256) -> bytes:
    """Literals, and matches up to `reach` back, greedily."""
    tree, bits, codes, i = AdaptiveTree(), bytearray(), position_codes(), 0
    while i < len(data):
        size, back = 0, 0
        start = data.rfind(data[i : i + 3], max(0, i - reach), i + 2) if i + 3 <= len(data) else -1
        if 0 <= start < i:
            ahead = data[i : i + 60]
            unlike = int.from_bytes(data[start : start + len(ahead)], "little") ^ int.from_bytes(ahead, "little")
            back, size = i - start, ((unlike & -unlike).bit_length() - 1) // 8 if unlike else len(ahead)
        symbol = 253 + size if size else data[i]
        bits.extend(tree.path(symbol))
        tree.add(symbol)
        if size:
            code, n = codes[back - 1 >> 6]
            bits.extend(map(int, f"{code:0{n}b}{back - 1 & 63:06b}"))
        i += max(1, size)
    return np.packbits(np.frombuffer(bits, np.uint8)).tobytes()


def lzw(data: bytes, version: int = 1) -> bytes:
    """Chunks of 4096 bytes; version 2 with growing codes and a flag before each."""
    out = []
    for at in range(0, len(data), 4096):
        chunk = data[at : at + 4096]
        longer, made, codes, word = {}, 257, [], chunk[0]  # a word's code and a byte, to the code of both
        for b in chunk[1:]:
            key = word << 8 | b
            known = longer.get(key)
            if known is None:
                codes.append(word)
                if made < 4096:
                    longer[key] = made
                    made += 1
                word = b
            else:
                word = known
        codes.append(word)
        # The reader's table has 257 + i words when it comes to the code i, counted from the second.
        width = np.full(len(codes), 12)
        if version == 2:
            width = np.minimum(12, np.maximum(9, np.floor(np.log2(256 + np.maximum(1, np.arange(len(codes))))).astype(int) + 1))
        starts = np.cumsum(width) - width
        codes, bits = np.array(codes), np.zeros(int(width.sum()), np.uint8)
        for k in range(12):
            has = width > k
            bits[starts[has] + k] = codes[has] >> k & 1
        out.append((b"\1" if version == 2 else b"") + np.packbits(bits, bitorder="little").tobytes())
    return b"".join(out)


@lru_cache(1)
def _balanced_tree() -> tuple[list[tuple[int, int]], list[str]]:
    """Nodes of a balanced tree over all 257 values, and the path to each value."""
    nodes: list = []

    def grow(values):
        me = len(nodes)
        nodes.append(None)
        half = len(values) // 2
        nodes[me] = tuple(-(p[0] + 1) if len(p) == 1 else grow(p) for p in (values[:half], values[half:]))
        return me

    grow(list(range(257)))
    paths = [""] * 257
    todo = [(0, "")]
    while todo:
        n, path = todo.pop()
        for bit, child in enumerate(nodes[n]):
            if child < 0:
                paths[-(child + 1)] = path + str(bit)
            else:
                todo.append((child, path + str(bit)))
    return nodes, paths


def squeeze(data: bytes, name: str | None = None) -> bytes:
    """Run lengths, then a balanced tree over all 257 values."""
    nodes, paths = _balanced_tree()
    bits = "".join(map(paths.__getitem__, repeat(data))) + paths[256]
    head = b"" if name is None else b"\x76\xff" + struct.pack("<H", sum(data) & 0xFFFF) + name.encode("latin-1") + b"\0"
    body = np.packbits(np.frombuffer(bits.encode(), np.uint8) & 1, bitorder="little").tobytes()
    return head + struct.pack("<H", len(nodes)) + b"".join(struct.pack("<hh", *n) for n in nodes) + body
