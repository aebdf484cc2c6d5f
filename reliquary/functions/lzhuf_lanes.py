"""LZHUF of many texts at a time, byte for byte what `encoders.lzhuf` and `codecs.unlzhuf` give.

Each text has a lane with an adaptive tree of its own; a step codes one symbol of every lane, as
whole arrays. Where few lanes are left, the texts go on by themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from .codecs import LZH_LEAST, LZH_LONGEST, AdaptiveTree, lzh_bytes, lzh_symbols, position_codes

#: Lanes under which a step of arrays costs more than its symbols by themselves.
FEW = 200
NODES = 2 * AdaptiveTree.SYMBOLS  # one is not used, so pairs start at even places in every lane
#: Texts and bytes that are coded together.
MOST, BYTES = 4096, 12 << 20


class Trees:
    """AdaptiveTree of each lane; nodes are numbered through all lanes, `low` of a leaf is -(symbol + 1)."""

    def __init__(self, lanes: int):
        tree = AdaptiveTree()
        first = np.arange(lanes)[:, None] * NODES
        low = np.array([low if symbol is None else -(symbol + 1) for symbol, low in zip(tree.leaf, tree.low, strict=True)] + [-1])
        self.count = np.tile(np.array([*tree.count, 0], np.int32), lanes)
        self.low = np.where(low < 0, low, low + first).astype(np.int32).reshape(-1)
        self.up = (np.array([*tree.up[:-1], tree.root, 0]) + first).astype(np.int32).reshape(-1)
        self.place = (np.array(tree.place) + first).astype(np.int32).reshape(-1)
        self.roots = first[:, 0] + tree.root

    def one(self, lane: int) -> AdaptiveTree:
        """The tree of a lane by itself."""
        tree, first = AdaptiveTree(), lane * NODES
        of = lambda a, n, by: [x - by for x in a[lane * n : lane * n + n].tolist()]
        low = self.low[first : first + NODES - 1].tolist()
        tree.count, tree.place = of(self.count, NODES, 0)[:-1], of(self.place, AdaptiveTree.SYMBOLS, first)
        tree.up = [*of(self.up, NODES, first)[:-2], None]
        tree.leaf, tree.low = [-x - 1 if x < 0 else None for x in low], [None if x < 0 else x - first for x in low]
        return tree

    def put(self, lane: int, tree: AdaptiveTree) -> None:
        first, symbols = lane * NODES, tree.SYMBOLS
        self.count[first : first + NODES - 1] = tree.count
        self.up[first : first + NODES - 2] = np.array(tree.up[:-1]) + first
        self.place[lane * symbols : (lane + 1) * symbols] = np.array(tree.place) + first
        self.low[first : first + NODES - 1] = [first + low if symbol is None else -(symbol + 1) for symbol, low in zip(tree.leaf, tree.low, strict=True)]

    def leaves(self, lanes, symbols):
        return self.place.take(lanes * AdaptiveTree.SYMBOLS + symbols)

    def add(self, lanes, symbols) -> None:
        count, up, roots = self.count, self.up, self.roots.take(lanes)
        total = count.take(roots)
        for lane in lanes[total >= 0x8000].tolist():
            tree = self.one(lane)
            tree._halve()
            self.put(lane, tree)
        count[roots] += 1
        node = self.leaves(lanes, symbols)
        while node.size:
            c = count.take(node) + 1
            count[node] = c
            late = np.flatnonzero(count.take(node + 1) < c)
            if late.size:
                node[late] = self._swapped(node.take(late), c.take(late), roots.take(late))
            node = up.take(node)
            going = node != roots
            node, roots = node[going], roots[going]

    def _swapped(self, node, c, roots):
        """Each node changes places with the last that has a lower count, and is there then."""
        count, low, up = self.count, self.low, self.up
        last, some, climbed = node + 1, np.arange(len(node)), []

        def climb(some, step):
            at = np.minimum(last.take(some) + step, roots.take(some))
            lower = count.take(at) < c.take(some)
            some = some[lower]
            last[some] = at[lower]
            return some

        while (some := climb(some, 1 << len(climbed))).size:
            climbed.append(some)
        for i in reversed(range(len(climbed))):  # who climbed steps up to this one has less than its double before it
            climb(climbed[i], 1 << i)
        count[node], count[last] = c - 1, c
        here, there = low.take(node), low.take(last)
        low[node], low[last] = there, here
        for at, below in ((node, there), (last, here)):
            leaf = below < 0
            mine = at[leaf]
            self.place[mine // NODES * AdaptiveTree.SYMBOLS - below[leaf] - 1] = mine
            below, at = below[~leaf], at[~leaf]
            up[below] = up[below + 1] = at
        return last


def batches(rows: Iterable, weight) -> Iterator[list]:
    """So many rows, or rows of so much weight, at a time; a heavier row is alone."""
    held, size = [], 0
    for r in rows:
        own = weight(r)
        if held and (len(held) >= MOST or size + own > BYTES):
            yield held
            held, size = [], 0
        held.append(r)
        size += own
    if held:
        yield held


def _matched(data, ends, reach: int):
    """For each byte of texts that lie one after the other: how far a match goes from there, or 0, and how far back it is."""
    n = len(data)
    size, back = np.zeros(n, np.uint8), np.zeros(n, np.int32)
    if n < 3:
        return size, back
    wide = data.astype(np.int32)
    key = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    at, before = order[again + 1], order[again]
    lengths = np.diff(ends, prepend=0)
    start, end = np.repeat(ends - lengths, lengths), np.repeat(ends, lengths)
    fit = (before >= start[at]) & (at - before <= reach) & (at + 3 <= end[at])
    at, before, end = at[fit], before[fit], end[at[fit]]
    back[at], size[at] = at - before, 3
    for k in range(3, LZH_LONGEST):
        same = at + k < end
        at, before, end = at[same], before[same], end[same]
        same = data[at + k] == data[before + k]
        at, before, end = at[same], before[same], end[same]
        if not at.size:
            break
        size[at] = k + 1
    return size, back


def parsed(texts: list[bytes], reach: int) -> tuple[list, list]:
    """Symbols, and places of matches less one, of each text: greedily, to the last place of three equal bytes."""
    symbols, places, held, weight = [], [], [], 0

    def flush():
        data, ends = np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(t) for t in held])
        size, back = _matched(data, ends, reach)
        symbol = np.where(size > 0, 253 + size.astype(np.int16), data)
        step, at = size.tobytes(), 0
        for end in ends.tolist():
            taken = []
            while at < end:
                taken.append(at)
                at += step[at] or 1
            taken = np.array(taken, np.int64)
            symbols.append(symbol[taken])
            places.append((back[taken] - 1).astype(np.int16))

    for t in texts:
        held.append(t)
        weight += len(t)
        if weight > 1 << 19:
            flush()
            held, weight = [], 0
    if held:
        flush()
    return symbols, places


def lzhuf(texts: list[bytes], reach: int = 256) -> list[bytes]:
    symbols, places = parsed(texts, reach)
    count = np.array([len(s) for s in symbols], np.int64)
    order = np.argsort(-count, kind="stable")
    starts = np.zeros(len(texts), np.int64)  # of lanes: the longest text is the first
    np.cumsum(count[order][:-1], out=starts[1:])
    flat = np.concatenate([symbols[i] for i in order]) if texts else np.zeros(0, np.int16)
    codes, widths = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.uint8)
    trees, lanes, left, step = Trees(len(texts)), np.arange(len(texts)), count[order], 0
    while (active := int(np.searchsorted(-left, -step))) > FEW:  # lanes with more symbols than this
        lanes = lanes[:active]
        at = starts[:active] + step
        symbol = flat.take(at)
        node, roots = trees.leaves(lanes, symbol), trees.roots[:active]
        code, width = np.zeros(active, np.int64), np.zeros(active, np.int64)
        going, depth = node != roots, 0
        while going.any():
            code |= (node & 1) << depth
            width += going
            node = trees.up.take(node)
            going, depth = node != roots, depth + 1
        codes[at], widths[at] = code, width
        trees.add(lanes, symbol)
        step += 1
    for lane in range(active):
        tree = trees.one(lane)
        for at in range(starts[lane] + step, starts[lane] + left[lane]):
            symbol = int(flat[at])
            path = tree.path(symbol)
            tree.add(symbol)
            codes[at], widths[at] = int("".join(map(str, path)), 2), len(path)
    found = np.flatnonzero(flat > 255)
    place = np.concatenate([places[i] for i in order])[found].astype(np.int64) if texts else found
    upper = np.array(position_codes())[place >> 6]
    codes[found] = (codes[found] << upper[:, 1] | upper[:, 0]) << 6 | place & 63
    widths[found] += (upper[:, 1] + 6).astype(np.uint8)
    out: list[bytes] = [b""] * len(texts)
    for lane, i in enumerate(order.tolist()):
        mine = slice(starts[lane], starts[lane] + left[lane])
        out[i] = _bits(codes[mine], widths[mine].astype(np.int64))
    return out


def _bits(codes, widths) -> bytes:
    """Codes of at most 64 bits, one after the other."""
    ends = np.cumsum(widths)
    of = np.repeat(np.arange(len(codes)), widths)
    return np.packbits((codes[of] >> (ends[of] - 1 - np.arange(len(of))) & 1).astype(np.uint8)).tobytes()


def _upper_six() -> np.ndarray:
    """The value and the length of the position code that each eight bits begin with."""
    out = np.zeros((256, 2), np.int64)
    for i, (code, n) in enumerate(position_codes()):
        out[code << 8 - n : (code + 1) << 8 - n] = i, n
    return out


def unlzhuf(packed: list[bytes], sizes: list[int], fill: int = 0x20) -> list[bytes]:
    pad = bytes(128)  # bits past the end read as zero, and a symbol takes less
    raw = np.frombuffer(b"".join(p + pad for p in packed) + pad, np.uint8)
    bits = np.unpackbits(raw)
    length = np.array([len(p) for p in packed], np.int64)
    first = 8 * (np.cumsum(length + len(pad)) - length - len(pad))
    most, want = first + 8 * (length + 8), np.array(sizes, np.int64)
    at, made, trees, upper = first.copy(), np.zeros(len(packed), np.int64), Trees(len(packed)), _upper_six()
    lanes, taken, low = np.arange(len(packed)), [], trees.low
    kind = np.uint16 if len(packed) < 1 << 16 else np.int64
    lanes = lanes[want > 0]
    while lanes.size > FEW:
        node, place, some = trees.roots.take(lanes), at.take(lanes), np.arange(len(lanes))
        symbol, end = np.empty(len(lanes), np.int64), np.empty(len(lanes), np.int64)
        below = low.take(node)
        while some.size:
            below = low.take(below + bits.take(place))
            place += 1
            leaf = below < 0
            if leaf.any():
                symbol[some[leaf]], end[some[leaf]] = -below[leaf] - 1, place[leaf]
                going = ~leaf
                some, below, place = some[going], below[going], place[going]
        trees.add(lanes, symbol)
        back, match = np.zeros(len(lanes), np.int64), np.flatnonzero(symbol > 255)
        if match.size:
            place = end.take(match)
            word = place >> 3
            three = [raw.take(word + k).astype(np.int64) << 16 - 8 * k for k in range(3)]
            ahead = (three[0] | three[1] | three[2]) >> (10 - (place & 7)) & 0x3FFF  # 14 bits
            value, n = upper[ahead >> 6].T
            back[match] = value << 6 | ahead >> (8 - n) & 63
            end[match] += n + 6
        at[lanes] = end
        made[lanes] += np.where(symbol > 255, symbol - (255 - LZH_LEAST), 1)
        taken.append((lanes.astype(kind), symbol.astype(np.int16), back.astype(np.int16)))
        lanes = lanes[(made.take(lanes) < want.take(lanes)) & (end <= most.take(lanes))]
    rest = {}
    for lane in lanes.tolist():
        mine = bits[first[lane] : first[lane] + 8 * (int(length[lane]) + len(pad))].tobytes()
        rest[lane] = lzh_symbols(trees.one(lane), mine, int(at[lane] - first[lane]), int(most[lane] - first[lane]), int(want[lane] - made[lane]))
    lane, symbol, back = (np.concatenate([np.zeros(0, t), *(x[k] for x in taken)]) for k, t in enumerate((kind, np.int16, np.int16)))
    order = np.argsort(lane, kind="stable")
    symbol, back = symbol[order], back[order]
    ends, out = np.cumsum(np.bincount(lane, minlength=len(packed))).tolist(), []
    for i, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
        more = rest.get(i, ([], []))
        out.append(lzh_bytes(np.concatenate([symbol[a:b], np.array(more[0], np.int16)]), np.concatenate([back[a:b], np.array(more[1], np.int16)]), int(want[i]), fill))
    return out
