"""N-gram Jaccard join with PartEnum signatures.

Sets whose Jaccard similarity reaches the threshold lie in the same or in neighbouring size bands,
and differ in a number of elements that the band bounds. The feature domain is split into
first-level partitions, so few of them that one must hold at most one difference, and each of these
into second-level ones; every subset that leaves one second-level partition out is a signature. So
similar sets share a signature, whatever their differences.

Copies with equal sets are one node. Rows (signature, node) are partitioned by signature, sorted
and streamed; the smallest node of a bucket is its pivot. All buckets with the same pivot make one
group, so nodes that share dozens of signatures meet in a few groups, and nodes that share any meet
in one at least. A node comes to each of its groups once, however many others do. Groups are cut
into blocks of bounded size, and a task compares the nodes of a block. Blocks of the few groups with
several are then packed, a row each, and each two of a group meet in a task of their own. A block
knows the elements that most of its sets have, and of each set only where it differs from those.
Two nodes are compared in the smallest of the groups they share and in no other. A task returns no
pairs: it says how many links each node has there and which nodes hang together, a row for each
node it got. So every link is verified once, and none is listed unless it is asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import discard, fresh, materialise, skew_lookup

U = np.uint64
#: Second-level partitions of each first-level one; a signature leaves one of them out.
SECOND = 3
#: One spare first-level partition for so many that are needed.
SPARE = 5
#: Signatures of fewer shingles may be kept back, as far as spare partitions allow.
LIGHT = 8
#: A table of nodes is broadcast up to this many rows of under 100 bytes each.
BROADCAST_ROWS = 500_000
#: Nodes in a block, and elements of their sets, about; a set with more elements is a block of its own.
BLOCK, ELEMENTS = 16_384, 2_000_000
#: A smaller group that more than one in so many nodes of a block are in has a bit there.
OFTEN = 32
#: Bytes of text that are hashed together.
CHUNK = 1 << 19
#: Rows of one bucket that are held until its smallest node is taken as known.
HELD = 1 << 20
#: Bytes of a word whose places are told apart by a table, a power of two; later ones take one more step.
PLACES = 64
#: The id that stands for null where rows are looked up.
NO_ID = -(2**63)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = _mix(np.arange(1, PLACES * 256 + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def _words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the texts data[cuts[i] : cuts[i + 1]]: the hash of every word, A-Z lower-cased, and the words of each text."""
    letter = ~_GAP[data]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    edges = cuts[:-1][np.diff(cuts) > 0]
    begins[edges] = letter[edges]
    counts = np.diff(np.searchsorted(np.flatnonzero(begins), cuts))
    at = np.flatnonzero(begins[letter])
    if not len(at):
        return np.empty(0, U), counts
    letters = _LOWER[data[letter]]
    sizes = np.diff(np.append(at, len(letters)))
    place = np.arange(len(letters), dtype=np.int32) - np.repeat(at.astype(np.int32), sizes)
    h = _BYTES[((place & (PLACES - 1)) << 8) | letters]
    if sizes.max() > PLACES:
        far = place >= PLACES
        h[far] = _mix(h[far] + (place[far] // PLACES).astype(U) * U(0xD6E8FEB86659FD93))
    return _mix(np.add.reduceat(h, at) + sizes.astype(U)), counts


def _long_words(data: np.ndarray) -> np.ndarray:
    """The words of one long text, a chunk at a time, cut between words."""
    out, at = [], 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data) and not (gaps := _GAP[data[end : end + CHUNK]]).any():
            end += CHUNK
        end = len(data) if end >= len(data) else end + int(gaps.argmax())
        out.append(_words(data[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate(out)


def _shingled(words: np.ndarray, counts: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's word shingles, one text after the other, and how many each has."""
    factor = _mix(np.arange(1, width + 2, dtype=U) + U(seed * 1000003)) | U(1)
    ends = np.cumsum(counts)
    sizes = np.where(counts >= width, counts - width + 1, counts > 0)
    out, whole = np.empty(sizes.sum(), U), np.repeat(counts >= width, sizes)
    at = np.flatnonzero(np.repeat(ends, counts) - np.arange(len(words)) >= width)
    h = np.zeros(len(at), U)
    for i in range(width):
        h += words[at + i] * factor[i]
    out[whole] = _mix(h)
    few = (counts > 0) & (counts < width)  # these have one shingle, all their words
    short = np.zeros(few.sum(), U)
    for i in range(width - 1):
        has = counts[few] > i
        short[has] += words[(ends - counts)[few][has] + i] * factor[i]
    out[~whole] = _mix(short + counts[few].astype(U) * factor[width])
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    for a, n in zip(starts.tolist(), sizes[sizes > 0].tolist(), strict=True):
        if n > 1:
            out[a : a + n].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[starts] = True
    sizes[sizes > 0] = np.add.reduceat(keep, starts, dtype=np.int64) if len(starts) else 0
    return out[keep], sizes


def shingles(data: bytes, width: int, seed: int = 0) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles, A-Z lower-cased; the whole sequence if it has fewer words."""
    text = np.frombuffer(data, np.uint8)
    words, counts = _words(text, np.array([0, len(text)]))
    return _shingled(words, counts, width, seed)[0]


def _texts(column: pa.Array):
    """(first row, row after the last, bytes, cuts) of stretches of about CHUNK bytes; longer texts are alone."""
    column = column.cast(pa.large_binary())
    _, cuts, data = column.buffers()
    cuts = np.frombuffer(cuts, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data, at = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + CHUNK, side="right")) - 1)
        yield at, to, data[cuts[at] : cuts[to]], cuts[at : to + 1] - cuts[at]
        at = to


def _sets_of(column: pa.Array, width: int, seed: int):
    """(first row, row after the last, elements, sizes) of the texts' sets."""
    for at, to, data, cuts in _texts(column):
        words, counts = (w := _long_words(data), np.array([len(w)])) if len(data) > CHUNK else _words(data, cuts)
        yield at, to, *_shingled(words, counts, width, seed)


class PartEnum:
    """Signatures for Jaccard similarity of at least num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.bounds = num, den, [1]

    def bands(self, sizes: np.ndarray) -> np.ndarray:
        """Bands [bounds[i], bounds[i + 1]); similar sets are in one band or in two neighbouring ones."""
        while len(self.bounds) < 4 or self.bounds[-3] <= sizes.max(initial=1):
            self.bounds.append(self.bounds[-1] * self.den // self.num + 1)
        return np.searchsorted(self.bounds, sizes, side="right") - 1

    def enumerate(self, h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The signatures of many sets, none empty, and the number of the set each belongs to: those
        of its own band, and those of the next, where sets of that band look for it.

        There are more first-level partitions than needed by some spare ones, so similar sets agree
        in that many more. So a set may keep back its lightest signatures, those of less than a
        weight of its own below which as many partitions have one as there are spare. Of two
        similar sets the one with the greater such weight keeps back the more, and what they agree
        in has the same weight in both: they lose no more than the spare ones. In bands that allow
        no difference similar sets are equal, and their one signature is the whole set.
        """
        own, out, owners = self.bands(sizes), [], []
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        for band in (own, own + 1):
            # Most elements that only one of two similar sets has, if none is larger than the band allows.
            k = (self.den - self.num) * 2 * (np.array(self.bounds)[band + 1] - 1) // (self.den + self.num)
            spare = np.where(k > 0, (k // 2 + 1) // SPARE + 1, 0)
            first = np.where(k > 0, k // 2 + 1 + spare, 1)
            cells = first * SECOND
            base = np.cumsum(cells) - cells
            sums, n = np.zeros(cells.sum(), U), np.zeros(cells.sum(), np.int64)
            for a in range(0, len(h), 1 << 20):
                part, of = h[a : a + (1 << 20)], owner[a : a + (1 << 20)]
                cell = base[of] + np.where(k[of] > 0, _mix(part + band[of].astype(U)) % cells[of].astype(U), 0).astype(np.int64)
                np.add.at(sums, cell, part)
                n += np.bincount(cell, minlength=len(n))
            sums, n = sums.reshape(-1, SECOND), n.reshape(-1, SECOND)
            left_out = sums.sum(axis=1, dtype=U)[:, None] - sums
            weight = n.sum(axis=1)[:, None] - n
            lightest, least = weight.min(axis=1), np.zeros(len(sizes), np.int64)
            for w in range(1, LIGHT + 1):
                least += np.add.reduceat(lightest < w, base // SECOND, dtype=np.int64) <= spare
            place = np.arange(len(sums) * SECOND) - np.repeat(base, cells)
            give = np.where(np.repeat(k > 0, cells), weight.ravel() >= np.repeat(least, cells), place == 1)
            tag = place.astype(U) * U(0x9E3779B97F4A7C15) + np.repeat(band, cells).astype(U) * U(0xD6E8FEB86659FD93)
            out.append(_mix(_mix(left_out.ravel()) + tag)[give])
            owners.append(np.repeat(np.arange(len(sizes)), cells)[give])
        return np.concatenate(out), np.concatenate(owners)

    def signatures(self, h: np.ndarray) -> np.ndarray:
        """Those of one set."""
        return self.enumerate(h, np.array([len(h)]))[0] if len(h) else np.empty(0, U)


def _nodes(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set, none of them empty."""
    starts, m = np.cumsum(sizes) - sizes, _mix(h)
    return np.add.reduceat(m, starts).view(np.int64), np.add.reduceat(_mix(m ^ U(0xA5A5A5A5)), starts).view(np.int64)


def _sets(width: int, seed: int):
    def sets(batches):
        for b in batches:
            for at, to, h, sizes in _sets_of(b["data"], width, seed):
                node, check, any_ = np.zeros(to - at, np.int64), np.zeros(to - at, np.int64), sizes > 0
                if any_.any():
                    node[any_], check[any_] = _nodes(h, sizes[any_])
                hashes = [pa.array(x, mask=~any_) for x in (node, check)]
                yield pa.RecordBatch.from_arrays([b["doc_id"][at:to], b["th"][at:to], pa.array(sizes), *hashes], ["doc_id", "th", "n", "node", "check"])

    return sets


def _signatures(width: int, num: int, den: int, seed: int):
    """(sig, node) of each set, once in a task however many copies it has there."""

    def signatures(batches):
        method, given = PartEnum(num, den), set()
        for b in batches:
            for *_, h, sizes in _sets_of(b["data"], width, seed):
                sizes = sizes[sizes > 0]
                if not len(sizes):
                    continue
                node = _nodes(h, sizes)[0]
                if len(given) > 200_000:
                    given.clear()
                new = np.zeros(len(node), bool)
                new[[i for i, x in enumerate(node.tolist()) if x not in given and not given.add(x)]] = True
                if new.any():
                    sig, owner = method.enumerate(h[np.repeat(new, sizes)], sizes[new])
                    for a in range(0, len(sig), 200_000):
                        yield pa.RecordBatch.from_arrays([pa.array(sig[a : a + 200_000].view(np.int64)), pa.array(node[new][owner[a : a + 200_000]])], ["sig", "node"])

    return signatures


def _groups(batches):
    """From (sig, node) sorted by sig: (node, pivot) for the buckets with several nodes."""
    rows = lambda node, pivot: pa.RecordBatch.from_arrays([pa.array(node), pa.array(pivot)], ["node", "pivot"])
    sig = node = np.empty(0, np.int64)  # the open bucket
    known = None  # its sig and pivot, if it has so many rows that its first ones went out

    def closed(sig, node):
        starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        low, size = np.minimum.reduceat(node, starts), np.diff(np.append(starts, len(sig)))
        if known and sig[0] == known[0]:
            low[0] = known[1]
        several = np.repeat((np.maximum.reduceat(node, starts) != low) | (np.minimum.reduceat(node, starts) != low), size)
        node, pivot = node[several], np.repeat(low, size)[several]
        order = np.lexsort((node, pivot))
        node, pivot = node[order], pivot[order]
        once = np.append(True, (node[1:] != node[:-1]) | (pivot[1:] != pivot[:-1]))[: len(node)]
        return rows(node[once], pivot[once])

    for b in batches:
        sig, node = np.append(sig, b["sig"].to_numpy()), np.append(node, b["node"].to_numpy())
        if not len(sig):
            continue
        open_from = int(np.searchsorted(sig, sig[-1]))
        if open_from:
            yield closed(sig[:open_from], node[:open_from])
            sig, node = sig[open_from:], node[open_from:]
        known = known if known and known[0] == sig[0] else None
        if len(sig) > HELD:
            low, high = int(node.min()), int(node.max())
            if known or low != high:
                known = known or (sig[0], low)
                yield closed(sig, node)
                sig, node = sig[:0], node[:0]
            else:
                sig, node = sig[:1], node[:1]
    if len(sig):
        yield closed(sig, node)


class _Common:
    """How many values one list has in common with each of many lists."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        order = np.argsort(values, kind="stable")
        self.values, starts = np.unique(values[order], return_index=True)
        self.ends, self.n = np.append(starts, len(values)), len(sizes)
        self.owner = np.repeat(np.arange(self.n), sizes)[order]

    def counts(self, x: np.ndarray) -> np.ndarray:
        if not len(self.values):
            return np.zeros(self.n, np.int64)
        at = np.minimum(np.searchsorted(self.values, x), len(self.values) - 1)
        at = at[self.values[at] == x]
        n = self.ends[at + 1] - self.ends[at]
        index = np.arange(n.sum()) + np.repeat(self.ends[at] - np.cumsum(n) + n, n)
        return np.bincount(self.owner[index], minlength=self.n)


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and each list's length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _cut(values: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1])


class _Elsewhere:
    """Which of many lists have a value in common with one list; values of many lists are bits."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        owner, n = np.repeat(np.arange(len(sizes)), sizes), len(sizes)
        self.values, at, count = np.unique(values, return_inverse=True, return_counts=True)
        often = count * OFTEN > n
        self.bit = np.where(often, np.cumsum(often) - 1, -1)
        bit = self.bit[at]
        self.bits = np.zeros((often.sum() + 63 >> 6, n), U)
        np.bitwise_or.at(self.bits, (bit[bit >= 0] >> 6, owner[bit >= 0]), U(1) << (bit[bit >= 0] & 63).astype(U))
        self.rare = _Common(values[bit < 0], np.bincount(owner[bit < 0], minlength=n))

    def some(self, x: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Of the lists at these places."""
        if not len(self.values) or not len(x):
            return np.zeros(len(among), bool)
        at = np.minimum(np.searchsorted(self.values, x), len(self.values) - 1)
        bit = self.bit[at[self.values[at] == x]]
        out = self.rare.counts(x)[among] > 0 if (bit < 0).any() else np.zeros(len(among), bool)
        mask = np.zeros(len(self.bits), U)
        np.bitwise_or.at(mask, bit[bit >= 0] >> 6, U(1) << (bit[bit >= 0] & 63).astype(U))
        for word in np.flatnonzero(mask).tolist():
            out |= self.bits[word][among] & mask[word] != 0
        return out


class _Block:
    """Nodes of a group: copies, n elements in the set of each, base (the elements that more than half
    of the sets have), away (of each set what only it or only the base has) and the smaller groups
    that they are in. The sets away are never larger in all than the sets."""

    LISTS = ("node", "copies", "n", "base", "away", "aways", "earlier", "earliers")

    def __init__(self, *lists: np.ndarray):
        self.node, self.copies, self.n, self.base, self.away, self.aways, self.earlier, self.earliers = lists

    @classmethod
    def of(cls, rows: pa.Table) -> _Block:
        """From rows (pivot, node, n, copies, pivots, set)."""
        values, sizes = _lists(rows["set"])
        owner, (kinds, at, count) = np.repeat(np.arange(len(sizes)), sizes), np.unique(values, return_inverse=True, return_counts=True)
        most = 2 * count > len(sizes)
        common, place = most[at], np.cumsum(most) - 1
        lacks = np.ones((len(sizes), most.sum()), bool)  # at most twice as many as there are values
        lacks[owner[common], place[at[common]]] = False
        lacking, what = np.nonzero(lacks)
        base, who = kinds[most], np.append(owner[~common], lacking)
        away = np.append(values[~common], base[what])[np.argsort(who, kind="stable")]
        pivots, groups = _lists(rows["pivots"])
        smaller = pivots < rows["pivot"][0].as_py()
        earliers = np.bincount(np.repeat(np.arange(len(sizes)), groups)[smaller], minlength=len(sizes))
        return cls(*(rows[c].to_numpy() for c in ("node", "copies", "n")), base, away, np.bincount(who, minlength=len(sizes)), pivots[smaller], earliers)

    def links(self, other: _Block | None, num: int, den: int):
        """(x, its partners) as places here and in the other block, or here if there is none: each link once."""
        right = other or self
        if not len(self.node) or not len(right.node) or (other is None and len(self.node) < 2):
            return
        sets, earlier = _cut(self.away, self.aways), _cut(self.earlier, self.earliers)
        odd = np.setxor1d(self.base, right.base) if other else np.empty(0, np.int64)
        if len(odd):  # the base is the other block's
            sets = [np.setxor1d(x, odd, assume_unique=True) for x in sets]
        held, elsewhere = _Common(right.away, right.aways), _Elsewhere(right.earlier, right.earliers)
        # Two sets have in common what both share with the base, less the base, and in what they are
        # away from it alike; of the base a set has (its size + the base's - what it is away) / 2.
        weight, p = den + num, len(right.base)
        gain = lambda n, d: weight * ((n + p - d) // 2) - num * n
        own, gains = gain(self.n, np.array([len(x) for x in sets])), gain(right.n, right.aways)
        for x in range(len(sets)):
            partners = np.flatnonzero(held.counts(sets[x]) * weight + gains >= weight * p - own[x])
            if other is None:
                partners = partners[np.searchsorted(partners, x, side="right") :]
            if len(partners):
                partners = partners[~elsewhere.some(earlier[x], partners)]
            if len(partners):
                yield x, partners


def _together(batches, keys: list[str]):
    """Tables of the rows with equal keys, which come sorted."""
    parts = []  # of the open key
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b[c].to_numpy() for c in keys])
        starts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        if parts and any(parts[-1][c][-1].as_py() != b[c][0].as_py() for c in keys):
            yield pa.Table.from_batches(parts).combine_chunks()
            parts = []
        for a, z in zip(starts[:-2], starts[1:-1], strict=True):
            yield pa.Table.from_batches([*parts, b.slice(a, z - a)]).combine_chunks()
            parts = []
        parts.append(b.slice(starts[-2]))
    if parts:
        yield pa.Table.from_batches(parts).combine_chunks()


def _alone(batches):
    """(block, None) of rows that are dealt by blocks."""
    for rows in _together(batches, ["pivot", "block"]):
        yield _Block.of(rows), None


def _pairs(batches):
    """(block, other block) of packed rows, two for each (pivot, i, j)."""
    for rows in _together(batches, ["pivot", "i", "j"]):
        if rows.num_rows == 2:  # a block may be empty
            yield tuple(_Block(*(np.array(rows[c][at].values.to_numpy()) for c in _Block.LISTS)) for at in range(2))


def _packed(batches):
    """(pivot, block, blocks, the lists of the block): one row for all rows of a block."""
    for rows in _together(batches, ["pivot", "block"]):
        block, ends = _Block.of(rows), lambda x: pa.array([0, len(x)], pa.int32())
        lists = [pa.ListArray.from_arrays(ends(x), pa.array(x.astype(np.int64))) for x in (getattr(block, c) for c in _Block.LISTS)]
        yield pa.RecordBatch.from_arrays([*(rows[c].slice(0, 1).combine_chunks() for c in ("pivot", "block", "blocks")), *lists], ["pivot", "block", "blocks", *_Block.LISTS])


def _verified(num: int, den: int, meetings):
    """(node, beside, root): rows that the node links with here, and the smallest place it hangs together with."""

    def verified(batches):
        for block, other in meetings(batches):
            node, copies = (np.concatenate([getattr(b, c) for b in (block, other) if b]) for c in ("node", "copies"))
            beside, root = np.zeros(len(node), np.int64), np.arange(len(node))
            for x, partners in block.links(other, num, den):
                partners = partners + len(block.node) if other else partners
                beside[x] += copies[partners].sum()
                beside[partners] += copies[x]
                meet = root[partners]
                if (meet != root[x]).any():
                    meet = np.unique(np.append(meet, root[x]))
                    root[np.isin(root, meet[1:])] = meet[0]
            some = beside > 0
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (node, beside, node[root])], ["node", "beside", "root"])

    return verified


def _listed(num: int, den: int, meetings):
    """(a, b) of every link."""

    def listed(batches):
        for block, other in meetings(batches):
            for x, partners in block.links(other, num, den):
                y = (other or block).node[partners]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(block.node[x], y)), pa.array(np.maximum(block.node[x], y))], ["a", "b"])

    return listed


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _prepared(docs: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame, int, list, list[DataFrame]]:
    """made (doc_id, th, n, node, check), classes (node, first, copies, n), how many documents have
    shingles, (rows, their reader) of the blocks alone and of each two that meet, and the scratch
    tables that these are made of."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.encode(text, "utf-8").alias("data"))
    for seed in range(8):
        made = materialise(rows.mapInArrow(_sets(width, seed), "doc_id long, th long, n long, node long, check long"), "nodes-of-documents")
        classes = made.where("node is not null").groupBy("node").agg(
            F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min("check").alias("c1"), F.max("check").alias("c2"), F.min(F.struct("doc_id", "th")).alias("one")
        )
        classes = materialise(classes, "classes")
        total, clash = classes.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.count(F.when(F.col("c1") != F.col("c2"), 1))).first()
        if not clash:
            break
        discard(made, classes)  # two sets share a 64-bit hash: take another
    # A bucket has at most one row per node and task, of the hundreds that each node gives out: even
    # if it held all nodes, it would be a small part of the rows.
    signed = rows.select("data").mapInArrow(_signatures(width, num, den, seed), "sig long, node long")
    grouped = signed.repartition("sig").sortWithinPartitions("sig").mapInArrow(_groups, "node long, pivot long")
    members = materialise(grouped.distinct(), "members", rows=50_000)

    # The sets of these nodes, from one of each node's documents.
    known = classes.join(members.groupBy("node").agg(F.array_sort(F.collect_list("pivot")).alias("pivots")), "node")
    known = materialise(known.select("node", "n", "copies", "pivots", F.coalesce("one.doc_id", F.lit(NO_ID)).alias("doc_id"), "one.th"), "chosen")
    discard(members)

    def write_sets(batches):
        for b in batches:
            for at, to, h, sizes in _sets_of(b["data"], width, seed):
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b["node"][at:to], pa.array(sizes), lists], ["node", "n", "set"])

    chosen = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).join(_small(known.select("node", "doc_id", "th")), ["doc_id", "th"]).select("node", "data")
    sets = materialise(chosen.mapInArrow(write_sets, "node long, n long, set array<long>"), "node-sets")
    if sets.count() > known.count():  # rows that repeat an id with its text
        many, sets = sets, materialise(sets.dropDuplicates(["node"]), "sets")
        discard(many)

    most = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(ELEMENTS) / F.max("n"))))
    large = known.select("n", F.explode("pivots").alias("pivot")).groupBy("pivot").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
    large = materialise(large.where("blocks > 1"), "large-groups")
    placed = sets.join(known.select("node", "copies", "pivots"), "node").withColumn("pivot", F.explode("pivots"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    dealt = lambda rows, *keys: rows.repartition(*keys).sortWithinPartitions(*keys)
    alone = placed.join(_small(large), "pivot", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).select("pivot", block, "node", "n", "copies", "pivots", "set")
    meetings = [(dealt(alone, "pivot", "block"), _alone)]
    if large.limit(1).count():
        cut = placed.join(_small(large), "pivot").select("pivot", block, "blocks", "node", "n", "copies", "pivots", "set")
        packed = dealt(cut, "pivot", "block").mapInArrow(_packed, "pivot long, block int, blocks int, " + ", ".join(f"{c} array<long>" for c in _Block.LISTS))
        met = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block <> other")
        met = met.select("pivot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *_Block.LISTS)
        meetings.append((dealt(met, "pivot", "i", "j"), _pairs))
    return made, classes, total, meetings, [known, sets, large]


def _over(meetings: list, work, num: int, den: int, schema: str) -> DataFrame:
    """The rows that work makes of all meetings."""
    parts = [rows.mapInArrow(work(num, den, reader), schema) for rows, reader in meetings]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _members(made: DataFrame, classes: DataFrame, total: int, found: DataFrame) -> DataFrame:
    """(doc_id, th, n_shingles, set, set_id, component_id, n_links) of each document."""
    labels = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    beside = found.groupBy("node").agg(F.sum("beside").alias("beside"))
    named = classes.join(labels, "node", "left").join(beside, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = materialise(named.select("node", "first", "copies", "label", (F.coalesce("beside", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    by_node = named.join(smallest, "label").select("node", "copies", "component_id", F.col("first").alias("set_id"), "n_links")
    columns = ["doc_id", "th", F.col("n").alias("n_shingles"), F.col("node").alias("set"), "set_id", "component_id", "n_links"]
    out = skew_lookup(made.where("node is not null").select("doc_id", "th", "n", "node"), by_node, ["node"], "copies", total)
    own = F.col("doc_id")
    alone = made.where("node is null").withColumns({"set_id": own, "component_id": own, "n_links": F.lit(0).cast("long")})
    return out.select(*columns).unionByName(alone.select(*columns))


def similar_documents(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: doc_id, th, n_shingles, set, set_id, component_id, n_links.

    Two documents link when the Jaccard similarity of their sets of `width`-word shingles is at
    least num / den. set and set_id are the hash of its set and the smallest doc_id that has it,
    component_id the smallest doc_id reachable by links, its own included, and n_links how many
    other rows it links with, those with an equal set included. A text of fewer words is one
    shingle, the whole sequence; a null, empty or blank text has none, is its own set_id and links
    with nothing. Rows that repeat an id count by their texts; null ids never name a set or a
    component unless it has no other. An empty table gives an empty result.
    """
    made, classes, total, meetings, scratch = _prepared(docs, width, num, den)
    found = materialise(_over(meetings, _verified, num, den, "node long, beside long, root long"), "found")
    discard(*scratch)
    out = _members(made, classes, total, found)
    discard(classes, found)
    return out


def similar_links(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """All links: (set_a, set_b, doc_a, doc_b), and what similar_documents returns.

    The first has one row for each two linked sets, as each set is there once however many
    documents have it: their hashes, set_a < set_b, and the smallest doc_id of either. It grows with
    the number of links, so with the square of a group of near copies, and is computed only if used.
    """
    made, classes, total, meetings, _ = _prepared(docs, width, num, den)
    found = materialise(_over(meetings, _verified, num, den, "node long, beside long, root long"), "found")
    pairs = _over(meetings, _listed, num, den, "a long, b long")
    first = classes.select("node", "first")
    links = pairs.join(first.toDF("a", "doc_a"), "a").join(first.toDF("b", "doc_b"), "b")
    return links.select(F.col("a").alias("set_a"), F.col("b").alias("set_b"), "doc_a", "doc_b"), _members(made, classes, total, found)


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """Of each component of similar documents the row with the smallest id, with all its columns.

    Rows without a word are alone and stay. Of rows that repeat an id with the same text, all stay
    or none; a null id stays only where its component has no other. An empty table stays empty, and
    no name of a column of docs is taken.
    """
    found = similar_documents(docs.select("doc_id", "text"), **how)
    doc, text = fresh(docs, "doc"), fresh(docs, "text_hash")
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.coalesce("doc_id", F.lit(NO_ID)).alias(doc), F.col("th").alias(text)).distinct()
    rows = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), text: F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    return rows.join(keep, [doc, text], "left_semi").select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 4 THEN array_to_string(words, ' ') ELSE array_to_string(words[i : i + 3], ' ') END AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), h AS (SELECT doc_id, hash(g) AS g FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM h a JOIN h b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), r AS (
  SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.c = l.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, coalesce(k.n_links, 0) AS n_links
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n_links FROM l GROUP BY a) k ON k.a = d.doc_id"""

#: With the smallest doc_id of each document's set.
LINKS_ORACLE = ORACLE[: ORACLE.index("SELECT d.doc_id,")] + r"""
, k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a
), e AS (
  SELECT a, min(b) AS first FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE common = x.n AND common = y.n GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(e.first, d.doc_id)) AS set_id, m.c AS component_id, coalesce(k.n_links, 0) AS n_links
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
LEFT JOIN k ON k.a = d.doc_id LEFT JOIN e ON e.a = d.doc_id"""
