"""Best-fit packing with certified bin counts.

Documents become token ids; only documents longer than a sequence are cut. Pieces are dealt to
partitions, each packs its own by best-fit decreasing and compares its number of bins with lower
bounds from dual feasible functions. Where they agree the partition is certified. Partitions with
a gap keep their full bins, exchange the pieces of the others under a new deal into fewer
partitions and pack again; so do all partitions while the whole is above its own bound, until
that is met or an exchange saves no bin.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise

#: Pieces that one partition packs, about; they are lengths and row numbers only.
PIECES = 50_000
#: Characters of a word that is kept in the cache, so that it is bounded in bytes as well.
LONG = 80
_ID = np.dtype("<u4")
assert sys.byteorder == "little" and array("I").itemsize == 4  # ids are kept as this machine's unsigned 32-bit numbers
#: Texts of these characters alone are split here as the tokenizer's own pattern would: in them letters
#: are a-z and the Latin-1 ones, digits 0-9, and case folding and normalisation change nothing else.
_ODD = re.compile(r"[^\t-\r\x20-\x7e\xc0-\xff]|<\|(?:start|end)oftext\|>")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+")


#: A byte-level vocabulary shows bytes as characters: printable Latin-1 ones as themselves, the others from code point 256 on.
_PLAIN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


class WordIds:
    """Token ids by the `tokenizers` library, which sees each different word once while it is cached."""

    def __init__(self, path: str, words: int = 300_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.cache = Tokenizer.from_file(path), words, {}  # words of up to LONG characters

    def _pieces(self, text: str) -> list[str]:
        if not _ODD.search(text):
            return _PIECE.findall(text.lower())
        out = []
        for chunk in re.split(r"[\x20\x09-\x0D]+", text):  # no token spans one of these
            out.extend([chunk] if _ODD.search(chunk) else _PIECE.findall(chunk.lower()))
        return [x for x in out if x]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [self._pieces(t) for t in texts]
        if len(self.cache) > self.words:
            self.cache.clear()
        model, odd, long = self.tokenizer.model, [], {}
        for w in {w for p in split for w in p if w not in self.cache}:
            if _ODD.search(w):
                odd.append(w)
            else:  # one word by the tokenizer's own pattern: straight to its model
                (self.cache if len(w) <= LONG else long)[w] = array("I", [t.id for t in model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_SHOWN))]).tobytes()
        for w, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            (self.cache if len(w) <= LONG else long)[w] = array("I", e.ids).tobytes()
        known = self.cache.__getitem__ if not long else lambda w: long[w] if w in long else self.cache[w]
        return [b"".join(map(known, p)) for p in split]


_words: dict[str, WordIds] = {}


def pieces_of(docs: DataFrame, tokenizer: str, size: int, end: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, row: the pieces of every document, null texts as empty."""
    last = np.array([end], _ID).tobytes()

    def cut(batches):
        words = _words.setdefault(tokenizer, WordIds(tokenizer)) if tokenizer not in _words else _words[tokenizer]
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                ids, rows = part["doc_id"].to_pylist(), []
                for i, x in enumerate(words.encode([t or "" for t in part["text"].to_pylist()])):
                    x += last
                    n = len(x) // 4
                    rows.extend((ids[i], p, s, min(size, n - s), zlib.crc32(x[4 * s : 4 * (s + size)])) for p, s in enumerate(range(0, n, size)))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")
    return materialise(out.withColumn("row", F.monotonically_increasing_id()), "pieces", rows=1000)


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """The best of several bounds on the bins that these lengths need, by dual feasible functions."""
    return bound_of(np.bincount(lengths, minlength=size + 1).astype(np.int64), size)


def bound_of(n: np.ndarray, size: int) -> int:
    """The same from the number n[x] of pieces of each length x."""
    x = np.arange(size + 1, dtype=np.int64)
    best = -(-int((n * x).sum()) // size)
    count, weight = np.cumsum(n), np.cumsum(n * x)
    # Items over size - e need a bin each, items under e are let go, the rest count by length.
    e = np.arange(1, size // 2 + 1)
    large = count[size] - count[size - e]
    best = max(best, int((large - (-(weight[size - e] - weight[e - 1]) // size)).max()))
    for k in range(1, 33):  # rounding up to multiples of 1/k where the length isn't a multiple of 1/(k+1)
        scaled = (k + 1) * x
        whole = scaled % size == 0
        value = np.where(whole, scaled * k, (k + 1) * (scaled // size) * size)  # in units of 1/(k (k+1) size)
        best = max(best, -(-int((n * value).sum()) // (k * (k + 1) * size)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_: list[list[int]] = [[] for _ in range(size + 1)]  # by room left
    mask, made = 0, 0  # bit r: a bin with room r is open
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = open_[room].pop()
            if not open_[room]:
                mask &= ~(1 << room)
        else:
            b, room, made = made, size, made + 1
        bins[i], offsets[i] = b, size - room
        if room > n:
            open_[room - n].append(b)
            mask |= 1 << (room - n)
    return bins, offsets, made


def _pack(size: int, turn: int):
    def pack(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        part = TaskContext.get().partitionId()
        lengths = table["length"].to_numpy()
        bins, offsets, made = best_fit_decreasing(lengths, size)
        fill = np.bincount(bins, weights=lengths, minlength=made)
        gap = made - lower_bound(lengths, size)
        n = len(bins)
        cols = [*table.columns, pa.array((turn << 54) + (part << 30) + bins), pa.array(offsets), pa.array(fill[bins] == size), pa.array(np.full(n, gap, np.int64))]
        yield from pa.table(cols, [*table.column_names, "sequence_id", "offset", "full", "gap"]).to_batches()

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 4096, end: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, gap.

    gap is what the partition that packed the piece used above its certified lower bound. Null
    texts are empty and still hold the end id; repeated rows are packed each; an empty table gives
    an empty result. A partition holds about PIECES pieces, whatever the input's size.
    """
    pieces = pieces_of(docs, tokenizer, size, end)
    histogram = np.zeros(size + 1, np.int64)  # at most `size` rows reach the driver
    for r in pieces.groupBy("length").count().collect():
        histogram[r["length"]] = r["count"]
    least, count = bound_of(histogram, size), int(histogram.sum())
    turn, parts = 0, max(1, -(-count // PIECES))
    schema = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "full": F.lit(True), "gap": F.lit(0).cast("long")}).schema

    def deal(rows: DataFrame) -> DataFrame:
        dealt = rows.select(*pieces.columns).repartition(parts, F.xxhash64(F.lit(turn), "row"))
        return materialise(dealt.mapInArrow(_pack(size, turn), schema), f"packed{turn}")

    def bins(rows: DataFrame) -> int:
        return rows.select("sequence_id").distinct().count()

    packed, loose = deal(pieces), (F.col("gap") > 0) & ~F.col("full")
    wide = False  # first the partitions with a gap; then, if the whole has one, all that aren't full
    while bins(packed) > least:
        chosen = packed.where(loose)
        moved, before = chosen.count(), bins(chosen)
        if moved:
            turn, parts = turn + 1, max(1, min(parts // 2, -(-moved // PIECES)))
            again = deal(chosen)
            if bins(again) < before:
                packed = packed.where(~loose).unionByName(again)
                continue
        if wide:
            break
        wide, loose = True, ~F.col("full")
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "gap")
