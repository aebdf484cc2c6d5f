"""Language-model scoring by prediction by partial matching over bytes.

A trie of byte contexts up to `order` holds how often each symbol followed; symbol 256 is the
text's end. A symbol's probability comes from the longest known context; a symbol unseen there
costs an escape (method D: kinds / (2 count), each seen symbol giving up half a count) to the next shorter context, where the symbols
of the longer one are excluded, and at last a share of the symbols never seen. A text starts in a
context of NUL bytes. A-Z are lower-cased, as in the word model beside it.

The trie is gathered from the training texts as counts of (order + 1)-grams, added up inside each
task, then by shuffle. As the successors of a context are also those of its suffixes, exclusion is
a number per context, and a gram's probability is a table look-up. The trie lies in blocks of about
BLOCK grams, cut by the last bytes of the context, two of them or, where that would be too many
grams, more; only the executors ever hold a block, one at a time. Texts don't look grams up one by
one: they are dealt into chunks, each chunk asks every block once for the different grams it has
there, and the answers meet the chunk's texts. So the texts are read three times, however large the
trie. Words of the base model are asked for in the same way.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard import _mix
from .shared import materialise

END = 256
#: Grams of a block of the trie, about; also words of a block of the base model.
BLOCK = 1_000_000
#: Bytes of text in a chunk, about.
CHUNK = 16 << 20
#: Keys in one row that is shuffled, at most.
ROW = 250_000
U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_STEP = 0x9E3779B97F4A7C15 | 1
_BYTE = _mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of _STEP and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for i, step in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            factors = np.full(n, step, U)
            factors[0] = 1
            _powers[i] = np.cumprod(factors, dtype=U)
    return _powers


class Block:
    """Several texts, or a part of a long one, as arrays.

    grams: (context << 9 | symbol) of every symbol; where: number of grams of each piece;
    words: a 64-bit hash of every word; word_piece: the piece it is in.
    """

    def __init__(self, pieces: list[tuple[bytes, bytes, bool]], order: int):
        buf = b"\0" * 8 + b"".join(c + p + b"\0" * end for c, p, end in pieces)
        a = np.frombuffer(buf, np.uint8)
        size = np.array([len(p) + end for _, p, end in pieces])
        start = 8 + np.cumsum(size + order) - size  # of each piece's first symbol
        fresh = np.ones(len(a), bool)
        fresh[:8] = False
        for i in range(order):
            fresh[start - 1 - i] = False
        ends = (start + size - 1)[np.array([e for _, _, e in pieces], bool)]
        window = np.ndarray((len(a) - 7,), ">u8", buf, strides=(1,)).astype(U)  # bytes i to i + 7
        window = window[1:]  # ends at byte 8 + i
        grams = ((window >> U(8)) & U((1 << (8 * order)) - 1)) << U(9) | (window & U(255))
        grams[ends - 8] = (grams[ends - 8] & ~U(511)) | U(END)
        self.grams, self.where = grams[fresh[8:]].astype(np.int64), size
        letter = fresh & ~_BLANK[a]
        letter[ends] = False
        step = np.diff(letter.astype(np.int8), prepend=0, append=0)
        first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        up, down = _power(len(a) + 1)
        total = np.concatenate([np.zeros(1, U), np.cumsum(_BYTE[a] * up[: len(a)], dtype=U)])
        self.words = _mix((total[last] - total[first]) * down[first] + (last - first).astype(U)).astype(np.int64)
        self.word_piece = np.searchsorted(start, first, side="right") - 1


def blocks(texts, order: int, most: int = 1 << 18):
    """(document numbers, Block) over texts; long ones are cut at blanks, so memory stays bounded."""
    docs, pieces, held = [], [], 0
    for i, data in enumerate(texts):
        data, at, context = data.lower(), 0, b"\0" * order
        while True:
            end = len(data)
            if end - at > most:
                end = next((x for x in range(at + most, len(data)) if _BLANK[data[x]]), len(data))
            docs.append(i)
            pieces.append((context, data[at:end], end == len(data)))
            held += end - at
            context = (context + data[at:end])[-order:]
            if held >= most:
                yield np.array(docs), Block(pieces, order)
                docs, pieces, held = [], [], 0
            at = end
            if end == len(data):
                break
    if pieces:
        yield np.array(docs), Block(pieces, order)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    at = np.argsort(k)
    k, n = k[at], n[at]
    heads = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[heads], np.add.reduceat(n, heads) if len(k) else n


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    heads = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
    return x[heads], np.diff(np.append(heads, len(x)))


class _Tally:
    """Different keys and their counts. Parts are merged when together they outweigh what is merged already."""

    def __init__(self):
        self.parts, self.loose = [], 0

    def add(self, keys: np.ndarray) -> None:
        k, n = _counted(keys)
        self.parts.append((k, n))
        self.loose += len(k)
        if self.loose > max(1_000_000, len(self.parts[0][0])):
            self.settle()

    def settle(self) -> None:
        self.parts, self.loose = [_merged(*map(list, zip(*self.parts, strict=True)))], 0

    def __len__(self) -> int:
        return len(self.parts[0][0]) if self.parts and not self.loose else 0

    def pop(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return (np.empty(0, np.int64),) * 2
        self.settle()
        out, self.parts = self.parts[0], []
        return out


def _gather(order: int):
    """Counts of grams (kind 0) and of words (kind 1), added up within the task."""

    def rows(kind, tally):
        k, n = tally.pop()
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n)], ["kind", "key", "n"])

    def gather(batches):
        tallies = _Tally(), _Tally()
        for b in batches:
            for _, x in blocks((t.as_py() for t in b["data"]), order):
                for kind, values in enumerate((x.grams, x.words)):
                    tallies[kind].add(values)
                    if len(tallies[kind]) > 3_000_000:
                        yield rows(kind, tallies[kind])
        for kind, tally in enumerate(tallies):
            yield rows(kind, tally)

    return gather


class Table:
    """Look-up of int64 keys: open addressing, filled in order of slots."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 1.5).bit_length())
        slot = self._slot(keys)
        at = np.argsort(slot, kind="stable")
        place = np.maximum.accumulate(slot[at] - np.arange(len(keys))) + np.arange(len(keys))
        size = max((1 << self.bits) + 1, int(place[-1]) + 2 if len(keys) else 0)
        self.keys, self.index = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        self.keys[place], self.index[place] = keys[at], at
        self.used = self.index >= 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U) * U(_STEP)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key in the list given, or -1."""
        place = self._slot(keys)
        out = np.where(self.keys[place] == keys, self.index[place], -1)
        open_ = np.flatnonzero((out < 0) & self.used[place])
        place = place[open_]
        while len(open_):
            place = place + 1
            out[open_] = np.where(self.keys[place] == keys[open_], self.index[place], -1)
            more = (out[open_] < 0) & self.used[place]
            open_, place = open_[more], place[more]
        return out


class Trie:
    """Log10 probabilities of grams from counts of one block's (order + 1)-grams.

    levels: for 1 the counts of (context of one byte, symbol) over all blocks, and for others those
    of the contexts that several blocks share, as sorted keys and counts.
    """

    def __init__(self, order: int, keys: np.ndarray, counts: np.ndarray, levels: dict[int, tuple[np.ndarray, np.ndarray]]):
        shared, self.order, levels = levels, order, {order: (keys, counts), 1: levels[1]}
        for m in range(order - 1, -1, -1):
            if m != 1:
                k, n = levels[m + 1]
                k = k & self._mask(m)
                if m in shared:  # what this block has of them is a part
                    own = ~np.isin(k >> 9, shared[m][0] >> 9)
                    k, n = np.append(k[own], shared[m][0]), np.append(n[own], shared[m][1])
                levels[m] = _merged([k], [n])
        self.grams, self.logs, self.contexts, self.direct, self.escape, self.below, self.again = {}, {}, {}, {}, {}, {}, {}
        stats = {}
        for m in range(order + 1):
            k, n = levels[m]
            context = k >> 9
            heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(k) else np.empty(0, np.int64)
            total = np.add.reduceat(n, heads) if len(k) else n
            kinds = np.diff(np.append(heads, len(k)))
            stats[m] = total, kinds
            self.grams[m], self.contexts[m], self.logs[m] = Table(k), Table(context[heads]), np.log10(2 * n - 1)
            self.direct[m] = np.log10(2 * total)
            self.escape[m] = np.log10(kinds) - self.direct[m]
            if m:
                up = self.contexts[m - 1].find(context[heads] & (self._mask(m - 1) >> 9))
                excluded = np.add.reduceat(levels[m - 1][1][self.grams[m - 1].find(k & self._mask(m - 1))], heads) if len(k) else n
                count, others = stats[m - 1][0][up] - excluded, stats[m - 1][1][up] - kinds
                with np.errstate(divide="ignore"):
                    self.below[m] = np.where(others > 0, np.log10(2 * count), 0.0)
                    self.again[m] = np.where(others > 0, np.log10(np.maximum(others, 1)) - self.below[m], 0.0)
            else:
                self.never = -math.log10(max(1, 257 - int(kinds.sum())))
        heads = self.contexts[order].find(keys >> 9)
        self.known = (self.logs[order] - self.direct[order][heads]).astype(np.float32)

    @staticmethod
    def _mask(m: int) -> int:
        return (1 << (8 * m + 9)) - 1

    def score(self, keys: np.ndarray) -> np.ndarray:
        at = self.grams[self.order].find(keys)
        out = self.known[at] if len(self.known) else np.zeros(len(keys), np.float32)
        new = np.flatnonzero(at < 0)
        if len(new):
            odd, back = np.unique(keys[new], return_inverse=True)
            out[new] = self._unseen(odd)[back]
        return out

    def _unseen(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(keys)), np.arange(len(keys))
        child = np.full(len(keys), -1)  # context of the level above, if it was known
        for m in range(self.order, -1, -1):
            k = keys[left] & self._mask(m)
            gram, context = self.grams[m].find(k), self.contexts[m].find(k >> 9)
            escaped, seen = child >= 0, gram >= 0
            log = self.logs[m][gram] if len(self.logs[m]) else np.zeros(len(k))
            if m < self.order and len(self.below[m + 1]):
                out[left] += np.where(escaped, np.where(seen, log - self.below[m + 1][child], self.again[m + 1][child]), 0)
            if len(self.direct[m]):
                out[left] += np.where(~escaped & (context >= 0), np.where(seen, log - self.direct[m][context], self.escape[m][context]), 0)
            left, child = left[~seen], context[~seen]
        out[left] += self.never
        return out


def _suffix(keys: np.ndarray, m: int) -> np.ndarray:
    """The last m bytes of the grams' contexts."""
    return keys >> 9 & ((1 << (8 * m)) - 1)


def _block_of(keys: np.ndarray, crowded: dict[int, np.ndarray], blocks: int) -> np.ndarray:
    """Number of the block that holds each gram: by the last two bytes of its context, or by as
    many more as it takes to come to a suffix that isn't crowded."""
    place, open_ = _mix(_suffix(keys, 2).astype(U)), np.ones(len(keys), bool)
    for m, suffixes in sorted(crowded.items()):
        open_ &= np.isin(_suffix(keys, m), suffixes)
        place[open_] = _mix(_suffix(keys[open_], m + 1).astype(U) + U(m << 56))
    return (place % U(blocks)).astype(np.int64)


#: Keys and numbers travel as bytes, many to a row.
_ROWS = "block int, role int, chunk long, keys binary, n binary"


def _packed_keys(values: list[np.ndarray]) -> pa.Array:
    """Sorted keys as differences, first bytes first: what compresses well in a shuffle."""
    return pa.array([np.diff(v, prepend=v[:0].dtype.type(0)).view(np.uint8).reshape(-1, 8).T.tobytes() for v in values], pa.binary())


def _keys(packed: pa.Scalar) -> np.ndarray:
    planes = np.frombuffer(packed.as_buffer(), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())


def _packed(values: list[np.ndarray]) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def _numbers(packed: pa.Scalar, kind=np.int64) -> np.ndarray:
    return np.frombuffer(packed.as_buffer(), kind)


def _split(block: np.ndarray, *columns: np.ndarray):
    """(block, part of each column) for the rows of each block, of at most ROW values."""
    if not len(block):
        return
    order = np.argsort(block, kind="stable")
    block, columns = block[order], [c[order] for c in columns]
    starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    for a, z in zip(starts, [*starts[1:], len(block)], strict=True):
        for i in range(a, z, ROW):
            yield int(block[a]), *(c[i : min(z, i + ROW)] for c in columns)


def _dealt(rows: list[tuple], role: int, chunk: int | None) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([role] * n, pa.int32()), pa.array([chunk] * n, pa.int64()), _packed_keys([r[1] for r in rows]), _packed([r[2] if len(r) > 2 else r[1][:0] for r in rows])],
        ["block", "role", "chunk", "keys", "n"],
    )


class _Layout:
    """Which block holds a gram (kind 0) or a word (kind 1); words come after the grams' blocks."""

    def __init__(self, crowded: dict[int, np.ndarray], grams: int, words: int):
        self.crowded, self.grams, self.words = crowded, grams, words

    def of(self, kind: int, keys: np.ndarray) -> np.ndarray:
        return self.grams + (_mix(keys.astype(U)) % U(self.words)).astype(np.int64) if kind else _block_of(keys, self.crowded, self.grams)


def _store(layout: _Layout):
    """Rows of counts (role 0), by block, from (kind, key, n)."""

    def store(batches):
        for b in batches:
            kinds, keys, n = (b[c].to_numpy() for c in ("kind", "key", "n"))
            for kind in (0, 1):
                mine = kinds == kind
                if mine.any():
                    yield _dealt(list(_split(layout.of(kind, keys[mine]), keys[mine], n[mine])), 0, None)

    return store


def _ask(order: int, layout: _Layout):
    """Rows of questions (role 1), by block: the different grams and words of each chunk, whose texts come one after the other."""

    def ask(batches):
        chunk, tallies = None, (_Tally(), _Tally())

        def asked():
            for kind, tally in enumerate(tallies):
                keys = tally.pop()[0]
                for row in _split(layout.of(kind, keys), keys):
                    yield _dealt([row], 1, chunk)

        for b in batches:
            if not b.num_rows:
                continue
            chunks = b["chunk"].to_numpy()
            starts = np.flatnonzero(np.append(True, chunks[1:] != chunks[:-1]))
            for a, z in zip(starts, [*starts[1:], len(chunks)], strict=True):
                if chunks[a] != chunk:
                    yield from asked()
                    chunk = int(chunks[a])
                for _, x in blocks((t.as_py() for t in b["data"].slice(a, z - a)), order):
                    tallies[0].add(x.grams)
                    tallies[1].add(x.words)
        yield from asked()

    return ask


def _answer(order: int, layout: _Layout, levels: dict):
    """Answers (chunk, keys, logs) for grams and (chunk, keys, n) for words, from the rows of each block: counts, then questions."""

    def answer(batches):
        block, held, table = None, [], None
        for b in batches:
            for i in range(b.num_rows):
                number, role = b["block"][i].as_py(), b["role"][i].as_py()
                if number != block:
                    block, held, table = number, [], None
                keys = _keys(b["keys"][i])
                if role == 0:
                    held.append((keys, _numbers(b["n"][i])))
                    continue
                if table is None:
                    k, n = _merged(*map(list, zip(*held, strict=True))) if held else (np.empty(0, np.int64),) * 2
                    table, held = (Trie(order, k, n, levels) if block < layout.grams else (Table(k), n)), []
                if block < layout.grams:
                    logs, n = _packed([table.score(keys).astype(np.float32)]), pa.nulls(1, pa.binary())
                else:
                    at = table[0].find(keys)
                    keys, found = keys[at >= 0], table[1][at[at >= 0]]
                    logs, n = pa.nulls(1, pa.binary()), _packed([found])
                yield pa.RecordBatch.from_arrays([b["chunk"].slice(i, 1), _packed_keys([keys]), logs, n], ["chunk", "keys", "logs", "n"])

    return answer


def _score(order: int):
    """Per document: score, words, known words, base; from a chunk's answers (role 0), then its texts (role 1)."""

    def score(batches):
        chunk, held, tables = None, {0: [], 1: []}, None
        columns = ("logs", np.float32), ("n", np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            chunks, roles = b["chunk"].to_numpy(), b["role"].to_numpy()
            starts = np.flatnonzero(np.append(True, (chunks[1:] != chunks[:-1]) | (roles[1:] != roles[:-1])))
            for a, z in zip(starts, [*starts[1:], len(chunks)], strict=True):
                if chunks[a] != chunk:
                    chunk, held, tables = chunks[a], {0: [], 1: []}, None
                part = b.slice(a, z - a)
                if roles[a] == 0:
                    for i in range(part.num_rows):
                        kind = 0 if part["logs"][i].is_valid else 1
                        name, of = columns[kind]
                        held[kind].append((_keys(part["keys"][i]), _numbers(part[name][i], of)))
                    continue
                if tables is None:
                    joined = [[np.concatenate(c) for c in zip(*held[kind], strict=True)] if held[kind] else [np.empty(0, np.int64), np.empty(0)] for kind in (0, 1)]
                    tables, held = [(Table(k), v) for k, v in joined], {0: [], 1: []}
                    tables[1] = tables[1][0], np.log10(tables[1][1] + 1.0)
                (grams, logs), (words, word_logs) = tables
                n = part.num_rows
                total, n_words, n_known, base = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
                for docs, x in blocks((t.as_py() for t in part["data"]), order):
                    at = grams.find(x.grams)
                    if (at < 0).any():
                        raise RuntimeError("a gram of the chunk has no answer")
                    value = logs[at].astype(np.float64)
                    full = x.where > 0
                    np.add.at(total, docs[full], np.add.reduceat(value, (np.cumsum(x.where) - x.where)[full]) if full.any() else 0)
                    at, owner = words.find(x.words), docs[x.word_piece]
                    known = at >= 0
                    np.add.at(n_words, owner, 1)
                    np.add.at(n_known, owner[known], 1)
                    np.add.at(base, owner[known], word_logs[at[known]])
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], *map(pa.array, (total, n_words, n_known, base))], ["doc_id", "held_out", "score", "n_words", "n_known", "base"])

    return score


def _crowded(grams: DataFrame, order: int) -> tuple[dict[int, np.ndarray], dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The context suffixes of each length that have more than BLOCK grams, and the counts of the
    contexts they are: at most a suffix for BLOCK grams, of at most 257 rows."""
    crowded, levels, within = {}, {}, grams
    for m in range(2, order):
        suffix = F.shiftright("key", 9).bitwiseAND(F.lit((1 << (8 * m)) - 1))
        found = within.groupBy(suffix.alias("suffix")).agg(F.count("*").alias("k")).where(F.col("k") > BLOCK).select("suffix").toArrow()
        if not found.num_rows:
            break
        crowded[m] = np.sort(found["suffix"].to_numpy())
        within = within.where(suffix.isin(crowded[m].tolist()))
        rows = within.groupBy(F.col("key").bitwiseAND(F.lit((1 << (8 * m + 9)) - 1)).alias("key")).agg(F.sum("n").alias("n")).orderBy("key").toArrow()
        levels[m] = rows["key"].to_numpy(), rows["n"].to_numpy()
    return crowded, levels


def score_documents(docs: DataFrame, order: int = 5, folds: int = 7, fold: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the documents whose crc32(doc_id as text) mod `folds` is not `fold` (a null id
    counts as the empty string), scores all. score is log10 of the model's probability of the
    whole text, lower-cased A-Z, with its end. base_score is a word model with one added to each
    count; words are known by a 64-bit hash. A null text is empty. Repeated rows train and score
    each. An empty table gives an empty result; with nothing to learn from, symbols are uniform.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    crc = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc % folds == fold).alias("held_out"), F.encode(text, "utf-8").alias("data"))
    counts = rows.where(~F.col("held_out")).select("data").mapInArrow(_gather(order), "kind int, key long, n long")
    counts = materialise(counts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    learned, size = rows.agg(F.count(F.when(~F.col("held_out"), 1)), F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()
    n_grams, n_kinds, n_words = counts.agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, v)), F.lit(0)) for k, v in ((0, F.lit(1)), (1, F.lit(1)), (1, F.col("n")))]).first()
    train_tokens, kinds = n_words + learned, n_kinds + (1 if learned else 0)

    grams = counts.where("kind = 0").select("key", "n")
    crowded, levels = _crowded(grams, order)
    # At most 256 * 257 rows, whatever the corpus.
    low = grams.groupBy(F.col("key").bitwiseAND(F.lit((1 << 17) - 1)).alias("key")).agg(F.sum("n").alias("n")).orderBy("key").toArrow()
    levels[1] = low["key"].to_numpy(), low["n"].to_numpy()
    layout = _Layout(crowded, 2 * n_grams // BLOCK + 1, n_kinds // BLOCK + 1)

    chunk = F.pmod(F.xxhash64("doc_id", "data"), F.lit(size // CHUNK + 1)).alias("chunk")
    texts = rows.select(chunk, "doc_id", "held_out", "data")
    questions = texts.select("chunk", "data").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_ask(order, layout), _ROWS)
    asked = counts.mapInArrow(_store(layout), _ROWS).unionByName(questions).repartition("block").sortWithinPartitions("block", "role")
    answers = asked.mapInArrow(_answer(order, layout, levels), "chunk long, keys binary, logs binary, n binary")

    met = answers.withColumn("role", F.lit(0)).unionByName(texts.withColumn("role", F.lit(1)), allowMissingColumns=True)
    met = met.repartition("chunk").sortWithinPartitions("chunk", "role").mapInArrow(_score(order), "doc_id long, held_out boolean, score double, n_words long, n_known long, base double")
    per_token = math.log10(train_tokens + kinds + 1)
    n_tokens = F.col("n_words") + 1
    return materialise(met, "scored").select(
        "doc_id",
        "held_out",
        n_tokens.alias("n_tokens"),
        (F.col("n_known") + (1 if learned else 0)).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(math.log10(learned + 1)) - n_tokens * F.lit(per_token)).alias("base_score"),
        "score",
    )


class AdaptiveTrie:
    """The same model, symbol by symbol: it learns as it reads. Plain dictionaries, for one document at a time."""

    def __init__(self, order: int = 4):
        self.order, self.counts = order, defaultdict(lambda: defaultdict(int))

    def probability(self, context: bytes, symbol: int) -> float:
        p, out = 1.0, set()
        for m in range(self.order, -1, -1):
            after = self.counts.get(context[len(context) - m :])
            if not after:
                continue
            open_ = {s: n for s, n in after.items() if s not in out}
            if not open_:
                continue
            total = 2 * sum(open_.values())
            if symbol in open_:
                return p * (2 * open_[symbol] - 1) / total
            p *= len(open_) / total
            out |= set(after)
        return p / max(1, 257 - len(out))

    def learn(self, context: bytes, symbol: int) -> None:
        for m in range(self.order + 1):
            self.counts[context[len(context) - m :]][symbol] += 1

    def read(self, data: bytes, learn: bool = True) -> float:
        """log10 probability of the text and its end."""
        data, total = data.lower(), 0.0
        padded = b"\0" * self.order + data
        for i, s in enumerate([*data, END]):
            context = padded[i : i + self.order]
            total += math.log10(self.probability(context, s))
            if learn:
                self.learn(context, s)
        return total


def adaptive_scores(docs: DataFrame, order: int = 4) -> DataFrame:
    """doc_id, score: each text's adaptive code length, from an empty trie of its own. A null text is
    empty and has its end only; repeated rows score alike, null ids stay null, an empty table gives
    an empty result and further columns are ignored."""

    def score(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([AdaptiveTrie(order).read(x.as_py()) for x in b["data"]], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data")).mapInArrow(score, "doc_id long, score double")
