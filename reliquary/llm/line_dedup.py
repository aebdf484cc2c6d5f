"""Line dedup by range-partitioned hashes, streamed in order.

Line hashes are range-partitioned and sorted by (hash, document, position), so one line's rows are
a run, and a line that holds a third of all rows, be it in one document, is spread over several
partitions. Each partition is streamed once, holding back at most the rows of the first min_docs - 1
documents of the current run. A run that touches a partition's edge may go on next door: its rows
wait for the sum of such runs' document counts (at most two per partition), less the documents that
an edge cuts. What comes out are dropped positions, gathered into one compressed keep bitmap per
document, never text.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, discard, fresh, materialise

BLANK = b" \t\n\x0b\x0c\r"
NO_ID = -(2**63)


def line_keys(data: bytes) -> list[bytes]:
    """A line's key: A-Z lower-cased, blanks stripped at both ends."""
    return [x.strip(BLANK) for x in data.lower().split(b"\n")]


def with_identity(docs: DataFrame, doc: str, th: str, data: str) -> DataFrame:
    """Under these names the id, a stand-in if null, the hash of the text, which tell documents apart, and the text as bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), th: F.xxhash64(text), data: F.encode(text, "utf-8")})


def _hash_lines(batches):
    for b in batches:
        digests, doc, th, pos = [], [], [], []
        for d, t, data in zip(b["doc"].to_pylist(), b["th"].to_pylist(), b["data"], strict=True):
            n = len(digests)
            keys = line_keys(data.as_py())
            for i, k in enumerate(keys):
                if k:
                    digests.append(xxhash.xxh3_128_digest(k))
                    pos.append(i)
            doc.append(np.full(len(digests) - n, d, np.int64))
            th.append(np.full(len(digests) - n, t, np.int64))
        h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        flat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(flat(doc)), pa.array(flat(th)), pa.array(np.array(pos, np.int32))], ["h1", "h2", "doc", "th", "pos"])


class _Run:
    """The run that is open while a partition streams by."""

    def __init__(self, key, edge: bool):
        self.key, self.edge, self.docs, self.held, self.first, self.last, self.begun = key, edge, 0, [], None, None, False

    def take(self, doc, th, pos, least: int, first: bool):
        """Add rows; yield (rows, kind) that are certain by now. kind 0: drop, 1: wait, 2: wait, lead row."""
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])
        new[0] = self.last != (doc[0], th[0])
        self.docs += int(new.sum())
        self.first, self.last = self.first or (doc[0], th[0]), (doc[-1], th[-1])
        rows = (doc, th, pos)
        if self.edge:  # began at the partition's start, perhaps before it
            if not self.begun:
                yield tuple(x[:1] for x in rows), 2
                rows = tuple(x[1:] for x in rows)
            yield rows, 1
        elif self.docs < least:
            self.held.append(rows)
        else:
            if self.held is not None:
                rows, self.held = tuple(np.concatenate([*(h[i] for h in self.held), rows[i]]) for i in range(3)), None
                rows = tuple(x[1:] for x in rows) if first else rows
            yield rows, 0
        self.begun = True

    def close(self, at_end: bool):
        if not self.edge and at_end and self.held:
            held = tuple(np.concatenate([h[i] for h in self.held]) for i in range(3))
            yield tuple(x[:1] for x in held), 2
            yield tuple(x[1:] for x in held), 1


def _stream(least: int, first: bool):
    names = ["kind", "part", "h1", "h2", "doc", "th", "pos", "n"]

    def stream(batches):
        part = TaskContext.get().partitionId()
        run = None

        def out(rows, kind, key, n=0):
            size = len(rows[0])
            const = lambda v, t: pa.array(np.full(size, v, t))
            return pa.RecordBatch.from_arrays([const(kind, np.int32), const(part, np.int32), const(key[0], np.int64), const(key[1], np.int64), pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2]), const(n, np.int64)], names)

        def ends(run):
            """Kinds 3 and 4: how many documents the run has here, its first one and its last."""
            for kind, (doc, th), n in ((3, run.first, run.docs), (4, run.last, 0)):
                yield out((np.array([doc], np.int64), np.array([th], np.int64), np.zeros(1, np.int32)), kind, run.key, n)

        for b in batches:
            h1, h2, doc, th, pos = (b[c].to_numpy() for c in ("h1", "h2", "doc", "th", "pos"))
            if not len(h1):
                continue
            cut = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
            starts = np.concatenate([[0], cut, [len(h1)]])
            i, last = 0, len(starts) - 2
            if run is None:
                run = _Run((h1[0], h2[0]), True)
            if run.key == (h1[0], h2[0]):
                e = starts[1]
                for rows, kind in run.take(doc[:e], th[:e], pos[:e], least, first):
                    yield out(rows, kind, run.key)
                i = 1
            if i > last:
                continue
            if run.edge:
                yield from ends(run)
            if last > i:  # whole runs inside the batch
                a, z = starts[i], starts[last]
                new = np.ones(z - a, np.int64)
                new[1:] = (doc[a + 1 : z] != doc[a : z - 1]) | (th[a + 1 : z] != th[a : z - 1])
                heads = starts[i:last] - a
                new[heads] = 1
                docs = np.add.reduceat(new, heads)
                drop = np.repeat(docs >= least, np.diff(np.append(heads, z - a)))
                if first:
                    drop[heads] = False
                if drop.any():
                    yield out((doc[a:z][drop], th[a:z][drop], pos[a:z][drop]), 0, (0, 0))
            a = starts[last]
            run = _Run((h1[a], h2[a]), False)
            for rows, kind in run.take(doc[a:], th[a:], pos[a:], least, first):
                yield out(rows, kind, run.key)
        if run is not None:
            for rows, kind in run.close(True):
                yield out(rows, kind, run.key)
            yield from ends(run)

    return stream


def _bitmaps(batches):
    for b in batches:
        maps = []
        for p in b["dropped"]:
            p = np.array(p.values.to_numpy(), np.int64)
            bits = np.ones(8 * (int(p.max()) // 8 + 1), bool)
            bits[p] = False
            maps.append(zlib.compress(np.packbits(bits).tobytes()))
        yield pa.RecordBatch.from_arrays([b["doc"], b["th"], pa.array(maps, pa.binary())], ["doc", "th", "keep"])


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """(doc, th, keep): a zlib-compressed bitmap of the lines to keep, for documents that lose any.

    Lines beyond the bitmap's end stay. A line is dropped when its key, of at least one code
    point, occurs in `min_docs` documents or more; with keep_first its first occurrence, by doc_id
    and position, stays. A null or empty text has one empty line, which is never dropped. Rows
    that repeat a doc_id with the same text are one document; null ids count as one id. An empty
    table gives an empty result.
    """
    rows = with_identity(docs.select("doc_id", "text"), "doc", "th", "data").select("doc", "th", "data")
    lines = materialise(rows.mapInArrow(_hash_lines, "h1 long, h2 long, doc long, th long, pos int"), "line-hashes")
    # The position is in the range key too, so one document that repeats a line is spread as well.
    order = ["h1", "h2", "doc", "th", "pos"]
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    runs = materialise(ranged.mapInArrow(_stream(min_docs, keep_first), "kind int, part int, h1 long, h2 long, doc long, th long, pos int, n long"), "line-runs", rows=50_000)
    discard(lines)
    # At most two such runs per partition. A document that goes on from one to the next counts once.
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct("doc", "th")))
    ends = runs.where("kind in (3, 4)").groupBy("h1", "h2", "part").agg(F.sum("n").alias("n"), at(3).alias("from"), at(4).alias("to"))
    cut = F.coalesce(F.lag("to").over(Window.partitionBy("h1", "h2").orderBy("part")) == F.col("from"), F.lit(False))
    sums = ends.withColumn("n", F.col("n") - cut.cast("int")).groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.min("part").alias("lead"))
    sums = F.broadcast(sums.where(F.col("docs") >= min_docs))
    waiting = runs.where("kind in (1, 2)").join(sums, ["h1", "h2"])
    if keep_first:
        waiting = waiting.where("not (kind = 2 and part = lead)")
    dropped = runs.where("kind = 0").select("doc", "th", "pos").unionByName(waiting.select("doc", "th", "pos"))
    return dropped.groupBy("doc", "th").agg(F.collect_set("pos").alias("dropped")).mapInArrow(_bitmaps, "doc long, th long, keep binary")


def lines_kept(data: bytes, keep: bytes | None) -> tuple[int, list[bytes]]:
    """Number of lines, and the kept ones."""
    lines = data.split(b"\n")
    if keep is None:
        return len(lines), lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    return len(lines), [x for i, x in enumerate(lines) if i >= len(bits) or bits[i]]


def _joined(docs: DataFrame, how: dict) -> tuple[DataFrame, str, str]:
    """docs with the text as bytes and the bitmap, and these columns' names."""
    doc, th, data, keep = (fresh(docs, c) for c in ("doc_key", "text_hash", "text_bytes", "keep_bits"))
    maps = keep_bitmaps(docs.select("doc_id", "text"), **how)
    return with_identity(docs, doc, th, data).join(maps.toDF(doc, th, keep), [doc, th], "left"), data, keep


def _digest(batches):
    for b in batches:
        n_lines, n_dropped, sha = [], [], []
        for data, keep in zip(b["data"], b["keep"], strict=True):
            n, kept = lines_kept(data.as_py(), keep.as_py())
            n_lines.append(n)
            n_dropped.append(n - len(kept))
            sha.append(hashlib.sha256(b"\n".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def line_digests(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document, as keep_bitmaps has it."""
    rows, data, keep = _joined(docs.select("doc_id", "text"), how)
    rows = rows.select("doc_id", F.col(data).alias("data"), F.col(keep).alias("keep"))
    return materialise(rows.mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string"), "line-digests")


def dedup_lines(docs: DataFrame, **how) -> DataFrame:
    """The documents with their kept lines as text; a null text stays null. n_chars, if there, is set
    anew. Rows that repeat an id with the same text keep the same lines; an empty table stays empty,
    and no name of a column of docs is taken."""
    schema = docs.withColumn("text", F.col("text").cast("string")).schema

    def apply(batches):
        for b in batches:
            texts = [b"\n".join(lines_kept(d.as_py(), k.as_py())[1]) for d, k in zip(b[data], b[keep], strict=True)]
            texts = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([texts if c == "text" else b[c] for c in schema.names], schema.names)

    rows, data, keep = _joined(docs, how)
    changed = rows.where(F.col(keep).isNotNull()).select(*[c for c in docs.columns if c != "text"], data, keep).mapInArrow(apply, schema)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
    return rows.where(F.col(keep).isNull()).select(*docs.columns).unionByName(changed)


ORACLE = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l
), f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id"""
