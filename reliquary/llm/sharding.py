"""Sharding by sampled splitters.

Keys are drawn with a chance in proportion to their row's size; quantiles of the sample split the
key space into many narrow ranges. The ranges' exact weights are then counted over all rows; a
range that came out overfull is subdivided by a sample of its own, and a range that is one single
key and outweighs a shard is subdivided by a hash of the document id. Whole ranges are dealt to
shards, heaviest first.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, number_rows

UNIT = 1 << 53


def _ranges(rows: DataFrame, cuts: np.ndarray) -> DataFrame:
    """Add `unit`: the number of cuts at or below the row's key."""

    def place(batches):
        for b in batches:
            unit = np.searchsorted(cuts, b["key"].to_numpy(), side="right").astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(unit)], [*b.schema.names, "unit"])

    return rows.mapInArrow(place, rows.withColumn("unit", F.lit(0).cast("long")).schema)


def shard_documents(docs: DataFrame, shards: int = 8, ranges: int = 4096, sample: int = 65_536, seed: int = 7) -> DataFrame:
    """Deal all documents to `shards` shards of near-equal bytes.

    The key is a hash of the text, so equal texts share a range and with it a shard, unless one
    text's copies outweigh a shard. Driver memory is bounded by `sample` keys and by the `ranges`
    (each overfull one adds a few). Size is the text's UTF-8 bytes plus 1; a null text has none.
    Null ids count as one id; repeated rows each get a slot; an empty table gives an empty result.

    Returns doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialise(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
            F.xxhash64(F.lit(seed), F.col("doc_id"), F.monotonically_increasing_id()).alias("tie"),
        ),
        "shard-rows",
    )
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = min(ranges, max(16 * shards, count // 8))
    target = total / shards

    def draw(of: DataFrame, weight: int, count: int) -> np.ndarray:
        chance = F.pmod(F.xxhash64(F.lit(seed), "key", "tie"), F.lit(UNIT)) / F.lit(float(UNIT))
        return np.sort(np.array([r[0] for r in of.where(chance < F.col("size") * F.lit(count / max(weight, 1))).select("key").collect()], np.int64))

    keys = draw(rows, total, sample)
    cuts = np.unique(keys[:: max(1, len(keys) // ranges)])
    # A key that the sample holds often is a range of its own.
    values, times = np.unique(keys, return_counts=True)
    single = values[times > 2 * max(1, len(keys) // ranges)]
    cuts = np.unique(np.concatenate([cuts, single, single[single < np.iinfo(np.int64).max] + 1]))
    for _ in range(64):
        weights = {r["unit"]: r for r in _ranges(rows, cuts).groupBy("unit").agg(F.sum("size").alias("w"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
        over = [r for r in weights.values() if r["w"] > 2 * max(1, total // ranges) and r["lo"] < r["hi"]]
        if not over:
            break
        units = [r["unit"] for r in over]
        more = draw(_ranges(rows, cuts).where(F.col("unit").isin(units)), sum(r["w"] for r in over), 16 * len(over))
        middle = np.array([x for r in over for x in (r["lo"] + (r["hi"] - r["lo"] + 1) // 2, r["hi"])], np.int64)
        cuts = np.unique(np.concatenate([cuts, more, middle]))

    # (unit, piece) -> weight; only a single key over a whole shard's weight has several pieces.
    pieces = {r["unit"]: int(np.ceil(r["w"] / max(1.0, target / 64))) for r in weights.values() if r["lo"] == r["hi"] and r["w"] > max(target, 1)}
    units = _ranges(rows, cuts)
    parts = F.create_map(*[F.lit(int(x)) for p in pieces.items() for x in p]) if pieces else None
    count = F.coalesce(F.element_at(parts, F.col("unit").cast("int")), F.lit(1)) if pieces else F.lit(1)
    units = units.withColumn("piece", F.pmod("tie", count).cast("long"))
    load = units.groupBy("unit", "piece").agg(F.sum("size").alias("w")).collect()
    heap, dealt = [(0, s) for s in range(shards)], {}
    for r in sorted(load, key=lambda r: (-r["w"], r["unit"], r["piece"])):
        w, s = heapq.heappop(heap)
        dealt[r["unit"], r["piece"]] = s
        heapq.heappush(heap, (w + r["w"], s))
    # At most ranges + a few pieces per shard: a bounded table.
    plan = docs.sparkSession.createDataFrame([(u, p, s) for (u, p), s in dealt.items()] or [(-1, 0, 0)], "unit long, piece long, shard int")
    out = units.join(F.broadcast(plan), ["unit", "piece"])
    out = number_rows(out, ["shard"], ["unit", "key", "doc_id", "size", "tie"], "slot")
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")
