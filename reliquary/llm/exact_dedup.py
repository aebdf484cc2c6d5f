"""Exact dedup over a log-structured merge index of digests.

Documents go to memtables by a hash of their ids. Each is flushed as a run: its digests in order,
each once with the identifier to keep and how often it came, and a filter of one bit for each of
sixteen slots a document, kept as bitmaps. Every run's digests are probed in the filters of the
other runs. Those that none of them may hold are settled; compaction merges only the others, and
keeps the chosen identifier of each digest. A digest found more than once is a hit, and hits are
verified byte by byte: their whole texts are grouped by value, pre-aggregated before the shuffle.
Native functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, materialise, skew_lookup

#: Digests of hits are broadcast as a filter up to this many (under 100 bytes each); beyond, they are joined by shuffle.
FILTER_KEYS = 500_000


#: Memtables, and so runs before compaction.
RUNS = 4
#: Slots of a run's filter for each document of the index.
SLOTS = 16
#: Filters are broadcast up to this many bytes in all; beyond, they are joined by shuffle.
FILTER_BYTES = 64 << 20


class DigestIndex:
    """Runs of (digest, keep_id, group_size), their filters, and the level they are compacted to."""

    def __init__(self, keep: str = "max", runs: int = RUNS):
        if keep not in ("min", "max"):
            raise ValueError(f"keep must be min or max, not {keep}")
        self.pick, self.each = F.max if keep == "max" else F.min, runs
        self.runs = self.level = None
        self.n_runs = self.count = 0

    def _slot(self):
        return F.pmod(F.xxhash64("digest"), F.lit(SLOTS * max(1, self.count))) + 1

    def flush(self, docs: DataFrame) -> DataFrame:
        """Take documents (doc_id, text) in; returns (doc_id, digest) of each."""
        rows = materialise(docs.select("doc_id", F.unhex(F.sha2(normalised(), 256)).alias("digest")), "digests")
        run = F.pmod(F.xxhash64("doc_id"), F.lit(self.each)).cast("int") + self.n_runs
        runs = rows.groupBy(run.alias("run"), "digest").agg(self.pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        runs = materialise(runs.sortWithinPartitions("run", "digest"), "runs", **{"parquet.bloom.filter.enabled#digest": "true"})
        self.runs = runs if self.runs is None else self.runs.unionByName(runs)
        self.n_runs, self.count = self.n_runs + self.each, self.count + rows.count()
        return rows

    def filters(self) -> DataFrame:
        """(run, bucket, bits) of all runs."""
        slots = self.runs.select("run", self._slot().alias("slot"))
        bits = slots.groupBy("run", F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
        return materialise(bits, "filters")

    def _may_be_elsewhere(self) -> DataFrame:
        """The runs' rows, and whether the filter of another run has their digest's bit."""
        by_bucket = self.filters().groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("run", "bits"))).alias("bits"))
        by_bucket = F.broadcast(by_bucket) if self.count * SLOTS // 8 * self.n_runs <= FILTER_BYTES else by_bucket
        rows = self.runs.withColumns({"bucket": F.bitmap_bucket_number(self._slot()), "at": F.bitmap_bit_position(self._slot())})
        byte = lambda bits: F.conv(F.hex(F.substring(bits, (F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = lambda bits: byte(bits).bitwiseAND(F.pow(F.lit(2), F.col("at") % 8).cast("int")) > 0
        others = F.map_values(F.map_filter("bits", lambda run, _: run != F.col("run")))
        return rows.join(by_bucket, "bucket").select("digest", "keep_id", "group_size", F.exists(others, is_set).alias("elsewhere"))

    def compact(self) -> DataFrame:
        """Merge the runs: digest, keep_id, group_size. What no other run may hold goes on as it is."""
        probed = materialise(self._may_be_elsewhere(), "probed")
        merged = probed.where("elsewhere").groupBy("digest").agg(self.pick("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        settled = probed.where("not elsewhere").drop("elsewhere")
        self.level = materialise(settled.unionByName(merged), "level", **{"parquet.bloom.filter.enabled#digest": "true"})
        return self.level

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """Point reads: the IN list reaches the level's Parquet filters and statistics."""
        return self.level.where(F.col("digest").isin([F.lit(d) for d in digests]))


def normalised():
    return ascii_lower(F.coalesce(F.col("text"), F.lit("")))


def exact_duplicates(docs: DataFrame, keep: str = "max") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal
    texts the row with the largest (keep="min": smallest) doc_id stays. Rows that repeat a doc_id
    are one document, so they share the verdict; a null doc_id stays only where all ids are null.
    An empty table gives an empty result, and further columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    index = DigestIndex(keep)
    rows = index.flush(docs)
    level = index.compact()
    total, hits = level.agg(F.coalesce(F.sum("group_size"), F.lit(0)), F.count(F.when(F.col("group_size") > 1, 1))).first()
    found = level.where("group_size > 1")
    texts = docs.select("doc_id", normalised().alias("value")).withColumn("digest", F.unhex(F.sha2("value", 256)))
    probe = found.select("digest")
    texts = texts.join(F.broadcast(probe) if hits <= FILTER_KEYS else probe, "digest", "left_semi")
    pick = F.max if keep == "max" else F.min
    # Grouping by the value itself compares bytes; copies collapse inside each task before the shuffle.
    checked = materialise(texts.groupBy("digest", "value").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "verified")
    several = checked.groupBy("digest").agg(F.count("*").alias("values")).where("values > 1")
    out = skew_lookup(rows, checked.select("digest", "keep_id", "group_size"), ["digest"], "group_size", total)
    if several.limit(1).count():  # two texts with one SHA-256: rows of those digests go by their text
        clash = docs.select("doc_id", normalised().alias("value")).withColumn("digest", F.unhex(F.sha2("value", 256))).join(several, "digest", "left_semi")
        apart = clash.join(checked, ["digest", "value"]).select("digest", "doc_id", "keep_id", "group_size")
        rows = rows.join(several, "digest", "left_anti")
        out = skew_lookup(rows, checked.select("digest", "keep_id", "group_size"), ["digest"], "group_size", total).unionByName(apart)
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
