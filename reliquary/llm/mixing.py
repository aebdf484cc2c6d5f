"""Mixing sources to target weights by systematic sampling, with native functions only.

Each document of a source expects target / source_size copies. The expected copies are summed up
along the source in order of size, one offset per source is added, and a document is emitted once
for every integer its interval of that sum crosses. In order of size, what a source gives differs
from its target by no more than its longest document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, materialise, number_rows


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """From (source, source_size): weight and target of each source.

    Sources sorted by code point, null last, weigh `weights`, repeating. All sizes together are
    shared out by weight; a target stops at `most` times its source's size and the excess is
    reshared by weight. That ends where sources, by rising size per weight, are capped up to the
    first that its share of the rest doesn't fill, so running sums give it without iterating.
    One row per source, so the windows' single task grows with sources, not with documents.
    """
    name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = F.pmod(F.row_number().over(name) - 1, F.lit(len(weights)))
    out = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long"))
    out = out.withColumn("cap", most * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    out = out.withColumns({
        "total": F.sum("source_size").over(everything),
        "w_rest": F.sum("weight").over(everything) - F.sum("weight").over(fill.rowsBetween(Window.unboundedPreceding, 0)) + F.col("weight"),
        "c_before": F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "nth": F.row_number().over(fill),
    })
    open_ = (F.col("total") - F.col("c_before")) * F.col("weight") <= F.col("cap") * F.col("w_rest")
    out = out.withColumn("first_open", F.min(F.when(open_, F.col("nth"))).over(everything))
    at_first = lambda c: F.max(F.when(F.col("nth") == F.col("first_open"), F.col(c))).over(everything)
    share = (at_first("total") - at_first("c_before")).cast("double") * F.col("weight") / at_first("w_rest")
    capped = F.col("first_open").isNull() | (F.col("nth") < F.col("first_open"))
    return out.select("source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: row (its number within the source), doc_id, source, text_hash, size,
    source_size, target, copies, taken, and the columns in `carry`.

    Size is the number of words (null: 0). The offset of a source is a hash of its name, so reruns
    agree. Documents without words get their share of copies too, but take nothing. A null source
    is a source; ties in size go by doc_id (nulls first), then text hash; equal rows are interchangeable.
    An empty table gives an empty result, and further columns are left out unless they are carried.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    extra = [F.col(c).alias(f"_carry_{c}") for c in carry]
    rows = docs.select("doc_id", "source", F.xxhash64(text).alias("text_hash"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), *extra)
    if not carry:
        rows = materialise(rows, "mix-rows")
    sizes = materialise(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "mix-targets")
    ranked = number_rows(rows, ["source"], ["size", "doc_id", "text_hash"], "row")
    # One row per source: Spark broadcasts it below its own threshold, and else joins by shuffle with AQE's skew split.
    t = sizes.select(F.col("source").alias("_s"), "source_size", "target")
    out = ranked.join(t, ranked["source"].eqNullSafe(t["_s"])).drop("_s")
    name = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    offset = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = lambda n: F.floor(n.cast("double") * rate + offset)
    out = out.withColumn("copies", (upto(F.col("row") + 1) - upto(F.col("row"))).cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document's row, with all its columns, as often as it is taken. Null and
    empty texts are taken as often as their source's others; ties, repeated rows and an empty table
    are as in mix_sources, and no name of a column of docs is taken."""
    out = mix_sources(docs, carry=tuple(docs.columns), **how).where("copies > 0")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col(f"_carry_{c}").alias(c) for c in docs.columns])


def oracle() -> str:
    """DuckDB's version of op6."""
    return r"""
WITH r AS (
  SELECT doc_id, source, text,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source
), w AS (
  SELECT source, source_size, 3 * source_size AS cap,
         1 + (row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, ''))) - 1) % 3 AS weight
  FROM s
), f AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
    CAST(sum(weight) OVER () - sum(weight) OVER o + weight AS BIGINT) AS w_rest,
    CAST(sum(cap) OVER o - cap AS BIGINT) AS c_before, row_number() OVER o AS nth
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source IS NULL, source ROWS UNBOUNDED PRECEDING)
), g AS (
  SELECT *, min(CASE WHEN (total - c_before) * weight <= cap * w_rest THEN nth END) OVER () AS first_open FROM f
), t AS (
  SELECT source, source_size,
    CASE WHEN first_open IS NULL OR nth < first_open THEN CAST(cap AS DOUBLE)
      ELSE CAST(max(CASE WHEN nth = first_open THEN total - c_before END) OVER () AS DOUBLE) * weight
        / max(CASE WHEN nth = first_open THEN w_rest END) OVER () END AS target
  FROM g
), x AS (
  SELECT r.doc_id, r.size, t.source_size, t.target,
    row_number() OVER (PARTITION BY r.source ORDER BY r.size, r.doc_id NULLS FIRST) AS n,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST(('0x' || substr(md5(CASE WHEN r.source IS NULL THEN 'n' ELSE 's' || r.source END), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST((floor(CAST(n AS DOUBLE) * rate + u) - floor(CAST(n - 1 AS DOUBLE) * rate + u)) * size AS BIGINT) AS taken
FROM x"""
