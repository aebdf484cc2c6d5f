"""What the ten operators share: scratch tables, gapless numbering, skew-safe lookups."""

from __future__ import annotations

import contextlib
import re
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: What the contracts call a word: a run of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"

#: A query's shuffle files go when it has run.
DROP_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Of each thread, the scratch tables that are there: runs in different threads don't see each other's.
_scratch = threading.local()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only for a local master that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    root = root or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="reliquary-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of so many rows or 16 MB, while the jobs inside run: whole texts are large rows."""
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}):
        yield


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def materialise(df: DataFrame, tag: str, rows: int = 2000, **options: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: it survives lost
    executors, and what comes later neither recomputes it nor drags its lineage along. Its shuffle
    files go as soon as it is written."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/reliquary-{uuid.uuid4().hex}-{tag}"
    with batches_of(spark, rows), settings(spark, DROP_SHUFFLES):
        df.write.options(**options).parquet(path)
    made().append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def made() -> list[str]:
    """Paths of this thread's scratch tables, oldest first."""
    if not hasattr(_scratch, "paths"):
        _scratch.paths = []
    return _scratch.paths


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete these scratch tables, or all of this thread; only when no DataFrame over them is needed any more."""
    conf = spark._jsc.hadoopConfiguration()
    for path in list(made() if paths is None else paths):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        if path in made():
            made().remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that a later one has taken the place of."""
    for df in tables:
        release(df.sparkSession, [df.scratch_path])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. lower() does that in one pass unless it would also change a
    character outside ASCII; only such texts pay for translate(), which looks up every character."""
    other = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    plain = (F.octet_length(text) == F.length(text)) | (F.lower(other) == other)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def number_rows(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 0, without gaps, in the given order.

    Range partitioning on (group, order) also splits a group that holds a third of all rows; each
    partition's row count per group (at most partitions + groups rows) then gives the offsets.
    """
    keys = [*group, *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()), f"numbered-{name}")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy("_part", *group).agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    parts = parts.select(*[F.col(c).alias(f"_g_{i}") for i, c in enumerate(group)], F.col("_part").alias("_p"), "_low", "_base")
    same = rows["_part"] == parts["_p"]
    for i, c in enumerate(group):
        same = same & rows[c].eqNullSafe(parts[f"_g_{i}"])
    out = rows.join(parts, same)
    return out.select(*df.columns, (F.col("_base") + F.col("_at") - F.col("_low")).cast("long").alias(name))


def skew_lookup(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, hot: int = 256) -> DataFrame:
    """Left join of left with right, whose rows are unique on `on` and say in `weight` how many left
    rows have the key. Keys with over total/hot rows number fewer than `hot`, so they are broadcast
    under that bound and never shuffled; the rest join by shuffle."""
    limit = max(1, total // hot)
    heavy = F.broadcast(right.where(F.col(weight) > limit))
    first = left.join(heavy, on, "inner")
    rest = left.join(heavy.select(*on), on, "left_anti").join(right.where(F.col(weight) <= limit), on, "left")
    return first.unionByName(rest)
