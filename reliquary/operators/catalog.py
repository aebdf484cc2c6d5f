"""The catalog: Parquet tables under one root, written by one writer at a time.

A table is a folder of versions; the newest numbered manifest names the current ones of all tables.
A change, of one table or of several, writes new versions and then one manifest with the next number,
so readers see either state and a crash in between changes nothing. The last manifests stay, and the
versions they name, so that a reader who holds one can finish. Files go through Hadoop's filesystem
API, so the root may be in any store.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import cut

ENTRIES = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("parent_id", T.StringType()), T.StructField("is_dir", T.BooleanType()), T.StructField("name", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("type_code", T.StringType()), T.StructField("creator_code", T.StringType()), T.StructField("finder_flags", T.IntegerType()), T.StructField("label_color", T.IntegerType()),
    T.StructField("created_at", T.TimestampType()), T.StructField("modified_at", T.TimestampType()), T.StructField("data_size", T.LongType()), T.StructField("rsrc_size", T.LongType()),
    T.StructField("data_sha256", T.StringType()), T.StructField("rsrc_sha256", T.StringType()), T.StructField("encoding", T.StringType()), T.StructField("source", T.StringType()), T.StructField("added_at", T.TimestampType()),
])
FORKS = T.StructType([T.StructField("id", T.StringType()), T.StructField("data_fork", T.BinaryType()), T.StructField("rsrc_fork", T.BinaryType())])
THUMBNAILS = T.StructType([T.StructField("id", T.StringType()), T.StructField("png", T.BinaryType())])
HISTORY = T.StructType([T.StructField("url", T.StringType()), T.StructField("filename", T.StringType()), T.StructField("date", T.TimestampType()), T.StructField("entry_id", T.StringType()), T.StructField("source", T.StringType())])
META = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
#: Manifests that stay, with the versions they name.
KEPT = 4
TABLES = {"entries": ENTRIES, "forks": FORKS, "thumbnails": THUMBNAILS, "catalog_meta": META, "download_history": HISTORY}


class CatalogError(Exception):
    """kind: AlreadyExists, NotFound or MissingFork."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


class _Store:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """A new file, which nobody sees before it is whole."""
        stream = self.fs.create(self._path(f".{name}.new"), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.rename(self._path(f".{name}.new"), self._path(name)):
            raise CatalogError("AlreadyExists", name)

    def names(self, pattern: str) -> list[str]:
        return [f.getPath().getName() for f in self.fs.globStatus(self._path(pattern)) or []]

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def with_defaults(rows: DataFrame) -> DataFrame:
    """Entries from rows that may lack columns or values."""
    blank = {"is_dir": False, "path": "", "finder_flags": 0, "label_color": 0, "data_size": 0, "rsrc_size": 0, "encoding": "MacRoman"}
    out = []
    for f in ENTRIES:
        c = F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
        out.append((F.coalesce(c, F.lit(blank[f.name]).cast(f.dataType)) if f.name in blank else c).alias(f.name))
    return rows.select(*out)


def fork_facts(rows: DataFrame) -> DataFrame:
    """Sizes and SHA-256 of data_fork and rsrc_fork; an empty resource fork has no hash."""
    data, rsrc = F.coalesce("data_fork", F.lit(b"")), F.coalesce("rsrc_fork", F.lit(b""))
    return rows.withColumns({
        "data_size": F.octet_length(data).cast("long"), "rsrc_size": F.octet_length(rsrc).cast("long"),
        "data_sha256": F.sha2(data, 256), "rsrc_sha256": F.when(F.octet_length(rsrc) > 0, F.sha2(rsrc, 256)),
    })


def numbered(rows: DataFrame, order: list[str], start: int) -> DataFrame:
    """Add id: four digits or more, consecutive from `start` in the given order. Rows are range
    partitioned and each partition's count gives the offsets, so no task sees all of them."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = cut(ranged)
    part = F.shiftright("_at", 33)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    base = counts.select("_part", "_low", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    out = ranged.withColumn("_part", part).join(base, "_part")  # one row per partition
    number = F.col("_at") - F.col("_low") + F.col("_base") + start
    return out.withColumn("id", F.when(number < 10_000, F.lpad(number.cast("string"), 4, "0")).otherwise(number.cast("string"))).drop("_at", "_part", "_low", "_base")


def entry_json(entries: DataFrame) -> DataFrame:
    """id and the entry as JSON, keys sorted, dates in ISO form."""
    columns = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c) if entries.schema[c].dataType == T.TimestampType() else F.col(c) for c in sorted(entries.columns)]
    return entries.select("id", F.to_json(F.struct(*columns)).alias("json"))


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, _Store(spark, root)
        if not self.store.names("manifest-*.json"):
            raise CatalogError("NotFound", root)

    @classmethod
    def create(cls, spark: SparkSession, root: str) -> Catalog:
        store = _Store(spark, root)
        if store.exists(""):
            raise CatalogError("AlreadyExists", root)
        created = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        store.write("manifest-000000.json", json.dumps({"app_version": "reliquary", "created": created, "tables": {}, "version": "1"}, sort_keys=True))
        out = cls(spark, root)
        out._replace("catalog_meta", spark.createDataFrame([("schema_version", "1")], META))
        return out

    open = classmethod(lambda cls, spark, root: cls(spark, root))

    def _manifests(self) -> list[str]:
        return sorted(self.store.names("manifest-*.json"), key=lambda n: (len(n), n))

    def manifest(self) -> dict:
        return json.loads(self.store.read(self._manifests()[-1]))

    def table(self, name: str) -> DataFrame:
        versions = self.manifest()["tables"].get(name, [])
        if not versions:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.store.root}/{name}/{v}" for v in versions])

    def _change(self, replaced: dict[str, DataFrame] | None = None, added: dict[str, DataFrame] | None = None) -> None:
        """New contents of tables, and rows to append to others, all in one manifest."""
        tables = self.manifest()["tables"]
        for rows_of, old in ((replaced or {}, {}), (added or {}, tables)):
            for name, rows in rows_of.items():
                version = uuid.uuid4().hex
                rows.select(*TABLES[name].names).write.parquet(f"{self.store.root}/{name}/{version}")
                tables = tables | {name: [*old.get(name, []), version]}
        names = self._manifests()
        self.store.write(f"manifest-{int(names[-1][9:-5]) + 1:06d}.json", json.dumps(self.manifest() | {"tables": tables}, sort_keys=True))
        for name in names[: -KEPT + 1]:  # with the versions that only they name
            gone = json.loads(self.store.read(name))["tables"]
            self.store.delete(name)
            held = [json.loads(self.store.read(n))["tables"] for n in self._manifests()]
            for t, versions in gone.items():
                for v in set(versions) - {v for tables in held for v in tables.get(t, [])}:
                    self.store.delete(f"{t}/{v}")

    def _append(self, name: str, rows: DataFrame) -> None:
        self._change(added={name: rows})

    def _replace(self, name: str, rows: DataFrame) -> None:
        self._change(replaced={name: rows})

    entries = property(lambda self: self.table("entries"))
    forks = property(lambda self: self.table("forks"))
    thumbnails = property(lambda self: self.table("thumbnails"))
    history = property(lambda self: self.table("download_history"))

    def next_id(self) -> int:
        return (self.entries.agg(F.max(F.expr("try_cast(id AS BIGINT)"))).first()[0] or 0) + 1

    def add_files(self, rows: DataFrame, order: list[str] | None = None) -> DataFrame:
        """Add rows with name, data_fork, rsrc_fork and any of the entry's other columns; in the
        given order (default: path, name, data) they get the next ids. Returns the new entries."""
        rows = fork_facts(rows)
        for c in ("path", "source", "parent_id"):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit("" if c == "path" else None).cast("string"))
        rows = numbered(rows, order or ["path", "name", "data_sha256", "rsrc_sha256"], self.next_id())
        staged = f"{self.store.root}/_staged/{uuid.uuid4().hex}"
        rows.withColumn("added_at", F.date_trunc("second", F.current_timestamp())).write.parquet(staged)
        rows = self.spark.read.parquet(staged)
        forks = rows.select("id", F.coalesce("data_fork", F.lit(b"")).alias("data_fork"), F.coalesce("rsrc_fork", F.lit(b"")).alias("rsrc_fork"))
        number = F.expr("try_cast(id AS BIGINT)")
        first, last = rows.agg(F.min(number), F.max(number)).first()
        if first is not None:
            self._change(added={"forks": forks, "entries": with_defaults(rows)})
        self.store.delete(staged.removeprefix(self.store.root + "/"))
        return self.entries.where(number.between(first, last) if first is not None else F.lit(False))

    def add_directory(self, name: str, parent_id: str | None = None, path: str = "") -> str:
        new = f"{self.next_id():04d}"
        row = self.spark.createDataFrame([(new, parent_id, True, name, path)], "id string, parent_id string, is_dir boolean, name string, path string")
        self._append("entries", with_defaults(row.withColumn("added_at", F.date_trunc("second", F.current_timestamp()))))
        return new

    def count(self) -> int:
        return self.entries.count()

    def entry(self, entry_id: str):
        from .listing import entry

        return entry(self.entries, entry_id).head()

    def data_fork(self, entry_id: str) -> bytes:
        row = self.forks.where(F.col("id") == entry_id).select("data_fork").head()
        if row is None:
            raise CatalogError("MissingFork", entry_id)
        return bytes(row[0])

    def rsrc_fork(self, entry_id: str) -> bytes:
        row = self.forks.where(F.col("id") == entry_id).select("rsrc_fork").head()
        return bytes(row[0]) if row and row[0] is not None else b""

    def with_forks(self, entries: DataFrame) -> DataFrame:
        return entries.join(self.forks, "id", "left").withColumn("rsrc_fork", F.coalesce("rsrc_fork", F.lit(b"")))

    def set_thumbnails(self, rows: DataFrame) -> None:
        self._replace("thumbnails", self.thumbnails.join(rows.select("id"), "id", "left_anti").unionByName(rows))

    def thumbnail(self, entry_id: str) -> bytes | None:
        row = self.thumbnails.where(F.col("id") == entry_id).head()
        return bytes(row["png"]) if row else None

    def delete_thumbnails(self, ids: DataFrame | None = None) -> int:
        """Of these ids, or all; how many went."""
        before = self.thumbnails.count()
        rest = self.thumbnails.join(ids, "id", "left_anti") if ids is not None else self.thumbnails.where(F.lit(False))
        self._replace("thumbnails", rest)
        return before - self.thumbnails.count()

    def delete(self, *ids: str) -> int:
        """Entries, all below them, their forks and thumbnails; how many entries went."""
        from .listing import subtree

        gone = subtree(self.entries, self.spark.createDataFrame([(i,) for i in ids], "id string"))
        before = self.count()
        self._change({name: self.table(name).join(gone, "id", "left_anti") for name in ("forks", "thumbnails", "entries")})
        return before - self.count()

    def record_download(self, rows: DataFrame) -> None:
        self._append("download_history", rows)

    def already_downloaded(self, urls: DataFrame) -> DataFrame:
        return urls.join(self.history.select("url"), "url", "left_semi")

    def sql(self, query: str, **args) -> DataFrame:
        """A query with bound parameters; the tables are views of their names."""
        for name in TABLES:
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(query, args=args)
