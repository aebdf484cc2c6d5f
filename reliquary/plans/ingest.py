"""Pipelines: import of files, extraction to a fixpoint, downloads, index documents, thumbnails."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import resources as R
from ..functions.classify import is_extractable, is_mac_paint, is_text, kind_label
from ..functions.text import download_name, human_size, keyword_tokens, read_text, site_of
from ..operators.catalog import Catalog
from ..operators.scratch import cut
from ..sources import probe
from ..sources.tables import read_files


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """path, name and content of files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")


def unwrapped(files: DataFrame) -> DataFrame:
    """name, path, forks, codes and dates of each file: recognised containers unwrapped to their
    first file, all others, and those that fail to parse, as they are."""
    known = files.withColumn("format", probe.identify(F.col("content"), F.col("name")))
    read = read_files(known.where("format is not null"), "container", source="path").where("ordinal = 0 and error is null")
    read = read.select(F.col("source_id").alias("path"), F.coalesce(F.nullif("name", F.lit("")), F.regexp_extract("source_id", r"([^/]+)$", 1)).alias("name"), "data_fork", "rsrc_fork", "type_code", "creator_code", "finder_flags", F.col("created").alias("created_at"), F.col("modified").alias("modified_at"))
    rest = files.join(read.select("path"), "path", "left_anti").select("path", "name", F.col("content").alias("data_fork"), F.lit(b"").alias("rsrc_fork"))
    return read.unionByName(rest, allowMissingColumns=True)


def import_files(catalog: Catalog, path: str) -> DataFrame:
    return catalog.add_files(unwrapped(raw_files(catalog.spark, path)))


def extract_all(catalog: Catalog) -> int:
    """Unpack every extractable entry without children, then what that brought, until nothing is
    new. Children get parent_id and source of their archive. An archive equal to one it lies in,
    unpacked in this call, would unpack for ever: it stays packed."""
    added, within = 0, None
    while True:
        entries = catalog.entries
        open_ = entries.where(~F.col("is_dir")).where(is_extractable(F.col("name")) & (F.col("data_size") > 0))
        open_ = open_.join(entries.select(F.col("parent_id").alias("id")).where("id is not null"), "id", "left_anti")
        if within is not None:
            open_ = open_.join(within, "id").where(~F.array_contains("outer", F.col("data_sha256")))
        else:
            open_ = open_.withColumn("outer", F.array().cast("array<string>"))
        open_ = cut(open_.select("id", "name", F.array_append("outer", F.col("data_sha256")).alias("outer")))
        packed = open_.select("id", "name").join(catalog.forks.select("id", "data_fork"), "id")
        files = read_files(packed.withColumnRenamed("data_fork", "content"), "any", source="id").where("error is null")
        names = open_.select(F.col("id").alias("source_id"), F.col("name").alias("source"))
        rows = files.join(names, "source_id").select(
            F.col("source_id").alias("parent_id"), "source", F.regexp_extract("name", r"([^/]*)$", 1).alias("name"), F.col("name").alias("path"), "data_fork", "rsrc_fork", "type_code", "creator_code",
            "finder_flags", F.col("created").alias("created_at"), F.col("modified").alias("modified_at"),
        )
        new = catalog.add_files(rows, ["parent_id", "path", "name", "data_sha256"])
        within = cut(new.select("id", "parent_id").join(open_.select(F.col("id").alias("parent_id"), "outer"), "parent_id").select("id", "outer"))
        count = within.count()
        if not count:
            return added
        added += count


def listed(rows: DataFrame, reader: str = "any") -> DataFrame:
    """What archives and images hold, without the bytes: source_id, ordinal, name, sizes, codes, error."""
    files = read_files(rows, reader)
    return files.select("source_id", "ordinal", "name", F.octet_length("data_fork").alias("data_size"), F.octet_length("rsrc_fork").alias("rsrc_size"), "type_code", "creator_code", "error")


def extract_selected(rows: DataFrame, chosen: DataFrame, reader: str = "any") -> DataFrame:
    """Of archives and images (source_id, name, content) only the chosen members (source_id, name).
    Sources of which nothing is chosen aren't opened."""
    wanted = rows.join(chosen.select("source_id").distinct(), "source_id", "left_semi")
    return read_files(wanted, reader).join(chosen.select("source_id", "name").distinct(), ["source_id", "name"], "left_semi")


def import_downloads(catalog: Catalog, downloads: DataFrame) -> DataFrame:
    """downloads: url, header (Content-Disposition), content. New URLs only; they are unwrapped,
    stored with their site as source, and recorded."""
    new = downloads.join(catalog.history.select("url"), "url", "left_anti").dropDuplicates(["url"])
    named = new.select("url", download_name(F.col("header"), F.col("url")).alias("name"), "content")
    files = unwrapped(named.select(F.col("url").alias("path"), "name", "content"))
    added = catalog.add_files(files.withColumn("source", site_of(F.col("path"))))
    record = named.join(added.select(F.col("path").alias("url"), F.col("id").alias("entry_id")), "url", "left")
    catalog.record_download(record.select("url", F.col("name").alias("filename"), F.date_trunc("second", F.current_timestamp()).alias("date"), "entry_id", site_of(F.col("url")).alias("source")))
    return added


def index_documents(entries: DataFrame, catalog_name: str, as_of: Column, days: int = 30) -> DataFrame:
    """What a search index holds of each entry: title, description, keywords, expiry."""
    kind = F.coalesce(kind_label(F.col("name"), F.col("type_code")), F.lit("File"))
    return entries.select(
        F.concat(F.lit(f"file:{catalog_name}/"), "id").alias("index_id"),
        F.col("name").alias("title"),
        F.concat_ws(" — ", kind, human_size(F.col("data_size") + F.col("rsrc_size")), "source").alias("description"),
        keyword_tokens(F.col("name"), F.col("type_code"), F.col("creator_code"), F.lit(catalog_name)).alias("keywords"),
        (as_of + F.expr(f"INTERVAL {int(days)} DAYS")).alias("expires"),
    )


def parse_index_id(index_id: Column) -> Column:
    """Catalog path and entry id of vault:<path> and file:<path>/<id>."""
    kind = F.regexp_extract(index_id, r"^(vault|file):", 1)
    path = F.when(kind == "vault", F.regexp_extract(index_id, r"^vault:(.*)$", 1)).when(kind == "file", F.regexp_extract(index_id, r"^file:(.*)/[^/]*$", 1))
    return F.struct(path.alias("path"), F.when(kind == "file", F.regexp_extract(index_id, r"([^/]*)$", 1)).alias("id"))


def store_index(documents: DataFrame, path: str) -> None:
    """Index documents as a Parquet table, one folder for each scope (vault or file, and the catalog); a scope written again is replaced."""
    scoped = documents.withColumn("scope", F.sha2(index_scope(F.col("index_id")), 256))
    spark = documents.sparkSession
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        scoped.write.mode("overwrite").partitionBy("scope").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)


def index_scope(index_id: Column) -> Column:
    """What is removed together: all documents of one catalog."""
    return F.when(index_id.startswith("vault:"), index_id).otherwise(F.regexp_extract(index_id, r"^(.*)/[^/]*$", 1))


def without_scope(documents: DataFrame, scope: str) -> DataFrame:
    """The index documents of all other catalogs."""
    return documents.where(~index_scope(F.col("index_id")).eqNullSafe(F.lit(scope)))


def store_thumbnails(catalog: Catalog, side: int = 128) -> int:
    """Thumbnails of the files that have none yet; how many were made."""
    missing = catalog.with_forks(catalog.entries.where(~F.col("is_dir"))).join(catalog.thumbnails.select("id"), "id", "left_anti")
    made = cut(thumbnails(missing, side))
    count = made.count()
    if count:
        catalog.set_thumbnails(made)
    return count


def store_conversions(catalog: Catalog, ids: DataFrame | None = None) -> DataFrame:
    """Converted files beside their originals: same parent, path and source. Names that are there already are left out."""
    rows = catalog.entries.where(~F.col("is_dir"))
    rows = rows.join(ids.select("id"), "id", "left_semi") if ids is not None else rows
    made = converted(catalog.with_forks(rows)).select("id", F.col("name").alias("new"), "content")
    beside = rows.join(made, "id").select(F.col("new").alias("name"), "path", "parent_id", "source", F.col("content").alias("data_fork"), F.lit(b"").alias("rsrc_fork"))
    old = catalog.entries.select("name", F.coalesce("parent_id", F.lit("")).alias("_p"))
    new = beside.withColumn("_p", F.coalesce("parent_id", F.lit(""))).join(old, ["name", "_p"], "left_anti").drop("_p")
    return catalog.add_files(new, ["path", "name", "data_sha256"])


def thumbnails(rows: DataFrame, side: int = 128) -> DataFrame:
    """id and PNG of entries with forks: MacPaint, icon or sound, the first that works; others have none."""
    marked = rows.select("id", "data_fork", "rsrc_fork", is_mac_paint(F.col("name"), F.col("type_code")).alias("paint"))

    def draw(batches):
        for b in batches:
            ids, pngs = [], []
            for i, data, rsrc, paint in zip(b["id"].to_pylist(), b["data_fork"], b["rsrc_fork"], b["paint"].to_pylist(), strict=True):
                data, rsrc = data.as_py() or b"", rsrc.as_py() or b""
                image = R.mac_paint(data) if paint else None
                image = image or R.best_icon(rsrc)
                if not image:
                    sounds = (R.sound_samples(R.resource_data(rsrc, r) or b"") for r in R.parse_fork(rsrc) if r.type_code == "snd ")
                    samples = next((s for s in sounds if s), None)
                    image = R.waveform(samples, side) if samples else None
                if image:
                    ids.append(i)
                    pngs.append(R.png(R.scaled(image, side)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(pngs, pa.binary())], ["id", "png"])

    return marked.mapInArrow(draw, "id string, png binary")


def converted(rows: DataFrame) -> DataFrame:
    """New name and bytes of what can be converted: text to UTF-8, MacPaint to PNG, sounds to WAV."""
    kinds = rows.select("id", "name", "data_fork", "rsrc_fork", is_mac_paint(F.col("name"), F.col("type_code")).alias("paint"), (F.col("type_code") == "snd ").alias("sound"), is_text(F.col("name"), F.col("type_code")).alias("text"))
    text = kinds.where("text and not paint").select("id", F.concat("name", F.lit(".txt")).alias("name"), F.encode(read_text(F.col("data_fork")), "utf-8").alias("content"))

    def convert(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                image = R.mac_paint(r["data_fork"] or b"") if r["paint"] else None
                if image:
                    out.append({"id": r["id"], "name": r["name"] + ".png", "content": R.png(image)})
                    continue
                for s in R.parse_fork(r["rsrc_fork"] or b"") if r["sound"] else []:
                    body = R.resource_data(r["rsrc_fork"], s) or b""
                    info, samples = (R.sound(body), R.sound_samples(body)) if s.type_code == "snd " else (None, None)
                    if samples:
                        from ..functions.codecs import wav

                        out.append({"id": r["id"], "name": r["name"] + ".wav", "content": wav(samples, info["rate"], info["bits"], info["channels"])})
                        break
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("id", pa.string()), ("name", pa.string()), ("content", pa.binary())]))

    return text.unionByName(kinds.where("paint or sound").select("id", "name", "data_fork", "rsrc_fork", "paint", "sound").mapInArrow(convert, "id string, name string, content binary"))
