"""Registered queries of the catalog engine, each with its SQL for DuckDB.

Operators on bytes are checked by encode-then-decode: a query builds containers, images or volumes
from table rows, reads them back, and its SQL selects the original columns.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import binary, classify, codecs, dates, encoders, lzhuf_lanes, resources, text
from .operators import listing
from .operators.catalog import entry_json, fork_facts, with_defaults
from .plans import export, ingest
from .sources import containers, disks, probe, volumes
from .sources.tables import gathered, read_files, read_image_info, read_partitions, read_resources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# A catalog made from `documents`, in Spark and in SQL

_ID = "CASE WHEN {0} < 10000 THEN lpad(CAST({0} AS {1}), 4, '0') ELSE CAST({0} AS {1}) END"


def _catalog_sql(kind: str, sha: str, size: str) -> str:
    number = lambda x: _ID.format(x, kind)
    return f"""
SELECT {number("doc_id")} AS id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE {number("(doc_id - doc_id % 10)")} END AS parent_id, doc_id % 10 = 0 AS is_dir,
  concat('doc', CAST(doc_id AS {kind}), CASE doc_id % 6 WHEN 0 THEN '.txt' WHEN 1 THEN '.SIT' WHEN 2 THEN '.img' WHEN 3 THEN '.tar.gz' WHEN 4 THEN '' ELSE '.Md' END) AS name,
  concat(source, '/', CAST(doc_id AS {kind})) AS path, CASE doc_id % 8 WHEN 0 THEN 'TEXT' WHEN 1 THEN 'PICT' WHEN 2 THEN 'APPL' WHEN 3 THEN NULL WHEN 4 THEN '' WHEN 5 THEN 'snd ' WHEN 6 THEN 'PNTG' ELSE 'CWWP' END AS type_code,
  CASE doc_id % 3 WHEN 0 THEN 'ttxt' WHEN 1 THEN 'BOBO' ELSE NULL END AS creator_code, CAST(doc_id % 65536 AS INT) AS finder_flags, CAST({size} AS BIGINT) AS data_size, CAST(CASE WHEN doc_id % 4 = 0 THEN n_chars ELSE 0 END AS BIGINT) AS rsrc_size,
  {sha} AS data_sha256, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS source
FROM documents"""


E = f"WITH e AS ({_catalog_sql('VARCHAR', 'sha256(text)', 'octet_length(encode(text))')})\n"


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _catalog_sql("STRING", "sha2(text, 256)", "octet_length(text)").replace("FROM documents", "FROM {documents}")
    return spark.sql(sql, documents=table(spark, sf_dir, "documents"))


@query(E + "SELECT id, name, CAST(row_number() OVER (ORDER BY is_dir DESC, name, id) AS BIGINT) AS place FROM e WHERE parent_id = '0010'")
def list_children(spark, sf):
    rows = listing.children(catalog(spark, sf), "0010").select("id", "name", "is_dir")
    return rows.withColumn("place", F.row_number().over(listing.Window.orderBy(F.desc("is_dir"), "name", "id")).cast("long")).drop("is_dir")


@query(E + "SELECT count(*) AS n FROM e")
def entry_count(spark, sf):
    return catalog(spark, sf).agg(F.count("*").alias("n"))


@query(E + "SELECT id, name, path, data_size FROM e WHERE id = '0042'")
def entry_lookup(spark, sf):
    return listing.entry(catalog(spark, sf), "0042").select("id", "name", "path", "data_size")


@query(E + "SELECT id, name FROM e WHERE lower(name) LIKE '%doc1_.t%' OR lower(path) LIKE '%doc1_.t%' OR lower(source) LIKE '%doc1_.t%' OR lower(type_code) LIKE '%doc1_.t%' OR lower(creator_code) LIKE '%doc1_.t%'")
def search_like(spark, sf):
    return listing.search(catalog(spark, sf), " DOC1_.T ").select("id", "name")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%a%' OR p_brand ILIKE '%a%'")
def search_parts(spark, sf):
    return listing.search(table(spark, sf, "part").withColumn("id", F.col("p_partkey")).withColumn("name", F.col("p_name")), "A", ("p_name", "p_brand")).select("p_partkey", "p_name")


@query(E + "SELECT coalesce(source, 'Vault root') AS source, list(name ORDER BY name) AS names FROM e WHERE contains(lower(name), 'doc7') OR contains(lower(path), 'doc7') GROUP BY 1")
def search_grouped(spark, sf):
    return listing.by_source(listing.search(catalog(spark, sf), "doc7", ("name", "path"), literal=True))


@query(E + "SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, count(*) AS files FROM e GROUP BY 1")
def grouped_by_folder(spark, sf):
    return listing.by_folder(catalog(spark, sf).withColumn("name", F.col("path")))


@query(E + """
SELECT id, 'plain' AS kind FROM e WHERE contains(lower(type_code), 'p') AND contains(lower(creator_code), 'tt') AND (rsrc_size > 0) = false AND data_size >= 500 AND data_size <= 50000
UNION ALL SELECT id, 'forked' FROM e WHERE contains(lower(type_code), 'ex') AND (rsrc_size > 0) = true AND data_size <= 20000
UNION ALL SELECT id, 'large' FROM e WHERE data_size >= 5000""")
def conjunctive_filter(spark, sf):
    e = catalog(spark, sf)
    kinds = {"plain": listing.filtered(e, "P", "tt", False, 500, 50_000), "forked": listing.filtered(e, "eX", has_rsrc=True, max_size=20_000), "large": listing.filtered(e, min_size=5000)}
    parts = [rows.select("id", F.lit(kind).alias("kind")) for kind, rows in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(E + "SELECT count(*) FILTER (NOT is_dir) AS files, count(*) FILTER (is_dir) AS dirs, count(*) FILTER (parent_id IS NULL) AS roots, count(*) FILTER (rsrc_size > 0) AS with_rsrc, CAST(coalesce(sum(data_size), 0) AS BIGINT) AS data_bytes, CAST(coalesce(sum(rsrc_size) FILTER (rsrc_size > 0), 0) AS BIGINT) AS rsrc_bytes FROM e")
def catalog_summary(spark, sf):
    return listing.summary(catalog(spark, sf))


@query(E + "SELECT type_code, count(*) AS n FROM e WHERE type_code IS NOT NULL AND type_code <> '' GROUP BY 1 ORDER BY n DESC, type_code LIMIT 10")
def type_histogram(spark, sf):
    return listing.type_histogram(catalog(spark, sf))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def event_histogram(spark, sf):
    return listing.type_histogram(table(spark, sf, "events"), column="event_type")


@query(E + "SELECT id, name FROM e WHERE parent_id IS NULL ORDER BY is_dir DESC, name, id LIMIT 25")
def root_names_top25(spark, sf):
    return listing.first_roots(catalog(spark, sf)).select("id", "name")


@query(E + "SELECT id, name FROM e WHERE EXISTS (SELECT 1 FROM e c WHERE c.parent_id = e.id)")
def has_children(spark, sf):
    return listing.with_children(catalog(spark, sf)).select("id", "name")


@query(E + ", p AS (SELECT id, name AS path, 0 AS depth FROM e WHERE parent_id IS NULL), q AS (SELECT e.id, p.path || '/' || e.name AS path, 1 AS depth FROM e JOIN p ON e.parent_id = p.id) SELECT * FROM p UNION ALL SELECT * FROM q")
def subtree_paths(spark, sf):
    return listing.paths(catalog(spark, sf))


_REGIONS = "SELECT CAST(r_regionkey AS VARCHAR) AS id, r_name AS path, 0 AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, r_name || '/' || n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(_REGIONS)
def region_paths(spark, sf):
    regions = table(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"))
    nations = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_regionkey").cast("string").alias("parent_id"), F.col("n_name").alias("name"))
    return listing.paths(regions.unionByName(nations))


@query(E + "SELECT id, name FROM e WHERE coalesce(parent_id, id) NOT IN ('0010', '0030') AND id <> '0022'")
def delete_cascade(spark, sf):
    entries = catalog(spark, sf)
    gone = listing.subtree(entries, spark.createDataFrame([("0010",), ("0030",), ("0022",)], "id string"))
    return entries.join(gone, "id", "left_anti").select("id", "name")


def chain(spark, sf) -> DataFrame:
    """Documents in chains: each is the parent of the next, up to 150 levels deep."""
    at = F.col("doc_id")
    return table(spark, sf, "documents").select(at.cast("string").alias("id"), F.when(at % 150 > 0, at - 1).cast("string").alias("parent_id"), F.concat(F.lit("d"), at % 7).alias("name"))


_CHAIN = """
WITH RECURSIVE p AS (
  SELECT doc_id, 'd' || doc_id % 7 AS path, 0 AS depth FROM documents WHERE doc_id % 150 = 0
  UNION ALL SELECT d.doc_id, p.path || '/d' || d.doc_id % 7, p.depth + 1 FROM p JOIN documents d ON d.doc_id = p.doc_id + 1 WHERE d.doc_id % 150 > 0
)"""


@query(_CHAIN + "SELECT CAST(doc_id AS VARCHAR) AS id, path, depth FROM p")
def deep_paths(spark, sf):
    return listing.paths(chain(spark, sf))


@query("SELECT doc_id FROM documents WHERE doc_id % 150 < 40 OR doc_id // 150 % 2 = 1")
def deep_delete(spark, sf):
    """From level 40 on, every other chain goes."""
    entries = chain(spark, sf)
    number = F.col("id").cast("long")
    gone = listing.subtree(entries, entries.where((number % 150 == 40) & (F.floor(number / 150) % 2 == 0)).select("id"))
    return entries.join(gone, "id", "left_anti").select(number.alias("doc_id"))


@query(E + "SELECT parent_id, count(*) AS children, list(name ORDER BY name) AS names FROM e WHERE parent_id IS NOT NULL GROUP BY 1")
def tree_children(spark, sf):
    return listing.tree(catalog(spark, sf))


@query("SELECT user_id, max(ts) AS last_opened FROM events GROUP BY 1 HAVING max(ts) > TIMESTAMP '2024-06-01' - INTERVAL 365 DAYS")
def recents_ttl(spark, sf):
    known = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last_opened")).withColumn("path", F.col("user_id").cast("string"))
    return listing.recents(known, F.lit("2024-06-01").cast("timestamp_ntz")).drop("path")


@query("SELECT role AS name, conv_id * 1000 + turn AS ordinal, conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS n FROM conversations) WHERE n = 1")
def first_occurrence(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("role").alias("name"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"), "conv_id", "turn")
    return listing.first_of_each(rows)


def _zips(spark, sf) -> DataFrame:
    """Of each document an archive of its text, its language and its source."""

    def build(r):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in (("text.txt", r["data"]), ("lang", r["lang"].encode()), ("deep/source", r["source"].encode())):
                z.writestr(name, body)
        return [{"source_id": str(r["doc_id"]), "name": f"{r['doc_id']}.zip", "content": out.getvalue()}]

    return mapped(table(spark, sf, "documents").select("doc_id", "lang", "source", F.encode("text", "utf-8").alias("data")), "source_id string, name string, content binary", build)


@query("SELECT doc_id, 'text.txt' AS name, sha256(text) AS sha256 FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND text <> '' UNION ALL SELECT doc_id, 'deep/source', sha256(source) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def selected_members(spark, sf):
    """Only the chosen members of labelled documents' archives."""
    labels = table(spark, sf, "labels")
    chosen = labels.select(F.col("doc_id").cast("string").alias("source_id"), F.lit("text.txt").alias("name"))
    chosen = chosen.unionByName(labels.where("toxic = 1").select(F.col("doc_id").cast("string").alias("source_id"), F.lit("deep/source").alias("name")))
    files = ingest.extract_selected(_zips(spark, sf), chosen, "archive").where("octet_length(data_fork) > 0")
    return files.select(F.col("source_id").cast("long").alias("doc_id"), "name", F.sha2("data_fork", 256).alias("sha256"))


@query("SELECT doc_id, 'text.txt' AS name, octet_length(encode(text)) AS data_size FROM documents UNION ALL SELECT doc_id, 'lang', octet_length(encode(lang)) FROM documents UNION ALL SELECT doc_id, 'deep/source', octet_length(encode(source)) FROM documents")
def member_lists(spark, sf):
    return ingest.listed(_zips(spark, sf), "archive").select(F.col("source_id").cast("long").alias("doc_id"), "name", "data_size")


@query("SELECT 'f/' || doc_id AS name, CASE WHEN doc_id % 2 = 0 THEN 'near' WHEN doc_id % 3 = 0 THEN 'mac' WHEN doc_id % 5 = 0 THEN 'bare' END AS companion FROM documents")
def pair_forks(spark, sf):
    ids = table(spark, sf, "documents").select("doc_id")
    files = ids.select(F.concat(F.lit("f/"), "doc_id").alias("name"), F.lit("data").alias("data_fork"))
    for step, prefix, mark in ((2, "f/._", "near"), (3, "__MACOSX/f/._", "mac"), (5, "__MACOSX/._", "bare")):
        files = files.unionByName(ids.where(F.col("doc_id") % step == 0).select(F.concat(F.lit(prefix), "doc_id").alias("name"), F.lit(mark).alias("data_fork")))
    return listing.pair_forks(files).select("name", "companion")


@query(E + "SELECT data_sha256, count(*) AS copies, min(id) AS first_id FROM e GROUP BY 1 HAVING count(*) > 1")
def duplicate_forks(spark, sf):
    return listing.duplicates(catalog(spark, sf))


@query(E + "SELECT path, CASE WHEN in_a IS NULL THEN 'added' WHEN in_b IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT path, true AS in_a, data_sha256 AS a FROM e WHERE finder_flags % 5 <> 0) FULL JOIN (SELECT path, true AS in_b, CASE WHEN finder_flags % 11 = 0 THEN 'x' ELSE data_sha256 END AS b FROM e WHERE finder_flags % 3 <> 0) USING (path) WHERE in_a IS NULL OR in_b IS NULL OR a <> b")
def catalog_difference(spark, sf):
    e = catalog(spark, sf)
    right = e.where("finder_flags % 3 <> 0").withColumn("data_sha256", F.when(F.col("finder_flags") % 11 == 0, "x").otherwise(F.col("data_sha256")))
    return listing.difference(e.where("finder_flags % 5 <> 0"), right)


@query(E + "SELECT id, name FROM e WHERE finder_flags % 2 = 0 UNION ALL SELECT id, name FROM e WHERE finder_flags % 2 = 1 AND data_sha256 NOT IN (SELECT data_sha256 FROM e WHERE finder_flags % 2 = 0)")
def catalog_merge(spark, sf):
    e = catalog(spark, sf)
    return listing.merged(e.where("finder_flags % 2 = 0"), e.where("finder_flags % 2 = 1")).select("id", "name")


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE s_name END AS v FROM supplier UNION ALL SELECT -1, 'new'")
def upsert_rows(spark, sf):
    old = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    new = old.where("k % 2 = 0").select("k").unionByName(spark.createDataFrame([(-1,)], "k long")).withColumn("v", F.lit("new"))
    return listing.upsert(old, new, "k")


@query("SELECT s_suppkey AS k, s_name AS v FROM supplier UNION ALL SELECT -1, 'seed'")
def seed_rows(spark, sf):
    old = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    return listing.seed(old, spark.createDataFrame([(-1, "seed"), (1, "seed")], "k long, v string"), "k")


@query(E + ", s AS (SELECT CAST(floor(CAST(sum(data_size) + sum(rsrc_size) AS DOUBLE) * CAST(1.3 AS DOUBLE)) AS BIGINT) + 32768 AS needed FROM e) SELECT needed, coalesce((SELECT min(x) FROM (VALUES (409600), (819200), (1474560), (5242880), (10485760), (20971520), (52428800), (104857600), (524288000)) v(x) WHERE x >= needed), greatest(needed, 819200)) AS image_size FROM s")
def image_size_rule(spark, sf):
    return listing.image_size(catalog(spark, sf))


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), '' ORDER BY o_orderkey) AS content FROM orders GROUP BY 1")
def assemble_extents(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").cast("string").alias("piece"))
    return listing.assembled(rows, ["o_custkey"], "o_orderkey", "piece")


@query("SELECT source_id, ordinal, source_id || '/' || (ordinal // 2 * 2) || '/x' || ordinal AS path FROM (SELECT source AS source_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS ordinal FROM documents) WHERE ordinal % 2 = 1")
def hls_listing(spark, sf):
    n = F.row_number().over(listing.Window.partitionBy("source").orderBy("doc_id")).cast("long") - 1
    rows = table(spark, sf, "documents").select(F.col("source").alias("source_id"), n.alias("ordinal"))
    line = F.when(F.col("ordinal") % 2 == 0, F.concat("source_id", F.lit("/"), "ordinal", F.lit(":"))).otherwise(F.concat(F.lit("x"), "ordinal"))
    return listing.hls_paths(rows.withColumn("line", line))


@query("""
WITH b AS (SELECT doc_id, octet_length(encode(text)) AS n, hex(encode(text)) AS h FROM documents WHERE text <> ''), p AS (SELECT doc_id, greatest(1, n // 16) AS step, n, h FROM b),
v AS (SELECT doc_id, step, n, unnest(range(0, n)) AS i, h FROM p), w AS (SELECT doc_id, i // step AS bucket, CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS INT) AS b FROM v)
SELECT doc_id, bucket, min(b) AS low, max(b) AS high FROM w WHERE bucket < 16 GROUP BY 1, 2""")
def envelope_minmax(spark, sf):
    """Least and largest byte of each sixteenth of a text, as of 8-bit samples."""
    rows = table(spark, sf, "documents").where("text <> ''").select("doc_id", F.encode("text", "utf-8").alias("data"))
    ends = lambda r: [{"doc_id": r["doc_id"], "bucket": i, "low": low, "high": high} for i, (low, high) in enumerate(resources.envelope(r["data"], 16))]
    return mapped(rows, "doc_id long, bucket long, low int, high int", ends)


# Rows and labels

@query(E + "SELECT id, CASE WHEN type_code IS NULL THEN NULL WHEN creator_code IS NULL THEN type_code ELSE type_code || '/' || creator_code END AS display, rsrc_size > 0 AS has_rsrc FROM e")
def type_creator_display(spark, sf):
    return catalog(spark, sf).select("id", classify.type_creator(F.col("type_code"), F.col("creator_code")).alias("display"), (F.col("rsrc_size") > 0).alias("has_rsrc"))


@query(E + "SELECT id, 'MacRoman' AS encoding, 0 AS label_color, path, finder_flags FROM e")
def row_defaults(spark, sf):
    return with_defaults(catalog(spark, sf)).select("id", "encoding", "label_color", "path", "finder_flags")


@query(E + """SELECT id, '{"data_size":' || data_size || ',"id":"' || id || '","name":"' || name || '"}' AS json FROM e""")
def entry_json_rows(spark, sf):
    return entry_json(catalog(spark, sf).select("id", "name", "data_size"))


@query("SELECT doc_id, sha256(text) AS data_sha256, CAST(octet_length(encode(text)) AS BIGINT) AS data_size, CAST(0 AS BIGINT) AS rsrc_size, CAST(NULL AS VARCHAR) AS rsrc_sha256 FROM documents")
def fork_checksums(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.encode("text", "utf-8").alias("data_fork"), F.lit(b"").alias("rsrc_fork"))
    return fork_facts(rows).select("doc_id", "data_sha256", "data_size", "rsrc_size", "rsrc_sha256")


def _case(key: str, values: dict[str, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


_EXT = "lower(regexp_extract(name, '[^.]\\.([^.]*)$', 1))"
_in = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
_TEXT = f"(coalesce(type_code IN {_in(classify.TEXT_TYPES)}, false) OR {_EXT} IN {_in(classify.TEXT_EXTENSIONS)} OR lower(name) IN {_in(classify.TEXT_NAMES)})"
_LEGACY = f"(coalesce(type_code IN {_in(classify.LEGACY_TYPES)}, false) OR {_EXT} IN {_in(classify.LEGACY_EXTENSIONS)})"
_PAINT = f"(coalesce(type_code = 'PNTG', false) OR {_EXT} IN ('pntg', 'mac'))"
_FONT = f"(coalesce(type_code IN {_in(classify.FONT_TYPES)}, false) OR {_EXT} IN {_in(classify.FONT_EXTENSIONS)})"
_PICT = f"(coalesce(type_code = 'PICT', false) OR {_EXT} IN ('pict', 'pct'))"
_CLARIS = "(coalesce(type_code IN ('CWWP', 'CWSS', 'CWDB', 'CWGR', 'CWPR', 'CWK '), false) OR coalesce(creator_code = 'BOBO', false))"
_ARCHIVE = f"({_EXT} IN {_in(classify.UNPACKED)} OR regexp_matches(lower(name), '\\.tar\\.(gz|bz2|xz|lzma|zst|z)$'))"


@query(E + f"SELECT id, {_EXT} AS extension, coalesce({_case('type_code', classify.KIND_BY_TYPE)}, {_case(_EXT, classify.KIND_BY_EXTENSION)}) AS kind, {_TEXT} AS is_text, {_EXT} IN {_in(classify.PREVIEWED)} OR {_TEXT} AS previewed FROM e")
def kind_label(spark, sf):
    n, t = F.col("name"), F.col("type_code")
    return catalog(spark, sf).select("id", classify.extension(n).alias("extension"), classify.kind_label(n, t).alias("kind"), classify.is_text(n, t).alias("is_text"), classify.is_previewed(n, t).alias("previewed"))


_SUFFIX = " ".join(f"WHEN lower(name) LIKE '%{s}' THEN '{v}'" for s, v in classify.ARCHIVE_SUFFIXES)


@query(E + f"SELECT id, CASE {_SUFFIX} ELSE coalesce({_case(_EXT, classify.ARCHIVES)}, 'compressed archive') END AS label, {_ARCHIVE} AS archive, {_EXT} IN {_in(classify.DISK_IMAGES)} AS image, {_ARCHIVE} OR {_EXT} IN {_in(classify.DISK_IMAGES)} OR {_EXT} IN {_in(classify.SMALL_CONTAINERS)} AS extractable, {_EXT} IN {_in(classify.MOUNTED)} AS mounted FROM e")
def archive_label(spark, sf):
    n = F.col("name")
    return catalog(spark, sf).select("id", classify.archive_label(n).alias("label"), classify.is_archive(n).alias("archive"), classify.is_disk_image(n).alias("image"), classify.is_extractable(n).alias("extractable"), classify.is_mounted(n).alias("mounted"))


@query(E + f"SELECT id, {_LEGACY} AS legacy, {_CLARIS} AS claris, {_FONT} AS font, {_PICT} AS pict, {_PAINT} AS paint, CASE WHEN {_PAINT} THEN 'PNG' WHEN type_code = 'snd ' THEN 'WAV' WHEN {_CLARIS} OR {_LEGACY} THEN 'Markdown' WHEN {_TEXT} THEN 'UTF-8 text' END AS target FROM e")
def document_kinds(spark, sf):
    n, t, c = F.col("name"), F.col("type_code"), F.col("creator_code")
    return catalog(spark, sf).select("id", classify.is_legacy_document(n, t).alias("legacy"), classify.is_claris_works(t, c).alias("claris"), classify.is_font(n, t).alias("font"), classify.is_pict(n, t).alias("pict"), classify.is_mac_paint(n, t).alias("paint"), classify.convert_target(n, t, c).alias("target"))


@query(E + f"SELECT id, CASE WHEN {_FONT} THEN 'font' WHEN {_LEGACY} THEN 'document' WHEN {_TEXT} THEN 'text' WHEN {_PAINT} THEN 'macpaint' WHEN {_PICT} THEN 'pict' WHEN finder_flags % 9 = 0 THEN 'icon' WHEN rsrc_size > 0 THEN 'resources' WHEN data_size > 0 THEN 'hex' ELSE 'none' END AS preview FROM e")
def preview_kind(spark, sf):
    return catalog(spark, sf).select("id", classify.preview_kind(F.col("name"), F.col("type_code"), F.col("data_size"), F.col("finder_flags") % 9 == 0, F.col("rsrc_size")).alias("preview"))


@query(E + "SELECT id, CASE WHEN data_size < 1000 THEN data_size || ' bytes' WHEN data_size < 1000000 THEN CAST(round(data_size / CAST(1000 AS DOUBLE), 0) AS BIGINT) || ' KB' ELSE printf('%.1f MB', data_size / CAST(1000000 AS DOUBLE)) END AS size, data_size + rsrc_size AS total, '0x' || upper(lpad(to_hex(finder_flags), 4, '0')) AS flags FROM e")
def get_info(spark, sf):
    return catalog(spark, sf).select("id", text.human_size(F.col("data_size")).alias("size"), (F.col("data_size") + F.col("rsrc_size")).alias("total"), classify.flags_text(F.col("finder_flags")).alias("flags"))


@query(E + f"SELECT 'file:C/' || id AS index_id, name AS title, list_concat(list_filter(regexp_split_to_array(name, '[^A-Za-z0-9]+'), lambda w: w <> ''), list_filter([type_code, creator_code, 'C'], lambda x: x IS NOT NULL), ['retro', 'vintage']) AS keywords, TIMESTAMP '2024-01-31' AS expires FROM e")
def index_documents(spark, sf):
    return ingest.index_documents(catalog(spark, sf), "C", F.lit("2024-01-01").cast("timestamp_ntz")).drop("description")


@query("SELECT doc_id, list_concat(list_filter(regexp_split_to_array(source, '[^A-Za-z0-9]+'), lambda w: w <> ''), [lang], ['retro', 'vintage']) AS tokens FROM documents")
def keyword_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.keyword_tokens(F.col("source"), F.col("lang")).alias("tokens"))


@query("SELECT page_id, regexp_extract(url, '^[^:]*://(.*)$', 1) AS path, CAST(page_id AS VARCHAR) AS id FROM pages")
def index_ids(spark, sf):
    key = F.concat(F.lit("file:"), F.regexp_extract("url", r"^[^:]*://(.*)$", 1), F.lit("/"), "page_id")
    return table(spark, sf, "pages").select("page_id", ingest.parse_index_id(key).alias("x")).select("page_id", "x.path", "x.id")


# Text and web

@query("SELECT doc_id, text AS plain FROM documents")
def normalize_newlines(spark, sf):
    old = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.replace("text", F.lit("\n"), F.lit("\r")))
    return table(spark, sf, "documents").select("doc_id", text.normalize_newlines(old).alias("plain"))


@query("SELECT doc_id, text AS plain, 'UTF-8' AS charset FROM documents")
def read_text(spark, sf):
    data = F.encode("text", "utf-8")
    return table(spark, sf, "documents").select("doc_id", text.read_text(data).alias("plain"), text.charset(data).alias("charset"))


#: What stands for some ASCII letters where bytes over 0x7F are wanted: MacRoman's code and character of each.
_HIGH_MAC = str.maketrans({"a": "ä", "e": "é", "i": "í", "o": "ö", "u": "ü", "n": "ñ", "c": "ç", "d": "†", "q": "“", "x": "∞"})
_CYRILLIC = "".join(map(chr, range(0x430, 0x430 + 26)))
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_ASCII = "regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g')"


def _high(spark, sf, codec: str, shown: str) -> DataFrame:
    """doc_id, data: the text's ASCII, each small letter written as the codec's byte for what is shown for it."""
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "?")
    return table(spark, sf, "documents").select("doc_id", F.encode(F.translate(plain, _LETTERS, shown.encode(codec).decode("latin-1")), "ISO-8859-1").alias("data"))


@query(f"SELECT doc_id, translate({_ASCII}, '{_LETTERS}', '{_LETTERS.translate(_HIGH_MAC)}') AS plain FROM documents")
def mac_roman_text(spark, sf):
    """Half of the vowels and some consonants are bytes over 0x7F."""
    return _high(spark, sf, "mac_roman", _LETTERS.translate(_HIGH_MAC)).select("doc_id", binary.col_mac_roman(F.col("data")).alias("plain"))


@query(f"SELECT doc_id, translate({_ASCII}, '{_LETTERS}', '{_CYRILLIC}') AS plain FROM documents")
def charset_convert(spark, sf):
    return _high(spark, sf, "cp1251", _CYRILLIC).select("doc_id", text.decode_as(F.col("data"), "MacCyrillic").alias("plain"))


@query(f"SELECT doc_id, translate({_ASCII}, '{_LETTERS}', '{_LETTERS.translate(_HIGH_MAC)}') AS plain, CASE WHEN regexp_matches(text, '[aeioundcqx]') THEN 'MacRoman' ELSE 'UTF-8' END AS charset FROM documents")
def read_legacy_text(spark, sf):
    """Bytes that aren't UTF-8 are taken as MacRoman."""
    return _high(spark, sf, "mac_roman", _LETTERS.translate(_HIGH_MAC)).select("doc_id", text.read_text(F.col("data")).alias("plain"), text.charset(F.col("data")).alias("charset"))


_DUMP = """
WITH d AS (SELECT doc_id, octet_length(encode(text)) AS n, hex(encode(text)) AS h FROM documents),
r AS (SELECT doc_id, n, h, unnest(range(0, n, 16)) AS o FROM d),
x AS (SELECT doc_id, n, o, h[2 * o + 1 : least(2 * (o + 16), 2 * n)] AS p FROM r),
y AS (SELECT doc_id, n, o, upper(printf('%08x', o)) || '  ' || rpad(regexp_replace(p[1:16], '(..)', '\\1 ', 'g'), 24, ' ') || ' ' || rpad(regexp_replace(p[17:32], '(..)', '\\1 ', 'g'), 24, ' ') || '|'
  || list_aggregate(list_transform(range(0, len(p) // 2), lambda i: CASE WHEN CAST('0x' || p[2 * i + 1 : 2 * i + 2] AS INT) BETWEEN 32 AND 126 THEN chr(CAST('0x' || p[2 * i + 1 : 2 * i + 2] AS INT)) ELSE '.' END), 'string_agg', '') || '|' AS line FROM x),
z AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY o) AS dump FROM y GROUP BY 1)
SELECT d.doc_id, coalesce(z.dump, '') AS dump FROM d LEFT JOIN z USING (doc_id)"""


@query(_DUMP)
def hex_dump(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.hex_dump(F.encode("text", "utf-8"), None).alias("dump"))


@query(_DUMP.replace("o FROM d),", "o FROM (SELECT doc_id, least(n, 64) AS n, h[1:128] AS h FROM d)),").replace("SELECT d.doc_id, coalesce(z.dump, '') AS dump", "SELECT d.doc_id, coalesce(z.dump, '') || CASE WHEN n > 64 THEN chr(10) || '... (' || (n - 64) || ' more bytes)' ELSE '' END AS dump"))
def hex_preview(spark, sf):
    """The first four rows, and what is left out."""
    return table(spark, sf, "documents").select("doc_id", text.hex_dump(F.encode("text", "utf-8"), 64).alias("dump"))


def _runs_sql(least: int, tabs: str) -> str:
    high = "".join(sorted(set(_LETTERS.translate(_HIGH_MAC)) - set(_LETTERS)))
    plain = f"translate(translate({_ASCII}, '?', chr(1)), '{_LETTERS}', '{_LETTERS.translate(_HIGH_MAC)}')"
    return f"""
WITH r AS (SELECT doc_id, regexp_extract_all({plain}, '[\\x20-\\x7E\\x0D\\x0A{tabs}{high}]{{{least},}}') AS runs FROM documents)
SELECT doc_id, list_transform(list_filter(runs, lambda r: len(regexp_replace(r, '[^A-Za-z ]', '', 'g')) > len(r) * CAST(0.5 AS DOUBLE)), lambda r: trim(r, ' ')) AS runs FROM r"""


def _run_bytes(spark, sf) -> DataFrame:
    rows = _high(spark, sf, "mac_roman", _LETTERS.translate(_HIGH_MAC))
    return rows.select("doc_id", F.encode(F.translate(F.decode("data", "ISO-8859-1"), "?", "\x01"), "ISO-8859-1").alias("data"))


@query(_runs_sql(12, ""))
def text_runs(spark, sf):
    return _run_bytes(spark, sf).select("doc_id", text.text_runs(F.col("data"), 12).alias("runs"))


@query(_runs_sql(8, "\\x09"))
def document_runs(spark, sf):
    """Tabs are part of a run, as in word processors' files."""
    return _run_bytes(spark, sf).select("doc_id", text.text_runs(F.col("data"), 8, tabs=True).alias("runs"))


def _markdown_sql() -> str:
    out = "html"
    for pattern, replacement in text.MARKDOWN:
        out = f"regexp_replace({out}, '{pattern}', '{replacement.replace('{1}', chr(92) + '1')}', 'g')".replace("\n", "' || chr(10) || '")
    for entity, plain in text.ENTITIES:
        out = f"replace({out}, '{entity}', '{plain.replace(chr(39), chr(39) * 2)}')"
    newlines = r"\n{3,}"
    return f"SELECT page_id, regexp_replace(regexp_replace({out}, '{newlines}', chr(10) || chr(10), 'g'), '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') AS markdown FROM pages"


@query(_markdown_sql())
def html_to_markdown(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.html_to_markdown(F.col("html")).alias("markdown"))


@query("SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS plain, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, translate(url, ':/', '__') AS safe FROM pages")
def strip_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.strip_tags(F.col("html")).alias("plain"), text.html_escape(F.col("html")).alias("escaped"), text.safe_name(F.col("url")).alias("safe"))


_CLEAN = "nullif(trim(regexp_replace(regexp_extract(html, '(?is)<{0}[^>]*>(.*?)</{0}>', 1), '<[^>]+>', '', 'g')), '')"
_LEAF = "nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '://[^/]+/(?:.*/)?([^/]+)$', 1), '')"


@query(f"SELECT page_id, coalesce({_CLEAN.format('h1')}, {_CLEAN.format('title')}, {_LEAF}) AS title, lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS site, coalesce({_LEAF}, 'download') AS filename FROM pages")
def page_titles(spark, sf):
    url, html = F.col("url"), F.col("html")
    return table(spark, sf, "pages").select("page_id", text.page_title(html, url).alias("title"), text.site_of(url).alias("site"), text.download_name(F.lit(None).cast("string"), url).alias("filename"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '(?i)href=\"([^\"]+)\"', 1)) AS href FROM pages")
def page_hrefs(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(text.page_hrefs(F.col("html"))).alias("href"))


@query("SELECT page_id, list_filter(regexp_extract_all(html, '(?i)href=\"([^\"]+)\"', 1), lambda h: regexp_matches(h, '(?i)\\.(sit|sitx|sea|hqx|bin|img|dsk|zip|iso|toast|dmg)$')) AS links, list_filter(regexp_extract_all(html, '(?i)href=\"([^\"]+)\"', 1), lambda h: contains(lower(h), 'download')) AS others FROM pages")
def download_links(spark, sf):
    html = F.col("html")
    return table(spark, sf, "pages").select("page_id", text.download_links(html).alias("links"), text.download_links(html, True).alias("others"))


@query()
def resolved_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.resolved(text.page_hrefs(F.col("html")), F.col("url")).alias("links"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a b' || event_id || '.sit' WHEN 1 THEN 'x' || event_id || '.hqx' WHEN 2 THEN 'y' || event_id ELSE 'leaf' || event_id || '.bin' END AS filename FROM events")
def disposition_names(spark, sf):
    n = F.col("event_id").cast("string")
    header = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("attachment; filename=\"no\"; filename*=UTF-8''a%20b"), n, F.lit(".sit"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit('attachment; filename="x'), n, F.lit('.hqx"'))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("inline; filename=y"), n))
    return table(spark, sf, "events").select("event_id", text.download_name(header, F.concat(F.lit("http://h/a/leaf"), n, F.lit(".bin?x=1"))).alias("filename"))


@query("SELECT n_nationkey, map(['FontName', 'Weight'], [n_name, 'Bold ' || n_nationkey]) AS fields FROM nation")
def afm_fields(spark, sf):
    lines = F.concat(F.lit("StartFontMetrics\nFontName first\nFontName "), "n_name", F.lit("\nWeight Bold "), "n_nationkey")
    return table(spark, sf, "nation").select("n_nationkey", text.afm_fields(lines).alias("fields"))


# Dates and numbers

@query("SELECT o_orderkey, o_orderdate AS round_trip, CAST(epoch(o_orderdate) AS BIGINT) + 2082844800 AS mac_seconds, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM orders")
def mac_epoch(spark, sf):
    when = F.col("o_orderdate").cast("timestamp")
    seconds = dates.mac_seconds(when)
    return table(spark, sf, "orders").select("o_orderkey", dates.mac_timestamp(seconds).cast("timestamp_ntz").alias("round_trip"), seconds.alias("mac_seconds"), dates.iso(when).alias("iso"))


@query("SELECT o_orderkey, o_orderdate AS y2k, date_trunc('minute', o_orderdate) AS prodos, o_orderdate AS from_iso FROM orders")
def prodos_dates(spark, sf):
    when = F.col("o_orderdate").cast("timestamp")
    packed = F.pmod(F.year(when), F.lit(100)) * 512 + F.month(when) * 32 + F.dayofmonth(when)
    return table(spark, sf, "orders").select(
        "o_orderkey", dates.y2k_timestamp(F.unix_timestamp(when) - dates.Y2K).cast("timestamp_ntz").alias("y2k"),
        dates.prodos_timestamp(packed, F.hour(when) * 256 + F.minute(when), 0x1F, 0x3F).cast("timestamp_ntz").alias("prodos"), dates.from_iso(dates.iso(when)).cast("timestamp_ntz").alias("from_iso"),
    )


@query("SELECT l_orderkey, l_linenumber, CAST(l_partkey AS BIGINT) AS big, CAST(l_partkey AS BIGINT) AS little, CAST((l_partkey + 127) // 128 * 128 AS BIGINT) AS padded FROM lineitem")
def fixed_width_numbers(spark, sf):
    data = F.unhex(F.lpad(F.hex("l_partkey"), 8, "0"))
    swapped = F.unhex(F.concat(*[F.substring(F.lpad(F.hex("l_partkey"), 8, "0"), 7 - 2 * i, 2) for i in range(4)]))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", binary.col_be(data, 0, 4).alias("big"), binary.col_le(swapped, 0, 4).alias("little"), binary.col_padded_size(F.col("l_partkey")).alias("padded"))


# Bytes: encode, then decode

def mapped(df: DataFrame, schema: str, fn) -> DataFrame:
    """fn makes a list of dicts of each row."""
    return _mapped(df, schema, lambda rows: (x for r in rows for x in fn(r)))


def mapped_many(df: DataFrame, schema: str, fn, weight) -> DataFrame:
    """fn makes a list of dicts of as many rows as lzhuf_lanes takes together."""
    return _mapped(df, schema, lambda rows: (x for held in lzhuf_lanes.batches(rows, weight) for x in fn(held)))


def _mapped(df: DataFrame, schema: str, fn) -> DataFrame:
    def task(batches):
        yield from gathered(fn(r for b in batches for at in range(0, b.num_rows, 64) for r in b.slice(at, 64).to_pylist()), kinds)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark_schema = _parse_datatype_string(schema)
    kinds = to_arrow_schema(spark_schema)
    return df.mapInArrow(task, spark_schema)


def documents_as(spark, sf, build) -> DataFrame:
    """source_id, name, content: build(name, data, lang) of each document."""
    rows = table(spark, sf, "documents").select("doc_id", "lang", F.encode("text", "utf-8").alias("data"))
    return mapped(rows, "source_id string, name string, content binary", lambda r: [{"source_id": str(r["doc_id"]), "name": "x", "content": build(f"doc{r['doc_id']}", r["data"], r["lang"])}])


def as_file(name: str, data: bytes, lang: str = "en", rsrc: bool = True) -> dict:
    return containers.file(name=name, data_fork=data, rsrc_fork=data[::-1] if rsrc else b"", type_code=(lang + "TX")[:4], creator_code="ttxt", finder_flags=len(data) & 0xFFFF)


def facts(files: DataFrame) -> DataFrame:
    return files.select(F.col("source_id").cast("long").alias("doc_id"), "name", "type_code", "creator_code", "finder_flags", F.sha2("data_fork", 256).alias("data_sha256"), F.octet_length("rsrc_fork").alias("rsrc_size"), "error")


_FACTS = "SELECT doc_id, 'doc' || doc_id AS name, lang || 'TX' AS type_code, 'ttxt' AS creator_code, CAST(octet_length(encode(text)) % 65536 AS INT) AS finder_flags, sha256(text) AS data_sha256, octet_length(encode(text)) AS rsrc_size, CAST(NULL AS VARCHAR) AS error FROM documents"


@query(_FACTS)
def unwrap_macbinary(spark, sf):
    return facts(read_files(documents_as(spark, sf, lambda n, d, g: containers.write_macbinary(as_file(n, d, g))), "container"))


@query(_FACTS)
def unwrap_binhex(spark, sf):
    return facts(read_files(documents_as(spark, sf, lambda n, d, g: containers.write_binhex(as_file(n, d, g))), "container"))


@query(_FACTS)
def unwrap_apple_single(spark, sf):
    return facts(read_files(documents_as(spark, sf, lambda n, d, g: containers.write_apple_single(as_file(n, d, g))), "container"))


@query(_FACTS)
def unwrap_apple_little_endian(spark, sf):
    return facts(read_files(documents_as(spark, sf, lambda n, d, g: containers.write_apple_single(as_file(n, d, g), "little", containers.DOUBLE)), "container"))


_PLAIN = "SELECT doc_id, 'doc' || doc_id AS name, '$06' AS type_code, '$2000' AS creator_code, 0 AS finder_flags, sha256(text) AS data_sha256, {0} AS rsrc_size, CAST(NULL AS VARCHAR) AS error FROM documents WHERE text <> ''"


@query(_PLAIN.format("0"))
def unwrap_binary_ii(spark, sf):
    return facts(read_files(documents_as(spark, sf, lambda n, d, g: containers.write_binary_ii([("DIR", 0x0F, 0, b""), (n, 6, 0x2000, d)])), "container"))


@query(_PLAIN.format("octet_length(encode(text))"))
def unwrap_apple_link(spark, sf):
    return facts(read_files(documents_as(spark, sf, lambda n, d, g: containers.write_apple_link([(n, 6, 0x2000, d, d[::-1])])), "container"))


@query("SELECT doc_id, 'doc' || doc_id AS name, lang || 'TX' AS type_code, 'ttxt' AS creator_code, CAST(octet_length(encode(text)) % 65536 AS INT) AS finder_flags, CAST(octet_length(encode(text)) AS BIGINT) AS data_size, 2 AS version FROM documents")
def macbinary_headers(spark, sf):
    data = documents_as(spark, sf, lambda n, d, g: containers.write_macbinary(as_file(n, d, g)))
    h = data.select(F.col("source_id").cast("long").alias("doc_id"), probe.macbinary_header(F.col("content")).alias("h"), probe.macbinary_version(F.col("content")).alias("version"))
    return h.select("doc_id", "h.name", "h.type_code", "h.creator_code", "h.finder_flags", "h.data_size", "version")


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'macbinary' WHEN 1 THEN 'binhex' WHEN 2 THEN 'applesingle' WHEN 3 THEN 'binary_ii' WHEN 4 THEN 'applelink' END AS format FROM documents")
def identify_containers(spark, sf):
    def build(n, d, g):
        k = int(n[3:]) % 6
        f = as_file(n, d, g)
        return d if k == 5 else (containers.write_macbinary, containers.write_binhex, containers.write_apple_single, lambda f: containers.write_binary_ii([(n, 6, 0, d)]), lambda f: containers.write_apple_link([(n, 6, 0, d, b"")]))[k](f)

    rows = documents_as(spark, sf, build)
    return rows.select(F.col("source_id").cast("long").alias("doc_id"), probe.identify(F.col("content"), F.col("name")).alias("format"))


@query("SELECT lang || 'TX' AS type_code, count(*) AS n, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def type_bytes(spark, sf):
    """The engine's flagship: unwrap a collection of containers and total it by type code."""
    files = read_files(documents_as(spark, sf, lambda n, d, g: containers.write_macbinary(as_file(n, d, g, rsrc=False) if d else as_file(n, d + b"", g) | {"rsrc_fork": b"\0"})), "container")
    return files.groupBy("type_code").agg(F.count("*").alias("n"), F.sum(F.octet_length("data_fork").cast("long")).alias("bytes"))


@query("SELECT doc_id, 'doc' || doc_id || '.txt' AS name, lang || 'TX' AS type_code, sha256(text) AS data_sha256, octet_length(encode(text)) AS rsrc_size FROM documents")
def archive_forks(spark, sf):
    """Zip and compressed tar archives, with companions in their three places."""

    def build(n, d, g):
        k, f = int(n[3:]), as_file(n, d, g)
        double = codecs.apple_double(f["rsrc_fork"], f["type_code"], f["creator_code"], always=True)
        members = [(f"{n}.txt", d), ((f"._{n}.txt", f"__MACOSX/._{n}.txt")[k % 2], double), (".hidden", b"x")]
        out = io.BytesIO()
        if k % 3:
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for path, body in members:
                    z.writestr(path, body)
        else:
            with tarfile.open(fileobj=out, mode="w:gz" if k % 2 else "w") as t:
                for path, body in members:
                    info = tarfile.TarInfo(path)
                    info.size = len(body)
                    t.addfile(info, io.BytesIO(body))
        return out.getvalue()

    files = read_files(documents_as(spark, sf, build), "archive")
    return files.select(F.col("source_id").cast("long").alias("doc_id"), "name", "type_code", F.sha2("data_fork", 256).alias("data_sha256"), F.octet_length("rsrc_fork").alias("rsrc_size"))


# Codecs

def codec_query(name: str, pack, unpack) -> None:
    def run(spark, sf):
        rows = table(spark, sf, "documents").select("doc_id", F.encode("text", "utf-8").alias("data"))
        return mapped(rows, "doc_id long, plain binary", lambda r: [{"doc_id": r["doc_id"], "plain": unpack(pack(r["data"]), len(r["data"]))}]).select("doc_id", F.sha2("plain", 256).alias("sha256"))

    run.__name__ = name
    query("SELECT doc_id, sha256(text) AS sha256 FROM documents")(run)


codec_query("codec_packbits", codecs.pack_bits, lambda b, n: codecs.unpack_bits(b))
codec_query("codec_run_lengths", codecs.repeat, lambda b, n: codecs.unrepeat(b))
codec_query("codec_squeeze", encoders.squeeze, lambda b, n: codecs.unsqueeze(b)[0])
codec_query("codec_lzw1", encoders.lzw, codecs.unlzw)
codec_query("codec_lzw2", lambda b: encoders.lzw(b, 2), lambda b, n: codecs.unlzw(b, n, 2))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def codec_lzhuf(spark, sf):
    """Dealt to all cores, since a file may be one task, and coded many texts at a time."""
    rows = table(spark, sf, "documents").select("doc_id", F.encode("text", "utf-8").alias("data"))

    def coded(held):
        texts = [r["data"] for r in held]
        plain = lzhuf_lanes.unlzhuf(lzhuf_lanes.lzhuf(texts), [len(t) for t in texts])
        return [{"doc_id": r["doc_id"], "plain": p} for r, p in zip(held, plain, strict=True)]

    dealt = rows.repartition(3 * spark.sparkContext.defaultParallelism, "doc_id", "data")
    return mapped_many(dealt, "doc_id long, plain binary", coded, lambda r: len(r["data"])).select("doc_id", F.sha2("plain", 256).alias("sha256"))


@query("SELECT doc_id, 36 + octet_length(encode(text)) AS riff_size, octet_length(encode(text)) AS data_size, 22050 AS rate, 8 AS bits, sha256(text) AS sha256, '52494646' AS mark FROM documents")
def wav_headers(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.encode("text", "utf-8").alias("data"))
    built = mapped(rows, "doc_id long, wav binary", lambda r: [{"doc_id": r["doc_id"], "wav": codecs.wav(r["data"], 22050)}])
    number = lambda at, n: binary.col_le(F.col("wav"), at, n).cast("int")
    return built.select("doc_id", number(4, 4).alias("riff_size"), number(40, 4).alias("data_size"), number(24, 4).alias("rate"), number(34, 2).alias("bits"), F.sha2(F.expr("substring(wav, 45)"), 256).alias("sha256"), F.hex(F.substring("wav", 1, 4)).alias("mark"))


_BITS = "xor(CAST((c * 2) % 65536 AS INT), CASE WHEN xor(CAST(c // 32768 AS INT), CAST(CAST('0x' || h[2 * (i // 8) + 1 : 2 * (i // 8) + 2] AS INT) // CAST(power(2, 7 - i % 8) AS INT) % 2 AS INT)) = 1 THEN 4129 ELSE 0 END)"


@query(f"""
WITH RECURSIVE n AS (SELECT p_partkey, hex(encode(p_name)) AS h, octet_length(encode(p_name)) AS n FROM part),
c AS (SELECT p_partkey, h, n, 0 AS i, 0 AS c FROM n UNION ALL SELECT p_partkey, h, n, i + 1, {_BITS} FROM c WHERE i < 8 * n),
w AS (SELECT p_partkey, h, n, 0 AS i, CAST(0 AS BIGINT) AS s FROM n UNION ALL
  SELECT p_partkey, h, n, i + 1, (s + CAST('0x' || h[4 * i + 1 : 4 * i + 4] AS INT)) % 4294967296 // 2 + (s + CAST('0x' || h[4 * i + 1 : 4 * i + 4] AS INT)) % 2 * 2147483648 FROM w WHERE i < n // 2)
SELECT c.p_partkey, c.c AS crc, w.s AS rotated FROM c JOIN w USING (p_partkey) WHERE c.i = 8 * c.n AND w.i = w.n // 2""")
def name_checksums(spark, sf):
    """CRC-16 bit by bit, and the rotating checksum word by word, of part names."""
    rows = table(spark, sf, "part").select("p_partkey", F.encode("p_name", "utf-8").alias("data"))
    return mapped(rows, "p_partkey long, crc int, rotated long", lambda r: [{"p_partkey": r["p_partkey"], "crc": codecs.crc16(r["data"]), "rotated": codecs.rotating_checksum(r["data"])}])


@query()
def checksums(spark, sf):
    """CRC-16 and the rotating checksum of every text."""
    rows = table(spark, sf, "documents").select("doc_id", F.encode("text", "utf-8").alias("data"))
    return mapped(rows, "doc_id long, crc int, rotated long", lambda r: [{"doc_id": r["doc_id"], "crc": codecs.crc16(r["data"]), "rotated": codecs.rotating_checksum(r["data"])}])


# Disk images, partitions, volumes: each conversation is a volume, its turns are files

def conversations_as(spark, sf, build) -> DataFrame:
    """source_id, name, content: build(list of files) of each conversation."""
    turns = F.sort_array(F.collect_list(F.struct("turn", F.encode("text", "utf-8").alias("data"))))
    rows = table(spark, sf, "conversations").where("text <> ''").groupBy("conv_id").agg(turns.alias("turns"))
    to_files = lambda r: [containers.file(name=f"T{t['turn']}", data_fork=t["data"], type_code="TEXT", creator_code="ttxt") for t in r["turns"]]
    return mapped(rows, "source_id string, name string, content binary", lambda r: [{"source_id": str(r["conv_id"]), "name": "disk.img", "content": build(to_files(r))}])


def conversations_on(spark, sf, disks_of) -> DataFrame:
    """source_id (conv_id/number of the disk), name, content of the disks of each conversation: disks_of(list of files)."""
    turns = F.sort_array(F.collect_list(F.struct("turn", F.encode("text", "utf-8").alias("data"))))
    rows = table(spark, sf, "conversations").where("text <> ''").groupBy("conv_id").agg(turns.alias("turns"))

    def to_disks(r):
        files, times = [], {}
        for t in r["turns"]:  # a turn that is there twice is two files
            k = times[t["turn"]] = times.get(t["turn"], 0) + 1
            files.append(containers.file(name=f"T{t['turn']}" + (f".{k - 1}" if k > 1 else ""), data_fork=t["data"], type_code="TEXT", creator_code="ttxt"))
        for k, disk in enumerate(disks_of(files)):
            yield {"source_id": f"{r['conv_id']}/{k}", "name": "disk.img", "content": disk}

    return mapped(rows, "source_id string, name string, content binary", to_disks)


def joined(files: DataFrame) -> DataFrame:
    """Files of conversations_on, those put together that go on at a next disk; source_id is the conversation's."""
    place = F.split("source_id", "/")
    parts = files.select(place[0].alias("source_id"), place[1].cast("int").alias("disk"), "ordinal", "name", "data_fork", "error")
    whole = parts.groupBy("source_id", "name", "error").agg(F.sort_array(F.collect_list(F.struct("disk", "ordinal", "data_fork"))).alias("parts"))
    return whole.select("source_id", "name", "error", F.aggregate("parts", F.lit(b""), lambda data, p: F.concat(data, F.coalesce(p["data_fork"], F.lit(b"")))).alias("data_fork"))


def turns_of(files: DataFrame) -> DataFrame:
    return files.select(F.col("source_id").cast("long").alias("conv_id"), F.regexp_extract("name", r"T(\d+)", 1).cast("long").alias("turn"), F.sha2(F.regexp_replace(F.col("data_fork").cast("string"), r"[\x00\x1A]+$", ""), 256).alias("sha256"), F.octet_length("data_fork").alias("size"), "error")


def _turns(size: str) -> str:
    return f"SELECT conv_id, turn, sha256(text) AS sha256, CAST({size.replace('n', 'octet_length(encode(text))')} AS INT) AS size, CAST(NULL AS VARCHAR) AS error FROM conversations WHERE text <> ''"


def volume_query(name: str, build, size: str, reader: str = "image") -> None:
    def run(spark, sf):
        return turns_of(read_files(conversations_as(spark, sf, build), reader))

    run.__name__ = name
    query(_turns(size))(run)


def disks_query(name: str, disks_of, size: str, reader: str = "volume") -> None:
    """As volume_query, on as many disks as a conversation needs."""
    def run(spark, sf):
        return turns_of(joined(read_files(conversations_on(spark, sf, disks_of), reader)))

    run.__name__ = name
    query(_turns(size))(run)


volume_query("volume_mfs", lambda f: volumes.write_mfs("Talk", f), "n")
volume_query("volume_prodos", lambda f: volumes.write_prodos("TALK", f), "n")
disks_query("volume_dos33", volumes.dos_disks, "(n + 255) // 256 * 256")
disks_query("volume_dos32", lambda f: volumes.dos_disks(f, 13), "(n + 255) // 256 * 256")
disks_query("volume_cpm", volumes.cpm_disks, "(n + 127) // 128 * 128")
disks_query("volume_pascal", lambda f: volumes.pascal_disks("TALK", f), "n", "image")
disks_query("volume_rdos", volumes.rdos_disks, "n")
disks_query("volume_gutenberg", volumes.gutenberg_disks, "(n + 249) // 250 * 250")
disks_query("hybrid_disk", volumes.dos_disks, "(n + 255) // 256 * 256", "hybrid")


def _two_systems(files):
    """A DOS disk whose empty track 3 holds a CP/M directory and whose other file systems it shares no sector with."""
    disk = bytearray(volumes.dos_disks(files[:1] and [containers.file(name="DOSSIDE", data_fork=files[0]["data_fork"][:2000], type_code="TEXT")])[0])
    body = files[-1]["data_fork"][:896].ljust(896, b"\x1a")
    disk[12_288 + 2048 : 12_288 + 2048 + 896] = body
    disk[12_288 : 12_288 + 2048] = b"\xe5" * 2048
    disk[12_288 : 12_288 + 32] = bytes([0]) + b"CPMSIDE TXT" + bytes([0, 0, 0, 7]) + bytes([2]).ljust(16, b"\0")
    return bytes(disk)


@query("""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, encode(text)) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE text <> '')
SELECT conv_id, 'DOSSIDE' AS name, sha256(unhex(hex(encode(text))[1:4000])) AS sha256 FROM t WHERE k = 1
UNION ALL SELECT conv_id, 'CPMSIDE.TXT', sha256(unhex(hex(encode(text))[1:1792])) FROM t WHERE k = n""")
def hybrid_union(spark, sf):
    """One disk with two file systems: both readers' files come out."""
    files = read_files(conversations_as(spark, sf, _two_systems), "hybrid")
    plain = F.unhex(F.regexp_replace(F.hex("data_fork"), "(00|1A)+$", ""))
    return files.select(F.col("source_id").cast("long").alias("conv_id"), "name", F.sha2(plain, 256).alias("sha256"))


def _dual(files):
    sides = [volumes.dos_disks([containers.file(name=f"T{k}", data_fork=f["data_fork"][:20_000], type_code="TEXT")])[0].ljust(409_600, b"\0") for k, f in enumerate((files[0], files[-1]))]
    return b"".join(sides)


@query("""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, encode(text)) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE text <> '')
SELECT conv_id, 'T0' AS name, sha256(unhex(hex(encode(text))[1:40000])) AS sha256 FROM t WHERE k = 1 UNION ALL SELECT conv_id, 'T1', sha256(unhex(hex(encode(text))[1:40000])) FROM t WHERE k = n""")
def dual_volumes(spark, sf):
    """Two DOS volumes side by side on an 800K disk."""
    files = read_files(conversations_as(spark, sf, _dual), "dual_dos")
    return files.select(F.col("source_id").cast("long").alias("conv_id"), "name", F.sha2(F.unhex(F.regexp_replace(F.hex("data_fork"), "(00)+$", "")), 256).alias("sha256"))


@query("""
SELECT conv_id, CASE n % 4 WHEN 0 THEN '2img' WHEN 1 THEN 'diskcopy' WHEN 2 THEN 'woz' ELSE 'moof' END AS format,
  CASE n % 4 WHEN 0 THEN 'ProDOS block order' WHEN 2 THEN 'WOZ v2 (nibble-level)' WHEN 3 THEN 'MOOF (Mac flux image)' END AS disk_type,
  CASE n % 4 WHEN 1 THEN 'T' || conv_id END AS name, CAST(CASE WHEN n % 4 < 2 THEN 143360 ELSE 1000 END AS BIGINT) AS data_size
FROM (SELECT conv_id, count(*) AS n FROM conversations WHERE text <> '' GROUP BY 1)""")
def image_info(spark, sf):
    def build(r):
        kinds = (lambda: disks.write_two_img(bytes(143_360)), lambda: disks.write_disk_copy(f"T{r['conv_id']}", bytes(143_360)), lambda: b"WOZ2".ljust(1000, b"\0"), lambda: b"MOOF".ljust(1000, b"\0"))
        return [{"source_id": str(r["conv_id"]), "name": "disk", "content": kinds[r["n"] % 4]()}]

    rows = mapped(table(spark, sf, "conversations").where("text <> ''").groupBy("conv_id").agg(F.count("*").alias("n")), "source_id string, name string, content binary", build)
    return read_image_info(rows).select(F.col("source_id").cast("long").alias("conv_id"), "format", "disk_type", "name", "data_size")


disks_query("image_diskcopy", lambda f: [disks.write_disk_copy("Talk", v, b"tag!" * 6) for v in volumes.pascal_disks("TALK", f)], "n", "image")
volume_query("image_2img", lambda f: disks.write_two_img(volumes.write_prodos("TALK", f)), "n")
disks_query("image_dart", lambda f: [disks.write_dart(v) for v in volumes.pascal_disks("TALK", f)], "n", "image")
volume_query("image_apm", lambda f: disks.write_apm([("Map", "Apple_Free", b"x"), ("Old", "Apple_ProDOS", bytes(4096)), ("Talk", "Apple_MFS", volumes.write_mfs("Talk", f))]), "n")
volume_query("image_mac_ts", lambda f: disks.write_mac_ts([(b"TFS1", volumes.write_mfs("Talk", f))]), "n")


def _mixed_image(files):
    volume = volumes.pascal_disks("TALK", files)[0]
    return (volume, disks.write_two_img(volume), disks.write_disk_copy("T", volume), disks.write_dart(volume), disks.write_apm([("T", "Apple_MFS", volume)]), disks.write_mac_ts([(b"TFS1", volume)]))[len(files) % 6]


@query("SELECT conv_id, CASE count(*) % 6 WHEN 0 THEN 'raw' WHEN 1 THEN '2img' WHEN 2 THEN 'diskcopy' WHEN 3 THEN 'dart' WHEN 4 THEN 'apm' ELSE 'mac_ts' END AS format, CASE WHEN count(*) % 6 = 0 THEN 'pascal' ELSE 'unknown' END AS filesystem FROM conversations WHERE text <> '' GROUP BY 1")
def probe_images(spark, sf):
    rows = conversations_as(spark, sf, _mixed_image)
    kind, fs = probe.image_format(F.col("content")), probe.filesystem(F.col("content"))
    return rows.select(F.col("source_id").cast("long").alias("conv_id"), kind.alias("format"), F.when(kind == "raw", fs).otherwise("unknown").alias("filesystem"))


def _mixed_volume(files):
    writers = (lambda f: volumes.write_mfs("T", f), lambda f: volumes.write_prodos("T", f), lambda f: volumes.dos_disks(f)[0], lambda f: volumes.cpm_disks(f)[0], lambda f: volumes.pascal_disks("T", f)[0], lambda f: volumes.rdos_disks(f)[0], lambda f: volumes.gutenberg_disks(f)[0], lambda f: volumes.dos_disks(f, 13)[0])
    return writers[len(files) % 8](files)


@query("SELECT conv_id, CASE count(*) % 8 WHEN 0 THEN 'mfs' WHEN 1 THEN 'prodos' WHEN 2 THEN 'dos33' WHEN 3 THEN 'cpm' WHEN 4 THEN 'pascal' WHEN 5 THEN 'rdos' WHEN 6 THEN 'gutenberg' ELSE 'dos33' END AS filesystem FROM conversations WHERE text <> '' GROUP BY 1")
def probe_filesystems(spark, sf):
    return conversations_as(spark, sf, _mixed_volume).select(F.col("source_id").cast("long").alias("conv_id"), probe.filesystem(F.col("content")).alias("filesystem"))


@query("SELECT conv_id, k AS ordinal, 'focusdrive' AS scheme, 'P' || k AS name, CAST(2 + k * 280 AS BIGINT) AS start_block, CAST(280 AS BIGINT) AS block_count FROM (SELECT DISTINCT conv_id FROM conversations WHERE text <> ''), (VALUES (0), (1)) v(k)")
def hard_disk_partitions(spark, sf):
    rows = conversations_as(spark, sf, lambda f: disks.write_hard_disk(b"Parsons Engin.", [(f"P{k}", volumes.pascal_disks("TALK", f)[0]) for k in (0, 1)]))
    return read_partitions(rows).select(F.col("source_id").cast("long").alias("conv_id"), "ordinal", "scheme", "name", "start_block", "block_count")


@query("SELECT conv_id, 'Apple_MFS' AS type, 'mfs' AS holds FROM (SELECT DISTINCT conv_id FROM conversations WHERE text <> '')")
def best_partitions(spark, sf):
    rows = conversations_as(spark, sf, lambda f: disks.write_apm([("F", "Apple_Free", b"x"), ("P", "Apple_ProDOS", bytes(4096)), ("M", "Apple_MFS", volumes.write_mfs("T", f))]))
    parts = read_partitions(rows).withColumn("holds", probe.partition_holds(F.col("type")))
    rank = F.array_position(F.array(F.lit("hfs"), F.lit("mfs"), F.lit("prodos")), F.col("holds"))
    best = parts.where(rank > 0).groupBy("source_id").agg(F.min_by(F.struct("type", "holds"), F.struct(rank, "ordinal")).alias("best"))
    return best.select(F.col("source_id").cast("long").alias("conv_id"), "best.type", "best.holds")


# Resource forks: a document's fork holds its language, its text's lines and a version

def forks(spark, sf) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")

    def build(r):
        lang, source = r["lang"].encode(), r["source"].encode()
        parts = [
            ("STR ", 128, "lang", bytes([len(lang)]) + lang), ("STR#", -4, None, b"\0\2" + bytes([len(lang)]) + lang + bytes([len(source)]) + source),
            ("vers", 1, None, bytes([7, 0x53, 0x80, 0, 0, 0, len(lang)]) + lang + bytes([len(source)]) + source), ("ICN#", 200, "icon", bytes([r["doc_id"] % 256]) * 256),
            ("CODE", 0, None, (r["doc_id"] % 65536).to_bytes(2, "big") + b"\0\x08"),
        ]
        return [{"id": str(r["doc_id"]), "rsrc_fork": resources.build_fork(parts)}]

    return mapped(rows, "id string, rsrc_fork binary", build)


@query("SELECT doc_id, t AS type_code, CAST(i AS SMALLINT) AS resource_id, n AS name FROM documents, (VALUES ('STR ', 128, 'lang'), ('STR#', -4, NULL), ('vers', 1, NULL), ('ICN#', 200, 'icon'), ('CODE', 0, NULL)) v(t, i, n)")
def resource_rows(spark, sf):
    return read_resources(forks(spark, sf)).select(F.col("owner_id").cast("long").alias("doc_id"), "type_code", "resource_id", "name")


@query("SELECT doc_id, lang AS one, [lang, source] AS many, 7 AS major, 5 AS minor, 'release' AS stage, lang AS short, CAST(doc_id % 65536 AS BIGINT) AS jump FROM documents")
def resource_contents(spark, sf):
    def decode(r):
        found = {x.type_code: resources.resource_data(r["rsrc_fork"], x) for x in resources.parse_fork(r["rsrc_fork"])}
        v = resources.version(found["vers"])
        return [{"doc_id": int(r["id"]), "one": resources.string(found["STR "]), "many": resources.strings(found["STR#"]), "major": v["major"], "minor": v["minor"], "stage": v["stage"], "short": v["short"], "jump": resources.code(found["CODE"])["first"]}]

    return mapped(forks(spark, sf), "doc_id long, one string, many array<string>, major int, minor int, stage string, short string, jump long", decode)


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'icl8' WHEN 1 THEN 'icl4' ELSE 'ICN#' END AS type_code, CAST(CASE doc_id % 3 WHEN 0 THEN 9 WHEN 1 THEN 7 ELSE 200 END AS SMALLINT) AS resource_id FROM documents")
def best_icons(spark, sf):
    """Of several candidates the best kind, and of equal kinds the first."""
    rows = table(spark, sf, "documents").select("doc_id")

    def build(r):
        icons = [("ics#", 3, None, bytes(64)), ("ICN#", 200, None, bytes(256)), ("ICN#", 100, None, bytes(256)), ("cicn", 1, None, bytes(90))]
        icons += [("icl4", 7, None, bytes(512)), ("icl4", 5, None, bytes(512))] * (r["doc_id"] % 3 < 2) + [("icl8", 9, None, bytes(1024))] * (r["doc_id"] % 3 == 0)
        return [{"id": str(r["doc_id"]), "rsrc_fork": resources.build_fork(icons)}]

    found = listing.best_icons(read_resources(mapped(rows, "id string, rsrc_fork binary", build)))
    return found.select(F.col("owner_id").cast("long").alias("doc_id"), "type_code", "resource_id")


@query("SELECT t AS type_code, d AS description, count(*) AS n FROM documents, (VALUES ('STR ', 'String resource'), ('STR#', 'String list resource'), ('vers', 'Version information'), ('ICN#', '32×32 icon with mask'), ('CODE', '68K code segment')) v(t, d) GROUP BY 1, 2")
def described_resources(spark, sf):
    return listing.described_resources(read_resources(forks(spark, sf))).groupBy("type_code", "description").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(128 AS SMALLINT) AS resource_id, 'lang' AS name FROM documents")
def find_resource(spark, sf):
    return listing.find_resource(read_resources(forks(spark, sf)), "STR ", 128).select(F.col("owner_id").cast("long").alias("doc_id"), "resource_id", "name")


@query("SELECT doc_id, 32 AS width, 32 AS height, CASE WHEN doc_id % 256 >= 128 THEN '000000FF' ELSE '00000000' END AS first_pixel FROM documents")
def icon_pixels(spark, sf):
    rows = mapped(forks(spark, sf), "doc_id long, width int, height int, rgba binary", lambda r: [dict(zip(("doc_id", "width", "height", "rgba"), (int(r["id"]), *resources.best_icon(r["rsrc_fork"])), strict=True))])
    return rows.select("doc_id", "width", "height", F.hex(F.substring("rgba", 1, 4)).alias("first_pixel"))


@query()
def thumbnails(spark, sf):
    rows = forks(spark, sf).select("id", F.lit("x").alias("name"), F.lit(None).cast("string").alias("type_code"), F.lit(b"").alias("data_fork"), "rsrc_fork")
    return ingest.thumbnails(rows).select("id", F.octet_length("png").alias("size"))


_FULL = "CASE WHEN parent_id IS NULL THEN '' ELSE 'doc' || CAST(CAST(parent_id AS BIGINT) AS VARCHAR) || CASE CAST(parent_id AS BIGINT) % 6 WHEN 0 THEN '.txt' WHEN 2 THEN '.img' WHEN 4 THEN '' END || '/' END"


@query(E + f"""
SELECT {_FULL} || name AS path, sha256(CAST(name AS VARCHAR)) AS sha256, NULL AS type_code, NULL AS creator_code FROM e WHERE NOT is_dir
UNION ALL SELECT {_FULL} || '._' || name, sha256(CASE WHEN rsrc_size > 0 THEN source ELSE '' END), CASE WHEN type_code <> '' THEN type_code END, CASE WHEN creator_code <> '' THEN creator_code END
FROM (SELECT * REPLACE (CASE WHEN finder_flags % 5 = 0 AND rsrc_size = 0 THEN NULL ELSE type_code END AS type_code) FROM e) WHERE NOT is_dir AND source IS NOT NULL AND (rsrc_size > 0 OR coalesce(type_code, '') <> '')
UNION ALL SELECT {_FULL} || '._' || name, sha256(''), type_code, creator_code
FROM (SELECT * REPLACE (CASE WHEN finder_flags % 5 = 0 AND rsrc_size = 0 THEN NULL ELSE type_code END AS type_code) FROM e) WHERE NOT is_dir AND source IS NULL AND coalesce(type_code, '') <> ''""")
def export_rows(spark, sf):
    """Data forks, and beside them companions that say type, creator and resource fork when read again."""
    plain = (F.col("finder_flags") % 5 == 0) & (F.col("rsrc_size") == 0)
    entries = catalog(spark, sf).withColumn("type_code", F.when(~plain, F.col("type_code")))
    forks_ = entries.select("id", F.encode("name", "utf-8").alias("data_fork"), F.encode(F.when(F.col("rsrc_size") > 0, F.coalesce("source", F.lit(""))).otherwise(""), "utf-8").alias("rsrc_fork"))
    files = export.export_rows(entries, forks_)
    hidden = F.regexp_extract("path", r"([^/]*)$", 1).startswith("._")
    read = read_files(files.where(hidden).select(F.col("path").alias("source_id"), F.lit("x").alias("name"), "content"), "container")
    known = lambda c: F.nullif(F.regexp_replace(c, "^\\x00+$", ""), F.lit("")).alias(c)
    companions = read.select(F.col("source_id").alias("path"), F.sha2("rsrc_fork", 256).alias("sha256"), known("type_code"), known("creator_code"))
    return files.where(~hidden).select("path", F.sha2("content", 256).alias("sha256")).unionByName(companions, allowMissingColumns=True)


_JSON = " || ".join(f"""coalesce('"{c}":"' || {c} || '",', '')""" if c not in ("data_size", "rsrc_size") else f"""'"{c}":' || {c} || ','""" for c in ("creator_code", "data_sha256", "data_size", "id", "name", "path", "rsrc_size", "type_code"))


@query(E + f"SELECT '{{' || rtrim({_JSON}, ',') || '}}' AS json FROM e WHERE NOT is_dir")
def manifest_rows(spark, sf):
    return export.manifest(with_defaults(catalog(spark, sf)))


# More resources: each built from a row, then decoded


def _resource_query(name: str, source: str, columns: list[str], schema: str, build, sql: str) -> None:
    def run(spark, sf):
        return mapped(table(spark, sf, source).select(*columns), schema, build)

    run.__name__ = name
    query(sql)(run)


def _pascal(text_: str) -> bytes:
    raw = text_.encode("mac_roman", "replace")[:255]
    return bytes([len(raw)]) + raw


def _menu(r):
    items = [(r["n_name"], "K"), ("-", ""), (f"Key {r['n_nationkey']}", "")]
    data = r["n_nationkey"].to_bytes(2, "big") + bytes(12) + _pascal("Nations") + b"".join(_pascal(t) + bytes([0, ord(k) if k else 0, 0, 0]) for t, k in items) + b"\0"
    m = resources.menu(data)
    return [{"n_nationkey": r["n_nationkey"], "menu_id": m["menu_id"], "place": i, "title": x["title"], "key": x["key"], "separator": x["separator"]} for i, x in enumerate(m["items"])]


_resource_query("resource_menus", "nation", ["n_nationkey", "n_name"], "n_nationkey long, menu_id int, place int, title string, key string, separator boolean", _menu,
                "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_nationkey AS INT) AS menu_id, p AS place, CASE p WHEN 0 THEN n_name WHEN 1 THEN '-' ELSE 'Key ' || n_nationkey END AS title, CASE p WHEN 0 THEN 'K' END AS key, p = 1 AS separator FROM nation, (VALUES (0), (1), (2)) v(p)")


def _dialog(r):
    out, k = (1).to_bytes(2, "big"), r["s_suppkey"]
    for kind, label in ((4, r["s_name"]), (0x80 | 16, "x" * (k % 4))):
        raw = label.encode()
        out += bytes(4) + b"".join(v.to_bytes(2, "big", signed=True) for v in (k % 100, -5, k % 100 + 20, 300)) + bytes([kind, len(raw)]) + raw + b"\0" * (len(raw) % 2)
    return [{"s_suppkey": k, "place": i, "kind": x["kind"], "top": x["top"], "left": x["left"], "text": x["text"]} for i, x in enumerate(resources.dialog_items(out))]


_resource_query("resource_dialogs", "supplier", ["s_suppkey", "s_name"], "s_suppkey long, place int, kind string, top int, left int, text string", _dialog,
                "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, p AS place, CASE p WHEN 0 THEN 'button' ELSE 'editText' END AS kind, CAST(s_suppkey % 100 AS INT) AS top, -5 AS \"left\", CASE p WHEN 0 THEN s_name ELSE repeat('x', CAST(s_suppkey % 4 AS INT)) END AS text FROM supplier, (VALUES (0), (1)) v(p)")


def _bundle(r):
    two = lambda v: v.to_bytes(2, "big")
    k = r["c_custkey"]
    data = b"RELQ" + bytes(2) + two(1) + b"ICN#" + two(1) + two(0) + two(128) + two(k % 100) + two(129) + b"FREF" + two(0) + two(0) + two(200 + k % 50)
    b = resources.bundle(data)
    return [{"c_custkey": k, "signature": b["signature"], **x} for x in b["entries"]]


_resource_query("resource_bundles", "customer", ["c_custkey"], "c_custkey long, signature string, type_code string, local_id int, resource_id int", _bundle,
                "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, 'RELQ' AS signature, t AS type_code, CAST(CASE l WHEN -1 THEN c_custkey % 100 ELSE l END AS INT) AS local_id, CAST(CASE WHEN t = 'FREF' THEN 200 + c_custkey % 50 ELSE i END AS INT) AS resource_id FROM customer, (VALUES ('ICN#', 0, 128), ('ICN#', -1, 129), ('FREF', 0, 0)) v(t, l, i)")


def _colors(r):
    k = r["p_partkey"] % 65536
    data = bytes(6) + (1).to_bytes(2, "big") + b"".join(v.to_bytes(2, "big") for v in (0, k, 1, 2, 7, 65535 - k, 3, 4))
    return [{"p_partkey": r["p_partkey"], **x} for x in resources.color_table(data)]


_resource_query("resource_colors", "part", ["p_partkey"], "p_partkey long, index int, r int, g int, b int", _colors,
                "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, i AS \"index\", CAST(CASE i WHEN 0 THEN p_partkey % 65536 ELSE 65535 - p_partkey % 65536 END AS INT) AS r, CASE i WHEN 0 THEN 1 ELSE 3 END AS g, CASE i WHEN 0 THEN 2 ELSE 4 END AS b FROM part, (VALUES (0), (7)) v(i)")


def _font(r):
    k = r["n_nationkey"]
    v = [-28672, 65, 66, 8 + k, -1, 3 + k, 9, 2 + k, 1, 4, 5 + k, 12 + k, 2]
    f = resources.font(b"".join(x.to_bytes(2, "big", signed=True) for x in v))
    return [{"n_nationkey": k} | {c: f[c] for c in ("kind", "first", "last", "widest", "ascent", "descent", "leading", "height")} | {"shown": resources.font_text(f)}]


_resource_query("resource_fonts", "nation", ["n_nationkey"], "n_nationkey long, kind int, first int, last int, widest int, ascent int, descent int, leading int, height int, shown string", _font,
                "SELECT k AS n_nationkey, -28672 AS kind, 65 AS first, 66 AS last, CAST(8 + k AS INT) AS widest, CAST(3 + k AS INT) AS ascent, 9 AS descent, CAST(2 + k AS INT) AS leading, CAST(12 + k AS INT) AS height, 'Characters: 65-66' || chr(10) || 'Max width: ' || (8 + k) || chr(10) || 'Ascent: ' || (3 + k) || chr(10) || 'Descent: 9' || chr(10) || 'Leading: ' || (2 + k) || chr(10) || 'Height: ' || (12 + k) AS shown FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation)")


def _sound(r):
    rate, body = 11025 + r["doc_id"] % 1000, r["data"]
    data = (2).to_bytes(2, "big") + bytes(2) + (1).to_bytes(2, "big") + (0x8051).to_bytes(2, "big") + bytes(2) + (14).to_bytes(4, "big") + bytes(4) + len(body).to_bytes(4, "big") + (rate << 16).to_bytes(4, "big") + bytes(8) + b"\0\x3c" + body
    s_ = resources.sound(data)
    return [{"doc_id": r["doc_id"], "rate": s_["rate"], "bits": s_["bits"], "channels": s_["channels"], "compressed": s_["compressed"], "samples": resources.sound_samples(data)}]


@query("SELECT doc_id, CAST(11025 + doc_id % 1000 AS INT) AS rate, 8 AS bits, 1 AS channels, false AS compressed, sha256(text) AS sha256 FROM documents")
def resource_sounds(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.encode("text", "utf-8").alias("data"))
    return mapped(rows, "doc_id long, rate int, bits int, channels int, compressed boolean, samples binary", _sound).select("doc_id", "rate", "bits", "channels", "compressed", F.sha2("samples", 256).alias("sha256"))


def _pictures(r):
    k = r["doc_id"] % 256
    made = {"ICON": bytes([k]) * 128, "ics#": bytes([k]) * 32 + b"\xff" * 32, "CURS": bytes([k]) * 32 + b"\xff" * 32 + bytes(4), "PAT ": bytes([k]) * 8, "SICN": bytes([k]) * 32, "icl4": bytes([k]) * 512, "ics4": bytes([k]) * 128}
    for code, data in made.items():
        width, height, rgba = resources.render(code, data)
        yield {"doc_id": r["doc_id"], "type_code": code, "width": width, "height": height, "dark": sum(rgba[i : i + 4] == b"\0\0\0\xff" for i in range(0, len(rgba), 4))}


_resource_query("icon_kinds", "documents", ["doc_id"], "doc_id long, type_code string, width int, height int, dark int", _pictures,
                "SELECT doc_id, t AS type_code, w AS width, w AS height, CAST(CASE WHEN t IN ('icl4', 'ics4') THEN w * w // 2 * ((doc_id % 256 // 16 = 15)::INT + (doc_id % 16 = 15)::INT) ELSE w * w // 8 * bit_count(CAST(doc_id % 256 AS INT)) END AS INT) AS dark FROM documents, (VALUES ('ICON', 32), ('ics#', 16), ('CURS', 16), ('PAT ', 8), ('SICN', 16), ('icl4', 32), ('ics4', 16)) v(t, w)")


@query("SELECT doc_id, 'STR  #128 ''lang'' (' || (1 + octet_length(encode(lang))) || ' bytes)' AS first, 'CODE (1)' AS head FROM documents")
def resource_overviews(spark, sf):
    def show(r):
        found = resources.parse_fork(r["rsrc_fork"])
        return [{"doc_id": int(r["id"]), "first": resources.describe(next(x for x in found if x.type_code == "STR ")), "head": resources.overview(found).split("\n")[0]}]

    return mapped(forks(spark, sf), "doc_id long, first string, head string", show)
