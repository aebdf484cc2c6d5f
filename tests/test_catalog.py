"""The catalog's life, imports and extraction, on a temporary root."""

import hashlib
import io
import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from reliquary.operators import listing
from reliquary.operators.catalog import KEPT, Catalog, CatalogError, entry_json, with_defaults
from reliquary.plans import export, ingest
from reliquary.sources import containers as W
from reliquary.sources import disks as D
from reliquary.sources import volumes as V
from reliquary.sources.tables import read_files, read_resources, register
from reliquary.functions import codecs, dates, encoders, resources, text
from reliquary.streaming import dropbox

FORKS = "name string, data_fork binary, rsrc_fork binary, type_code string, creator_code string, parent_id string"


def rows(spark, *files):
    return spark.createDataFrame([(n, d, r, t, c, p) for n, d, r, t, c, p in files], FORKS)


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog.create(spark, str(tmp_path / "vault"))


def test_life(spark, catalog, tmp_path):
    with pytest.raises(CatalogError, match="AlreadyExists"):
        Catalog.create(spark, str(tmp_path / "vault"))
    with pytest.raises(CatalogError, match="NotFound"):
        Catalog.open(spark, str(tmp_path / "none"))
    assert catalog.table("catalog_meta").first().asDict() == {"key": "schema_version", "value": "1"}
    catalog.add_files(rows(spark, ("ReadMe", b"Hello from 1997!\r", b"", "TEXT", "ttxt", None)))
    folder = catalog.add_directory("System Folder")
    added = catalog.add_files(rows(spark, ("Finder", b"d", b"\0\0\1\0\xff", "FNDR", "MACS", folder), ("Clock", b"", None, None, None, folder)))
    assert folder == "0002" and sorted(r["id"] for r in added.collect()) == ["0003", "0004"]
    again = Catalog.open(spark, str(tmp_path / "vault"))
    assert again.count() == 4 and again.next_id() == 5
    assert [r["name"] for r in listing.children(again.entries).collect()] == ["System Folder", "ReadMe"]
    assert [r["name"] for r in listing.children(again.entries, folder).collect()] == ["Clock", "Finder"]
    e = again.entry("0001")
    assert e["data_size"] == 17 and e["rsrc_size"] == 0 and e["rsrc_sha256"] is None and e["data_sha256"] == hashlib.sha256(b"Hello from 1997!\r").hexdigest() and e["encoding"] == "MacRoman"
    assert again.data_fork("0001") == b"Hello from 1997!\r" and again.rsrc_fork("0001") == b""
    finder = listing.search(again.entries, "finder").first()["id"]
    assert again.rsrc_fork(finder) == b"\0\0\1\0\xff" and again.rsrc_fork("none") == b""
    with pytest.raises(CatalogError, match="MissingFork"):
        again.data_fork("none")
    assert json.loads(entry_json(again.entries).where("id = '0001'").first()["json"])["name"] == "ReadMe"
    assert again.sql("SELECT count(*) AS n FROM entries WHERE name = :name", name="ReadMe").first()["n"] == 1
    again.set_thumbnails(spark.createDataFrame([("0001", b"a"), (finder, b"b")], "id string, png binary"))
    again.set_thumbnails(spark.createDataFrame([("0001", b"c")], "id string, png binary"))
    assert again.thumbnail("0001") == b"c" and again.thumbnail("0009") is None
    assert again.delete(folder) == 3 and again.count() == 1 and again.forks.count() == 1 and again.thumbnails.count() == 1
    assert again.delete_thumbnails() == 1
    card = export.summary_html(again.entries, "V & Co")
    assert "V &amp; Co" in card and "TEXT: 1" in card


def test_deep_delete_and_paths(spark):
    e = spark.createDataFrame([("1", None, "a"), ("2", "1", "b"), ("3", "2", "c"), ("4", "3", "d"), ("5", None, "e")], "id string, parent_id string, name string")
    assert sorted(r["id"] for r in listing.subtree(e, spark.createDataFrame([("2",)], "id string")).collect()) == ["2", "3", "4"]
    assert {r["path"] for r in listing.paths(e).collect()} == {"a", "a/b", "a/b/c", "a/b/c/d", "e"}
    assert listing.breadcrumb(e, "4") == ["a", "b", "c", "d"]


def test_import_and_extract(spark, catalog, tmp_path):
    inner = V.write_pascal("DISK", [W.file(name="A.TEXT", data_fork=b"deep text", type_code="TEXT")])
    outer = V.write_prodos("OUT", [W.file(name="INNER.PO", data_fork=inner), W.file(name="NOTE", data_fork=b"n")], 900)
    source = tmp_path / "in"
    source.mkdir()
    (source / "disk.2mg").write_bytes(D.write_two_img(outer))
    (source / "app.bin").write_bytes(W.write_macbinary(W.file(name="App", data_fork=b"x", rsrc_fork=b"rr", type_code="APPL", creator_code="test", created=datetime(1990, 1, 1), modified=datetime(1991, 1, 1))))
    (source / "plain.txt").write_bytes(b"plain")
    (source / "broken.hqx").write_bytes(b"not binhex at all")
    ingest.import_files(catalog, str(source))
    got = {r["name"]: r for r in catalog.entries.collect()}
    assert set(got) == {"disk.2mg", "App", "plain.txt", "broken.hqx"}
    assert got["App"]["type_code"] == "APPL" and got["App"]["created_at"] == datetime(1990, 1, 1) and got["App"]["rsrc_size"] == 2
    assert ingest.extract_all(catalog) == 3 and ingest.extract_all(catalog) == 0
    got = {r["name"]: r for r in catalog.entries.collect()}
    assert got["A.TEXT"]["parent_id"] == got["INNER.PO"]["id"] and got["A.TEXT"]["source"] == "INNER.PO" and catalog.data_fork(got["A.TEXT"]["id"]) == b"deep text"
    new = spark.createDataFrame([("http://h/a%20b.txt", "attachment; filename*=UTF-8''a%20b.txt", b"t"), ("http://h/c", None, b"c")], "url string, header string, content binary")
    assert {r["name"] for r in ingest.import_downloads(catalog, new).collect()} == {"a b.txt", "c"}
    assert ingest.import_downloads(catalog, new).count() == 0 and catalog.history.count() == 2 and "a b.txt" in export.history_json(catalog.history)
    out = {r["path"]: bytes(r["content"]) for r in export.export_rows(catalog.entries, catalog.forks).collect()}
    assert out["disk.2mg/INNER.PO/A.TEXT"] == b"deep text" and W.read_apple(out["._App"])["type_code"] == "APPL"
    assert export.manifest(catalog.entries).count() == catalog.count()


def test_ids_of_four_digits_and_more(spark, catalog):
    """What add_files returns is what it stored, also where ids as strings are out of order."""
    seed = spark.createDataFrame([("9997", "seed")], "id string, name string")
    catalog._append("entries", with_defaults(seed))
    added = catalog.add_files(rows(spark, *[(f"f{i}", b"x%d" % i, b"", None, None, None) for i in range(5)]))
    assert sorted(int(r["id"]) for r in added.collect()) == [9998, 9999, 10000, 10001, 10002] and catalog.count() == 6
    assert catalog.add_files(rows(spark).where("false")).count() == 0 and catalog.count() == 6


def test_changes_are_seen_whole(spark, catalog):
    """A reader who has a table open finishes on it; a manifest that was never put in place changes nothing."""
    catalog.add_files(rows(spark, ("a", b"1", b"", None, None, None), ("b", b"2", b"", None, None, None)))
    before, forks = catalog.entries, catalog.forks
    names = catalog._manifests()
    assert catalog.delete("0001") == 1
    assert before.count() == 2 and forks.count() == 2 and catalog.count() == 1 and catalog.forks.count() == 1
    assert len(catalog._manifests()) == min(KEPT, len(names) + 1)
    newest = catalog.manifest()
    stream = catalog.store.fs.create(catalog.store._path(".manifest-000099.json.new"), True)
    stream.write(bytearray(b"{"))
    stream.close()
    assert catalog.manifest() == newest and catalog.count() == 1
    for i in range(6):
        catalog.set_thumbnails(spark.createDataFrame([("0002", b"%d" % i)], "id string, png binary"))
    assert len(catalog._manifests()) == KEPT and len(catalog.store.names("thumbnails/*")) <= KEPT and catalog.thumbnail("0002") == b"5"


def test_hierarchies_of_any_depth(spark):
    deep = [(str(i), str(i - 1) if i else None, f"n{i}") for i in range(1500)] + [("x", "gone", "lost")]
    e = spark.createDataFrame(deep, "id string, parent_id string, name string").repartition(4)
    got = {r["id"]: r for r in listing.paths(e).collect()}
    assert len(got) == 1500 and all(got[str(i)]["depth"] == i for i in range(1500)) and got["70"]["path"] == "/".join(f"n{i}" for i in range(71))
    below = lambda i: listing.subtree(e, spark.createDataFrame([(i,)], "id string"))
    assert below("300").count() == 1200 and below("1499").count() == 1 and [r["id"] for r in below("nowhere").collect()] == ["nowhere"]
    assert listing.breadcrumb(e, "70") == [f"n{i}" for i in range(71)]
    forks = e.select("id", F.encode("name", "utf-8").alias("data_fork"), F.lit(b"").alias("rsrc_fork"))
    laid = export.export_rows(with_defaults(e.where("id <> 'x'")), forks)
    assert laid.count() == 1500
    ring = spark.createDataFrame([("1", "3", "a"), ("2", "1", "b"), ("3", "2", "c"), ("4", None, "d"), ("5", "3", "e")], "id string, parent_id string, name string")
    with pytest.raises(ValueError, match="cycle"):
        listing.paths(ring)
    assert sorted(r["id"] for r in listing.subtree(ring, spark.createDataFrame([("2",)], "id string")).collect()) == ["1", "2", "3", "5"]
    assert len(listing.breadcrumb(ring, "5")) == 4


def test_nesting_of_any_depth(spark, catalog):
    body, name = b"innermost", "core.txt"
    for i in range(10):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, body)
        body, name = out.getvalue(), f"level{i}.zip"
    catalog.add_files(rows(spark, (name, body, b"", None, None, None)))
    assert ingest.extract_all(catalog) == 10
    assert len(listing.breadcrumb(catalog.entries, catalog.entries.where("name = 'core.txt'").head()["id"])) == 11


def test_conversions_and_thumbnails_are_stored(spark, catalog, tmp_path):
    paint = bytes(512) + codecs.pack_bits(b"\xaa" * 51840)
    folder = catalog.add_directory("Art")
    catalog.add_files(rows(spark, ("p", paint, b"", "PNTG", "MPNT", folder), ("note", b"caf\x8e\rend", b"", "TEXT", "ttxt", None)))
    new = {r["name"]: r for r in ingest.store_conversions(catalog).collect()}
    assert set(new) == {"p.png", "note.txt"} and new["p.png"]["parent_id"] == folder
    assert catalog.data_fork(new["note.txt"]["id"]).decode() == "café\nend"
    assert ingest.store_conversions(catalog, catalog.entries.where("name = 'p'")).count() == 0
    assert ingest.store_thumbnails(catalog) == 1 and ingest.store_thumbnails(catalog) == 0 and catalog.thumbnail(catalog.entries.where("name = 'p'").head()["id"])[:4] == b"\x89PNG"
    for name in ("A", "B"):
        ingest.store_index(ingest.index_documents(catalog.entries, name, F.lit("2024-01-01").cast("timestamp_ntz")), str(tmp_path / "index"))
    ingest.store_index(ingest.index_documents(catalog.entries.limit(2), "B", F.lit("2024-01-01").cast("timestamp_ntz")), str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.where("index_id like 'file:A/%'").count() == catalog.count() and index.where("index_id like 'file:B/%'").count() == 2
    assert ingest.without_scope(index, "file:A").count() == 2
    target = tmp_path / "out"

    def write(path, content):
        (target / path).parent.mkdir(parents=True, exist_ok=True)
        (target / path).write_bytes(content)

    export.write_files(export.export_rows(catalog.entries, catalog.forks), write)
    assert (target / "Art" / "p").read_bytes() == paint and (target / "Art" / "._p").exists()


def test_long_lzhuf_goes_there_and_back():
    data = b"".join(b"line %d of a text that repeats; " % (i * i % 977) for i in range(1500))
    packed = encoders.lzhuf(data)
    assert codecs.unlzhuf(packed, len(data)) == data
    # Symbols of a fresh tree: 314 leaves of equal weight, so the first literals have codes of eight or nine bits.
    assert 8 <= len(codecs.AdaptiveTree().path(0)) <= 9


def test_errors_are_rows(spark):
    bad = spark.createDataFrame([("1", "x.hqx", b"junk"), ("2", "y.txt", b"z")], "source_id string, name string, content binary")
    got = read_files(bad, "container").collect()
    assert len(got) == 1 and got[0]["source_id"] == "1" and got[0]["error"].startswith("invalid format")
    with pytest.raises(Exception, match="invalid format"):
        read_files(bad, "container", mode="FAILFAST").collect()
    register(spark)
    bad.createOrReplaceTempView("files")
    assert spark.sql("SELECT f.source_id, u.name FROM files f, LATERAL unwrap(f.content, f.name) u").count() == 0


def test_conversions(spark):
    paint = bytes(512) + codecs.pack_bits(b"\xaa" * 51840)
    e = spark.createDataFrame([("1", "a.txt", "TEXT", b"caf\x8e\rend", b""), ("2", "p", "PNTG", paint, b""), ("3", "none", None, b"", b"")], "id string, name string, type_code string, data_fork binary, rsrc_fork binary")
    out = {r["id"]: r for r in ingest.converted(e).collect()}
    assert bytes(out["1"]["content"]).decode() == "café\nend" and bytes(out["2"]["content"])[:4] == b"\x89PNG" and "3" not in out
    assert [r["id"] for r in ingest.thumbnails(e).collect()] == ["2"]
    fork = resources.build_fork([("STR ", 1, None, b"\1x")])
    owned = spark.createDataFrame([("1", fork), ("2", b"")], "id string, rsrc_fork binary")
    assert [r["type_code"] for r in read_resources(owned).collect()] == ["STR "]


def test_expressions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert value(dates.prodos_timestamp(F.lit((97 << 9) | (2 << 5) | 31), F.lit((10 << 8) | 30))) == datetime(1997, 3, 3, 10, 30)
    assert value(dates.prodos_timestamp(F.lit(0), F.lit(0))) is None and value(dates.mac_timestamp(F.lit(0))) is None
    assert value(dates.mac_timestamp(F.lit(2082844800))) == datetime(1970, 1, 1)
    assert value(text.read_text(F.lit(b"line1\rline2\r\nHello\xd2"))) == "line1\nline2\nHello“"
    assert value(text.decode_as(F.lit("привет".encode("cp1251")), "MacCyrillic")) == "привет"
    assert value(text.html_to_markdown(F.lit("<head>x</head><h2>T</h2><p><b>B</b><br>&amp;lt; <img src=i></p>"))) == "## T\n\n**B**\n&lt;"
    assert value(text.hex_dump(F.lit(b"Hello"))) == "00000000  " + "48 65 6C 6C 6F ".ljust(24) + " " * 25 + "|Hello|"


def test_files_dropped_into_a_folder(spark, tmp_path):
    source = tmp_path / "drop"
    source.mkdir()
    (source / "a.bin").write_bytes(W.write_macbinary(W.file(name="A", data_fork=b"x", type_code="TEXT")))
    (source / "b.txt").write_bytes(b"no container")
    dropbox.into(dropbox.incoming(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    (source / "c.hqx").write_bytes(W.write_binhex(W.file(name="C", data_fork=b"y", type_code="TEXT")))
    dropbox.into(dropbox.incoming(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["name"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["A", "C"]
