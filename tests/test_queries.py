"""Every registered query with SQL gives what DuckDB gives."""

import duckdb
import pytest
from pyspark.sql import functions as F

from reliquary import queries

QUICK = [n for n in queries.SQL if n not in ("codec_lzhuf",)]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 9)
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, dict):
        return str(sorted(x.items()))
    if isinstance(x, (list, tuple)):
        return str([plain(i) for i in x])
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return float(x) if isinstance(x, int) and not isinstance(x, bool) else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([names[i] for i in order]), sorted((tuple(repr(plain(r[i])) for i in order) for r in rows))


@pytest.mark.parametrize("name", QUICK)
def test_equals_sql(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    want = duck.sql(queries.SQL[name])
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def test_without_sql(spark, sf):
    assert queries.resolved_links(spark, sf).where("exists(links, x -> x like 'http%://%')").count() > 0
    row = queries.checksums(spark, sf).first()
    assert 0 <= row["crc"] < 1 << 16 and row["rotated"] >= 0
    assert queries.thumbnails(spark, sf).where("size > 50").count() == 200


def test_plans_prune_and_push(spark, sf):
    """Listing reads no more columns than it shows, and filters reach the scan."""
    text = queries.table(spark, sf, "documents").where("doc_id = 42").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,42)" in text and "text" not in text.split("ReadSchema")[1]


def test_long_conversations_keep_every_turn(spark, tmp_path):
    """40 turns, a turn of 300 KB, a turn that is there twice."""
    turns = [(1, i, f"turn {i} " * (i + 1)) for i in range(40)] + [(2, 0, "first"), (2, 1, "0123456789ä" * 28_000), (2, 2, "last"), (3, 7, "one"), (3, 7, "two")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for name in ("volume_gutenberg", "volume_dos33", "volume_dos32", "hybrid_disk"):
        df = queries.QUERIES[name](spark, str(tmp_path))
        con = duckdb.connect()
        con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        want = con.sql(queries.SQL[name])
        assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())
    turns = [(n, i, "0123456789" * 30_000 if i == 1 else f"turn {i}") for n in (2, 6, 7) for i in range(n)]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/large/conversations.parquet")
    assert {r[0]: r[1] for r in queries.probe_filesystems(spark, f"{tmp_path}/large").collect()} == {2: "dos33", 6: "gutenberg", 7: "dos33"}


def test_probe_takes_no_text_for_a_cpm_directory(spark):
    from reliquary.sources import containers, probe, volumes

    files = [containers.file(name="A", data_fork=bytes(4096)), containers.file(name="B", data_fork=b"\nshort end")]
    disks = [volumes.write_rdos(files), volumes.write_cpm([containers.file(name="A.TXT", data_fork=b"x" * 40_000)])]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(disks)], "i int, content binary")
    assert [r[0] for r in rows.orderBy("i").select(probe.filesystem(rows.content)).collect()] == ["rdos", "cpm"]


def test_charsets_of_single_bytes_need_no_python(spark):
    from reliquary.functions import text

    every = bytes(range(256))
    rows = spark.createDataFrame([(every,), (None,)], "data binary")
    for label, codec in text.CHARSETS.items():
        shown = rows.select(text.decode_as(rows.data, label))
        assert {r[0] for r in shown.collect()} == {every.decode(codec, "replace"), None}
        assert ("Python" in shown._jdf.queryExecution().executedPlan().toString()) == (codec in ("euc_jp", "utf_8"))


def empty_texts(spark, sf, path):
    """documents of sf, a text in three empty; its DuckDB."""
    spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "if(doc_id % 3 = 0, '', text) AS text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return con


def test_macbinary_headers_of_empty_texts(spark, sf, tmp_path):
    con = empty_texts(spark, sf, tmp_path)
    for name in ("macbinary_headers", "identify_containers"):
        df, want = queries.QUERIES[name](spark, str(tmp_path)), con.sql(queries.SQL[name])
        assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def test_unwrapped_macbinary_of_empty_texts(spark, sf, tmp_path):
    con = empty_texts(spark, sf, tmp_path)
    df, want = queries.unwrap_macbinary(spark, str(tmp_path)), con.sql(queries.SQL["unwrap_macbinary"])
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def test_a_file_without_forks_needs_its_checksum(spark):
    from reliquary.functions import binary, codecs
    from reliquary.sources import containers, probe

    blank = {v: containers.write_macbinary(containers.file(name="Blank", type_code="TEXT", creator_code="ttxt"), v) for v in (1, 2, 3)}
    other = blank[2][:124] + bytes(2) + blank[2][126:]
    named = blank[2][:2] + b"c" + blank[2][3:]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate((blank[2], blank[3], blank[2] + bytes(8192), blank[1], other, named, blank[2][:127], blank[2] + bytes(8193)))], "i int, content binary").orderBy("i")
    assert [r[0] for r in rows.select(probe.macbinary_version(rows.content)).collect()] == [2, 3, 2] + [None] * 5
    assert [r[0] for r in rows.select(probe.identify(rows.content, rows.i.cast("string"))).collect()] == ["macbinary"] * 3 + [None] * 5
    noise = bytes(range(256)) * 2
    rows = spark.createDataFrame([(noise[i : i + 130],) for i in range(256)] + [(b"short",)], "content binary")
    assert all(r[1] == (codecs.crc16(bytes(r[0][:124])) if len(r[0]) > 5 else None) for r in rows.select("content", binary.col_crc16(rows.content, 124)).collect())


def test_short_last_sector_is_no_cpm_directory(spark, tmp_path):
    """A turn ends with a line of eleven letters where a CP/M directory would lie: sector 48 of RDOS, block 24 of Pascal; or with DIR in Gutenberg's place."""
    tail = "\nEinungheit."
    turns = [(1, 0, "x" * 16 * 256 + tail), (1, 1, "next"), (2, 0, "x" * 18 * 512 + tail), (2, 1, "next"), (3, 0, "y" * 60_000), (3, 1, "z" * (71_440 - (32 + 235) * 256) + "DIR end")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    for name in ("volume_rdos", "volume_pascal", "image_dart", "image_diskcopy"):
        df, want = queries.QUERIES[name](spark, str(tmp_path)), con.sql(queries.SQL[name])
        assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def test_probe_goes_by_whole_headers_first(spark):
    from reliquary.sources import containers, probe, volumes

    a = lambda size, tail: [containers.file(name="A", data_fork=b"x" * size + tail), containers.file(name="B", data_fork=b"y")]
    line, cpm = b"\nEinungheit.", volumes.write_cpm([containers.file(name="A.TXT", data_fork=b"x" * 5000)])
    both = bytearray(volumes.write_dos(a(500, b"")))
    both[1024:2048] = volumes.write_pascal("P", a(500, b""))[1024:2048]
    disks = [volumes.write_rdos(a(4096, line)), volumes.write_pascal("P", a(18 * 512, line)), cpm, bytes(both), volumes.write_rdos(a(4096, line))[:4096] + b"\x01RDOS" + bytes(139_259), volumes.write_pascal("P", a(1024, b"all of MISSISSIPPI, and so on"))]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(disks)], "i int, content binary").orderBy("i")
    want = ["rdos", "pascal", "cpm", "dos33", "rdos", "pascal"]
    assert [volumes.filesystem_of(d) for d in disks] == want and [r[0] for r in rows.select(probe.filesystem(rows.content)).collect()] == want


def test_lzhuf_is_dealt_to_all_cores(spark, sf, duck):
    df = queries.codec_lzhuf(spark, sf)
    assert df.select(F.spark_partition_id()).distinct().count() > 4
    want = duck.sql(queries.SQL["codec_lzhuf"])
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())
