"""Recognition as Catalyst expressions, so that only candidates reach a reader in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.binary import col_be, col_crc16, col_le, col_padded_size, col_slice, col_starts
from ..functions.classify import extension


def _true(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def is_macbinary(data: Column) -> Column:
    size, rsrc, second = col_be(data, 83, 4), col_be(data, 87, 4), col_be(data, 120, 2)
    expected = F.lit(128) + col_padded_size(second) + col_padded_size(size) + col_padded_size(rsrc)
    zero = (col_be(data, 0, 1) == 0) & (col_be(data, 74, 1) == 0) & (col_be(data, 82, 1) == 0)
    sizes = (size + rsrc > 0) & (size < 1 << 31) & (rsrc < 1 << 31)
    return _true((F.octet_length(data) >= 128) & zero & col_be(data, 1, 1).between(1, 63) & sizes & F.octet_length(data).between(expected - 127, expected + 8192))


def is_empty_macbinary(data: Column) -> Column:
    """A file without forks, which is_macbinary takes for chance: version II or III, with the checksum that its header asks for."""
    zero = (col_be(data, 0, 1) == 0) & (col_be(data, 74, 1) == 0) & (col_be(data, 82, 1) == 0) & (col_be(data, 83, 4) == 0) & (col_be(data, 87, 4) == 0)
    expected = F.lit(128) + col_padded_size(col_be(data, 120, 2))
    whole = (F.octet_length(data) >= 128) & F.octet_length(data).between(expected - 127, expected + 8192)
    return _true(whole & zero & col_be(data, 1, 1).between(1, 63) & col_be(data, 122, 1).isin(0x81, 0x82) & (col_be(data, 124, 2) == col_crc16(data, 124)))


def macbinary_version(data: Column) -> Column:
    mark = col_be(data, 122, 1)
    return F.when(is_macbinary(data) | is_empty_macbinary(data), F.when(mark == 0x82, 3).when(mark == 0x81, 2).otherwise(1))


def macbinary_header(data: Column) -> Column:
    """Name length, sizes, flags and dates of a MacBinary file, without leaving the JVM."""
    from ..functions.binary import col_mac_roman
    from ..functions.dates import mac_timestamp

    n = col_be(data, 1, 1)
    return F.when(is_macbinary(data) | is_empty_macbinary(data), F.struct(
        col_mac_roman(F.substring(data, F.lit(3), n.cast("int"))).alias("name"), col_mac_roman(col_slice(data, 65, 4)).alias("type_code"), col_mac_roman(col_slice(data, 69, 4)).alias("creator_code"),
        (col_be(data, 73, 1) * 256 + col_be(data, 101, 1)).cast("int").alias("finder_flags"), col_be(data, 83, 4).alias("data_size"), col_be(data, 87, 4).alias("rsrc_size"),
        mac_timestamp(col_be(data, 91, 4)).alias("created"), mac_timestamp(col_be(data, 95, 4)).alias("modified"),
    ))


def is_apple(data: Column) -> Column:
    big = (col_starts(data, b"\0\x05\x16\0") | col_starts(data, b"\0\x05\x16\x07")) & (col_starts(data, b"\0\1\0\0", 4) | col_starts(data, b"\0\2\0\0", 4))
    return _true((F.octet_length(data) >= 26) & (big | col_starts(data, b"\0\x16\x05\0") | col_starts(data, b"\x07\x16\x05\0")))


def is_binhex(data: Column) -> Column:
    head = F.decode(F.substring(data, 1, 256), "ISO-8859-1")
    return _true(~head.rlike(r"[\x80-\xFF]") & F.contains(head, F.lit("(This file must be converted with BinHex")))


def is_binary_ii(data: Column) -> Column:
    return _true((F.octet_length(data) >= 128) & col_starts(data, b"\x0aGL") & (col_be(data, 18, 1) == 2))


def is_apple_link(data: Column) -> Column:
    return _true((F.octet_length(data) >= 20) & col_starts(data, b"fZink\x01", 4))


def identify(data: Column, name: Column) -> Column:
    by_name = F.when(extension(name) == "bin", "macbinary").when(extension(name) == "hqx", "binhex").when(extension(name).isin("bny", "bqy"), "binary_ii").when(extension(name) == "acu", "applelink")
    return F.when(is_macbinary(data) | is_empty_macbinary(data), "macbinary").when(is_apple(data), "applesingle").when(is_binhex(data), "binhex").when(is_binary_ii(data), "binary_ii").when(is_apple_link(data), "applelink").otherwise(by_name)


def image_format(data: Column) -> Column:
    n = F.octet_length(data)
    kind, size = col_be(data, 1, 1), col_be(data, 2, 2)
    dart = (col_be(data, 0, 1) <= 2) & ((kind.between(1, 3) & size.isin(400, 800)) | (kind.between(16, 18) & size.isin(720, 1440)))
    er = col_starts(data, b"ER")
    iso = col_starts(data, b"CD001", 32769)
    return (
        F.when(n <= 84, "unknown").when(_true(dart), "dart").when(col_starts(data, b"2IMG"), "2img").when(col_starts(data, b"WOZ"), "woz").when(col_starts(data, b"MOOF"), "moof")
        .when(er & col_starts(data, b"PM", 512) & (n >= 1024), "apm").when(er & col_starts(data, b"TS", 512) & (n >= 1024), "mac_ts")
        .when(_true(col_starts(data, b"\x01\0", 82) & col_be(data, 0, 1).between(1, 63) & (col_be(data, 64, 4) > 0) & (col_be(data, 64, 4) <= n)), "diskcopy")
        .when(F.substring(data, -512, 4) == F.lit(b"koly"), "udif").when(iso & (col_starts(data, b"BD", 1024) | (er & col_starts(data, b"PM", 2048))), "hybrid").when(iso, "iso")
        .when(F.contains(F.decode(F.substring(data, 1, 84), "ISO-8859-1"), F.lit("bcem")) | col_starts(data, b"ndif"), "ndif").when(n > 1026, "raw").otherwise("unknown")
    )


def _seven(data: Column, at: int, size: int) -> Column:
    """Bytes without their high bit, as text."""
    high = "".join(map(chr, range(128, 256)))
    low = "".join(map(chr, range(128)))
    return F.translate(F.decode(col_slice(data, at, size), "ISO-8859-1"), high, low)


def filesystem(data: Column) -> Column:
    n = F.octet_length(data)

    def dos(per_track: int) -> Column:
        at = 17 * per_track * 256
        sized = n.isin(35 * per_track * 256, 40 * per_track * 256, 50 * 32 * 256)
        return _true(sized & (col_be(data, at + 1, 1) == 17) & col_be(data, at + 2, 1).between(1, 31) & col_be(data, at + 0x34, 1).isin(35, 40, 50) & col_be(data, at + 0x35, 1).isin(13, 16, 32))

    def entry(at: int) -> Column:
        return F.decode(col_slice(data, at + 1, 15), "ISO-8859-1").rlike(r"(?s)^[\x20-\x7E\xA0-\xFE]{11}[\x00-\x1F].[\x00-\x3F][\x00-\x80]")

    def cpm(at: int) -> Column:
        live = [(col_be(data, at + 32 * i, 1), col_be(data, at + 32 * i + 1, 1)) for i in range(8)]
        sound, some = F.lit(True), F.lit(False)
        for i, (user, first) in enumerate(live):
            named = (user != 0xE5) & (first % 128).between(0x20, 0x7E)
            sound = sound & ((user == 0xE5) | (user <= 31)) & (~named | (user > 15) | entry(at + 32 * i))
            some = some | named
        return _true(sound & some)

    letters = _seven(data, 1031, 7)
    pascal = (n >= 3072) & (col_le(data, 1028, 2) == 0) & col_be(data, 1030, 1).between(1, 7) & (F.length(F.regexp_extract(letters, r"^[\x21-\x7E]*", 0)) >= col_be(data, 1030, 1))
    pascal_header = pascal & (col_le(data, 1024, 2) == 0) & (col_le(data, 1026, 2) == 6) & (col_le(data, 1038, 2) > 6) & (col_le(data, 1038, 2) <= F.floor(n / 512)) & (col_le(data, 1040, 2) <= 77)
    rdos, rdos_header = F.lit(False), F.lit(False)
    for per_track, size in ((16, 143_360), (13, 116_480)):
        head = _seven(data, per_track * 256, 24)
        rdos = rdos | head.rlike("RDOS|SSI")
        rdos_header = rdos_header | (n == size) & head.rlike(r"^(?=.*(RDOS|SSI))[\x20-\x7E]{24}\z")
    return (
        F.when(n <= 1026, "unknown").when(col_starts(data, b"BD", 1024), "hfs").when(col_starts(data, b"\xd2\xd7", 1024), "mfs").when(col_starts(data, b"H+", 1024), "hfs+")
        .when(_true((n >= 3072) & (col_be(data, 1028, 1) >= 0xF0)), "prodos").when(~_true(pascal_header) & _true(rdos_header), "rdos").when(dos(16) | dos(13), "dos33")
        .when(_true(pascal_header), "pascal").when(_true((n == 143_360) & cpm(12_288)) | _true((n == 819_200) & cpm(16_384)), "cpm")
        .when(_true(pascal), "pascal").when(_true(_seven(data, (17 * 16 + 7) * 256 + 16, 3) == "DIR"), "gutenberg").when(_true(rdos), "rdos").otherwise("unknown")
    )


def partition_holds(kind: Column) -> Column:
    k = F.lower(kind)
    return (
        F.when(k.isin("apple_hfs", "apple_hfsx"), "hfs").when(k == "apple_mfs", "mfs").when(k == "apple_prodos", "prodos").when(k.isin("apple_free", "apple_scratch"), "free")
        .when(k == "apple_partition_map", "map").when(k.startswith("apple_driver"), "driver").otherwise("other")
    )
