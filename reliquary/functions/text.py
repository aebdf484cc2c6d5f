"""Text and web functions as Catalyst expressions."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .binary import col_mac_roman


def normalize_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def read_text(data: Column) -> Column:
    """UTF-8 if it is, else MacRoman; line ends become LF."""
    return normalize_newlines(F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(col_mac_roman(data)))


def charset(data: Column) -> Column:
    return F.when(F.is_valid_utf8(data.cast("string")), F.lit("UTF-8")).otherwise(F.lit("MacRoman"))


#: Labels of legacy scripts and the codecs that stand for them.
CHARSETS = {"MacRoman": "mac_roman", "MacJapanese": "euc_jp", "MacCyrillic": "cp1251", "MacGreek": "cp1253", "MacCentralEurope": "cp1250", "UTF-8": "utf_8", "ASCII": "ascii"}


def decode_as(data: Column, label: str) -> Column:
    """Bytes in a legacy charset; undecodable ones become U+FFFD."""
    codec = CHARSETS[label]
    if codec not in ("euc_jp", "utf_8"):  # a byte is a character: no Python
        high = bytes(range(128, 256))
        return F.translate(F.decode(data, "ISO-8859-1"), high.decode("latin-1"), high.decode(codec, "replace"))

    @F.pandas_udf("string")
    def decode(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else bytes(b).decode(codec, "replace"))

    return decode(data)


def hex_dump(data: Column, most: int | None = 4096) -> Column:
    """16 bytes a row: offset, two groups of eight, ASCII; a last line says what is left out.
    None shows all. Digits and characters are cut into rows once, so time grows with what is shown."""
    shown = data if most is None else F.substring(data, 1, most)
    digits = F.regexp_extract_all(F.hex(shown), F.lit(".{1,32}"), F.lit(0))
    plain = F.regexp_extract_all(F.regexp_replace(F.decode(shown, "ISO-8859-1"), r"[^\x20-\x7E]", "."), F.lit(".{1,16}"), F.lit(0))
    group = lambda d, at: F.rpad(F.regexp_replace(F.substring(d, at, 16), "(..)", "$1 "), 24, " ")

    def row(x: Column, i: Column) -> Column:
        return F.concat(F.lpad(F.hex(i.cast("long") * 16), 8, "0"), F.lit("  "), group(x["d"], 1), F.lit(" "), group(x["d"], 17), F.lit("|"), x["p"], F.lit("|"))

    rows = F.transform(F.arrays_zip(digits.alias("d"), plain.alias("p")), row)
    if most is None:
        return F.array_join(rows, "\n")
    rest = F.when(F.octet_length(data) > most, F.array(F.concat(F.lit("... ("), (F.octet_length(data) - most).cast("string"), F.lit(" more bytes)")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(rows, rest), "\n")


def text_runs(data: Column, least: int = 8, tabs: bool = False, share: float = 0.5) -> Column:
    """Runs of printable bytes, of which more than `share` are letters or blanks; MacRoman."""
    allowed = r"[\x20-\x7E\x0D\x0A\x80-\xFE" + (r"\x09" if tabs else "") + "]{" + str(least) + ",}"
    runs = F.regexp_extract_all(F.decode(data, "ISO-8859-1"), F.lit(allowed), F.lit(0))
    kept = F.filter(runs, lambda r: F.length(F.regexp_replace(r, r"[^A-Za-z ]", "")) > F.length(r) * share)
    return F.transform(kept, lambda r: F.trim(normalize_newlines(col_mac_roman(F.encode(r, "ISO-8859-1")))))


#: (pattern, replacement, with {1} for the first group), in order; no look-around, so RE2 takes them too.
MARKDOWN = (
    (r"(?is)<(head|style|script)\b[^>]*>.*?</(head|style|script)>", ""),
    *((rf"(?is)<h{n}\b[^>]*>(.*?)</h{n}>", "\n" + "#" * n + " {1}\n") for n in range(1, 7)),
    (r"(?i)</?(b|strong)\b[^>]*>", "**"),
    (r"(?i)</?(i|em)\b[^>]*>", "*"),
    (r"(?i)</?u\b[^>]*>", "_"),
    (r"(?i)<li\b[^>]*>", "\n- "),
    (r"(?i)</?(ul|ol)\b[^>]*>", "\n"),
    (r"(?i)<br\b[^>]*>", "\n"),
    (r"(?i)</?p\b[^>]*>", "\n\n"),
    (r"(?s)<[^>]+>", ""),
)
#: &amp; comes last, so that nothing is decoded twice.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&"))


def html_to_markdown(html: Column) -> Column:
    for pattern, replacement in MARKDOWN:
        html = F.regexp_replace(html, pattern, replacement.replace("{1}", "$1"))
    for entity, plain in ENTITIES:
        html = F.replace(html, F.lit(entity), F.lit(plain))
    return F.regexp_replace(F.regexp_replace(html, r"\n{3,}", "\n\n"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]+>", "")


def html_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def safe_name(name: Column) -> Column:
    return F.translate(name, ":/", "__")


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def url_leaf(url: Column) -> Column:
    return _found(F.regexp_replace(url, r"[?#].*$", ""), r"://[^/]+/(?:.*/)?([^/]+)$")


def disposition_name(header: Column) -> Column:
    """File name of a Content-Disposition header: extended, then quoted, then bare form."""
    extended = F.try_url_decode(F.replace(_found(header, r"(?i)filename\*=UTF-8''([^;]+)"), F.lit("+"), F.lit("%2B")))
    return F.coalesce(extended, _found(header, r'(?i)filename="([^"]+)"'), F.trim(_found(header, r"(?i)filename=([^;\"]+)")))


def download_name(header: Column, url: Column) -> Column:
    return F.coalesce(disposition_name(header), url_leaf(url), F.lit("download"))


#: Hosts of download sites and their names.
SITES = (("macintoshrepository", "Macintosh Repository"), ("macintoshgarden", "Macintosh Garden"), ("archive.org", "Internet Archive"))


def site_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[^:]+://([^/?#]*)", 1))
    out = host
    for part, name in reversed(SITES):
        out = F.when(F.contains(host, F.lit(part)), F.lit(name)).otherwise(out)
    return out


def page_title(html: Column, url: Column) -> Column:
    """h1, else title, else the URL's leaf; tags inside go."""
    clean = lambda tag: F.nullif(F.trim(strip_tags(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))), F.lit(""))
    return F.coalesce(clean("h1"), clean("title"), url_leaf(url))


def page_description(html: Column) -> Column:
    return _found(html, r"(?is)<meta[^>]*name=[\"']description[\"'][^>]*content=[\"']([^\"']*)[\"']")


def page_hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)href="([^"]+)"'), F.lit(1))


#: Extensions of archives worth downloading.
DOWNLOADS = ("sit", "sitx", "sea", "hqx", "bin", "img", "dsk", "zip", "iso", "toast", "dmg")


def download_links(html: Column, any_extension: bool = False) -> Column:
    """Links to archives by extension, or those with 'download' in them."""
    wanted = (lambda h: F.contains(F.lower(h), F.lit("download"))) if any_extension else (lambda h: h.rlike(rf"(?i)\.({'|'.join(DOWNLOADS)})$"))
    return F.filter(page_hrefs(html), wanted)


@F.pandas_udf(T.ArrayType(T.StringType()))
def resolved(urls: pd.Series, base: pd.Series) -> pd.Series:
    """Links against the page's address."""
    return pd.Series([None if u is None else [urljoin(b or "", x) for x in u] for u, b in zip(urls, base, strict=True)])


def keyword_tokens(name: Column, *more: Column) -> Column:
    words = F.filter(F.split(name, r"[^A-Za-z0-9]+"), lambda w: w != "")
    return F.concat(words, F.filter(F.array(*more), lambda x: x.isNotNull()), F.array(F.lit("retro"), F.lit("vintage")))


def afm_fields(text: Column) -> Column:
    """Key and value of the first 40 lines, split at the first space; the last of a key wins."""
    lines = F.filter(F.slice(F.split(text, "\n"), 1, 40), lambda s: F.contains(s, F.lit(" ")))
    keys = F.transform(lines, lambda s: F.substring_index(s, " ", 1))
    last = F.filter(F.transform(lines, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: F.array_position(F.reverse(keys), F.substring_index(x["s"], " ", 1)) == F.size(keys) - x["i"])
    return F.map_from_entries(F.transform(last, lambda x: F.struct(F.substring_index(x["s"], " ", 1), F.regexp_extract(x["s"], r"^[^ ]* (.*)$", 1))))


def human_size(size: Column) -> Column:
    """Decimal units, one decimal from megabytes on."""
    return (
        F.when(size < 1000, F.concat(size.cast("string"), F.lit(" bytes")))
        .when(size < 1_000_000, F.concat(F.round(size / 1e3, 0).cast("long").cast("string"), F.lit(" KB")))
        .when(size < 1_000_000_000, F.format_string("%.1f MB", size / 1e6))
        .otherwise(F.format_string("%.2f GB", size / 1e9))
    )
