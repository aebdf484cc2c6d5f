"""Sinks: data files with AppleDouble companions and a manifest, an HTML card, JSON rows."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import apple_double
from ..functions.text import safe_name
from ..operators import listing


def export_rows(entries: DataFrame, forks: DataFrame) -> DataFrame:
    """path and content of every file to write: the data forks at full depth, and `._name` beside
    those with a resource fork or a type."""
    files = entries.where(~F.col("is_dir")).join(listing.paths(entries).select("id", F.col("path").alias("full")), "id").join(forks, "id")

    def lay_out(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                folder, slash, leaf = r["full"].rpartition("/")
                out.append({"path": r["full"], "content": r["data_fork"] or b""})
                if r["rsrc_fork"] or r["type_code"]:
                    out.append({"path": f"{folder}{slash}._{leaf}", "content": apple_double(r["rsrc_fork"] or b"", r["type_code"], r["creator_code"], r["finder_flags"] or 0)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return files.select(safe_segments(F.col("full")).alias("full"), "data_fork", "rsrc_fork", "type_code", "creator_code", "finder_flags").mapInArrow(lay_out, "path string, content binary")


def safe_segments(path):
    return F.array_join(F.transform(F.split(path, "/"), lambda s: safe_name(s)), "/")


def write_files(rows: DataFrame, write) -> None:
    """Hand every (path, content) to `write`, a function of both that puts it into a store all can reach."""

    def put(part):
        for r in part:
            write(r["path"], bytes(r["content"]))

    rows.foreachPartition(put)


def manifest(entries: DataFrame) -> DataFrame:
    columns = sorted(("id", "name", "path", "type_code", "creator_code", "data_size", "rsrc_size", "data_sha256", "rsrc_sha256"))
    return entries.where(~F.col("is_dir")).select(F.to_json(F.struct(*columns)).alias("json"))


def summary_html(entries: DataFrame, name: str) -> str:
    """The card of a catalog: one row of numbers, the first roots, the commonest types."""
    escape = lambda s: str(s).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    numbers = listing.summary(entries).first().asDict()
    roots, kinds = listing.first_roots(entries).select("name", "is_dir").collect(), listing.type_histogram(entries).collect()
    cells = "".join(f"<td>{escape(k)}: {v}</td>" for k, v in numbers.items())
    names = "".join(f"<li>{'📁' if r['is_dir'] or '.' not in r['name'] else '📄'} {escape(r['name'])}</li>" for r in roots)
    types = "".join(f"<li>{escape(k['type_code'])}: {k['n']}</li>" for k in kinds)
    return f"<html><body><h1>{escape(name)}</h1><table><tr>{cells}</tr></table><ul>{names}</ul><ul>{types}</ul></body></html>"


def history_json(history: DataFrame) -> str:
    return json.dumps([json.loads(r[0]) for r in history.select(F.to_json(F.struct(*history.columns))).toLocalIterator()])
