"""Readers as table operators: rows of bytes become rows of files, resources or partitions.

Each reader runs in the tasks that hold the bytes; there is no shuffle. Rows of blobs are large:
read with small Arrow batches (`blob_batches`). A reader's failure is a row with `error` set, or
with mode FAILFAST ends the job.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from ..functions import resources as R
from . import archives, containers, disks, volumes
from .containers import ContainerError

EXTRACTED = (
    "source_id string, ordinal int, name string, data_fork binary, rsrc_fork binary, type_code string, creator_code string, "
    "finder_flags int, created timestamp_ntz, modified timestamp_ntz, error string"
)
RESOURCES = "owner_id string, ordinal int, type_code string, resource_id short, name string, attributes short, data_offset int, data_length int"
PARTITIONS = "source_id string, ordinal int, scheme string, name string, type string, start_block long, block_count long, error string"
INFO = "source_id string, format string, disk_type string, name string, data_size long, filesystem string, error string"
_INFO = pa.schema([("source_id", pa.string()), ("format", pa.string()), ("disk_type", pa.string()), ("name", pa.string()), ("data_size", pa.int64()), ("filesystem", pa.string()), ("error", pa.string())])
_EXTRACTED = pa.schema([
    ("source_id", pa.string()), ("ordinal", pa.int32()), ("name", pa.string()), ("data_fork", pa.binary()), ("rsrc_fork", pa.binary()), ("type_code", pa.string()), ("creator_code", pa.string()),
    ("finder_flags", pa.int32()), ("created", pa.timestamp("us")), ("modified", pa.timestamp("us")), ("error", pa.string()),
])
_RESOURCES = pa.schema([("owner_id", pa.string()), ("ordinal", pa.int32()), ("type_code", pa.string()), ("resource_id", pa.int16()), ("name", pa.string()), ("attributes", pa.int16()), ("data_offset", pa.int32()), ("data_length", pa.int32())])
_PARTITIONS = pa.schema([("source_id", pa.string()), ("ordinal", pa.int32()), ("scheme", pa.string()), ("name", pa.string()), ("type", pa.string()), ("start_block", pa.int64()), ("block_count", pa.int64()), ("error", pa.string())])


def blob_batches(spark: SparkSession, rows: int = 32) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def read_image(data: bytes, name: str = "") -> list[dict]:
    """Files on a disk image: unpack it, find the volume, read it."""
    return volumes.read_volume(disks.raw_sectors(data)[1])


def read_anything(data: bytes, name: str = "") -> list[dict]:
    """By name as catalogs route: small containers, disk images, then archives; [] if it is none."""
    if containers.identify(data, name):
        return containers.unwrap(data, name)
    if archives.archive_format(data):
        return archives.read_archive(data, name)
    kind = disks.image_format(data)
    if kind not in ("raw", "unknown") or volumes.filesystem_of(data) in volumes.READERS:
        return read_image(data, name)
    return []


READERS = {
    "container": containers.unwrap,
    "image": read_image,
    "volume": lambda data, name="": volumes.read_volume(data),
    "hybrid": lambda data, name="": volumes.read_hybrid(data),
    "dual_dos": lambda data, name="": volumes.read_dual_dos(data),
    "archive": archives.read_archive,
    "any": read_anything,
}


def gathered(rows, schema: pa.Schema, most: int = 256, size: int = 8 << 20):
    """Batches of so many rows, or of rows with so many bytes in them, at most; a larger row is alone."""
    held, weight = [], 0
    for r in rows:
        own = sum(len(v) for v in r.values() if isinstance(v, (bytes, bytearray)))
        if held and (len(held) >= most or weight + own > size):
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, weight = [], 0
        held.append(r)
        weight += own
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def read_files(df: DataFrame, reader: str = "any", source: str = "source_id", data: str = "content", name: str | None = "name", mode: str = "PERMISSIVE", forks: bool = True) -> DataFrame:
    """EXTRACTED rows of each input row. forks=False: listing only, forks stay empty."""
    read = READERS[reader]

    def rows(batches):
        for b in batches:
            for s, d, n in zip(b[source].to_pylist(), b[data], b[name].to_pylist() if name else [""] * b.num_rows, strict=True):
                try:
                    files = read(d.as_py() or b"", n or "")
                except (ContainerError, IndexError, ValueError) as e:
                    if mode == "FAILFAST":
                        raise
                    files = []
                    yield {"source_id": s, "ordinal": None, "error": str(e)}
                for i, f in enumerate(files):
                    yield f | {"source_id": s, "ordinal": i} | ({} if forks else {"data_fork": None, "rsrc_fork": None})

    def task(batches):
        yield from gathered(rows(batches), _EXTRACTED)

    columns = [source, data] + ([name] if name else [])
    return df.select(*columns).mapInArrow(task, EXTRACTED)


def read_resources(df: DataFrame, owner: str = "id", fork: str = "rsrc_fork") -> DataFrame:
    def task(batches):
        forks = ((o, f.as_py() or b"") for b in batches for o, f in zip(b[owner].to_pylist(), b[fork], strict=True))
        yield from gathered((r._asdict() | {"owner_id": o} for o, f in forks for r in R.parse_fork(f)), _RESOURCES, 5000)

    return df.select(owner, fork).mapInArrow(task, RESOURCES)


def read_partitions(df: DataFrame, source: str = "source_id", data: str = "content") -> DataFrame:
    def task(batches):
        blobs = ((s, d.as_py() or b"") for b in batches for s, d in zip(b[source].to_pylist(), b[data], strict=True))
        found = (p._asdict() | {"source_id": s, "error": None} for s, d in blobs for p in disks.partitions(d))
        yield from gathered(({k: r.get(k) for k in _PARTITIONS.names} for r in found), _PARTITIONS, 5000)

    return df.select(source, data).mapInArrow(task, PARTITIONS)


def read_image_info(df: DataFrame, source: str = "source_id", data: str = "content") -> DataFrame:
    """What disk images say of themselves, WOZ and MOOF included; an error for what isn't one."""
    def info(s, d):
        try:
            found = disks.nibble_image(d)
            if found is None:
                kind, raw, said = disks.raw_sectors(d)
                found = {"format": kind, "disk_type": said.get("order"), "name": said.get("name"), "data_size": len(raw), "filesystem": volumes.filesystem_of(raw)}
        except (ContainerError, IndexError, ValueError) as e:
            found = {"error": str(e)}
        return {k: found.get(k) for k in _INFO.names} | {"source_id": s}

    def task(batches):
        yield from gathered((info(s, d.as_py() or b"") for b in batches for s, d in zip(b[source].to_pylist(), b[data], strict=True)), _INFO, 5000)

    return df.select(source, data).mapInArrow(task, INFO)


_UNWRAPPED = T.StructType([
    T.StructField("ordinal", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("data_fork", T.BinaryType()), T.StructField("rsrc_fork", T.BinaryType()),
    T.StructField("type_code", T.StringType()), T.StructField("creator_code", T.StringType()), T.StructField("finder_flags", T.IntegerType()),
])


@udtf(returnType=_UNWRAPPED)
class Unwrap:
    """SQL form: SELECT ... FROM t, LATERAL unwrap(content, name)."""

    def eval(self, content: bytes, name: str):
        try:
            files = read_anything(bytes(content or b""), name or "")
        except (ContainerError, IndexError, ValueError):
            return
        for i, f in enumerate(files):
            yield i, f["name"], f["data_fork"], f["rsrc_fork"], f["type_code"], f["creator_code"], f["finder_flags"]


def register(spark: SparkSession) -> None:
    spark.udtf.register("unwrap", Unwrap)
