"""General archives through the standard library, with resource forks from their AppleDouble companions."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import posixpath
import tarfile
import zipfile

from .containers import ContainerError, apple_order, file, read_apple


def archive_format(data: bytes) -> str | None:
    if data[:4] in (b"PK\3\4", b"PK\5\6"):
        return "zip"
    for magic, kind in ((b"\x1f\x8b", "gzip"), (b"BZh", "bzip2"), (b"\xfd7zXZ\0", "xz")):
        if data.startswith(magic):
            return kind
    return "tar" if data[257:262] == b"ustar" else None


def archive_members(data: bytes, name: str = "") -> list[tuple[str, bytes]]:
    """(path, content) of all files, of compressed tar archives too."""
    kind = archive_format(data)
    try:
        if kind == "zip":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
        if kind in ("gzip", "bzip2", "xz"):
            plain = {"gzip": gzip, "bzip2": bz2, "xz": lzma}[kind].decompress(data)
            if archive_format(plain) == "tar":
                return archive_members(plain, name)
            leaf = posixpath.basename(name)
            return [(leaf.rpartition(".")[0] or leaf or "content", plain)]
        if kind == "tar":
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                return [(m.name, t.extractfile(m).read()) for m in t if m.isfile()]
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, lzma.LZMAError, RuntimeError, NotImplementedError, ValueError) as e:
        raise ContainerError("corrupted data", str(e)) from e
    raise ContainerError("unsupported format", f"no reader for {name or 'this archive'}")


def companions(path: str) -> list[str]:
    """Where a file's AppleDouble companion may be, best first."""
    folder, leaf = posixpath.split(path)
    return [posixpath.join(folder, "._" + leaf), posixpath.join("__MACOSX", folder, "._" + leaf), posixpath.join("__MACOSX", "._" + leaf)]


def read_archive(data: bytes, name: str = "") -> list[dict]:
    """Files of an archive, hidden ones left out; the first companion that parses gives fork and codes."""
    members = archive_members(data, name)
    content = dict(reversed(members))
    out = []
    for path, body in members:
        if any(p.startswith(".") or p == "__MACOSX" for p in path.split("/")):
            continue
        f = file(name=path, data_fork=body)
        for c in companions(path):
            if c in content and apple_order(content[c]):
                f |= {k: v for k, v in read_apple(content[c]).items() if k in ("rsrc_fork", "type_code", "creator_code", "finder_flags")}
                break
        out.append(f)
    return out
