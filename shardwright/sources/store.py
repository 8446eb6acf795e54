"""Files of a corpus by URI: local folders, HDFS and object stores alike.

Data, metadata and ledger paths are URIs (a bare absolute path is a local one). A
file appears under its name only when it is complete: it is written under a
temporary name and moved.
"""

from __future__ import annotations

import fnmatch
import posixpath
import uuid
import zlib

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it (``file:/x`` as Spark writes it, too)."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def below(uri: str, *names: str) -> str:
    return "/".join([uri.rstrip("/"), *names])


def exists(uri: str) -> bool:
    store, path = place(uri)
    return store.get_file_info(path).type != fs.FileType.NotFound


def is_file(uri: str) -> bool:
    store, path = place(uri)
    return store.get_file_info(path).type == fs.FileType.File


def size(uri: str) -> int:
    store, path = place(uri)
    return store.get_file_info(path).size


def listing(folder: str, pattern: str = "*") -> list[tuple[str, int]]:
    """``(uri, bytes)`` of the files of a folder whose name matches, by name."""
    store, path = place(folder)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((below(folder, f.base_name), f.size) for f in found
                  if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern))


def read(uri: str, offset: int, n: int) -> bytes:
    store, path = place(uri)
    with store.open_input_file(path) as f:
        return f.read_at(n, offset)


def checksum(uri: str) -> tuple[int, int]:
    """Bytes and CRC-32 of a file, read in pieces."""
    store, path = place(uri)
    n = crc = 0
    with store.open_input_stream(path) as f:
        while chunk := f.read(1 << 22):
            n, crc = n + len(chunk), zlib.crc32(chunk, crc)
    return n, crc


def move(source: str, target: str) -> None:
    """Renames within a store; a file already there (of an earlier attempt) is replaced."""
    store, a = place(source)
    _, b = place(target)
    if not isinstance(store, fs.LocalFileSystem) and store.get_file_info(b).type != fs.FileType.NotFound:
        store.delete_file(b)
    store.move(a, b)


def put(uri: str, data: bytes) -> None:
    """A small file, whole or not at all."""
    store, path = place(uri)
    store.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{uri}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(place(part)[1]) as out:
        out.write(data)
    move(part, uri)


def copy(source: str, target: str) -> None:
    """A file of any size from store to store, in pieces."""
    a, path = place(source)
    b, to = place(target)
    b.create_dir(posixpath.dirname(to), recursive=True)
    part = f"{target}.{uuid.uuid4().hex}.tmp"
    with a.open_input_stream(path) as src, b.open_output_stream(place(part)[1]) as out:
        while chunk := src.read(1 << 22):
            out.write(chunk)
    move(part, target)


def remove(uri: str) -> None:
    store, path = place(uri)
    kind = store.get_file_info(path).type
    if kind == fs.FileType.Directory:
        store.delete_dir(path)
    elif kind != fs.FileType.NotFound:
        store.delete_file(path)
