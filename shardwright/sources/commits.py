"""What a folder of shards consists of: commits that name their files.

Every attempt of a writing task puts its files into a folder of its own, under their final
names; nothing is renamed, replaced or deleted. The shards of a write become visible at once, when the
driver writes one small file to ``_commits`` that names them with their bytes and checksums.
Files that no commit names (of a lost, doubled or aborted attempt) are not there for readers.

A commit ends with a line that counts and checks the lines before it: a file that is not yet whole
does not count. Every ``SNAPSHOT``-th commit also repeats what came before, so a
reader opens the last such file and at most ``SNAPSHOT`` more, however many commits there are.
"""

from __future__ import annotations

import posixpath
import time
import uuid
import zlib
from dataclasses import dataclass

from shardwright.sources import store

FOLDER, DATA, SNAPSHOT = "_commits", "data", 16


@dataclass(frozen=True)
class ShardFile:
    shard: int
    bytes: int
    crc32: int
    path: str                      # below the folder

    def line(self) -> str:
        return f"{self.shard}\t{self.bytes}\t{self.crc32}\t{self.path}\n"


def attempt_folder() -> str:
    """A folder below the target that no other attempt uses."""
    return f"{DATA}/{uuid.uuid4().hex}"


def parse(text: str) -> list[ShardFile] | None:
    """The files of a commit; none if it is not whole."""
    body, _, end = text.rstrip("\n").rpartition("\n")
    body = body + "\n" if body else ""
    if end.split("\t") != ["end", str(body.count("\n")), str(zlib.crc32(body.encode()))]:
        return None
    rows = (line.split("\t") for line in body.splitlines())
    return [ShardFile(int(s), int(b), int(c), p) for s, b, c, p in rows]


def _names(folder: str) -> list[str]:
    return [posixpath.basename(uri) for uri, _ in store.listing(store.below(folder, FOLDER), "*.txt")]


def _read(folder: str, name: str) -> list[ShardFile] | None:
    uri = store.below(folder, FOLDER, name)
    return parse(store.read(uri, 0, store.size(uri)).decode())


def committed(folder: str) -> dict[int, ShardFile] | None:
    """The file of each shard, of the last commit that names it; ``None`` without any commit."""
    tail: list[list[ShardFile]] = []
    for name in reversed(_names(folder)):
        got = _read(folder, name)
        if got is not None:
            tail.append(got)
            if name.endswith("-all.txt"):
                break
    return {f.shard: f for files in reversed(tail) for f in files} if tail else None


def commit(folder: str, files: list[ShardFile]) -> None:
    """Makes ``files`` part of the folder, all at once."""
    before = _names(folder)
    since = next((i for i, n in enumerate(reversed(before)) if n.endswith("-all.txt")), len(before))
    whole = since >= SNAPSHOT
    if whole:
        files = list(({f.shard: f for f in (committed(folder) or {}).values()} | {f.shard: f for f in files}).values())
    body = "".join(f.line() for f in sorted(files, key=lambda f: f.shard))
    text = body + f"end\t{len(files)}\t{zlib.crc32(body.encode())}\n"
    # later commits sort behind earlier ones, whatever the clock says
    stamp = max(time.time_ns(), 1 + int(before[-1].split("-")[0]) if before else 0)
    where, path = store.place(store.below(folder, FOLDER, f"{stamp:020d}-{uuid.uuid4().hex}{'-all' if whole else ''}.txt"))
    where.create_dir(posixpath.dirname(path), recursive=True)
    with where.open_output_stream(path) as out:
        out.write(text.encode())


def unnamed(folder: str) -> list[str]:
    """Files of attempts that no commit names: what lost and doubled attempts left."""
    named = {f.path for f in (committed(folder) or {}).values()}
    where, path = store.place(store.below(folder, DATA))
    found = where.get_file_info(store.fs.FileSelector(path, allow_not_found=True, recursive=True))
    below = [f"{DATA}/{f.path[len(path):].lstrip('/')}" for f in found if f.type == store.fs.FileType.File]
    return sorted(store.below(folder, p) for p in below if p not in named)
