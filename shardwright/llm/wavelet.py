"""A wavelet matrix in one compressed file.

A sequence of token ids is stored as one bit-plane per bit, highest bit first; below
each plane the sequence is stably parted into its zeros and its ones. Planes are cut
into chunks, each compressed by itself, and a directory holds every chunk's place and
the number of ones before it. So one file answers, reading a few chunks each:
token at a place, occurrences of a token up to a place (rank), place of its k-th
occurrence (select), all its places, and the whole sequence again.

Tokens are stored as their place among the different tokens of the file, so a file has as
many planes as its own alphabet needs.

Layout (little endian): magic, then ``HEAD`` (tokens, documents, planes, chunks of a
plane, end id, different tokens), these tokens (u32, ascending), the number of zeros of each
plane (u64), the directory (u64 place, u32 stored size, u32 flags, u64 ones before; per plane
and chunk), the documents (i64 ids, u8 null flags, u32 token counts; compressed, their
stored size in front) and the chunks.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyarrow import fs

MAGIC, HEAD, SLOT = b"WAVEMAT1", "<QQIIQQ", np.dtype([("at", "<u8"), ("size", "<u4"), ("packed", "<u4"), ("ones", "<u8")])
CHUNK = 1 << 19            # bits of a chunk
STEP = 1 << 16             # bits put back in one step


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _pack(raw: bytes) -> tuple[bytes, int]:
    small = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
    return (small, 1) if len(small) < len(raw) else (raw, 0)


def write(uri: str, ids: np.ndarray, doc_ids: np.ndarray, null_ids: np.ndarray, counts: np.ndarray, end_id: int) -> int:
    """Writes ``ids`` to ``uri`` and returns the bytes written. The name must be one that no other attempt
    uses: nothing is moved or replaced, and a file counts when the manifest names it."""
    seen = np.zeros(int(ids.max(initial=0)) + 1, bool)
    for part in np.array_split(ids, -(-len(ids) // (1 << 20)) or 1):     # indexing widens: not all at once
        seen[part] = True
    alphabet = np.flatnonzero(seen).astype("<u4")
    planes = max(1, (len(alphabet) - 1).bit_length())
    place_of = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.uint16 if planes <= 16 else np.uint32)
    place_of[alphabet] = np.arange(len(alphabet))
    codes = np.empty(len(ids), place_of.dtype)
    for at in range(0, len(ids), 1 << 20):
        codes[at:at + (1 << 20)] = place_of[ids[at:at + (1 << 20)]]
    seq = pa.array(codes)
    n, per_plane = len(ids), -(-len(ids) // CHUNK)
    zeros, slots, body = np.zeros(planes, "<u8"), np.zeros((planes, per_plane), SLOT), []
    for k in range(planes):
        bits = np.packbits((seq.to_numpy() & place_of.dtype.type(1 << (planes - 1 - k))).astype(bool), bitorder="little")
        mask = pa.BooleanArray.from_buffers(pa.bool_(), n, [None, pa.py_buffer(bits)])
        low, high = seq.filter(pa.compute.invert(mask)), seq.filter(mask)
        zeros[k] = len(low)
        seq = pa.concat_arrays([low, high])
        ones = 0
        for c in range(per_plane):
            chunk = bits[c * CHUNK // 8:(c + 1) * CHUNK // 8]
            stored, packed = _pack(chunk.tobytes())
            slots[k, c] = (0, len(stored), packed, ones)
            ones += int(np.bitwise_count(chunk).sum())
            body.append(stored)
    docs = doc_ids.astype("<i8").tobytes() + null_ids.astype("u1").tobytes() + counts.astype("<u4").tobytes()
    packed_docs, flag = _pack(docs)
    front = MAGIC + struct.pack(HEAD, n, len(doc_ids), planes, per_plane, end_id, len(alphabet)) + alphabet.tobytes() + zeros.tobytes()
    after = len(front) + slots.nbytes + 12 + len(packed_docs)
    slots["at"] = (after + np.concatenate(([0], np.cumsum(slots["size"].ravel(), dtype=np.uint64)))[:-1]).reshape(slots.shape)
    store, path = place(uri)
    with store.open_output_stream(path) as out:
        out.write(front + slots.tobytes() + struct.pack("<IIi", len(packed_docs), len(docs), flag) + packed_docs)
        for stored in body:
            out.write(stored)
    return after + sum(map(len, body))


class Wavelet:
    """Reads one file; chunks are fetched when a question needs them."""

    def __init__(self, uri: str) -> None:
        store, path = place(uri)
        self.file = store.open_input_file(path)
        head = self.file.read_at(len(MAGIC) + struct.calcsize(HEAD), 0)
        if head[:len(MAGIC)] != MAGIC:
            raise ValueError(f"not a wavelet matrix file: {uri}")
        self.n, self.n_docs, self.planes, self.per_plane, self.end_id, size = struct.unpack_from(HEAD, head, len(MAGIC))
        at = len(head)
        self.alphabet = np.frombuffer(self.file.read_at(4 * size, at), "<u4")
        at += 4 * size
        self.zeros = np.frombuffer(self.file.read_at(8 * self.planes, at), "<u8").astype(np.int64)
        at += 8 * self.planes
        size = self.planes * self.per_plane * SLOT.itemsize
        self.slots = np.frombuffer(self.file.read_at(size, at), SLOT).reshape(self.planes, self.per_plane)
        self.docs_at, self.chunks = at + size, {}

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, null flags and token counts, in file order."""
        stored, size, flag = struct.unpack("<IIi", self.file.read_at(12, self.docs_at))
        raw = self.file.read_at(stored, self.docs_at + 12)
        raw = pa.decompress(raw, decompressed_size=size, codec="zstd", asbytes=True) if flag else raw
        d = self.n_docs
        return np.frombuffer(raw, "<i8", d), np.frombuffer(raw, "u1", d, 8 * d).astype(bool), np.frombuffer(raw, "<u4", d, 9 * d)

    def chunk(self, plane: int, c: int) -> np.ndarray:
        """The bits of a chunk, one byte each."""
        if (plane, c) not in self.chunks:
            if len(self.chunks) >= 4 * self.planes:
                self.chunks.clear()
            self.chunks[plane, c] = self._bits(plane, c)
        return self.chunks[plane, c]

    def _bits(self, plane: int, c: int) -> np.ndarray:
        slot = self.slots[plane, c]
        raw = self.file.read_at(int(slot["size"]), int(slot["at"]))
        m = min(CHUNK, self.n - c * CHUNK)
        if slot["packed"]:
            raw = pa.decompress(raw, decompressed_size=-(-m // 8), codec="zstd", asbytes=True)
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=m, bitorder="little")

    def rank1(self, plane: int, i: int) -> int:
        """Ones before place ``i`` of a plane."""
        if i >= self.n:
            return self.n - int(self.zeros[plane])
        c = i // CHUNK
        return int(self.slots[plane, c]["ones"]) + int(self.chunk(plane, c)[:i - c * CHUNK].sum(dtype=np.int64))

    def select(self, plane: int, bit: int, k: int) -> int:
        """Place of the ``k``-th (from 0) ``bit`` of a plane."""
        before = self.slots[plane]["ones"].astype(np.int64)
        if not bit:
            before = np.arange(self.per_plane) * CHUNK - before
        c = int(np.searchsorted(before, k, "right")) - 1
        return c * CHUNK + int(np.flatnonzero(self.chunk(plane, c) == bit)[k - before[c]])

    def code(self, token: int) -> int:
        """The token's place in the alphabet; -1 if the file does not hold it."""
        at = int(np.searchsorted(self.alphabet, token)) if token >= 0 else 0
        return at if at < len(self.alphabet) and self.alphabet[at] == token else -1

    def _down(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for k in range(self.planes):
            a, b = self.rank1(k, lo), self.rank1(k, hi)
            if token >> (self.planes - 1 - k) & 1:
                lo, hi = int(self.zeros[k]) + a, int(self.zeros[k]) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def access(self, i: int) -> int:
        """The token at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for k in range(self.planes):
            bit, ones = int(self.chunk(k, i // CHUNK)[i % CHUNK]), self.rank1(k, i)
            token = token << 1 | bit
            i = int(self.zeros[k]) + ones if bit else i - ones
        return int(self.alphabet[token])

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of ``token`` in places ``lo`` to before ``hi``."""
        token = self.code(token)
        if token < 0:
            return 0
        a, b = self._down(token, max(0, lo), min(self.n, self.n if hi is None else hi))
        return max(0, b - a)

    def locate(self, token: int, k: int) -> int:
        """Place of the ``k``-th (from 0) occurrence of ``token``."""
        token = self.code(token)
        if token < 0:
            raise IndexError(k)
        lo, hi = self._down(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for p in reversed(range(self.planes)):
            bit = token >> (self.planes - 1 - p) & 1
            at = self.select(p, bit, at - int(self.zeros[p]) if bit else at)
        return at

    def occurrences(self, token: int) -> np.ndarray:
        """All places of ``token``, ascending; a plane is read once."""
        token = self.code(token)
        if token < 0:
            return np.zeros(0, np.int64)
        lo, hi = self._down(token, 0, self.n)
        at = np.arange(lo, hi)
        for p in reversed(range(self.planes)):
            bit = token >> (self.planes - 1 - p) & 1
            at = np.flatnonzero(self.plane(p) == bit)[at - self.zeros[p] if bit else at]
        return np.sort(at)

    def plane(self, p: int) -> np.ndarray:
        return np.concatenate([self._bits(p, c) for c in range(self.per_plane)]) if self.per_plane else np.zeros(0, np.uint8)

    def sequence(self) -> np.ndarray:
        """All tokens, read back from the lowest plane upwards."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        seq = np.zeros(self.n, kind)
        for p in reversed(range(self.planes)):
            up, low, high, bit = np.empty(self.n, kind), 0, int(self.zeros[p]), kind(1 << (self.planes - 1 - p))
            for c in range(self.per_plane):
                bits = self._bits(p, c).view(bool)
                for at in range(0, len(bits), STEP):                     # places as indices: far faster than by a mask
                    part = bits[at:at + STEP]
                    zero, one = np.flatnonzero(~part), np.flatnonzero(part)
                    here = up[c * CHUNK + at:c * CHUNK + at + len(part)]
                    here[zero], here[one] = seq[low:low + len(zero)], seq[high:high + len(one)] | bit
                    low, high = low + len(zero), high + len(one)
            seq = up
        out = np.empty(self.n, "<u4")
        for at in range(0, self.n, 1 << 20):
            out[at:at + (1 << 20)] = self.alphabet[seq[at:at + (1 << 20)]]
        return out
