"""Token ids of whole documents in wavelet-matrix shards.

Documents are dealt by ranges of ``doc_id`` to shards of about ``shard_bytes`` of text.
One task encodes a shard in ``doc_id`` order, ends each document with ``end_id``, and writes
one file (see ``wavelet``) to the shared folder: a temporary name, then a move, so a
lost or repeated task leaves the same file. Starts in the whole stream come from the
shards' token counts by a two-level prefix sum. Nothing but file names and counts
reaches the driver's tables; ids are read back from the files.

A byte-level BPE never merges across its pre-tokens, so a text's ids are those of
its pre-tokens in a row. Texts of ASCII and Latin letters without two white-space
characters in a row are cut at their spaces, for a whole shard at once in Arrow: a
piece with the space or line feed before it starts and ends with a pre-token. The library
encodes every different word and tail of a piece once for the shard, many in one call, and
numpy puts the ids of the pieces together. A Python worker keeps the ids of the words it has met
for its next shards, up to ``KNOWN_BYTES`` for each lead. Any other text, and any text with ``<|``, goes
through the library whole.

Defined cases: a null text is an empty document (its end id alone); null ``doc_id``s come
first; documents with equal ids are ordered by their text's hash, equal texts are
interchangeable; an empty table writes no file and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.llm import wavelet
from shardwright.llm.common import scratch, staged
from shardwright.llm.texts import give_back
from shardwright.operators.ordering import prefix_sum

SHARD_BYTES = 32 << 20
END_ID = 2
KNOWN_BYTES = 32 << 20
PLAIN = re.compile("[\n -~À-ÖØ-öø-ſ]*")     # beyond ASCII letters only, none of them a number or space
START = "\r"                                # stands before a text's first piece
_BYTES = np.arange(256)
LETTER = (_BYTES >= 128) | (_BYTES >= 65) & (_BYTES <= 90) | (_BYTES >= 97) & (_BYTES <= 122)
JOINS = (_BYTES >= 48) & (_BYTES <= 57) | (_BYTES == 39)       # digits and the apostrophe: left to the library


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def strings(data: np.ndarray, held: np.ndarray, lens: np.ndarray) -> pa.Array:
    """Strings of the bytes of ``data`` that are ``held``, ``lens`` of them each."""
    off = np.concatenate(([0], np.cumsum(lens, dtype=np.int64)))
    return pa.Array.from_buffers(pa.large_string(), len(lens), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data[held]))])


def stretches(pool: np.ndarray, start: np.ndarray, lens: np.ndarray, entry: np.ndarray, total: int) -> np.ndarray:
    """``pool[start[e]:start[e] + lens[e]]`` of each entry ``e``, in a row."""
    out, done = np.empty(total, pool.dtype), 0
    for at in range(0, len(entry), 1 << 18):
        e = entry[at:at + (1 << 18)]
        n = lens[e]
        end = np.cumsum(n)
        here = int(end[-1])
        out[done:done + here] = pool[np.repeat(start[e] - end + n, n) + np.arange(here)]
        done += here
    return out


class Encoder:
    """Ids of the texts of a shard."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"                         # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        top = max(self.tokenizer.get_vocab(True).values())
        self.kind = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.feed = self.whole(["\n"])[0]
        self.met: dict[str, tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = {}

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, self.kind) for e in self.batch(texts, add_special_tokens=False)]

    def pieces(self, texts: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces without white space, each after ``lead``: all in a row, and how many
        each has. Many go into one text, with a line feed, whose id nothing else has, between."""
        if not texts:
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        rows = []
        for at in range(0, len(texts), 1 << 15):
            part = texts[at:at + (1 << 15)]
            rows += self.whole(["\n".join([lead + t for t in part[i:i + 500]]) + "\n" for i in range(0, len(part), 500)])
        ids = np.concatenate(rows)
        mark = ids == self.feed[0]
        ends = np.flatnonzero(mark)
        if len(ends) != len(texts):
            raise ValueError("a piece holds a line feed")
        return ids[~mark], np.diff(ends, prepend=-1) - 1

    def known(self, words: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different pieces, each after ``lead``: a pool, and where each piece's ids stand in it.
        Only pieces that no earlier call has met go through the library."""
        held, pool, start, lens = self.met.get(lead, (words.slice(0, 0), np.zeros(0, self.kind), *np.zeros((2, 0), np.int64)))
        at = pc.index_in(words, value_set=held)
        new = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        ids, n = self.pieces(words.take(pa.array(new)).to_pylist(), lead)
        at = at.fill_null(0).to_numpy().astype(np.int64)
        at[new] = len(held) + np.arange(len(new))
        start, lens = np.append(start, len(pool) + np.cumsum(n) - n), np.append(lens, n)
        pool = np.concatenate([pool, ids])
        held = pa.concat_arrays([held, words.take(pa.array(new))])
        size = lambda a, b: a.nbytes + b.nbytes + 16 * len(a)
        if size(held, pool) <= KNOWN_BYTES:
            self.met[lead] = held, pool, start, lens
        else:                                                            # begin anew with what this shard has, if that is small enough
            self.met.pop(lead, None)
            n = lens[at]
            own = stretches(pool, start, lens, at, int(n.sum()))
            if size(words, own) <= KNOWN_BYTES:
                self.met[lead] = words, own, np.cumsum(n) - n, n
        return pool, start[at], lens[at]

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with its end id, and how many each has."""
        column = pc.fill_null(column, "").cast(pa.large_string())
        plain = np.array([PLAIN.fullmatch(t) is not None and not any(x in t for x in ("  ", "\n\n", " \n", "\n ", "<|"))
                          for at in range(0, len(column), 2000) for t in column.slice(at, 2000).to_pylist()], bool)
        odd = self.whole(column.filter(pa.array(~plain)).to_pylist())
        mark, nothing = pa.scalar(START, pa.large_string()), pa.scalar("", pa.large_string())
        cut = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(
            mark, column if plain.all() else column.filter(pa.array(plain)), nothing), "\n", " \n"), " ")
        n_texts = len(column)
        del column
        sizes = np.diff(cut.offsets.to_numpy())
        coded = cut.flatten().dictionary_encode()
        del cut
        index, keys = coded.indices.to_numpy(), coded.dictionary
        pool, start, lens = self.table(keys)
        # the end mark and the texts taken whole are entries of the table like any other
        extra = [np.array([end_id], self.kind), *odd]
        more = np.array([len(x) for x in extra], np.int64)
        start, lens = np.append(start, len(pool) + np.cumsum(more) - more), np.append(lens, more)
        pool = np.concatenate([pool, *extra])
        end, first = len(keys), len(keys) + 1
        per_text = np.full(n_texts, 2, np.int64)
        per_text[plain] = sizes + 1
        stop = np.cumsum(per_text)
        entry = np.empty(int(stop[-1]) if len(stop) else 0, np.int32)
        own = np.ones(len(entry), bool)
        own[stop - 1] = own[stop[~plain] - 2] = False
        entry[np.flatnonzero(own)] = index
        entry[stop - 1], entry[stop[~plain] - 2] = end, first + np.arange(len(odd))
        del coded, index, own
        counts = np.add.reduceat(lens.astype(np.int32)[entry], stop - per_text, dtype=np.int64) if len(stop) else np.zeros(0, np.int64)
        return stretches(pool, start, lens, entry, int(counts.sum())), counts

    def table(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the different pieces: a pool, and where each piece's ids stand in it."""
        n = len(keys)
        off = np.frombuffer(keys.buffers()[1], np.int64 if pa.types.is_large_string(keys.type) else np.int32)[keys.offset:keys.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        data = np.frombuffer(keys.buffers()[2], np.uint8)[off[0]:off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
        off = off - off[0]
        size = np.diff(off)
        first = np.where(size > 0, data[np.minimum(off[:-1], max(0, len(data) - 1))] if len(data) else 0, 0)
        lead = np.isin(first, (10, 13)).astype(np.int64)                       # a line feed or the text's start
        begin = off[:-1] + lead
        count = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[off])
        letter = LETTER[data]
        rise = letter & ~np.concatenate(([False], letter[:-1]))
        rise[off[:-1][size > 0]] = letter[off[:-1][size > 0]]
        starts_so = (size > lead) & letter[np.minimum(begin, max(0, len(data) - 1))] if len(data) else np.zeros(n, bool)
        simple = starts_so & (count(rise) == 1) & (count(JOINS[data]) == 0)    # one word, then a tail of signs
        letters = count(letter)
        held = np.repeat(simple, size)
        tail = strings(data, held & ~letter & (np.arange(len(data)) >= np.repeat(begin, size)), (size - lead - letters)[simple])
        word = strings(data, held & letter, letters[simple])
        pool, place, width = [self.feed], np.zeros((n, 3), np.int64), np.zeros((n, 3), np.int64)
        at = len(self.feed)

        def put(where: np.ndarray, slot: int, what: pa.Array, before: str) -> None:
            nonlocal at
            coded = what.dictionary_encode()
            ids, start, lens = self.known(coded.dictionary, before)
            code = coded.indices.to_numpy()
            place[where, slot], width[where, slot] = at + start[code], lens[code]
            pool.append(ids)
            at += len(ids)

        which, bare = np.flatnonzero(simple), (lead > 0)[simple]
        put(which[bare], 1, word.filter(pa.array(bare)), "")
        put(which[~bare], 1, word.filter(pa.array(~bare)), " ")
        signs = (size - lead - letters)[simple] > 0
        put(which[signs], 2, tail.filter(pa.array(signs)), "")
        other = ~simple & (size > lead)
        rest = strings(data, np.repeat(other, size) & (np.arange(len(data)) >= np.repeat(begin, size)), (size - lead)[other])
        which, bare = np.flatnonzero(other), (lead > 0)[other]
        put(which[bare], 1, rest.filter(pa.array(bare)), "")
        put(which[~bare], 1, rest.filter(pa.array(~bare)), " ")
        width[first == 10, 0] = len(self.feed)
        space = self.whole([" "])[0]
        place[size == 0, 1], width[size == 0, 1] = at, len(space)
        pool = np.concatenate([*pool, space])
        lens = width.sum(1)
        table = stretches(pool, place.ravel(), width.ravel(), np.arange(3 * n), int(lens.sum()))
        return table, np.cumsum(lens) - lens, lens


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """The encoder of this Python worker, which serves one task after the other."""
    return Encoder(path)


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes ``folder/shard-*.wm``, each attempt of a task under names of its own; returns the manifest ``(shard, path, n_docs, n_tokens, start)``, one row a file."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(1, math.ceil(total / shard_bytes))
    at = F.xxhash64("text").alias("_h")
    dealt = (own.select("doc_id", "text", at).repartitionByRange(n_shards, F.col("doc_id").asc_nulls_first(), "_h")
             .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_h").select("doc_id", "text"))
    folder = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = None, TaskContext.get().partitionId() << 20
        held: list[pa.RecordBatch] = []

        def ended() -> pa.RecordBatch:
            nonlocal number
            key = pa.chunked_array([b.column("doc_id") for b in held]).combine_chunks()
            column = [pa.chunked_array([b.column("text").cast(pa.large_string()) for b in held]).combine_chunks()]
            held.clear()
            ids, counts = encoder.encode(column.pop(), end_id)           # the encoder lets go of the texts when it has cut them
            give_back()
            path = f"{folder}/shard-{number:012d}-{uuid.uuid4().hex}.wm"          # of this attempt alone
            wavelet.write(path, ids, key.fill_null(0).to_numpy(), key.is_null().to_numpy(zero_copy_only=False), counts, end_id)
            row = pa.RecordBatch.from_pydict({"shard": pa.array([number], pa.int64()), "path": [path],
                                              "n_docs": pa.array([len(counts)], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int64())})
            number += 1
            return row

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if encoder is None:
                encoder = encoder_of(tokenizer or _default_path())
                store, local = wavelet.place(folder)
                store.create_dir(local, recursive=True)
            held.append(batch)
            size += batch.column("text").nbytes
            del batch
            if size >= 2 * shard_bytes:                                   # ranges of ids are drawn by sampling: some are larger
                yield ended()
                size = 0
        if held:
            yield ended()
            give_back()

    written = staged(dealt.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long"), "token-shards")
    return prefix_sum(written, "n_tokens", "shard", F.shiftright("shard", 24), "start")


def read_shards(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, shard`` of every document, decoded from the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = wavelet.Wavelet(row["path"])
                ids, null, n = file.documents()
                seq = file.sequence()
                ends = np.cumsum(n, dtype=np.int64)
                crc = np.empty(len(n), np.int64)
                for d, (a, b) in enumerate(zip((ends - n).tolist(), ends.tolist())):
                    crc[d] = zlib.crc32(seq[a:b].astype("<u4"))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids, pa.int64(), mask=null), "start": pa.array(row["start"] + ends - n),
                    "n_tokens": pa.array(n.astype(np.int64)), "ids_crc32": pa.array(crc),
                    "shard": pa.array(np.full(len(n), row["shard"], np.int64))})
                del file, seq
                give_back()

    n = max(1, manifest.count())
    return (manifest.select("shard", "path", F.col("start").cast("long").alias("start")).repartitionByRange(n, "shard")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long"))


def encode_and_read(docs: DataFrame, **options) -> DataFrame:
    """The shards of ``docs`` in a fresh folder of the shared store, and what they say when read back."""
    return read_shards(write_shards(docs, scratch(docs.sparkSession, "tokens"), **options))
