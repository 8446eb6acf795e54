"""Text → token ids as Spark jobs.

Encoders add ``ids ARRAY<INT>`` (without EOS; ``with_eos`` appends it) and are
applied per partition: the byte encoder is vectorised over slices of Arrow batches,
the word encoder stays in the JVM, and a tokenizer library runs once per Python
worker over Arrow batches. No document is ever gathered on the driver.
"""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardwright.config import UINT16_MAX, check_vocab

# Fixed values of the built-in encoders.
BYTE_EOS = 256                 # byte encoder: ids 0..255 are UTF-8 bytes, 256 is EOS
BYTE_VOCAB = 257
WORD_PATTERN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"   # letters/digits runs, or one symbol
WORD_EOS = 0                   # word encoder: 0 = EOS, 1 = unknown, 2.. by frequency
WORD_UNK = 1
# What a Python worker works on at a time, of an Arrow batch of any size.
PIECE_BYTES = 1 << 20          # of texts or packed ids
PIECE_VALUES = 1 << 18         # words or ids


class Encoder(Protocol):
    """Anything that turns a DataFrame of texts into id arrays."""

    name: str
    revision: str
    vocab_size: int
    eos_id: int

    def encode(self, df: DataFrame, text_col: str = "text", out: str = "ids") -> DataFrame: ...


def _spread(df: DataFrame) -> DataFrame:
    """Per-row encoding is CPU bound: make sure it runs on every core (no-op
    when the input already has enough partitions, e.g. after a shuffle)."""
    from shardwright.sources.documents import balance

    key = df.columns[0]
    return balance(df, key)


def _ids_schema(df: DataFrame, out: str) -> T.StructType:
    return T.StructType(list(df.schema.fields) + [T.StructField(out, T.ArrayType(T.IntegerType()))])


def pieces(batches, col: str, most: int):
    """The batches in slices of rows that hold about ``most`` bytes (of a list: values) of a column; a longer
    row is a slice of its own. What a worker makes of a slice is gone before the next one is made."""
    for rb in batches:
        c = rb.column(col)
        listed = pa.types.is_list(c.type) or pa.types.is_large_list(c.type)
        n = (pc.list_value_length if listed else pc.binary_length)(c)
        ends = np.cumsum(n.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(ends):
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield rb.slice(at, to - at)
            at = to


def _utf8_bytes_to_ids(text: pa.Array) -> pa.Array:
    """One list of byte ids per string, vectorised over the Arrow buffers."""
    if text.null_count:
        raise ValueError("document text is null; null text is not a document")
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if pa.types.is_string(text.type):
        binary = text.cast(pa.binary())
        off_type = np.int32
    else:
        binary = text.cast(pa.large_binary())
        off_type = np.int64
    bufs = binary.buffers()
    n = len(binary)
    offsets = np.frombuffer(bufs[1], dtype=off_type)[binary.offset: binary.offset + n + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    values = data[offsets[0]: offsets[-1]].astype(np.int32)
    rel = (offsets - offsets[0]).astype(np.int64)
    if rel[-1] >= 2**31:
        return pa.LargeListArray.from_arrays(pa.array(rel, pa.int64()), pa.array(values))
    return pa.ListArray.from_arrays(pa.array(rel.astype(np.int32)), pa.array(values))


def pack_ids(df: DataFrame, ids_col: str = "ids", out: str = "tokens") -> DataFrame:
    """An id array as little-endian 16-bit numbers in one BINARY: half the bytes, no
    per-element work on the way to a shard file."""
    names = [c for c in df.columns if c != ids_col]
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(out, T.BinaryType())])

    def run(batches):
        for rb in pieces(batches, ids_col, PIECE_VALUES):
            lists = rb.column(ids_col)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            if flat.size and (flat.min() < 0 or flat.max() > UINT16_MAX):
                raise ValueError("token id outside 0..65535")
            offs = np.asarray(lists.offsets).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in names), _binaries(flat.astype("<u2"), offs - offs[0])],
                                             names=[*names, out])

    return df.mapInArrow(run, schema)


def _binaries(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    off = pa.py_buffer((2 * offsets).astype(np.int64))
    big = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, off, pa.py_buffer(np.ascontiguousarray(ids))])
    return big.cast(pa.binary()) if 2 * int(offsets[-1]) < 2**31 else big


class ByteEncoder:
    """UTF-8 bytes as ids; EOS = 256. Exactly reproducible by SQL oracles."""

    name = "bytes"
    revision = "utf-8"
    vocab_size = BYTE_VOCAB
    eos_id = BYTE_EOS

    def encode(self, df: DataFrame, text_col: str = "text", out: str = "ids") -> DataFrame:
        check_vocab(self.vocab_size, self.eos_id)
        df = _spread(df)
        schema = _ids_schema(df, out)
        names = df.columns

        def run(batches):
            for rb in pieces(batches, text_col, PIECE_BYTES):
                ids = _utf8_bytes_to_ids(rb.column(text_col))
                cols = [rb.column(c) for c in names] + [ids]
                yield pa.RecordBatch.from_arrays(cols, names=names + [out])

        return df.mapInArrow(run, schema)


    def encode_packed(self, df: DataFrame, text_col: str = "text", out: str = "tokens") -> DataFrame:
        """Bytes and the EOS of each text, packed as by ``pack_ids``, in one Arrow pass; the
        text itself does not come back."""
        names = [c for c in df.columns if c != text_col]
        schema = T.StructType([df.schema[c] for c in names] + [T.StructField(out, T.BinaryType())])

        def run(batches):
            for rb in pieces(batches, text_col, PIECE_BYTES):
                lists = _utf8_bytes_to_ids(rb.column(text_col))
                n = np.diff(np.asarray(lists.offsets).astype(np.int64))
                ends = np.cumsum(n + 1)
                ids = np.full(int(ends[-1]) if len(ends) else 0, BYTE_EOS, "<u2")
                body = np.ones(len(ids), bool)
                body[ends - 1] = False
                ids[body] = lists.values.to_numpy()
                yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in names), _binaries(ids, np.concatenate(([0], ends)))],
                                                 names=[*names, out])

        return df.mapInArrow(run, schema)


class WordEncoder:
    """Frequency-ranked word vocabulary, built and applied in the JVM.

    ``build_vocab`` is a word count (map-side combined) followed by a top-V;
    ``encode`` collects the vocabulary (at most ``vocab_size`` ≤ 65,535 rows) and
    sends it with the tasks. ``revision`` is a digest of the words and their ids, so
    two vocabularies of one size are told apart.
    """

    name = "words"
    eos_id = WORD_EOS

    def __init__(self, vocab: DataFrame, vocab_size: int):
        check_vocab(vocab_size, WORD_EOS)
        self.vocab = vocab
        self.vocab_size = vocab_size
        self._revision: str | None = None

    @property
    def revision(self) -> str:
        if self._revision is None:
            entry = F.concat_ws(":", "id", F.hex("word"))
            self._revision = self.vocab.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), ","), 256)).first()[0]
        return self._revision

    @staticmethod
    def words(text_col: str = "text"):
        return F.regexp_extract_all(F.col(text_col), F.lit(WORD_PATTERN), 0)

    @classmethod
    def build_vocab(cls, docs: DataFrame, vocab_size: int, text_col: str = "text") -> DataFrame:
        """(word, id, count): the ``vocab_size − 2`` most frequent words, ties by word."""
        check_vocab(vocab_size, WORD_EOS)
        counts = (_spread(docs).select(F.explode(cls.words(text_col)).alias("word"))
                  .groupBy("word").agg(F.count(F.lit(1)).alias("count")))
        top = counts.orderBy(F.col("count").desc(), F.col("word")).limit(vocab_size - 2)
        rank = F.row_number().over(Window.orderBy(F.col("count").desc(), F.col("word")))
        # ``top`` holds at most vocab_size rows, so this window is over a bounded table
        return top.select("word", (rank + F.lit(1)).cast("int").alias("id"), "count")

    @classmethod
    def fit(cls, docs: DataFrame, vocab_size: int, text_col: str = "text") -> "WordEncoder":
        return cls(cls.build_vocab(docs, vocab_size, text_col), vocab_size)

    def save(self, folder: str) -> str:
        """Writes the vocabulary under its name and digest and returns where: an artifact to pin."""
        path = f"{folder.rstrip('/')}/{self.name}-{self.vocab_size}-{self.revision}"
        self.vocab.write.mode("ignore").parquet(path)
        return path

    @classmethod
    def pinned(cls, spark, path: str) -> "WordEncoder":
        """The encoder saved at ``path``; a vocabulary that does not have the digest its name states is refused."""
        name, size, revision = path.rstrip("/").rsplit("/", 1)[-1].rsplit("-", 2)
        encoder = cls(spark.read.parquet(path), int(size))
        if name != cls.name or encoder.revision != revision:
            raise ValueError(f"{path} holds the vocabulary {encoder.revision}")
        return encoder

    def encode(self, df: DataFrame, text_col: str = "text", out: str = "ids") -> DataFrame:
        """Words are split in the JVM; ids come from a hash lookup over slices of
        Arrow batches (``pyarrow.compute.index_in``). The vocabulary travels
        with the task; its size is bounded by ``vocab_size`` ≤ 65,535."""
        rows = self.vocab.select("word", "id").collect()
        if len(rows) > self.vocab_size:
            raise ValueError("vocabulary larger than vocab_size")
        words = pa.array([r["word"] for r in rows], pa.string())
        ids = np.array([r["id"] for r in rows] + [WORD_UNK], dtype=np.int32)     # the last: of words not found
        df = _spread(df)
        split = df.withColumn("_words", self.words(text_col))
        names = df.columns
        schema = _ids_schema(df, out)

        def run(batches):
            for rb in pieces(batches, "_words", PIECE_VALUES):
                lists = rb.column("_words")
                pos = pc.index_in(lists.flatten(), value_set=words).fill_null(-1).to_numpy(zero_copy_only=False)
                vals = ids[pos]
                offs = np.asarray(lists.offsets)
                arr = pa.ListArray.from_arrays(pa.array(offs - offs[0], pa.int32()), pa.array(vals))
                yield pa.RecordBatch.from_arrays([rb.column(c) for c in names] + [arr],
                                                 names=names + [out])

        return split.mapInArrow(run, schema)


class TokenizerEncoder:
    """A ``tokenizers`` JSON artifact applied per Arrow batch.

    The JSON travels inside the task closure (a few MB at most); each Python
    worker builds the tokenizer once and calls ``encode_batch`` on every batch
    of texts without special tokens. The revision is the artifact's sha256.
    """

    name = "tokenizer-json"

    def __init__(self, tokenizer_json: str, eos_token: str):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(tokenizer_json)
        self.tokenizer_json = tokenizer_json
        self.vocab_size = tok.get_vocab_size(with_added_tokens=True)
        self.eos_id = tok.token_to_id(eos_token)
        self.revision = hashlib.sha256(tokenizer_json.encode()).hexdigest()
        check_vocab(self.vocab_size, self.eos_id)

    def encode(self, df: DataFrame, text_col: str = "text", out: str = "ids",
               batch_size: int = 1000) -> DataFrame:
        df = _spread(df)
        schema = _ids_schema(df, out)
        names = df.columns
        artifact = self.tokenizer_json

        def run(batches):
            from tokenizers import Tokenizer

            tok = Tokenizer.from_str(artifact)
            for rb in pieces(batches, text_col, PIECE_BYTES):
                texts = rb.column(text_col).to_pylist()
                if any(t is None for t in texts):
                    raise ValueError("document text is null; null text is not a document")
                ids: list[list[int]] = []
                for i in range(0, len(texts), batch_size):
                    ids.extend(e.ids for e in tok.encode_batch(texts[i:i + batch_size],
                                                               add_special_tokens=False))
                arr = pa.array(ids, type=pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([rb.column(c) for c in names] + [arr],
                                                 names=names + [out])

        return df.mapInArrow(run, schema)

    def decode(self, df: DataFrame, ids_col: str = "ids", out: str = "text",
               skip_special_tokens: bool = True) -> DataFrame:
        """P5: ids → text per Arrow batch."""
        schema = T.StructType(list(df.schema.fields) + [T.StructField(out, T.StringType())])
        names = df.columns
        artifact = self.tokenizer_json

        def run(batches):
            from tokenizers import Tokenizer

            tok = Tokenizer.from_str(artifact)
            for rb in batches:
                seqs = [s or [] for s in rb.column(ids_col).to_pylist()]
                texts = tok.decode_batch(seqs, skip_special_tokens=skip_special_tokens)
                yield pa.RecordBatch.from_arrays(
                    [rb.column(c) for c in names] + [pa.array(texts, pa.string())],
                    names=names + [out])

        return df.mapInArrow(run, schema)


def decode_bytes(df: DataFrame, ids_col: str = "ids", out: str = "text",
                 skip_special_tokens: bool = True) -> DataFrame:
    """P5 for the byte encoder, in the JVM: ids ≥ 256 are specials."""
    kept = F.filter(F.col(ids_col), lambda i: i < BYTE_EOS) if skip_special_tokens else F.col(ids_col)
    hexed = F.array_join(F.transform(kept, lambda i: F.lpad(F.hex(i), 2, "0")), "")
    return df.withColumn(out, F.decode(F.unhex(hexed), "UTF-8"))


def assert_ids(df: DataFrame, ids_col: str = "ids", max_id: int = 65535) -> DataFrame:
    """P3 on data: every id must fit a uint16 shard (checked lazily per row)."""
    bad = F.exists(F.col(ids_col), lambda i: (i < 0) | (i > max_id))
    checked = F.when(bad, F.raise_error(F.lit(f"token id outside 0..{max_id}"))).otherwise(
        F.col(ids_col))
    return df.withColumn(ids_col, checked.cast("array<int>"))
