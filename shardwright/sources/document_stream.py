"""S1 as a stream that knows where it is: documents in ``doc_id`` order, resumable inside a table.

``spark.readStream.format("ordered_documents").option("path", table).option("build", directory)``.
The offset is ``(last_doc_id, consumed)``: the last document given out, and the number of documents up to
it. A stream without a checkpoint of its own starts where the build in ``directory`` has come to,
so it goes on over the same table that a batch build, or another stream, has read the beginning of. With
``maxDocuments`` a micro-batch holds at most about so many documents.

Only Parquet footers are read to plan: row groups whose id ranges overlap form a run, runs are disjoint and in
order, and a batch ends with a run, or inside one of at most ``RUN_IDS`` documents, whose ids alone are
read for that. The number of documents up to the end of a run is known from the footers; if the build's
count does not lead there, the table is not the one it has read, and the stream refuses. Row
groups are the partitions; an executor reads two columns of its row group in small batches.

Documents without an id, and a table without id statistics, are refused by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from shardwright.sources import store
from shardwright.sources.manifests import read_state

SCHEMA = "doc_id long, text string"
RUN_IDS = 1 << 22          # ids of one run that are read to end a batch inside it
BATCH_ROWS = 1024


@dataclass(frozen=True)
class RowGroup(InputPartition):
    uri: str
    number: int
    lo: int
    hi: int
    rows: int
    after: int | None = None      # documents that the batch takes: after < doc_id <= upto
    upto: int | None = None


@dataclass(frozen=True)
class Run:
    groups: tuple
    lo: int
    hi: int
    rows: int
    before: int                   # documents of the runs before it


def open_parquet(uri: str) -> pq.ParquetFile:
    where, path = store.place(uri)
    return pq.ParquetFile(where.open_input_file(path))


def row_groups(uri: str, id_col: str) -> list[RowGroup]:
    """Row groups of a file with the range of their ids, from its footer."""
    meta = open_parquet(uri).metadata
    out = []
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        if not group.num_rows:
            continue
        column = next((group.column(c) for c in range(group.num_columns) if group.column(c).path_in_schema == id_col), None)
        stats = column.statistics if column is not None else None
        if stats is None or not stats.has_min_max or not stats.has_null_count:
            raise ValueError(f"{uri}: row group {g} tells no range of {id_col}")
        if stats.null_count:
            raise ValueError(f"{uri}: row group {g} has documents without {id_col}")
        out.append(RowGroup(uri, g, int(stats.min), int(stats.max), group.num_rows))
    return out


def runs_of(groups: list[RowGroup]) -> list[Run]:
    """Disjoint runs in id order; row groups that share ids or a range are in one run."""
    out: list[Run] = []
    held: list[RowGroup] = []
    hi = before = 0
    for g in [*sorted(groups, key=lambda g: (g.lo, g.hi, g.uri, g.number)), None]:
        if held and (g is None or g.lo > hi):
            rows = sum(h.rows for h in held)
            out.append(Run(tuple(held), held[0].lo, hi, rows, before))
            before += rows
            held = []
        if g is not None:
            hi = max(hi, g.hi) if held else g.hi
            held.append(g)
    return out


class OrderedDocumentReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.id_col, self.text_col = options.get("idCol", "doc_id"), options.get("textCol", "text")
        self.build = options.get("build")
        self.most = int(options["maxDocuments"]) if options.get("maxDocuments") else None
        self.footers: dict[tuple[str, int], list[RowGroup]] = {}
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        state = read_state(self.build) if self.build else None
        return {"last_doc_id": state["last_doc_id"] if state else None,
                "consumed": int(state["source_documents_consumed"] or 0) if state else 0}

    def runs(self) -> list[Run]:
        """The runs of the files that are there now; a footer is read once."""
        files = [(self.path, store.size(self.path))] if store.is_file(self.path) else store.listing(self.path, "*.parquet")
        new = [f for f in files if f not in self.footers]
        with ThreadPoolExecutor(16) as pool:
            self.footers.update(zip(new, pool.map(lambda f: row_groups(f[0], self.id_col), new)))
        return runs_of([g for f in files for g in self.footers[f]])

    def ids(self, run: Run, after: int | None) -> np.ndarray:
        parts = [open_parquet(g.uri).read_row_group(g.number, columns=[self.id_col]).column(0).to_numpy() for g in run.groups]
        ids = np.sort(np.concatenate(parts))
        return ids if after is None else ids[ids > after]

    def latestOffset(self) -> dict:
        """The end of the next batch: of all there is, or of ``maxDocuments`` from where the stream is."""
        here = self.at or self.initialOffset()
        if self.build:                                             # a restart: the build knows what is done
            done = self.initialOffset()
            here = max(here, done, key=lambda o: o["consumed"])
        last, consumed, room = here["last_doc_id"], here["consumed"], self.most
        for run in self.runs():
            if last is not None and run.hi <= last:
                continue
            if room is not None and room <= 0:
                break
            left = run.before + run.rows - consumed
            begun = last is not None and run.lo <= last
            if not begun and consumed != run.before or left <= 0:
                raise ValueError(f"{consumed} documents up to {last} were consumed, but {self.path} holds another number of them")
            if (begun or room is not None and left > room) and run.rows <= RUN_IDS:
                ids = self.ids(run, last)
                if len(ids) != left:
                    raise ValueError(f"{consumed} documents up to {last} were consumed, but {self.path} holds {run.before + run.rows - len(ids)}")
                take = len(ids) if room is None else min(room, len(ids))
                while take < len(ids) and ids[take] == ids[take - 1]:
                    take += 1                                      # equal ids stay together (and are refused by the build)
            else:
                ids, take = None, left
            last = run.hi if take == left else int(ids[take - 1])
            consumed += take
            room = None if room is None else room - take
        return {"last_doc_id": last, "consumed": consumed}

    def partitions(self, start: dict, end: dict) -> list[RowGroup]:
        self.at = end
        a, b = start["last_doc_id"], end["last_doc_id"]
        if b is None:
            return []
        return [RowGroup(g.uri, g.number, g.lo, g.hi, g.rows, a, b) for run in self.runs() for g in run.groups
                if g.lo <= b and (a is None or g.hi > a)]

    def commit(self, end: dict) -> None:
        self.at = end

    def read(self, part: RowGroup) -> Iterator[pa.RecordBatch]:
        for batch in open_parquet(part.uri).iter_batches(BATCH_ROWS, [part.number], [self.id_col, self.text_col]):
            ids = batch.column(self.id_col).cast(pa.int64())
            keep = pc.less_equal(ids, part.upto)
            if part.after is not None:
                keep = pc.and_(keep, pc.greater(ids, part.after))
            yield pa.RecordBatch.from_arrays([ids, batch.column(self.text_col).cast(pa.string())], ["doc_id", "text"]).filter(keep)


class OrderedDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ordered_documents"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> OrderedDocumentReader:
        return OrderedDocumentReader(self.options)             # its keys know no case


def documents_after(spark: SparkSession, path: str, build: str, id_col: str = "doc_id", text_col: str = "text",
                    max_documents: int | None = None) -> DataFrame:
    """The documents of a table that the build in ``build`` has not consumed, as a stream in id order."""
    spark.dataSource.register(OrderedDocuments)
    r = spark.readStream.format("ordered_documents").option("path", path).option("build", build).option("idCol", id_col).option("textCol", text_col)
    if max_documents:
        r = r.option("maxDocuments", str(max_documents))
    df = r.load()
    none = F.raise_error(F.concat(F.lit("null text in document "), F.col("doc_id").cast("string")))
    return df.withColumn("text", F.when(F.col("text").isNull(), none).otherwise(F.col("text")))
