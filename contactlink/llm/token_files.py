"""Token ids as Arrow files of equal-length sequences with masks.

Each shard is one Arrow file: the stream format with a footer that gives the place of every batch. A batch holds two
fixed-size-list columns, ``ids`` (16-bit if the vocabulary allows, else 32-bit) and ``mask`` (a bit each, set for ids and
not for padding), whose values are one flat buffer, so the place of any sequence, and of any id, follows from its number alone and a mapped file is read without copying. The
documents of a shard follow each other without gaps, so a document is a stretch of the flat values; only the end of a
shard is padded. Shards follow the order of ids, and a table of shards says where each begins.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactlink.llm.piece_table import word_table
from contactlink.llm.tables import exact, field_type
from contactlink.operators.storage import materialize, scratch_path

SEQUENCE, BATCH_ROWS, END_ID, PAD_ID = 1024, 256, 1, 0


def file_schema(sequence: int, vocabulary: int) -> pa.Schema:
    kind = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(pa.field("item", kind, nullable=False), sequence)), ("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), sequence))])


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Paths may be local ones, of folders that all machines mount, or URIs that Arrow knows."""
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


class TokenFileWriter:
    """Writes ids one after the other. The file appears under its name when it is whole, so a task that is run again, or
    twice at once, leaves one whole file."""

    def __init__(self, path: str, sequence: int = SEQUENCE, batch_rows: int = BATCH_ROWS, pad_id: int = PAD_ID, vocabulary: int = 1 << 32):
        self.sequence, self.batch_rows, self.pad_id = sequence, batch_rows, pad_id
        self.fs, self.path = _filesystem(path)
        self.written, self.waiting, self.held = 0, [], 0
        self.schema = file_schema(sequence, vocabulary)
        self.kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
        self.draft = f"{self.path}.{uuid.uuid4().hex}.draft"
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.sink = self.fs.open_output_stream(self.draft)
        self.writer = pa.ipc.new_file(self.sink, self.schema)

    def append(self, ids: np.ndarray) -> int:
        """Add ids; the place of the first in the file."""
        first = self.written + self.held
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.sequence * self.batch_rows:
            self._flush(whole=False)
        return first

    def _flush(self, whole: bool) -> None:
        step = self.sequence * self.batch_rows
        values = np.concatenate([*self.waiting, np.zeros(0, self.kind)]).astype(self.kind, copy=False)
        for at in range(0, len(values), step):
            part = values[at : at + step]
            if len(part) < step and not whole:
                self.waiting, self.held = [part], len(part)
                return
            real = len(part)
            part = np.append(part, np.full(-real % self.sequence, self.pad_id, self.kind))
            mask = np.arange(len(part)) < real
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(v), type=t) for v, t in zip((part, mask), self.schema.types)]
            self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
            self.written += real
        self.waiting, self.held = [], 0

    def close(self) -> int:
        """Finish the file; how many ids it has."""
        self._flush(whole=True)
        self.writer.close()
        self.sink.close()
        self.fs.move(self.draft, self.path)
        return self.written


class TokenFile:
    """Random access to a written file; arrays are views of the mapped file where the file is local."""

    def __init__(self, path: str):
        fs, inner = _filesystem(path)
        source = pa.memory_map(inner) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(inner)
        self.reader = pa.ipc.open_file(source)
        self.sequence = self.reader.schema.field("ids").type.list_size
        self.step = self._values(0, "ids").size if self.reader.num_record_batches else self.sequence

    @functools.lru_cache(4)  # noqa: B019
    def _batch(self, number: int) -> pa.RecordBatch:
        return self.reader.get_batch(number)

    def _values(self, number: int, column: str) -> np.ndarray:
        return self._batch(number).column(column).flatten().to_numpy(zero_copy_only=True)

    def __len__(self) -> int:
        """Sequences in the file."""
        n = self.reader.num_record_batches
        return 0 if not n else ((n - 1) * self.step + self._values(n - 1, "ids").size) // self.sequence

    def __getitem__(self, number: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of a sequence, both views of the file."""
        batch, at = divmod(number * self.sequence, self.step)
        mask = self._batch(batch).column("mask").flatten()
        return self._values(batch, "ids")[at : at + self.sequence], mask.slice(at, self.sequence)

    def ids(self, start: int, length: int) -> np.ndarray:
        """Any stretch of ids; a view if it lies in one batch."""
        first, last = start // self.step, max(start, start + length - 1) // self.step
        parts = [self._values(b, "ids")[max(0, start - b * self.step) : start + length - b * self.step] for b in range(first, last + 1)] if length else []
        return parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, np.uint16)])


INDEX = "shard int, path string, place long, n_tokens long"


def write_token_files(df: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE,
                      batch_rows: int = BATCH_ROWS, end_id: int = END_ID) -> DataFrame:
    """Write the ids of all texts, each followed by ``end_id``, to Arrow files in ``folder``, in ascending order of ids.

    Gives the index, written as a table: the id, ``shard`` (0, 1, ...: shards follow the order of ids), ``path``, ``place``
    (ids before the document in its shard) and ``n_tokens`` (with the end id). Rows are dealt to shards by ranges of ids
    and sorted in them; a null id comes first, rows of one id by text, a null text is empty. Rows that repeat an id are
    documents of their own. An empty table writes no file. Other columns are ignored. A shard's memory is one Arrow batch
    and one batch of the file, however large it is.
    """
    docs = df.select(exact(id_col).alias("id"), F.coalesce(exact(text_col).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("id", field_type(df, id_col)), *T._parse_datatype_string(INDEX).fields])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, shard = word_table(tokenizer), TaskContext.get().partitionId()
        path, writer = f"{folder}/shard-{shard:06d}.arrow", None
        end = np.array([end_id], "<u4")
        for batch in batches:
            for at, ids, bounds in table.in_slices(batch.column(1)):
                writer = writer or TokenFileWriter(path, sequence, batch_rows, vocabulary=max(table.vocabulary, end_id + 1))
                places, sizes = [], []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    places.append(writer.append(ids[a:b]))
                    writer.append(end)
                    sizes.append(b - a + 1)
                n = len(sizes)
                columns = [batch.column(0).slice(at, n), pa.array([shard] * n, pa.int32()), pa.array([path] * n), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        if writer:
            writer.close()

    by_range = docs.repartitionByRange(F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    return materialize(by_range.mapInArrow(write, schema).withColumnRenamed("id", id_col), "token-index")


def with_starts(index: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all documents before this one, over all shards."""
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()  # a row per file
    before = np.cumsum([0, *(r["n"] for r in shards)])
    known = index.sparkSession.createDataFrame([(r["shard"], int(b)) for r, b in zip(shards, before)], "shard int, _before long")
    return index.join(F.broadcast(known), "shard").withColumn("start", F.col("_before") + F.col("place")).drop("_before")


def read_documents(index: DataFrame, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """The documents of an index with ``start``, out of the files: id, ``start``, ``n_tokens``, ``ids_crc32`` (unsigned, of
    the little-endian 32-bit ids) and, if asked for, ``ids``."""
    schema = T.StructType([
        T.StructField("id", field_type(index, id_col)), *(T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")),
        *([T.StructField("ids", T.ArrayType(T.LongType(), False))] if keep_ids else []),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, file = None, None
        for batch in batches:
            found = []
            for path, place, n in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if path != opened:
                    opened, file = path, TokenFile(path)
                found.append(file.ids(place, n))
            crc = pa.array([zlib.crc32(np.ascontiguousarray(v, "<u4")) for v in found], pa.int64())
            lists = [pa.array([v.astype(np.int64) for v in found], pa.list_(pa.int64()))] if keep_ids else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), batch.column(3), crc, *lists], names=schema.names)

    rows = index.select(exact(id_col).alias("id"), "path", "place", "n_tokens", "start")
    return rows.mapInArrow(read, schema).withColumnRenamed("id", id_col)


def token_files(df: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, **layout: int) -> DataFrame:
    """Write the files (to a fresh folder of the shared one by default) and read all documents back from them."""
    folder = folder or scratch_path(df.sparkSession, "token-files")
    return read_documents(with_starts(write_token_files(df, folder, tokenizer, id_col, text_col, **layout)), id_col, keep_ids)
