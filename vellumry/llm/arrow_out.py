"""Token ids as Arrow files of equal-length sequences with masks.

Each document's ids, with END behind them, are cut into sequences of LENGTH; the last is filled up with END, where the mask is false. Sequences are written
in the Arrow file format, uncompressed, as record batches of ROWS rows (the last of a file may have fewer) with the columns

    doc_id int64, part int32, n_tokens int32, tokens fixed_size_list<uint16 or int32>[LENGTH], mask fixed_size_list<bool>[LENGTH]

so that sequence k of a file is row k % ROWS of batch k // ROWS, reached by address in a memory-mapped file with no copy and no decoding.

One file per task, first under a name of its own and then renamed: a task that runs again replaces its file by an equal one, and no reader meets half a file.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumry.llm import textnum as tn
from vellumry.llm import token_count
from vellumry.llm.common import materialize, prepare

LENGTH, ROWS, END = 512, 1024, 50256
INDEX = "doc_id long, part int, n_tokens int, file string, batch int, row int, crc32 long"


def schema(length: int = LENGTH, wide: bool = False) -> pa.Schema:
    kind = pa.int32() if wide else pa.uint16()
    return pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("n_tokens", pa.int32()), ("tokens", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


def sequences(doc_ids: pa.Array, texts: list, encoder: token_count.Encoder, length: int, end: int, wide: bool) -> pa.Table:
    """The rows of some documents. Null and empty texts give none; a null doc_id stays null."""
    some = np.flatnonzero([bool(t) for t in texts])
    ids, n = encoder.ids([texts[k] for k in some])
    total = n + 1
    rows = -(-total // length)
    first = np.cumsum(rows) - rows
    flat = np.full(rows.sum() * length, end, np.int32 if wide else np.uint16)
    flat[np.arange(len(ids)) + np.repeat(first * length - (np.cumsum(n) - n), n)] = ids
    part = np.arange(rows.sum()) - np.repeat(first, rows)
    real = np.minimum(np.repeat(total, rows) - part * length, length).astype(np.int32)
    mask = np.arange(length)[None] < real[:, None]
    tokens = pa.FixedSizeListArray.from_arrays(pa.array(flat), length)
    return pa.Table.from_arrays([doc_ids.take(pa.array(np.repeat(some, rows))), pa.array(part.astype(np.int32)), pa.array(real), tokens, pa.FixedSizeListArray.from_arrays(pa.array(mask.ravel()), length)], schema=schema(length, wide))


def _write(shared, path: str, length: int, rows: int, end: int, wide: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = token_count.Encoder(pickle.loads(shared.value))
    context = TaskContext.get()
    fs, base = pa.fs.FileSystem.from_uri(path)
    file, own = f"part-{context.partitionId():06d}.arrow", f"{base}/_attempt-{context.taskAttemptId()}"
    sink, writer, held, done = None, None, [], 0

    def put(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, done
        table = pa.concat_tables(held).combine_chunks()
        upto = len(table) if last else len(table) // rows * rows
        for a in range(0, upto, rows):
            piece = table.slice(a, min(rows, upto - a)).combine_chunks()
            batch = pa.RecordBatch.from_arrays([c.chunk(0) for c in piece.columns], schema=piece.schema)
            writer.write_batch(batch)
            tokens = batch.column(3).flatten().to_numpy().reshape(-1, length)
            crc = pa.array([zlib.crc32(t) for t in tokens], pa.int64())
            k = len(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([file] * k), pa.array(np.full(k, done, np.int32)), pa.array(np.arange(k, dtype=np.int32)), crc], names=["doc_id", "part", "n_tokens", "file", "batch", "row", "crc32"])
            done += 1
        held = [table.slice(upto)]

    for b in batches:
        texts = b.column(1).to_pylist()
        for i, j in tn.chunks(texts):
            table = sequences(b.column(0).slice(i, j - i), texts[i:j], encoder, length, end, wide)
            if not len(table):
                continue
            if writer is None:
                fs.create_dir(base, recursive=True)
                sink = fs.open_output_stream(own)
                writer = pa.ipc.new_file(sink, table.schema)
            held.append(table)
            if sum(map(len, held)) >= rows:
                yield from put(False)
    if writer is not None:
        if held and sum(map(len, held)):
            yield from put(True)
        writer.close()
        sink.close()
        final = f"{base}/{file}"
        if fs.type_name != "local" and fs.get_file_info(final).type != pa.fs.FileType.NotFound:
            fs.delete_file(final)
        fs.move(own, final)


def write(docs: DataFrame, path: str, length: int = LENGTH, rows: int = ROWS, end: int = END, vocabulary: str = token_count.VOCABULARY) -> DataFrame:
    """Write all documents' sequences below path (a URI that all executors reach); all files are there when this returns, and reading the result writes nothing.

    Returns the index, read from a table in the shared folder, one row per sequence: (doc_id, part, n_tokens, file, batch, row, crc32 of its ids). Rows that repeat give sequences each.
    Only doc_id and text are read. An empty table writes no file.
    """
    prepare(docs.sparkSession)
    ranks = token_count.load(vocabulary)
    wide = max(max(ranks.values()), end) >= 1 << 16
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(token_count.merges(ranks), protocol=5))
    return materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _write(shared, path, length, rows, end, wide, it), INDEX), "sequence-index")


class Sequences:
    """Random access to one file's sequences by memory mapping; what it returns are views of the file."""

    def __init__(self, file: str):
        self.reader = pa.ipc.open_file(pa.memory_map(file))
        self.rows = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0
        last = self.reader.num_record_batches - 1
        self.count = self.rows * last + self.reader.get_batch(last).num_rows if self.rows else 0

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """Ids as a numpy view, and the mask as an Arrow slice."""
        if not 0 <= k < self.count:
            raise IndexError(k)
        batch, row = self.reader.get_batch(k // self.rows), k % self.rows
        n = batch.schema.field("tokens").type.list_size
        return batch.column("tokens").values.slice(row * n, n).to_numpy(zero_copy_only=True), batch.column("mask").values.slice(row * n, n)
