"""Token ids as binary files: equal-length sequences and masks in Arrow stream files.

A file is an Arrow IPC stream. Its record batches hold two fixed-size-list columns, ``tokens`` (unsigned integers
of 16 bits where all ids fit, else of 32) and ``mask`` (true for a document's token, false for padding). All batches but the
last hold the same number of sequences, so sequence i is row ``i % batch`` of batch ``i // batch``, and a mapped
file gives any sequence without copying or decoding. Beside it lies a stream file of its documents: id, offset in
the file, number of tokens. A document may run over the end of a sequence, never over the end of a file.

Files come one from each range of document ids; their numbers follow the ids. A task writes under a name of its
own and renames when done, so a task that is lost, repeated or run twice leaves one whole file.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from samerow.llm.tasks import map_batches, slices, text_column
from samerow.llm.tokens import byte_encoder, with_end
from samerow.session import save

SEQUENCE = 2048
BATCH = 256
DOCS = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])
WRITTEN = "file string, part int, n_docs bigint, n_tokens bigint, n_sequences bigint"
READ = "doc_id bigint, part int, start_in_file bigint, n_tokens bigint, ids_crc32 bigint"


def open_uri(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file; a path without a scheme is local."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def token_schema(vocab_size: int, length: int) -> pa.Schema:
    kind = pa.uint16() if vocab_size <= 1 << 16 else pa.uint32()
    return pa.schema([("tokens", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Cuts a stream of ids into sequences and writes them as they fill up; holds one batch at most."""

    def __init__(self, sink, schema: pa.Schema, batch: int = BATCH):
        self.schema, self.length = schema, schema.field("tokens").type.list_size
        self.kind = schema.field("tokens").type.value_type.to_pandas_dtype()
        self.room = batch * self.length
        self.writer = ipc.new_stream(sink, schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = self.n_sequences = 0

    def write(self, ids: np.ndarray) -> None:
        self.n_tokens += len(ids)
        while len(ids):
            part = ids[: self.room - self.n_held]
            self.held.append(part.astype(self.kind))
            self.n_held += len(part)
            ids = ids[len(part) :]
            if self.n_held == self.room:
                self._flush()

    def _flush(self) -> None:
        rows = -(-self.n_held // self.length)
        tokens = np.zeros(rows * self.length, self.kind)
        tokens[: self.n_held] = np.concatenate(self.held)
        mask = np.arange(rows * self.length) < self.n_held
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (tokens, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
        self.n_sequences += rows
        self.held, self.n_held = [], 0

    def close(self) -> None:
        if self.n_held:
            self._flush()
        self.writer.close()


class SequenceFile:
    """Random access to a file's sequences. A local file is mapped, and what is returned lies in the map."""

    def __init__(self, uri: str):
        files, path = open_uri(uri)
        source = pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)
        with ipc.open_stream(source) as reader:
            self.batches = list(reader)
        self.per_batch = self.batches[0].num_rows if self.batches else 1

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, i: int) -> np.ndarray:
        column = self.batches[i // self.per_batch].column(0)
        length = column.type.list_size
        return column.values.to_numpy(zero_copy_only=True)[(i % self.per_batch) * length :][:length]

    def mask(self, i: int) -> pa.Array:
        column = self.batches[i // self.per_batch].column(1)
        length = column.type.list_size
        return column.values.slice((i % self.per_batch) * length, length)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start`` on; a copy only where they lie in several batches."""
        parts = []
        while n > 0:
            column = self.batches[start // (self.per_batch * self.batches[0].column(0).type.list_size)].column(0)
            size = self.per_batch * column.type.list_size
            values = column.values.to_numpy(zero_copy_only=True)[start % size :][:n]
            parts.append(values)
            start, n = start + len(values), n - len(values)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_file: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = SEQUENCE,
    batch: int = BATCH,
) -> DataFrame:
    """Encode every whole text, end each with ``end_id``, and write all as stream files into ``path``.

    Returns the stored manifest: ``file, part, n_docs, n_tokens, n_sequences``, one row per file. Documents go in
    ascending ``id_col``; null ids first, and rows with one id as in the input. A null or empty text is only its
    end id. A long text takes as many sequences as it needs. An empty table gives an empty manifest. Other
    columns are not read.
    """
    folder = f"{path.rstrip('/')}/{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        encoder = byte_encoder(tokenizer_file)
        schema = token_schema(max(encoder.tokenizer.get_vocab_size(), end_id + 1), length)
        files, base = open_uri(folder)
        files.create_dir(base, recursive=True)
        names = [f"tokens-{part:06d}.arrows", f"docs-{part:06d}.arrows"]
        drafts = [posixpath.join(base, f"_{n}.{attempt}") for n in names]
        sinks = [files.open_output_stream(d) for d in drafts]
        out, about = SequenceWriter(sinks[0], schema, batch), ipc.new_stream(sinks[1], DOCS)
        n_docs = 0
        for each in batches:
            for b in slices(each):
                ids, counts = with_end(*encoder.encode(text_column(b)), end_id)
                starts = out.n_tokens + np.cumsum(counts) - counts
                out.write(ids)
                about.write_batch(
                    pa.RecordBatch.from_arrays([b.column(0), pa.array(starts), pa.array(counts)], schema=DOCS)
                )
                n_docs += b.num_rows
        out.close()
        about.close()
        for s in sinks:
            s.close()
        if n_docs:
            for draft, name in zip(drafts, names):
                files.move(draft, posixpath.join(base, name))
            row = [f"{folder}/{names[0]}"], [part], [n_docs], [out.n_tokens], [out.n_sequences]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[0]), pa.array(row[1], pa.int32()), *map(pa.array, row[2:])],
                ["file", "part", "n_docs", "n_tokens", "n_sequences"],
            )
        else:
            for draft in drafts:
                files.delete_file(draft)

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    # Equal ids are spread over ranges by their place in the input.
    placed = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    return save(map_batches(placed.select("doc_id", "text"), write, WRITTEN))


def read_documents(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read back from the files of ``manifest``.

    ``start`` counts the ids of all documents before it, over all files. ``ids_crc32`` is the unsigned CRC-32 of
    its ids as little-endian unsigned 32-bit integers.
    """
    # One row per file.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = manifest.select("part", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("_before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for each in batches:
            for uri, part in zip(each.column(0).to_pylist(), each.column(1).to_pylist()):
                stored = SequenceFile(uri)
                files, path = open_uri(uri)
                folder, name = posixpath.split(path)
                with files.open_input_stream(posixpath.join(folder, name.replace("tokens-", "docs-"))) as f:
                    about = ipc.open_stream(f).read_all()
                for b in about.to_batches():
                    crcs = [
                        zlib.crc32(stored.tokens(s, n).astype("<u4").tobytes())
                        for s, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist())
                    ]
                    parts = pa.array([part] * b.num_rows, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0), parts, b.column(1), b.column(2), pa.array(crcs, pa.int64())],
                        ["doc_id", "part", "start_in_file", "n_tokens", "ids_crc32"],
                    )

    spark: SparkSession = manifest.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = map_batches(manifest.select("file", "part").repartition(tasks, "part"), read, READ)
    return found.join(F.broadcast(before), "part").select(  # one row per file
        "doc_id", (F.col("_before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32"
    )
