"""Operator 6: token ids in seekable Zstandard files.

File layout (``.tzst``), little-endian throughout:

* data frames: independent Zstandard frames holding the unsigned 32-bit ids
  of whole documents, one after the other; a frame is closed once it holds
  ``frame_ids`` ids, and a document longer than that spans several frames;
* an index frame: a skippable frame (magic 0x184D2A50) holding one Zstandard
  frame of ``int64 doc_id[n]``, ``uint8 id_is_null[n]``, ``int64 n_tokens[n]``;
* a trailing seek table in a skippable frame (magic 0x184D2A5E): for each data
  frame its compressed size, decompressed size and checksum (the low 32 bits
  of XXH64 over the decompressed bytes), then the number of data frames, a
  descriptor byte (bit 7: checksums) and the magic number 0x8F92EAB1.

Any Zstandard tool decompresses such a file whole; ``read_ids`` decompresses
only the frames that hold the requested documents and checks each of them.

One file is one contiguous range of ``doc_id`` order, files are numbered in
that order, and a task writes to a name of its own and renames it when it is
complete, so a lost executor or a repeated attempt leaves the same files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairnet.llm.common import input_bytes, narrow, parts_for, text_batches
from pairnet.llm.encoders import encoder
from pairnet.session import checkpoint, stage_path

# Fixed values of the Zstandard seekable format.
SEEK_MAGIC, INDEX_MAGIC, FOOTER_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
ENTRY, FOOTER = struct.Struct("<III"), struct.Struct("<IBI")

FRAME_IDS = 1 << 16
#: Text bytes a file is made of.
FILE_BYTES = 24 << 20


class SeekableWriter:
    """Streams documents' ids into one file; holds one frame in memory."""

    def __init__(self, sink, frame_ids: int = FRAME_IDS, level: int = 3):
        import zstandard

        self.sink, self.frame_bytes = sink, 4 * frame_ids
        self.zip = zstandard.ZstdCompressor(level=level)
        self.table, self.buffer, self.held = [], [], 0
        self.ids, self.lengths = [], []

    def _frame(self, raw: bytes) -> None:
        import xxhash

        packed = self.zip.compress(raw)
        self.sink.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        if self.held + len(ids) > self.frame_bytes:
            self.flush()
        while len(ids) > self.frame_bytes:
            self._frame(ids[:self.frame_bytes])
            ids = ids[self.frame_bytes:]
        self.buffer.append(ids)
        self.held += len(ids)
        if self.held >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self._frame(b"".join(self.buffer))
        self.buffer, self.held = [], 0

    def finish(self) -> None:
        self.flush()
        null = np.array([i is None for i in self.ids], "u1")
        index = self.zip.compress(
            np.array([0 if i is None else i for i in self.ids], "<i8").tobytes() + null.tobytes()
            + np.array(self.lengths, "<i8").tobytes())
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        body = b"".join(ENTRY.pack(*x) for x in self.table) + FOOTER.pack(len(self.table), 0x80, FOOTER_MAGIC)
        self.sink.write(struct.pack("<II", SEEK_MAGIC, len(body)) + body)


def _unpacked(packed: bytes, size: int) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed, max_output_size=size)


class SeekableReader:
    """Documents of one file's bytes by place; frames are decompressed on
    demand, one at a time, and checked against the seek table."""

    def __init__(self, data: bytes):
        import zstandard

        self.data = memoryview(data)
        frames, descriptor, magic = FOOTER.unpack(self.data[-FOOTER.size:])
        if magic != FOOTER_MAGIC or descriptor != 0x80:
            raise ValueError("not a seekable file with checksums")
        start = len(data) - FOOTER.size - frames * ENTRY.size
        self.table = [ENTRY.unpack_from(self.data, start + k * ENTRY.size) for k in range(frames)]
        self.packed_at = np.concatenate([[0], np.cumsum([x[0] for x in self.table], dtype="i8")]).astype("i8")
        self.raw_at = np.concatenate([[0], np.cumsum([x[1] for x in self.table], dtype="i8")]).astype("i8")
        at = int(self.packed_at[-1])
        magic, size = struct.unpack_from("<II", self.data, at)
        if magic != INDEX_MAGIC:
            raise ValueError("index frame missing")
        raw = zstandard.ZstdDecompressor().decompress(bytes(self.data[at + 8:at + 8 + size]))
        n = len(raw) // 17
        self.ids = np.frombuffer(raw, "<i8", n)
        self.null = np.frombuffer(raw, "u1", n, 8 * n).astype(bool)
        self.lengths = np.frombuffer(raw, "<i8", n, 9 * n)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1].astype("i8")
        self.last = (-1, b"")

    def _raw(self, k: int) -> bytes:
        import xxhash

        if self.last[0] != k:
            packed = bytes(self.data[int(self.packed_at[k]):int(self.packed_at[k + 1])])
            raw = _unpacked(packed, self.table[k][1])
            if len(raw) != self.table[k][1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k][2]:
                raise ValueError(f"checksum of frame {k} differs")
            self.last = (k, raw)
        return self.last[1]

    def document(self, place: int) -> bytes:
        begin, end = 4 * int(self.starts[place]), 4 * int(self.starts[place] + self.lengths[place])
        out, k = [], int(np.searchsorted(self.raw_at, begin, "right")) - 1
        while begin < end:
            stop = min(end, int(self.raw_at[k + 1]))
            base = int(self.raw_at[k])
            out.append(self._raw(k)[begin - base:stop - base])
            begin, k = stop, k + 1
        return b"".join(out)


MANIFEST = "file_no int, n_docs long, n_ids long"


def write_ids(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = 2,
              id_col: str = "doc_id", text_col: str = "text", frame_ids: int = FRAME_IDS,
              file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode every whole text and write the ids to ``folder`` (a shared
    folder's URI) in ascending ``doc_id`` order; returns the manifest (one row
    per file), already written.

    Null texts count as empty and still get ``end_id``. A null ``doc_id``
    sorts first and is marked in the index. Rows that share a ``doc_id`` are
    all written, in the order of their texts' hashes, and may fill several
    files, also where the texts are equal. Other columns are ignored. An
    empty table gives no file and an empty manifest. Memory: one frame and
    one slice of texts a task; a range of ids is one file.
    """
    spark = docs.sparkSession
    rows = narrow(docs, id_col, text_col)
    n, size = input_bytes(rows)
    if n == 0:
        return spark.createDataFrame([], MANIFEST)
    # One id may have a third of all rows, and these one text: hash and row number cut them.
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("nth")]
    ordered = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text")) \
        .withColumn("hash", F.xxhash64("text")).withColumn("nth", F.monotonically_increasing_id()) \
        .repartitionByRange(parts_for(size + 16 * n, file_bytes), *order).sortWithinPartitions(*order) \
        .select("doc_id", "text")
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        enc, number = encoder(tokenizer_path), TaskContext.get().partitionId()
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        own, ids, docs_in = f"{path}/_{number:06d}-{uuid.uuid4().hex}", 0, 0
        with store.open_output_stream(own) as sink:
            out = SeekableWriter(sink, frame_ids)
            for b in text_batches(batches, 16 << 20, 20_000):
                for doc_id, x in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text"))):
                    out.add(doc_id, x + end)
                    docs_in, ids = docs_in + 1, ids + (len(x) + len(end)) // 4
            out.finish()
        store.move(own, f"{path}/part-{number:06d}.tzst")
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([docs_in], pa.int64()),
                                          pa.array([ids], pa.int64())], ["file_no", "n_docs", "n_ids"])

    return checkpoint(ordered.mapInArrow(write, MANIFEST), "manifest")


READ = "file_no int, doc_id long, local_start long, n_tokens long, ids binary"


def read_ids(spark: SparkSession, folder: str, doc_ids: list[int] | None = None,
             with_ids: bool = True) -> DataFrame:
    """Documents of the files in ``folder``: ``file_no``, ``doc_id``,
    ``local_start`` (ids before it in its file), ``n_tokens`` and the ids as
    little-endian bytes (``with_ids=False``: their ``ids_crc32`` instead).
    ``doc_ids``: only these, decompressing only their frames."""
    wanted = None if doc_ids is None else np.unique(np.array(doc_ids, "i8"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.tzst").load(folder) \
        .select("path", "content")
    last, schema = ("ids", READ) if with_ids else ("ids_crc32", READ.replace("ids binary", "ids_crc32 long"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                number = int(b.column("path")[k].as_py().rsplit("part-", 1)[1].split(".")[0])
                f = SeekableReader(b.column("content")[k].as_py())
                at = np.arange(len(f.ids)) if wanted is None else \
                    np.flatnonzero(np.isin(f.ids, wanted) & ~f.null)
                for lo in range(0, len(at), 2000):
                    part = at[lo:lo + 2000]
                    raw = [f.document(int(i)) for i in part]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(part), number, "i4")),
                        pa.array(f.ids[part], pa.int64(), mask=f.null[part]),
                        pa.array(f.starts[part]), pa.array(f.lengths[part]),
                        pa.array(raw, pa.binary()) if with_ids else
                        pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                    ], ["file_no", "doc_id", "local_start", "n_tokens", last])

    return files.mapInArrow(parse, schema)


def token_digest(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, folder: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files, read them back, and give each document's ``start``
    (ids of all documents before it), ``n_tokens`` and ``ids_crc32``."""
    spark = docs.sparkSession
    folder = folder or stage_path(spark, "token-files")
    manifest = write_ids(docs, folder, tokenizer_path, end_id, id_col, text_col)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file_no int")
    # One row per file: the running total runs over the list of files only.
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    base = manifest.select("file_no", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    read = read_ids(spark, folder, with_ids=False)
    return read.join(base, "file_no").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "file_no")
