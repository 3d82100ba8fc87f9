"""Token ids in seekable zstandard files: one independent frame for each document, a trailing seek table, a checksum for each frame.

A file: the zstandard seekable format (frames, then a skippable frame with the sizes and checksums of all frames and a
footer that ends in the magic number 0x8F92EAB1). Frame 0 is the header: partition, number within the partition, id
width, and the document ids in order. Frame i + 1 holds document i's ids, little-endian. Every tool that reads
zstandard reads the file; a reader of some documents decompresses frame 0 and theirs.

Spark writes and commits the files, so they can lie in any store that Spark reaches, and a lost task leaves nothing:
a row of the text writer is a file but for its last byte, and the line separator is that byte.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratewise.llm import common, tokens

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80
FOOTER = struct.Struct("<IBI")
_HEADER = struct.Struct("<4sIIBQ")
_NO_ID = -(1 << 63)
#: Compressed bytes after which a file ends; a longer document makes a longer file.
FILE_BYTES = 8 << 20


def file_image(partition: int, number: int, doc_ids: list[int | None], documents: list[bytes], width: int, level: int = 1) -> bytes:
    """A whole file; documents are raw little-endian ids of width bytes each."""
    ids = np.array([_NO_ID if i is None else i for i in doc_ids], "<i8")
    raw = [_HEADER.pack(b"TIDF", partition, number, width, len(ids)) + ids.tobytes(), *documents]
    compressor = zstandard.ZstdCompressor(level=level, write_checksum=False)
    frames = [compressor.compress(x) for x in raw]
    return seal(frames, raw)


def seal(frames: list[bytes], raw: list[bytes]) -> bytes:
    entries = b"".join(struct.pack("<III", len(f), len(x), xxhash.xxh64_intdigest(x) & 0xFFFFFFFF) for f, x in zip(frames, raw, strict=True))
    table = entries + FOOTER.pack(len(frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
    return b"".join([*frames, struct.pack("<II", SKIPPABLE_MAGIC, len(table)), table])


class FrameReader:
    """Random access to a file's documents."""

    def __init__(self, image: bytes):
        frames, flags, magic = FOOTER.unpack_from(image, len(image) - FOOTER.size)
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("not a seekable file with checksums")
        size = 12 * frames + FOOTER.size
        if struct.unpack_from("<II", image, len(image) - size - 8) != (SKIPPABLE_MAGIC, size):
            raise ValueError("the seek table is damaged")
        table = np.frombuffer(image, "<u4", 3 * frames, len(image) - size).reshape(-1, 3)
        self.image, self.sizes, self.checks = memoryview(image), table[:, 1], table[:, 2]
        self.at = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        self._zstd = zstandard.ZstdDecompressor()
        head = self.frame(0)
        tag, self.partition, self.number, self.width, n = _HEADER.unpack_from(head)
        if tag != b"TIDF":
            raise ValueError("not a token id file")
        self.doc_ids = [None if i == _NO_ID else i for i in np.frombuffer(head, "<i8", n, _HEADER.size).tolist()]

    def frame(self, i: int) -> bytes:
        raw = self._zstd.decompress(self.image[self.at[i] : self.at[i + 1]], max_output_size=int(self.sizes[i]) or 1)
        if len(raw) != self.sizes[i] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.checks[i]:
            raise ValueError(f"frame {i} is damaged")
        return raw

    def document(self, i: int) -> np.ndarray:
        return np.frombuffer(self.frame(i + 1), f"<u{self.width}").astype("<u4")


def _images(batches, path: str, end_id: int, width: int, file_bytes: int):
    partition, number = TaskContext.get().partitionId(), 0
    encoder = tokens.encoder(path, keeps_space=True)
    compressor = zstandard.ZstdCompressor(level=1, write_checksum=False)
    ids, frames, sums, size = [], [], [], 0

    def finished():
        head = _HEADER.pack(b"TIDF", partition, number, width, len(ids)) + np.array(ids, "<i8").tobytes()
        entries = [(len(f := compressor.compress(head)), len(head), xxhash.xxh64_intdigest(head) & 0xFFFFFFFF), *sums]
        table = np.array(entries, "<u4").tobytes() + FOOTER.pack(len(entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        image = b"".join([f, *frames, struct.pack("<II", SKIPPABLE_MAGIC, len(table)), table])
        return pa.RecordBatch.from_arrays([pa.array([image[:-1]], pa.binary())], names=["image"])

    for batch in batches:
        for doc_id, piece in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
            raw = np.append(piece, np.uint32(end_id)).astype(f"<u{width}").tobytes()
            frames.append(compressor.compress(raw))
            sums.append((len(frames[-1]), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            ids.append(_NO_ID if doc_id is None else doc_id)
            size += len(frames[-1])
            if size >= file_bytes:
                yield finished()
                ids, frames, sums, size, number = [], [], [], 0, number + 1
    if ids:
        yield finished()


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, width: int = 2, file_bytes: int = FILE_BYTES) -> None:
    """Encode every text and write the files under path, in order of id (nulls first; rows that repeat an id by text).

    A null text has end_id alone. width: bytes of an id, 2 or 4. An empty table writes no file.
    """
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    rows = rows.repartitionByRange(common.shuffle_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    images = rows.mapInArrow(lambda it: _images(it, tokenizer_path, end_id, width, file_bytes), "image binary")
    last = chr(SEEKABLE_MAGIC >> 24)
    images.select(F.col("image").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", last).text(path)


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """Documents of the files under path: partition, number, nth, doc_id, start_in_file, n_tokens, ids_crc32, ids.

    Every frame read is checked. doc_ids: only these documents' frames are decompressed; start_in_file follows from the
    seek table. Without with_ids, ids are null.
    """
    wanted = None if doc_ids is None else set(doc_ids)

    def documents(batches):
        for batch in batches:
            for content in batch.column(0):
                reader = FrameReader(content.as_py())
                starts = np.concatenate([[0], np.cumsum(reader.sizes[1:] // reader.width, dtype=np.int64)])
                rows = []
                for i, doc_id in enumerate(reader.doc_ids):
                    if wanted is None or doc_id in wanted:
                        ids = reader.document(i)
                        rows.append((reader.partition, reader.number, i, doc_id, int(starts[i]), len(ids), zlib.crc32(ids.tobytes()), ids.tolist() if with_ids else None))
                if rows:
                    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["partition", "number", "nth", "doc_id", "start_in_file", "n_tokens", "ids_crc32", "ids"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(documents, "partition long, number long, nth long, doc_id long, start_in_file long, n_tokens long, ids_crc32 long, ids array<long>")


def corpus_positions(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    found = common.staged(read_token_files(spark, path, with_ids=False).drop("ids"), "token-documents")
    files = found.groupBy("partition", "number").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    partitions = files.groupBy("partition").agg(F.sum("n").alias("n"))  # one row for each partition of the writer
    earlier = partitions.select("partition", F.coalesce(F.sum("n").over(Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    files = files.withColumn("in_partition", F.coalesce(F.sum("n").over(before.partitionBy("partition").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bases = files.join(earlier, "partition").select("partition", "number", (F.col("in_partition") + F.col("earlier")).alias("base"))
    return found.join(bases, ["partition", "number"]).select("doc_id", (F.col("base") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")


def encode_corpus(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Write docs as token id files to the shared folder and read every document's place and checksum back from them."""
    spark = docs.sparkSession
    path = common.new_path(spark, "token-files")
    write_token_files(docs, path, tokenizer_path, id_col, text_col, end_id)
    return corpus_positions(spark, path)
