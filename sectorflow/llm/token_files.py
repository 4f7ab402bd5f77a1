"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

Format of a shard, little-endian:

    8 bytes  magic "TOKZ0001"
    header   HEADER: id width in bytes, SHA-256 of the dictionary, partition, number within it, documents, ids,
             ids before this shard within its partition, offset of the index
    frames   one zstandard frame for each document: its ids, 2 or 4 bytes each
    index    doc_id int64[n], 1 for a null doc_id uint8[n], frame offset uint64[n + 1], ids uint64[n]

A document is read by its index entry alone: one frame and the dictionary. The dictionary is trained on the serialized ids of a
bounded sample, SAMPLE documents by hash of their doc_id and SAMPLE_BYTES of text at most, and stored beside the shards
under its hash. It has an eighth of the sample's bytes, DICT_BYTES at most. A sample that zstandard's trainer finds too
small is the dictionary itself, as raw content; only a table without rows has none.

Documents are range-partitioned and sorted by doc_id (null first), so partition and number order the shards. A task
writes its shards under their final names by a move, so a repeated or speculative task writes the same files again.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, grouped, hash_sample, small_batches, texts
from .tokens import GROUP, encoder

MAGIC, HEADER = b"TOKZ0001", struct.Struct("<B32sIIQQQQ")
SAMPLE, SAMPLE_BYTES, DICT_BYTES, SHARD_BYTES, LEVEL, END_ID = 1000, 16 << 20, 65536, 8 << 20, 3, 1


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """Dictionary of serialized ids. Samples too few or short for the trainer are, one behind the other, a raw one."""
    whole = b"".join(samples)
    try:
        return zstandard.train_dictionary(max(256, min(size, len(whole) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return (whole * (-(-8 // len(whole))))[-size:] if whole else b""  # 8 bytes are the least it takes


def _coder(cls, data: bytes, **kw):
    return cls(dict_data=zstandard.ZstdCompressionDict(data), **kw) if data else cls(**kw)


def pack_shard(ids: list[int | None], rows: list[bytes], width: int, dictionary: bytes, partition: int, part: int, before: int) -> tuple[bytes, int]:
    """A shard of the rows' serialized ids, and how many ids it holds."""
    coder = _coder(zstandard.ZstdCompressor, dictionary, level=LEVEL)
    frames = [coder.compress(r) for r in rows]
    count = np.array([len(r) // width for r in rows], "<u8")
    start = len(MAGIC) + HEADER.size
    offs = np.cumsum([start, *map(len, frames)]).astype("<u8")
    n = int(count.sum())
    head = HEADER.pack(width, hashlib.sha256(dictionary).digest(), partition, part, len(rows), n, before, int(offs[-1]))
    index = [np.array([0 if i is None else i for i in ids], "<i8"), np.array([i is None for i in ids], "u1"), offs, count]
    return b"".join([MAGIC, head, *frames, *(x.tobytes() for x in index)]), n


class Shard:
    """Reads a shard: its header and index, and any document by its place."""

    def __init__(self, blob: bytes, dictionary: bytes):
        if blob[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        self.width, sha, self.partition, self.part, n, self.n_ids, self.before, at = HEADER.unpack_from(blob, len(MAGIC))
        if sha != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        self.blob, self.coder = memoryview(blob), _coder(zstandard.ZstdDecompressor, dictionary)
        self.doc_id = np.frombuffer(blob, "<i8", n, at)
        self.null = np.frombuffer(blob, "u1", n, at + 8 * n).astype(bool)
        self.offset = np.frombuffer(blob, "<u8", n + 1, at + 9 * n)
        self.count = np.frombuffer(blob, "<u8", n, at + 9 * n + 8 * (n + 1))

    def __len__(self) -> int:
        return len(self.doc_id)

    def document(self, i: int) -> np.ndarray:
        raw = self.coder.decompress(self.blob[int(self.offset[i]) : int(self.offset[i + 1])])
        return np.frombuffer(raw, f"<u{self.width}")


def _put(folder: str, name: str, blob: bytes) -> None:
    fs, root = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), folder)
    fs.create_dir(root, recursive=True)
    temp = f"{root}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(temp) as out:
        out.write(blob)
    fs.move(temp, f"{root}/{name}")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, kind: str = "word", end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, bytes]:
    """Write all texts as shards in `folder`, which every executor reaches. Returns a manifest, one row a shard
    (partition, part, file, docs, ids), as a lazy table that writes when it runs, and the dictionary."""
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sample = [r["text"] for r in hash_sample(src, "doc_id", SAMPLE, F.octet_length("text"), SAMPLE_BYTES).select("text").collect()]
    coder = encoder(tokenizer, kind)
    dictionary = train_dictionary([r + np.array([end_id], coder.dtype).tobytes() for r in coder.encode(sample)])
    _put(folder, f"dictionary-{hashlib.sha256(dictionary).hexdigest()}.zdict", dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, partition = encoder(tokenizer, kind), TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype).tobytes()
        ids, rows, size, part, before, done = [], [], 0, 0, 0, []

        def flush():
            nonlocal ids, rows, size, part, before
            name = f"shard-{partition:06d}-{part:06d}.tokz"
            blob, n = pack_shard(ids, rows, enc.dtype.itemsize, dictionary, partition, part, before)
            _put(folder, name, blob)
            done.append((partition, part, name, len(rows), n))
            ids, rows, size, part, before = [], [], 0, part + 1, before + n

        for some in grouped(batches, GROUP):
            for i, r in zip(some.column(0).to_pylist(), enc.encode(texts(some)), strict=True):
                ids.append(i)
                rows.append(r + end)
                size += len(r)
                if size >= 2 * SHARD_BYTES:
                    flush()
        if rows:
            flush()
        cols = list(zip(*done, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["partition", "part", "file", "docs", "ids"])

    ordered = src.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return ordered.mapInArrow(run, "partition int, part int, file string, docs long, ids long"), dictionary


def read_token_files(spark: SparkSession, folder: str, dictionary: bytes, totals: dict[int, int]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the folder's shards. totals: ids of each partition."""
    base, total = {}, 0
    for p in sorted(totals):
        base[p], total = total, total + totals[p]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                s = Shard(blob.as_py(), dictionary)
                count = s.count.astype(np.int64)
                start = base[s.partition] + s.before + np.cumsum(count) - count
                crc = [zlib.crc32(s.document(i).astype("<u4").tobytes()) for i in range(len(s))]
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_id, mask=s.null), pa.array(start), pa.array(count), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokz").load(folder).select("content")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


@small_batches
def tokenize_to_files(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Write token files and read them back: (doc_id, start, n_tokens, ids_crc32), a row for each row of `docs`.

    Null texts are empty ones: the end id alone. Null doc_ids come first. Rows that repeat a doc_id each have a place, in
    the order of a hash of their texts. An empty table writes no shard and gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-files")
    folder = folder or scratch.path("shards")
    manifest, dictionary = write_token_files(docs, folder, tokenizer, kind, end_id)
    manifest = scratch.save(manifest, "manifest")
    totals = {r["partition"]: r["n"] for r in manifest.groupBy("partition").agg(F.sum("ids").alias("n")).collect()}  # a row a partition
    return read_token_files(spark, folder, dictionary, totals)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenize_to_files(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
