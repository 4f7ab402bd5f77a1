"""Packing token ids into sequences by minimum bin slack.

A document of t ids gives t // WINDOW whole windows, each a sequence of its own, and a remainder shorter than a window.
Remainders are packed by length alone, and there are fewer than WINDOW lengths: the driver works on their histogram, so
its work does not grow with the corpus. Minimum bin slack: the longest remaining length opens a window; a bitset
subset-sum dynamic program over the remaining multiset (counts in binary parts) finds the sums that fill the rest, the
one closest to capacity wins, and backtracking gives how often it uses each length. The pattern is applied as often as
the counts allow, so a pattern uses up a length, or nearly: a few thousand patterns at most.

Windows left with more than SLACK ids of padding are taken apart: their remainders follow each other in one stream that
is cut at every WINDOW ids, which pads its last sequence only. Patterns, ranges of ranks within a length and places in
the stream are a table of bounded size. Documents find theirs by their rank among those with the same remainder, a rank
within a bucket of documents plus an offset of the bucket, so that a length that a third of all documents have is no
single task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, lean, offsets_by_bucket, small_batches, texts
from .tokens import encoder

WINDOW, SLACK, BUCKET_DOCS, END_ID = 1024, 4, 100_000, 0


def fill(counts: np.ndarray, room: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum up to `room`: bitset subset sums, longest first, with backtracking."""
    steps, bits, mask = [], 1, (1 << room + 1) - 1
    for n in range(room, 0, -1):
        left, k = min(int(counts[n]), room // n), 1
        while left:
            k = min(k, left)
            steps.append((n, k, bits))
            bits |= bits << n * k & mask
            left, k = left - k, 2 * k
        if bits >> room & 1:
            break
    goal, used = bits.bit_length() - 1, {}
    for n, k, before in reversed(steps):
        if not before >> goal & 1:
            used[n] = used.get(n, 0) + k
            goal -= n * k
    return used


def minimum_bin_slack(counts: np.ndarray, window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> how often) and how many windows are filled by each, for counts[length]."""
    counts, out = counts.astype(np.int64).copy(), []
    top = len(counts) - 1
    while top:
        if not counts[top]:
            top -= 1
            continue
        counts[top] -= 1
        used = fill(counts, window - top)
        counts[top] += 1
        used[top] = used.get(top, 0) + 1
        times = min(int(counts[n]) // k for n, k in used.items())
        for n, k in used.items():
            counts[n] -= k * times
        out.append((used, times))
    return out


def layout(counts: np.ndarray, window: int = WINDOW, slack: int = SLACK) -> tuple[dict[int, np.ndarray], int]:
    """For each length, rows (first rank, windows' worth, how often a window, first sequence, offset, stream place) by rank:
    ranks from the first on lie in sequences at the offset, or, where the stream place is 0 or more, in the stream. And the number of sequences."""
    rank, rows, seq, loose = np.zeros(len(counts), np.int64), {n: [] for n in range(1, len(counts)) if counts[n]}, 0, []
    for used, times in minimum_bin_slack(counts, window):
        if window - sum(n * k for n, k in used.items()) > slack:
            loose += [(n, k * times) for n, k in used.items()]
            continue
        at = 0
        for n, k in sorted(used.items(), reverse=True):
            rows[n].append((rank[n], k, seq, at, -1))
            rank[n] += k * times
            at += n * k
        seq += times
    place = 0
    for n, k in loose:
        rows[n].append((rank[n], 1, seq, 0, place))
        rank[n] += k
        place += n * k
    return {n: np.array(r, np.int64) for n, r in rows.items()}, seq + -(-place // window)


def locate(rows: dict[int, np.ndarray], n: int, rank: int, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """(start in the remainder, length, sequence, offset) of the pieces of a remainder; two where the stream is cut within it."""
    r = rows[n]
    first, k, seq, at, place = r[int(np.searchsorted(r[:, 0], rank, "right")) - 1].tolist()
    i = rank - first
    if place < 0:
        return [(0, n, seq + i // k, at + i % k * n)]
    a = place + i * n
    cut = min(n, window - a % window)
    out = [(0, cut, seq + a // window, a % window)]
    return out + ([(cut, n - cut, seq + a // window + 1, 0)] if cut < n else [])


def tokenize(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = END_ID) -> DataFrame:
    """(row, doc_id, tokens, ids) of (doc_id, text); row is a number of its own within the written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, row = encoder(tokenizer, kind), TaskContext.get().partitionId() << 40
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            for some in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                got = [r + end for r in enc.encode(texts(some).to_pylist())]
                size = [len(r) // enc.dtype.itemsize for r in got]
                yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(got)), pa.int64()), some.column(0), pa.array(size, pa.int64()), pa.array(got, pa.binary())], ["row", "doc_id", "tokens", "ids"])
                row += len(got)

    return docs.mapInArrow(lean(run), "row long, doc_id long, tokens long, ids binary")


@small_batches
def pack(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = END_ID, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, on demand, ids (array<int>).

    Null texts are empty ones: the end id alone. Rows with one doc_id, or none, are documents of their own; ties in rank
    are settled by place in the written table. Each id lies in one piece, pieces of a sequence follow each other without a gap, and
    sequences that are not full are padded to the window by whoever reads them, except at a power of two. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    width = encoder(tokenizer, kind).dtype.str
    table = scratch.save(tokenize(src, tokenizer, kind, end_id), "ids")

    rest = (F.col("tokens") % window).cast("int")
    hist = table.groupBy(rest.alias("rest")).agg(F.count("*").alias("n")).collect()  # at most `window` rows
    counts = np.zeros(window, np.int64)
    for r in hist:
        counts[r["rest"]] = r["n"]
    buckets = max(8, -(-int(counts.sum()) // BUCKET_DOCS))
    counts[0] = 0
    rows, first_whole = layout(counts, window)

    narrow = table.select("row", "doc_id", rest.alias("rest"), F.floor(F.col("tokens") / window).alias("whole"), F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int").alias("bucket"))
    by_rest = offsets_by_bucket(narrow.groupBy("rest", "bucket").agg(F.count("*").alias("n"), F.sum("whole").alias("w")), ["rest"], "bucket", "n", "rank0")
    whole = by_rest.groupBy("bucket").agg(F.sum("w").alias("w")).withColumn("all", F.lit(1))
    by_bucket = offsets_by_bucket(whole, ["all"], "bucket", "w", "whole0").select("bucket", "whole0")
    order = Window.partitionBy("bucket").orderBy("doc_id", "row")
    spot = narrow.withColumn("w1", F.sum("whole").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("whole"))
    spot = spot.withColumn("r1", F.row_number().over(Window.partitionBy("bucket", "rest").orderBy("doc_id", "row")) - 1)
    spot = spot.join(by_rest.select("rest", "bucket", "rank0"), ["rest", "bucket"]).join(by_bucket, "bucket")
    spot = spot.select("row", (F.col("rank0") + F.col("r1")).alias("rank"), (F.col("whole0") + F.col("w1")).alias("nth"))
    held = spark.sparkContext.broadcast(rows)  # at most `window` lengths times the patterns they occur in

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for d, ids, rank, nth in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                ids = np.frombuffer(ids, width).astype("<u4")
                cut = len(ids) // window * window
                where = [(k * window, window, first_whole + nth + k, 0) for k in range(cut // window)]
                if cut < len(ids):
                    where += [(cut + a, n, s, o) for a, n, s, o in locate(held.value, len(ids) - cut, rank, window)]
                for start, n, seq, off in where:
                    part = ids[start : start + n]
                    for x, v in zip(out, (d, start, n, zlib.crc32(part.tobytes()), len(ids), seq, off, part.astype(np.int32) if with_ids else None), strict=True):
                        x.append(v)
            cols = [pa.array(x, pa.int64()) for x in out[:7]] + ([pa.array(out[7], pa.list_(pa.int32()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(cols, PIECE[: len(cols)])

    joined = table.select("row", "doc_id", "ids").join(spot.hint("merge"), "row").select("doc_id", "ids", "rank", "nth")
    return joined.mapInArrow(lean(run), ", ".join(f"{c} long" for c in PIECE[:7]) + (", ids array<int>" if with_ids else ""))


PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
