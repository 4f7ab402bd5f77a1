"""Shared helpers of the training-data operators: scratch tables, Arrow batches, connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Where none is set, a temporary one for a local master, which has
    one machine, and an error for a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="sectorflow-"))
        atexit.register(shutil.rmtree, _LOCAL[0][len("file://") :], ignore_errors=True)
    return _LOCAL[0]


class Scratch:
    """Tables written to the shared folder. They cut lineage and outlive any executor. What an operator returns may read them, so
    they stay until `finish`, `clear` or the reader's own deletion."""

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.names = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}", []
        Scratch.made.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        self.names.append(name)
        df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def finish(self, df: DataFrame) -> DataFrame:
        """`df` as the last table; all before it, which it need no longer read, are deleted."""
        before, out = list(dict.fromkeys(self.names)), self.save(df, "result")
        for name in before:
            self.drop(name)
        self.names = ["result"]
        return out


def clear(keep: Collection[Scratch] = ()) -> None:
    """Delete all scratch tables of this driver, once what was read from them is written elsewhere, but those of `keep`."""
    for s in [s for s in Scratch.made if s not in keep]:
        s.drop()
        Scratch.made.remove(s)


@contextlib.contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """While it lasts, each query's shuffle files are deleted when it ends. By itself Spark does so once the driver has collected what
    stands for them, which may come after the last step, so that the files of all steps are on disk together."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as keep it apart from `columns` and the others, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def hash_sample(df: DataFrame, key: str, n: int, size=None, most: int = 0) -> DataFrame:
    """About `n` rows, those whose key has the smallest hashes: the bound is found on hashes alone, so tasks do not each
    send `n` whole rows to the driver. Ties at the bound are cut to `n` rows. With `size` (bytes of a row), rows that
    would bring the sum beyond `most` are left out, but for the smallest, which is taken where no row fits."""
    h = F.xxhash64(key)
    size = F.lit(0) if size is None else size
    top = df.select(h.alias("h"), size.alias("s")).orderBy("h", "s").limit(n).collect()
    room, taken = most, []
    for r in top:
        if r["s"] <= room:
            room -= r["s"]
            taken.append((r["h"], r["s"]))
    if not taken:
        taken = [(r["h"], r["s"]) for r in sorted(top, key=lambda r: r["s"])[:1]]
    if len(taken) == len(top):
        return df.where(h <= F.lit(top[-1]["h"] if top else 0)).limit(n)
    rows = df.sparkSession.createDataFrame(sorted(set(taken)), "_sample_h long, _sample_s long")  # n rows at most
    return df.join(F.broadcast(rows), (h == F.col("_sample_h")) & (size == F.col("_sample_s")), "left_semi").limit(len(taken))


@contextlib.contextmanager
def arrow_limits(spark: SparkSession, batch_rows: int = 2000) -> Iterator[None]:
    """Arrow batches of `batch_rows` rows while it lasts, so that workers that run beside each other hold little; a batch of long
    texts ends by its bytes, at the engine's own limit."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(batch_rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(f):
    """`f`, whose first argument is a DataFrame, within arrow_limits."""

    @functools.wraps(f)
    def within(df: DataFrame, *args, **kw):
        with arrow_limits(df.sparkSession):
            return f(df, *args, **kw)

    return within


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`f` for mapInArrow; at a task's end what it has freed goes back to the system. A worker waits for its next task beside the
    executor's heap, also while steps run that need no Python, and would else keep the most that any task has held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # where the C library is another one
                ctypes.CDLL(None).malloc_trim(0)

    return run


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col, "") if col.null_count else col


def pieces(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches where their texts reach `limit` bytes; a longer text is a piece by itself. Yields rows, bytes and offsets."""
    for batch in batches:
        col = texts(batch, name)
        offs = np.frombuffer(col.buffers()[1], dtype=np.int32, count=len(col) + 1, offset=4 * col.offset).astype(np.int64) if len(col) else np.zeros(1, np.int64)
        raw = col.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        a = 0
        while a < len(col):
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
            yield batch.slice(a, b - a), data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            a = b


def grouped(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The batches put together until they reach `limit` bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


HOT_LINKS, MOST_HOT = 1000, 100_000


def _with_least(links: DataFrame, least: Column, rows: int) -> DataFrame:
    """`links` (u, v) with m, the aggregate `least` of its u, by a join in which a u of more than `hot` links is cut into parts
    by v. There are rows / hot <= MOST_HOT such u at most, so they are broadcast."""
    hot = max(HOT_LINKS, rows // MOST_HOT)
    m = links.groupBy("u").agg(least.alias("m"), F.ceil(F.count("*") / hot).cast("int").alias("parts"))
    busy = m.where("parts > 1").select(F.col("u").alias("_u"), F.col("parts").alias("_parts"))
    cut = links.join(F.broadcast(busy), F.col("u") == F.col("_u"), "left").withColumn("part", F.pmod(F.xxhash64("v"), F.coalesce("_parts", F.lit(1))).cast("int"))
    m = m.select("u", "m", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return cut.select("u", "v", "part").join(m, ["u", "part"]).select("u", "v", "m")


def connected_components(scratch: Scratch, edges: DataFrame, name: str = "cc") -> DataFrame:
    """Components of an undirected graph with columns u, v (long). Returns (id, component), component being the
    smallest id reachable; nodes without an edge are absent.

    Alternating large-star and small-star rounds: each is one shuffle of at most the edges there are, with map-side
    deduplication, and the number of rounds grows with the logarithm of the longest path. The links of a node with very many
    (the centre of a star) are spread over several tasks. Each round is written to the shared folder, so a lost executor
    costs one round at most. Only counts reach the driver.
    """
    spark = scratch.spark
    e = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = scratch.save(e, f"{name}-0")
    last, k, rows = None, 0, 2 * e.count()
    while True:
        # large star: every neighbour larger than u is linked to the smallest of u and its neighbours
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, F.least(F.min("v"), F.first("u")), rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour and u itself are linked to the smallest
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, F.min("v"), rows)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        k += 1
        e_new = scratch.save(small, f"{name}-{k}")
        state = e_new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        scratch.drop(f"{name}-{k - 1}")
        e = e_new
        if (state["n"], state["h"]) == last:
            break
        last, rows = (state["n"], state["h"]), 2 * state["n"]
    comp = e.groupBy("u").agg(F.min("v").alias("component"))
    roots = comp.select(F.col("component").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return comp.select(F.col("u").alias("id"), "component").unionByName(roots)


def offsets_by_bucket(df: DataFrame, keys: list[str], bucket: str, amount: str, out: str) -> DataFrame:
    """Exclusive running sum of `amount` over buckets within keys, for a table with one row for each key and bucket."""
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(amount).over(w), F.lit(0)).cast("long"))
