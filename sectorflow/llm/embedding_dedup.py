"""Embedding near-dedup by an inverted multi-index.

Vectors are brought to length 1 and halved. Each half has a codebook of its own (k-means on a bounded sample, SAMPLE
vectors by hash), so the product of the codebooks is a grid of cells without a list of them. Every vector lies in the
cell of its two nearest centroids. A vector as a query visits cells by the multi-sequence traversal: the cells in order
of the sum of two lower bounds of squared distances, one a half. A half's bound is the larger of two: centroid distance
less the radius of the centroid's members, and the distance to the bisecting planes behind which the centroid is the
nearest. Cosine >= t means a squared distance <= 2 - 2t, so once the sum of bounds is beyond that, no further cell can
hold a link: the traversal stops at a recall of 1 (TARGET_RECALL), not at a guess. Radii are over all vectors.
Codebooks are as large as makes a label's cell hold about BLOCK / 4 vectors, up to MAX_CENTROIDS.

Identical vectors of one label are one node from the start. Vectors travel as the table has them (a table of floats as
floats) and are brought to length 1 where they are compared. Candidates are compared in double precision, cell by cell,
queries against members in blocks; a cell of more than BLOCK members is cut into parts, each a task of its own that its
queries visit too. What a task returns is, for each query, its number of links (weighted by the copies behind a node)
and a spanning forest of the links, at most one row for each vector: never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected_components, hash_sample, small_batches

THRESHOLD, MAX_CENTROIDS, SAMPLE, BLOCK, TARGET_RECALL, SEED, EPS = 0.93, 256, 8192, 2048, 1.0, 7, 1e-9


def matrix(col: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1, and which of them are vectors: not null, of length `dim` (that of the first vector where
    it is not given, all being alike), finite, not zero."""
    n = len(col)
    size = np.array([-1 if s is None else s for s in pa.compute.list_value_length(col).to_pylist()])
    if dim is None:
        dim = int(size[size > 0][0]) if (size > 0).any() else 1
    rows, ok = np.zeros((n, dim)), size == dim
    if ok.any():
        flat = col.filter(pa.array(ok)).flatten()
        rows[ok] = np.where(flat.is_null().to_numpy(zero_copy_only=False), np.nan, flat.to_numpy(zero_copy_only=False).astype(float)).reshape(-1, dim)
    ok &= np.isfinite(rows).all(axis=1)
    rows[~ok] = 0
    with np.errstate(over="ignore", invalid="ignore"):
        top = np.abs(rows).max(axis=1, initial=0)
        ok &= top > 0
        rows = rows / np.where(top > 0, top, 1)[:, None]
        rows = rows / np.where(ok, np.linalg.norm(rows, axis=1), 1)[:, None]
    return rows, ok


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means with seeded starts on distinct rows."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(SEED)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _distances(x, c).argmin(axis=1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(axis=0)
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * x @ c.T, 0))


def lower_bounds(x: np.ndarray, c: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each row and centroid, a bound below the squared distance to any vector whose nearest centroid it is; inf without members."""
    d = _distances(x, c)
    low = np.maximum(d - radius, 0)
    apart = _distances(c, c)
    for other in range(len(c)):  # beyond the plane between a centroid and another, the centroid is nearer
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d * d - d[:, other : other + 1] ** 2) / (2 * apart[:, other])
        low = np.maximum(low, np.where(apart[:, other] > EPS, plane, 0))
    return np.where(np.isfinite(radius), np.maximum(low - EPS, 0) ** 2, np.inf)


def traverse(bound1: np.ndarray, bound2: np.ndarray, stop: float) -> list[int]:
    """Multi-sequence traversal: cells i * k2 + j in order of bound1[i] + bound2[j] while that is <= stop."""
    import heapq

    o1, o2, k2 = np.argsort(bound1, kind="stable"), np.argsort(bound2, kind="stable"), len(bound2)
    heap, out, met = [(bound1[o1[0]] + bound2[o2[0]], 0, 0)], [], {(0, 0)}
    while heap:
        s, i, j = heapq.heappop(heap)
        if s > stop:
            break
        out.append(int(o1[i]) * k2 + int(o2[j]))
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(o1) and b < k2 and (a, b) not in met:
                met.add((a, b))
                heapq.heappush(heap, (bound1[o1[a]] + bound2[o2[b]], a, b))
    return out


def _labels(linked: np.ndarray, q: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id of each query's and each member's component under the links between them."""
    top = np.iinfo(np.int64).max
    lq, lm = q.copy(), m.copy()
    rows, cols = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    part = linked[np.ix_(rows, cols)]
    while len(rows):
        a = np.minimum(lq[rows], np.where(part, lm[cols], top).min(axis=1))
        b = np.minimum(lm[cols], np.where(part, a[:, None], top).min(axis=0))
        if (a == lq[rows]).all() and (b == lm[cols]).all():
            break
        lq[rows], lm[cols] = a, b
    return lq, lm


@small_batches
def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `vectors`; rows compare only with rows of the same label.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components, and rows with a null label,
    link with nothing and are their own component. vec_id is taken to be unique; rows that repeat it each count, and
    share a component. A null vec_id has null for a component. Links of equal vectors count like others. Tables may be empty.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding-dedup")
    kind = "array<float>" if vectors.select(F.col(vec)).schema[0].dataType.simpleString() == "array<float>" else "array<double>"
    src = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).cast(kind).alias("vec"), F.col(label).cast("string").alias("label"))

    sizes = src.where(F.size("vec") > 0).groupBy(F.size("vec").alias("size")).agg(F.count("*").alias("n"))
    usual = sizes.orderBy(F.desc("n"), "size").first()  # over all rows, so that a batch of other lengths is not taken for the usual one
    dim = usual["size"] if usual else 1

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, ok = matrix(b.column(1), dim)
            ok &= ~b.column(2).is_null().to_numpy(zero_copy_only=False) & ~b.column(0).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(ok)], ["vec_id", "vec", "label", "ok"])

    rows = src.mapInArrow(clean, f"vec_id long, vec {kind}, label string, ok boolean")
    rows = scratch.save(rows.withColumn("key", F.when(F.col("ok"), F.sha2(F.concat_ws("|", "label", F.array_join(F.transform("vec", lambda x: (x + F.lit(0.0)).cast("string")), ",")), 256))), "rows")
    nodes = scratch.save(rows.where("ok").groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("vec").alias("vec"), F.first("label").alias("label")), "nodes")

    sample = hash_sample(nodes, "node", SAMPLE).select("vec").toArrow()  # at most SAMPLE vectors
    x, ok = matrix(sample.column(0).combine_chunks())
    if not ok.any():
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    half = x.shape[1] // 2
    much = nodes.agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels")).first()
    k = max(1, min(MAX_CENTROIDS, round((much["n"] / max(1, much["labels"]) / (block / 4)) ** 0.5)))
    books = codebook(x[ok][:, :half], k), codebook(x[ok][:, half:], k)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, _ = matrix(b.column(2))
            d = [_distances(v[:, :half], books[0]), _distances(v[:, half:], books[1])]
            c = [y.argmin(axis=1) for y in d]
            r = [y[np.arange(len(v)), z] for y, z in zip(d, c, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), *(pa.array(z.astype(np.int32)) for z in c), *(pa.array(z) for z in r)], ["node", "copies", "vec", "label", "c1", "c2", "r1", "r2"])

    cells = nodes.select("node", "copies", "vec", "label").mapInArrow(assign, f"node long, copies long, vec {kind}, label string, c1 int, c2 int, r1 double, r2 double")
    cells = scratch.save(cells, "cells")
    radius = [np.full(len(b), -np.inf) for b in books]
    for k in (0, 1):
        for r in cells.groupBy(f"c{k + 1}").agg(F.max(f"r{k + 1}").alias("r")).collect():  # a row a centroid
            radius[k][r[0]] = r[1] + EPS
    parts = cells.groupBy("label", "c1", "c2").agg(F.count("*").alias("n")).select("label", (F.col("c1") * len(books[1]) + F.col("c2")).alias("cell"), F.ceil(F.col("n") / block).cast("int").alias("parts"))
    stop = 2 - 2 * threshold + 1e-6

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                v, _ = matrix(b.column(2))
                low = [lower_bounds(y, c, r) for y, c, r in zip((v[:, :half], v[:, half:]), books, radius, strict=True)]
                lists = [traverse(a, z, stop) for a, z in zip(*low, strict=True)]
                at = np.repeat(np.arange(len(v)), [len(y) for y in lists])
                for i in range(0, len(at), 4096):
                    rows_at = pa.array(at[i : i + 4096])
                    flat = pa.array(np.array([c for y in lists for c in y], np.int32)[i : i + 4096])
                    yield pa.RecordBatch.from_arrays([b.column(k).take(rows_at) for k in range(4)] + [flat], ["node", "copies", "vec", "label", "cell"])

    seen = cells.select("node", "copies", "vec", "label").mapInArrow(visits, f"node long, copies long, vec {kind}, label string, cell int")
    seen = seen.join(parts, ["label", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("label", "cell", "part", F.lit(1).alias("query"), "node", "copies", "vec")
    mine = cells.withColumn("cell", F.col("c1") * len(books[1]) + F.col("c2")).join(parts, ["label", "cell"])
    mine = mine.select("label", "cell", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("query"), "node", "copies", "vec")
    task = mine.unionByName(seen).repartition("label", "cell", "part").sortWithinPartitions("label", "cell", "part", "query")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, copies, rows_ = None, [], [], []
        for b in batches:
            key = list(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
            v, _ = matrix(b.column(6))
            q, i, n = (b.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5))
            cuts = [0, *(k for k in range(1, len(key)) if key[k] != key[k - 1] or q[k] != q[k - 1]), len(key)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if key[a] != now:
                    now, ids, copies, rows_ = key[a], [], [], []
                if q[a] == 0:
                    ids, copies, rows_ = [*ids, i[a:z]], [*copies, n[a:z]], [*rows_, v[a:z]]
                    continue
                m_id, m_n, m = np.concatenate(ids), np.concatenate(copies), np.concatenate(rows_)
                for s in range(a, z, 512):
                    e = min(z, s + 512)
                    linked = v[s:e] @ m.T >= threshold
                    other = linked & (i[s:e, None] != m_id)
                    total = (other * m_n).sum(axis=1)
                    lq, lm = _labels(linked, i[s:e], m_id)
                    at, to, num = np.r_[i[s:e], m_id], np.r_[lq, lm], np.r_[total, np.zeros(len(m_id), np.int64)].astype(np.int64)
                    told = (at != to) | (num > 0)
                    yield pa.RecordBatch.from_arrays([pa.array(at[told]), pa.array(to[told]), pa.array(num[told])], ["node", "to", "n"])

    found = scratch.save(task.mapInArrow(verify, "node long, to long, n long"), "found")
    comp = connected_components(scratch, found.select(F.col("node").alias("u"), F.col("to").alias("v")), "cc")
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    of = nodes.select("key", "node", "copies").join(links, "node", "left").join(comp, F.col("node") == F.col("id"), "left")
    of = of.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = rows.select("vec_id", "key").join(of, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return scratch.finish(out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of a label, and the smallest id that reaches each vector. An id travels only to larger ones: the least of a component meets no smaller one.
SQL = f"""
WITH RECURSIVE s AS (SELECT len(embedding) AS size FROM embeddings WHERE len(embedding) > 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
v AS (
  SELECT vec_id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings, s
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) = size AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r AS (SELECT DISTINCT u AS id, u AS c FROM l UNION SELECT l.u, r.c FROM r JOIN l ON l.v = r.id WHERE r.c < l.u),
k AS (SELECT id, min(c) AS c FROM r GROUP BY id), n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) IS NOT DISTINCT FROM vec_id AS kept
FROM embeddings LEFT JOIN k ON k.id = vec_id LEFT JOIN n ON n.u = vec_id
"""
