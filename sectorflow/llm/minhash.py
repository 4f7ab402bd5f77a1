"""MinHash near-dedup: BagMinHash signatures of word-shingle multisets, bands, exact verification.

Similarity is the Jaccard index of multisets of five-word shingles, sum of minima over sum of maxima.

Signatures: a shingle of multiplicity c owns the Poisson processes of the weight intervals (0, 1], (1, 2], (2, 4],
(4, 8], ... up to the one c lies in, each with the rate of its width. The points of the interval that c cuts are thinned
by their place in it, which is what descending its halves would do. A point has an arrival time and one of M registers;
a register keeps its earliest arrival over the whole document. Two documents agree in a register with a probability of
exactly their weighted Jaccard index. Only arrivals up to a time T can matter, by which all registers are full; T comes
from the total weight, and a document with an empty register at T is done again with 2T. So the work for a document is
its first arrivals plus about M ln M points, whatever its weights.

Bands of ROWS registers make candidates (at similarity 0.8 a pair is missed with a probability of about
(1 - 0.8^6)^32 = 6e-5). Identical texts are one node from the start. In a bucket every node is linked to the smallest;
components of these links are candidate clusters. Within a cluster the shingle multisets are compared exactly: a document
against all others of the cluster at once, by an inverted index, until all documents not yet compared are in one
class, for then no link between classes can be missing. So a group of g near copies takes about one comparison each,
and the result of a task is a spanning forest, not pairs. A cluster of more than BLOCK_SHINGLES shingles is cut into
parts, each a task. Its first document goes to all parts and is compared with their members; those that are like it are one
class, and need no comparison among each other. The others, none in a group of near copies, then go to all parts themselves,
and are compared with all members that are not known to be of their class. Classes are the components over all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected_components, lean, pieces, small_batches, unused
from .kernels import U, mix, multiset, shingles

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 32, 6
M = BANDS * ROWS
BLOCK_SHINGLES = 1 << 20


def _uniform(seed: np.ndarray, k: int) -> np.ndarray:
    return ((mix(seed + U(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(h: np.ndarray, doc: np.ndarray, count: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """n x m arrival times of the bags given by (hash, document, count); inf in rows of empty bags."""
    out = np.full((n, m), np.inf)
    weight = np.bincount(doc, weights=count, minlength=n)
    limit = m * (np.log(m) + 4.0) / np.maximum(weight, 1)
    todo = weight > 0
    while todo.any():
        pick = todo[doc]
        _arrivals(out, h[pick], doc[pick], count[pick], limit)
        todo &= np.isinf(out).any(axis=1)
        out[todo] = np.inf
        limit = np.where(todo, 2 * limit, limit)
    return out


def _arrivals(out, h, doc, count, limit) -> None:
    n, m = out.shape
    flat = out.reshape(-1)
    level = 0
    while len(h):
        low = 0.0 if level == 0 else 2.0 ** (level - 1)
        width = max(low, 1.0)
        seed, d, c = mix(h + U(level * 0xA0761D6478BD642F & (1 << 64) - 1)), doc, count
        t, k = np.zeros(len(seed)), 0
        while len(seed):
            t = t - np.log(_uniform(seed, 3 * k)) / width
            on = t <= limit[d]
            seed, d, c, t = seed[on], d[on], c[on], t[on]
            place = d * m + (_uniform(seed, 3 * k + 1) * m).astype(np.int64)
            if level:
                ok = low + width * _uniform(seed, 3 * k + 2) <= c
                np.minimum.at(flat, place[ok], t[ok])
            else:
                np.minimum.at(flat, place, t)
            k += 1
        more = count > width + low if level else count > 1
        h, doc, count, level = h[more], doc[more], count[more], level + 1


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key for each band of each row; the band's number is part of it."""
    bits = np.ascontiguousarray(sig).view(U).reshape(len(sig), -1, rows)
    key = np.broadcast_to(np.arange(1, bits.shape[1] + 1, dtype=U), bits.shape[:2]).copy()
    for k in range(rows):
        key = mix(key * U(0x9E6C63D0876A9A47) + bits[:, :, k])
    return key.view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, n, bands) of (doc_id, text): digest of the text, number of shingles, band keys (empty without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in pieces(batches, limit=2 << 20):
            n = len(offs) - 1
            h, doc, count = shingles(data, offs, SHINGLE)
            total = np.bincount(doc, weights=count, minlength=n).astype(np.int64)
            keys = band_keys(signatures(h, doc, count, n))
            full = total > 0
            bands = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(full, BANDS, 0))].astype(np.int32)), pa.array(keys[full].reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total), bands], ["doc_id", "copy", "n", "bands"])

    return docs.select("doc_id", F.unhex(F.md5("text")).alias("copy"), "text").mapInArrow(lean(run), "doc_id long, copy binary, n long, bands array<long>")


def link_forest(ids: np.ndarray, h: np.ndarray, doc: np.ndarray, count: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Links (document, smallest of its class) of the classes under multiset Jaccard >= threshold, exactly."""
    n = len(ids)
    total = np.bincount(doc, weights=count, minlength=n)
    o = np.argsort(h, kind="stable")
    hs, ds, cs = h[o], doc[o], count[o]
    bounds = np.searchsorted(doc, np.arange(n + 1))
    label, done = np.arange(n), np.zeros(n, bool)
    while True:
        rest = np.flatnonzero(~done)
        if not len(rest):
            break
        share = np.bincount(label[rest], minlength=n)
        main = int(share.argmax())
        if share[main] == len(rest) and done.any():
            break
        other = rest[label[rest] != main] if done.any() else rest
        u = int(other[0]) if len(other) else int(rest[0])
        if len(rest) == n and n == 1:
            break
        a, b = bounds[u], bounds[u + 1]
        lo, hi = np.searchsorted(hs, h[a:b], "left"), np.searchsorted(hs, h[a:b], "right")
        size = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        common = np.bincount(ds[at], weights=np.minimum(cs[at], np.repeat(count[a:b], size)), minlength=n)
        linked = common >= threshold * (total + total[u] - common) - 1e-9
        linked &= total > 0
        joined = np.unique(label[linked])
        label[np.isin(label, joined)] = joined.min() if len(joined) else u
        done[u] = True
    root = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(root, label, ids)
    return [(int(i), int(r)) for i, r in zip(ids, root[label], strict=True) if i != r]


def link_queries(q: tuple, m: tuple, known: dict[int, int], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Links between queries and members (each: ids, hashes, documents, counts), a spanning forest of them. `known` names the
    class of a member where it is not its own; members of a query's class are not compared with it."""
    ids, h, doc, count = m
    total = np.bincount(doc, weights=count, minlength=len(ids))
    o = np.argsort(h, kind="stable")
    hs, ds, cs = h[o], doc[o], count[o]
    names = np.array([known.get(i, i) for i in ids.tolist()], np.int64)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            x = y
        return x

    out = []
    q_ids, q_h, q_doc, q_count = q
    bounds = np.searchsorted(q_doc, np.arange(len(q_ids) + 1))
    for u, me in enumerate(q_ids.tolist()):
        a, b = bounds[u], bounds[u + 1]
        lo, hi = np.searchsorted(hs, q_h[a:b], "left"), np.searchsorted(hs, q_h[a:b], "right")
        size = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        common = np.bincount(ds[at], weights=np.minimum(cs[at], np.repeat(q_count[a:b], size)), minlength=len(ids))
        near = (common >= threshold * (total + q_count[a:b].sum() - common) - 1e-9) & (total > 0)
        for x in np.unique(names[near]).tolist():
            x, y = sorted((find(x), find(me)))
            if x != y:
                root[y] = x
                out.append((y, x))
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, part, query, class, doc_id, text), sorted by the first three: links of each run of equal cluster and part,
    between queries and members where there are queries, else of all."""
    now, sides, known = None, ([], []), {}

    def gathered(parts):
        ids = np.concatenate([p[0] for p in parts])
        base = np.cumsum([0] + [len(p[0]) for p in parts])
        h, doc, count = (np.concatenate([p[k] + (base[i] if k == 2 else 0) for i, p in enumerate(parts)]) for k in (1, 2, 3))
        return ids, h, doc.astype(np.int64), count

    def close():
        members, queries = sides
        got = [] if not members else link_queries(gathered(queries), gathered(members), known) if queries else link_forest(*gathered(members))
        return pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in (0, 1)], ["u", "v"])

    for batch, data, offs in pieces(batches):
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1)
        ids, of = (batch.column(k).to_numpy(zero_copy_only=False) for k in (4, 3))
        h, doc, count = shingles(data, offs, SHINGLE)
        cuts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(key)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if now is not None and tuple(key[a][:2]) != now:
                yield close()
                sides, known = ([], []), {}
            now = tuple(key[a][:2])
            s, e = np.searchsorted(doc, [a, b])
            sides[int(key[a][2])].append((ids[a:b], h[s:e], doc[s:e] - a, count[s:e]))
            known |= {i: c for i, c in zip(ids[a:b].tolist(), of[a:b].tolist(), strict=True) if i != c}
    if now is not None:
        yield close()


@small_batches
def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_shingles: int = BLOCK_SHINGLES, unnamed: bool = False) -> DataFrame:
    """(doc_id, copy, class_id, kept) for each row of `docs` with a doc_id; with `unnamed`, for each row.

    class_id is the smallest doc_id reachable by links of identical text or similarity >= 0.8; kept marks it. A text of
    one to four words has one shingle of all of them. Null texts count as empty; texts without words are only linked to
    identical ones. Rows with one doc_id are one document: repeated rows change nothing, and where their texts differ
    they join classes. Rows without a doc_id are left out unless `unnamed`: then those of one text are one document, with a
    stand-in behind all doc_ids from the text's hash. So a class is kept by a doc_id where it has one, and else named by
    the least stand-in. Tables may be empty.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    first = 1 << 62
    if unnamed:
        first = max(first, (src.agg(F.max("doc_id")).first()[0] or 0) + 1)
        room = (1 << 63) - first
        if not room and src.where("doc_id is null").limit(1).count():
            raise ValueError("doc_ids reach the largest long: rows without one cannot sort behind them")
        # where two texts share a stand-in both are kept, as two texts of one doc_id are
        src = src.withColumn("doc_id", F.coalesce("doc_id", F.pmod(F.xxhash64("text"), F.lit(room)) + F.lit(first))) if room else src
    src = src.where("doc_id is not null")
    rows = scratch.save(sketch(src), "rows")
    nodes = rows.groupBy("copy").agg(F.min(F.struct("doc_id", "n", "bands")).alias("r")).select("copy", "r.doc_id", "r.n", "r.bands")
    nodes = scratch.save(nodes, "nodes")

    keys = nodes.select("doc_id", F.explode("bands").alias("key"))
    heads = keys.groupBy("key").agg(F.min("doc_id").alias("head"), F.count("*").alias("size")).where("size > 1").select("key", "head")
    edges = keys.join(heads, "key").where("doc_id <> head").select(F.col("doc_id").alias("u"), F.col("head").alias("v"))
    cluster = scratch.save(connected_components(scratch, edges, "candidates"), "cluster")

    size = nodes.groupBy("doc_id").agg(F.max("n").alias("n")).join(cluster, F.col("doc_id") == F.col("id")).groupBy("component").agg(F.sum("n").alias("total"))
    parts = size.select("component", F.ceil(F.col("total") / block_shingles).cast("int").alias("parts"))
    member = cluster.join(parts, "component").select("id", F.col("component").alias("cluster"), "parts")
    member = scratch.save(member, "member")
    # merge joins at any size: the members have no size bound
    every = lambda df: df.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    home = member.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("query", F.lit(0))

    def compare(rows: DataFrame, name: str) -> DataFrame:
        """Links of the rows (id, cluster, part, query, class)."""
        task = src.join(rows.hint("merge"), F.col("doc_id") == F.col("id")).select("cluster", "part", "query", "class", "doc_id", "text")
        task = task.repartition("cluster", "part").sortWithinPartitions("cluster", "part", "query", "doc_id")
        return scratch.save(task.mapInArrow(lean(_verify), "u long, v long"), name)

    shape = ["id", "cluster", "part", "query", F.col("id").alias("class")]
    first_of = every(member.where("parts > 1 and id = cluster")).withColumn("query", F.lit(1))
    links = compare(home.select(*shape).unionByName(first_of.select(*shape)), "links")
    if member.where("parts > 1").limit(1).count():
        like = links.select(F.col("u").alias("_u"), F.col("v").alias("_v")).distinct()
        told = home.where("parts > 1").join(like.hint("merge"), (F.col("id") == F.col("_u")) & (F.col("cluster") == F.col("_v")), "left")
        told = scratch.save(told.select("id", "cluster", "parts", "part", F.when(F.col("_u").isNotNull(), F.col("cluster")).otherwise(F.col("id")).alias("class")), "told")
        other = told.where("class = id and id <> cluster")
        asked = every(other.drop("part")).select("id", "cluster", "part", F.lit(1).alias("query"), "class")
        with_other = told.join(other.select("cluster").distinct().hint("merge"), "cluster", "left_semi").select("id", "cluster", "part", F.lit(0).alias("query"), "class")
        more = compare(with_other.unionByName(asked), "more")
        classes = connected_components(scratch, links.unionByName(more), "classes")
    else:
        classes = links.select(F.col("u").alias("id"), F.col("v").alias("component")).distinct()

    name = nodes.select("copy", F.col("doc_id").alias("first")).join(classes, F.col("first") == F.col("id"), "left").select("copy", F.coalesce("component", "first").alias("class_id"))
    own = F.when(F.col("doc_id") < first, F.col("doc_id")) if unnamed and room else F.col("doc_id")
    return scratch.finish(rows.select("doc_id", "copy").join(name, "copy").select(own.alias("doc_id"), "copy", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept")))


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents with one of each class, the smallest doc_id, their columns as they are; repeated rows once. A class
    without any doc_id keeps one of its texts."""
    d, copy, mine = unused(docs.columns, "_doc", "_copy", "_own")
    kept = near_duplicates(docs, unnamed=True).where("kept").select(F.col("doc_id").alias(d), F.col("copy").alias(copy)).distinct()
    text = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    out = docs.withColumn(mine, text).join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(mine) == F.col(copy)))
    return out.dropDuplicates([d, copy]).select(*docs.columns)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, unnamed=True).select("doc_id", "class_id", "kept")


#: All pairs of texts that share a shingle, compared exactly, and the smallest id that reaches each text.
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT text, min(doc_id) AS id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d GROUP BY text),
s AS (SELECT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [w] ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: w[i:i + {SHINGLE - 1}]) END) AS g FROM t),
m AS (SELECT id, g, count(*) AS n FROM s GROUP BY ALL),
z AS (SELECT id, sum(n) AS n FROM m GROUP BY id),
p AS (SELECT a.id AS u, b.id AS v, sum(least(a.n, b.n)) AS n FROM m a JOIN m b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN z a ON a.id = u JOIN z b ON b.id = v WHERE p.n >= {THRESHOLD} * (a.n + b.n - p.n) - 1e-9),
l AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT id, id AS c FROM t UNION SELECT l.u, r.c FROM r JOIN l ON l.v = r.id WHERE r.c < l.u),
k AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT doc_id, c AS class_id, doc_id = c AS kept FROM d JOIN t USING (text) JOIN k USING (id)
"""
