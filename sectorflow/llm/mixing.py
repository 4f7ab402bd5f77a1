"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are word counts. Each source has a target of words; a document is taken once or twice, or not at all.

1. Targets: the sources' shares of the mix by weight, none above `repeats` times its source, the excess reshared.
2. Blocks: a document's block within its source is a hash of it, so blocks are exchangeable; their order is a seeded
   permutation. A source gets whole passes, then blocks in that order up to its target. The block in which the target
   lies is filled document by document in hash order, and a last document closes what gap is left.
3. Splitting tree: the quotas (blocks of each source, over all passes) are split among the output shards. At a node
   the left half of the shards gets its exact share of all blocks, dealt over the sources by one multivariate
   hypergeometric draw with a seed of its own; a shard thus holds a random sample of the mix of exact size.
4. Each shard takes disjoint runs of the permuted blocks, as the tree says, and shuffles its documents by hash.

What the driver holds is a row for each source and shard, and at most MAX_BLOCKS blocks of each source, fewer where
sources are so many that this would be more than ALL_BLOCKS: bounded by the number of sources, not by the documents.
These tables are broadcast up to BROADCAST_ROWS rows and merge-joined beyond. Everything else is grouped by (source,
block), so a source with a third of all rows is spread over many groups, and sums are combined before they are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, unused

WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
BLOCK_DOCS, MAX_BLOCKS, SHARDS, SEED = 64, 1 << 17, 16, 20240229
ALL_BLOCKS, BROADCAST_ROWS = 1 << 20, 1 << 20
N_WORDS = "cast(regexp_count(coalesce({0}, ''), '[^ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+') as bigint)"


def targets(sizes: list[int], weights: list[float], share: float = SHARE, repeats: float = REPEATS) -> list[float]:
    """Target of each source: weight-proportional parts of share * sum(sizes), none above repeats * size, the excess
    reshared among the others by weight until none is above. Sources of size 0 get 0."""
    free, out, left = [i for i, s in enumerate(sizes) if s > 0], [0.0] * len(sizes), share * sum(sizes)
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > repeats * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(repeats * sizes[i])
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def split_tree(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """shards x sources: how many blocks of each source a shard gets. Rows sum to shares that differ by one at most, columns to quotas."""
    out = np.zeros((shards, len(quotas)), np.int64)
    stack = [(0, shards, np.asarray(quotas, np.int64), 1)]
    while stack:
        a, b, q, node = stack.pop()
        if b - a == 1 or not q.sum():
            out[a] += q
            continue
        m = (a + b) // 2
        # the shards before k hold floor(total * k / shards) blocks in all
        total = int(np.asarray(quotas, np.int64).sum())
        left = total * m // shards - total * a // shards
        got = _draw(q, left, np.random.default_rng([seed, node]))
        stack += [(a, m, got, 2 * node), (m, b, q - got, 2 * node + 1)]
    return out


def _draw(q: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """One multivariate hypergeometric draw, source after source (numpy's own draws are limited to 10^9 items)."""
    got, rest = np.zeros(len(q), np.int64), int(q.sum())
    for i, c in enumerate(q.tolist()):
        rest -= c
        if n <= 0:
            break
        got[i] = n if rest == 0 else int(rng.hypergeometric(c, rest, n)) if c else 0
        n -= int(got[i])
    return got


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def _fill(block: pd.DataFrame) -> pd.DataFrame:
    """Documents in hash order while they fit, then again and again the one that leaves the smallest gap, as long as it shrinks."""
    block = block.sort_values(["place", "u", "size"]).reset_index(drop=True)
    size, take, room = block["size"].to_numpy(), np.zeros(len(block), bool), int(block["room"].iloc[0])
    take[: int(np.searchsorted(size.cumsum(), room, "right"))] = True
    room -= int(size[take].sum())
    while room and not take.all():
        off = np.where(take, np.iinfo(np.int64).max, np.abs(size - room))
        i = int(off.argmin())
        if off[i] >= abs(room):
            break
        take[i], room = True, room - int(size[i])
        if room <= 0:
            break
    return block[take].groupby("u").size().reset_index(name="picks")


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row for each row of `docs`: doc_id, key, source, size, source_size, target, copies, taken, shards.

    `weights` repeat over the sources by code point, null last. copies is how often the mix takes the document (whole),
    taken = copies * size, shards the output shard of each copy. A null text has size 0; documents of size 0 are never
    taken. Rows that repeat one (doc_id, text) are told apart by their number among each other and judged alike
    otherwise. An empty table gives no rows. The same rows give the same mix in any
    order and partitioning.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("key"), F.col(source).alias("source"), F.expr(N_WORDS.format(f"`{text}`")).alias("size"))
    rows = rows.withColumn("u", F.xxhash64(F.lit(seed), "doc_id", "key"))
    rows = scratch.save(rows, "rows")
    found = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n")).toPandas()  # a row for each source
    found = found.iloc[sorted(range(len(found)), key=lambda i: (found["source"].isna()[i], str(found["source"][i])))].reset_index(drop=True)
    size = [int(x) for x in found["source_size"]]
    found["target"] = targets(size, [weights[i % len(weights)] for i in range(len(found))], share, repeats) if len(found) else []
    found["sid"] = range(len(found))
    found["blocks"] = [max(1, min(MAX_BLOCKS, max(16, ALL_BLOCKS // len(found)), -(-int(n) // BLOCK_DOCS))) for n in found["n"]]
    found["passes"] = [int(t // s) if s else 0 for t, s in zip(found["target"], size, strict=True)]
    found["quota"] = [int(round(t - p * s)) for t, p, s in zip(found["target"], found["passes"], size, strict=True)]
    per_source = docs.sparkSession.createDataFrame(found[["source", "source_size", "target", "sid", "blocks", "passes", "quota"]].astype({"source": object}), "source string, source_size long, target double, sid int, blocks int, passes int, quota long")
    rows = rows.join(_sized(per_source.withColumnRenamed("source", "_s"), len(found)), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("block", F.pmod("u", F.col("blocks")).cast("int")).withColumn("place", F.xxhash64(F.lit(seed + 1), "u"))

    # whole blocks in permuted order up to the quota; bounded by sources * MAX_BLOCKS
    sums = rows.where("size > 0").groupBy("sid", "block").agg(F.sum("size").cast("long").alias("w")).toPandas()
    sums["perm"] = [int(np.random.default_rng([seed, s, b]).integers(1 << 62)) for s, b in zip(sums["sid"].tolist(), sums["block"].tolist(), strict=True)]
    sums = sums.sort_values(["sid", "perm", "block"]).reset_index(drop=True)
    sums["pos"] = sums.groupby("sid").cumcount()
    sums["before"] = sums.groupby("sid")["w"].cumsum() - sums["w"]
    quota = found["quota"].to_numpy(np.int64)
    sums["room"] = quota[sums["sid"].to_numpy(int)] - sums["before"] if len(sums) else 0
    sums["whole"] = sums["w"] <= sums["room"]
    sums["edge"] = ~sums["whole"] & (sums["room"] > 0)

    # blocks of each source over all passes, and the shard of each by the tree
    n_blocks = sums.groupby("sid").size().reindex(range(len(found)), fill_value=0).to_numpy(np.int64)
    extra = (sums["whole"] | sums["edge"]).groupby(sums["sid"]).sum().reindex(range(len(found)), fill_value=0).to_numpy(np.int64)
    passes = found["passes"].to_numpy(np.int64)
    ends = np.cumsum(split_tree(passes * n_blocks + extra, shards, seed), axis=0) if len(found) else np.zeros((shards, 0), np.int64)
    shard_of = lambda sid, slot: int(np.searchsorted(ends[:, sid], slot, "right"))
    sums["shards"] = [[min(shards - 1, shard_of(s, p * n_blocks[s] + i)) for p in range(int(passes[s]) + 1)] for s, i in zip(sums["sid"].tolist(), sums["pos"].tolist(), strict=True)]
    plan = docs.sparkSession.createDataFrame(sums[["sid", "block", "room", "whole", "edge", "shards"]], "sid int, block int, room long, whole boolean, edge boolean, shards array<int>")
    rows = rows.join(_sized(plan, len(sums)), ["sid", "block"], "left")

    # the block at the target, document by document; one block of each source, so a group has rows / MAX_BLOCKS rows
    edge = rows.where("edge and size > 0").select("sid", "block", "u", "place", "size", "room")
    chosen = edge.groupBy("sid", "block").applyInPandas(_fill, "u long, picks long")
    chosen = scratch.save(chosen, "edge")
    rows = rows.join(chosen, "u", "left")
    twin = F.row_number().over(Window.partitionBy("u").orderBy("source"))
    repeated = rows.where("picks is not null").withColumn("twin", twin)
    rest = rows.where("picks is null").withColumn("twin", F.lit(1))
    rows = repeated.unionByName(rest)
    part = F.when(F.col("size") <= 0, 0).when(F.coalesce("whole", F.lit(False)), 1).when(F.col("picks") >= F.col("twin"), 1).otherwise(0)
    copies = F.when(F.col("size") <= 0, F.lit(0)).otherwise(F.col("passes") + part).cast("int")
    rows = rows.withColumn("copies", copies)
    return rows.select("doc_id", "key", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), F.slice(F.coalesce("shards", F.array().cast("array<int>")), F.lit(1), F.col("copies")).alias("shards"))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "shards")


def draw(docs: DataFrame, mixed: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: rows of `docs` as often as taken, with its columns only and as they are, shard by shard in hash order
    within a shard. Documents without words (null and empty texts) are never taken; rows without a doc_id or source are
    rows like others; repeated rows are told apart by number, so each is there as often as the mix takes it."""
    *key, nth, of, shards, shard = unused(docs.columns, "_doc", "_null", "_key", "_twin", "_of", "_shards", "_shard")
    values = lambda text: (F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), text)
    twin = lambda *by: F.row_number().over(Window.partitionBy(*key).orderBy(*by))  # noqa: E731  tells repeated rows apart
    take = mixed.select(*[v.alias(k) for k, v in zip(key, values(F.col("key")), strict=True)], "copies", F.col("shards").alias(shards)).withColumn(nth, twin(F.desc("copies")))
    take = take.where("copies > 0").groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(nth, shards))).alias(of))
    mine = docs.withColumns(dict(zip(key, values(F.xxhash64("text")), strict=True))).withColumn(nth, twin("source"))
    out = mine.join(take.hint("merge"), key).withColumn(shard, F.explode(F.try_element_at(of, nth)))  # texts move once for window and join
    return out.repartition(shard).sortWithinPartitions(shard, F.xxhash64(F.lit(seed + 2), key[2], key[0])).select(*docs.columns)
