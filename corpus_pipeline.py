"""A training corpus from documents: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each stage as Parquet
and reads it again, so a lost executor costs one stage at most, and deletes what the stage no longer needs. All but the last
return the columns of their input, whatever further columns it has, under their names and as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sectorflow.llm import line_dedup, minhash, mixing, packing, quality
from sectorflow.llm.common import Scratch, clear


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counts and the perplexity bands keep. Null and empty texts go, as all of fewer than 50 words; ids and
    languages may be null; repeated rows stay or go together."""
    return quality.keep_good(docs)


def line_templates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the recurring lines of other documents; every row stays, a null text as null, an empty one as empty. The
    smallest doc_id keeps the line, in each row that ties for it; a null doc_id counts as the largest."""
    return line_dedup.drop_recurring_lines(docs, counts=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id; repeated rows once. Rows without a doc_id sort
    behind all others, and those of one text are one document. Null texts count as empty, and empty ones are copies."""
    return minhash.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in output shards. Texts without words are never taken; a null source is one of
    its own, the last; rows that repeat a document are taken each for itself."""
    shards = max(mixing.SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return mixing.draw(docs, mixing.mix_sources(docs, shards=shards))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mix in sequences: a row for each piece, with its ids. A null text is an empty one, the end id alone;
    rows with one doc_id, or none, are documents of their own."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_templates), ("near-dedup", near_dedup), ("mixing", mix), ("packing", pack)]

#: The perplexity model, the signatures and the tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before = set(Scratch.made)
        docs = scratch.save(stage(spark, docs, sf_dir), str(k))
        clear(before)
        if k:
            scratch.drop(str(k - 1))
    return docs
