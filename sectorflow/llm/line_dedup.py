"""Line dedup by a log-template tree, in DataFrame functions only.

Every line descends a tree of fixed depth: its token count, then its leading tokens. Tokens with a digit are variable
fields and count as `<*>` on the way. A leaf holds templates: the whole token sequence with its variable fields
generalised, and three looser ones, each of which also generalises one third of the tokens behind the leading ones,
so that a field without digits (a name, a place) does not split a template. A template is recurring when `min_docs`
documents have a line of it. Its lines are dropped from every document but the one with the smallest doc_id, so that
text which many documents share is kept once.

Plan: lines become template keys inside the scan (no line is shuffled as text), a document counts once for a template,
counts are combined before the shuffle, and only (document, line number) pairs of dropped lines go back to the texts.
A template that a third of all lines have is one row for each task after the partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, unused

LEADING, MIN_TOKENS, MIN_DOCS = 2, 3, 10
LOOSE_TOKENS = 9  # a looser template needs as many tokens, so that two thirds of them still identify it


def line_keys(line: Column) -> Column:
    """Template keys of a line: none for fewer than MIN_TOKENS tokens, else the strict one and up to three looser ones."""
    flat = F.trim(F.regexp_replace(line, "[ \\t\\x0B\\f\\r]+", " "))
    flat = F.when(line.rlike("[\\t\\x0B\\f\\r]|  |^ | $"), flat).otherwise(line)
    masked = F.when(flat.rlike("[0-9]"), F.regexp_replace(flat, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(flat)
    return F.transform(F.array(F.split(masked, " ")), _keys_of)[0]


def _keys_of(t: Column) -> Column:
    n = F.size(t)
    third = ((n - LEADING) / 3).cast("int")
    cut1, cut2 = LEADING + third, LEADING + 2 * third
    head = F.slice(t, 1, LEADING)
    part = lambda a, b: F.slice(t, a + 1, F.greatest(b - a, F.lit(0)))  # noqa: E731  tokens a..b
    parts = [part(F.lit(LEADING), cut1), part(cut1, cut2), part(cut2, n)]
    strict = F.xxhash64(F.lit(-1), n, t)
    loose = [F.xxhash64(F.lit(j), n, head, *[p for i, p in enumerate(parts) if i != j]) for j in range(3)]
    return F.when(n < MIN_TOKENS, F.array().cast("array<bigint>")).when(n < LOOSE_TOKENS, F.array(strict)).otherwise(F.array(strict, *loose))


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, doc_id: str = "doc_id", text: str = "text", counts: bool = True) -> DataFrame:
    """Documents without the recurring lines of others: all columns of `docs` as they are, but the text, and with `counts` two
    more, `n_lines` and `n_dropped` (int; columns of these names in `docs` are replaced).

    A line is what `\\n` splits. A null text stays null and has no lines; an empty one has one empty line and stays.
    Lines of fewer than 3 tokens are never dropped. A text whose lines are all dropped becomes empty. Rows that repeat
    doc_id and text are treated alike and count each. Null doc_ids count as the largest, and keep their lines among
    themselves. Ties in doc_id keep the line in each of the tied rows. An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    split = F.split(F.col("_x"), "\n", -1)
    src = docs.select(F.col(doc_id).alias("_d"), F.col(text).alias("_x")).where("_x is not null")
    lines = src.select("_d", F.xxhash64("_x").alias("_h"), F.transform(split, line_keys).alias("_k"))
    lines = scratch.save(lines, "keys")
    ids = F.coalesce(F.col("_d"), F.lit((1 << 63) - 1))
    seen = lines.select(ids.alias("_d"), F.explode(F.array_distinct(F.flatten("_k"))).alias("_t"))
    recurring = seen.groupBy("_t").agg(F.count("*").alias("_n"), F.min("_d").alias("_first")).where(F.col("_n") >= min_docs).select("_t", "_first")
    at = lines.select("_d", "_h", F.posexplode("_k").alias("_p", "_k")).select("_d", "_h", "_p", F.explode("_k").alias("_t"))
    # merge joins at any size: neither side has a size bound, and the plan should not change as the input grows
    drop = at.join(recurring.hint("merge"), "_t").where(ids > F.col("_first"))
    drop = drop.groupBy("_d", "_h").agg(F.collect_set("_p").alias("_drop"))
    own, d, h, gone = unused(docs.columns, "_hash", "_doc", "_text_hash", "_gone")
    drop = scratch.save(drop, "drop").select(F.col("_d").alias(d), F.col("_h").alias(h), F.col("_drop").alias(gone))
    out = docs.withColumn(own, F.xxhash64(text)).join(drop.hint("merge"), F.col(doc_id).eqNullSafe(F.col(d)) & (F.col(own) == F.col(h)), "left")
    split, none = F.split(F.col(text), "\n", -1), F.col(gone).isNull()
    kept = F.array_join(F.filter(split, lambda x, i: ~F.array_contains(F.col(gone), i)), "\n")
    cols = {text: F.when(none, F.col(text)).otherwise(kept)}
    if counts:
        cols |= {"n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(split)), "n_dropped": F.when(none, 0).otherwise(F.size(gone))}
    return out.withColumns(cols).drop(own, d, h, gone)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_recurring_lines(docs)
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The same rule with whole token sequences in place of their hashes.
SQL = """
WITH lines AS (
  SELECT doc_id, text, i - 1 AS p, string_split(text, chr(10))[i] AS line
  FROM documents, generate_series(1, len(string_split(text, chr(10)))) AS g(i) WHERE text IS NOT NULL
), flat AS (
  SELECT doc_id, text, p, string_split(regexp_replace(trim(regexp_replace(line, '[ \\t\\v\\f\\r]+', ' ', 'g')), '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' ') AS t FROM lines
), cut AS (
  SELECT *, len(t) AS n, (len(t) - 2) // 3 AS s FROM flat
), keys AS (
  SELECT doc_id, text, p, unnest(CASE WHEN n < 3 THEN [] WHEN n < 9 THEN [{'j': -1, 'n': n, 'a': t, 'b': []}] ELSE [
    {'j': -1, 'n': n, 'a': t, 'b': []}, {'j': 0, 'n': n, 'a': t[1:2], 'b': t[3 + s:n]},
    {'j': 1, 'n': n, 'a': t[1:2 + s], 'b': t[3 + 2 * s:n]}, {'j': 2, 'n': n, 'a': t[1:2 + 2 * s], 'b': []}] END) AS k FROM cut
), recurring AS (
  SELECT k, min(doc_id) AS first FROM (SELECT DISTINCT doc_id, k FROM keys) GROUP BY k HAVING count(*) >= 10
), gone AS (
  SELECT DISTINCT doc_id, p FROM keys JOIN recurring USING (k) WHERE doc_id > first
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE g.p IS NOT NULL) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE g.p IS NULL), '') AS text
  FROM lines LEFT JOIN gone g USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""
