"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source has a weight; the mix is to hold as many words as the corpus has.  A source's share is
its weight times a common level, but never more than ``epochs`` times its words; what a clamped
source can't take raises the level for the others.  Clamping one source after another until none is
above is the same as sorting sources by (cap / weight) and taking the first level that the next
source's cap allows, which running sums give.

A source's target is then taken as whole repetitions of all its documents and a fraction.  For the
fraction, documents stand in the order of a seeded hash, and are taken one more time while the
running sum of their words stays within it; the document at the end is taken in part, by its first
words, so that the source's words come to the target rounded to a whole number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, materialize, n_words

EPOCHS = 3.0
WEIGHTS = (5, 2, 1)
#: Hash buckets of a source, by which its documents are dealt out and summed up.
HEX_DIGITS = 3
SEED = "mix-1"
_SPACE = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def water_fill(sources: DataFrame, total: Column | None = None, epochs: float = EPOCHS) -> DataFrame:
    """``sources``: one row a source, with source_size and weight (> 0).  Adds target.

    The shares sum up to ``total``, by default all of source_size; sources without words get 0.
    The running sums have a row a source, so they are made over one window.
    """
    s = sources.withColumn("_cap", F.col("source_size") * F.lit(float(epochs)))
    s = s.withColumn("_ratio", F.col("_cap") / F.col("weight"))
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    want = (total if total is not None else F.sum("source_size").over(everything)).cast("double")
    s = s.withColumn("_want", want)
    s = s.withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    s = s.withColumn("_weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("_level", F.greatest(F.lit(0.0), (F.col("_want") - F.col("_capped")) / F.col("_weights")))
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(everything)["_level"]
    s = s.withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("weight") * level, F.col("_cap"))))
    return s.drop("_cap", "_ratio", "_want", "_capped", "_weights", "_level")


def weigh(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds weight: ``weights`` in turn to sources by code point, null last.  One row a source."""
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), rank % len(weights) + 1))


def _place(seed: str) -> Column:
    """A row's place in the order of its source, by its id and text, so that rows without an id, or with one that
    repeats, are dealt out like others."""
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).cast("binary"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: float = EPOCHS, seed: str = SEED, extra: tuple[str, ...] = ()) -> DataFrame:
    """What the mix takes of each row of ``docs`` (doc_id, text, source).

    Returns doc_id, source, size, source_size, target, copies (whole repetitions), part_words (words
    of one more, partial repetition) and taken = copies * size + part_words, and columns ``extra``.
    Null texts and texts without words have size 0 and are taken as often as their source's whole
    repetitions say, at no words.  Null sources are one source.  Repeated rows count each.
    Repeated rows stand beside one another in the order.  A source's rows are dealt out by hash bucket, so that
    no task holds a large source.
    """
    cols = [F.col(c) for c in extra]
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _place(seed).alias("_u"), *cols)
    rows = rows.withColumn("_b", F.substring("_u", 1, HEX_DIGITS)).withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_n", F.col("source").isNull())
    rows = materialize(rows, "mix")
    buckets = rows.groupBy("_s", "_n", "_b").agg(F.sum("size").alias("_words"))
    sources = buckets.groupBy("_s", "_n").agg(F.sum("_words").alias("source_size")).withColumn("source", F.when(~F.col("_n"), F.col("_s")))
    sources = water_fill(weigh(sources, weights), epochs=epochs).drop("source", "weight")
    before = Window.partitionBy("_s", "_n").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0))).drop("_words").join(sources, ["_s", "_n"])
    running = Window.partitionBy("_s", "_n", "_b").orderBy("_u", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_run", F.coalesce(F.sum("size").over(running), F.lit(0))).join(buckets, ["_s", "_n", "_b"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("_whole", whole)
    rest = F.round("target").cast("long") - F.col("_whole") * F.col("source_size")  # words that the last, fractional repetition is to give
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before") - F.col("_run"))).cast("long")
    rows = rows.withColumn("_part", part)
    full = (F.col("_part") == F.col("size")) & (F.col("size") > 0)
    rows = rows.withColumn("copies", F.col("_whole") + full.cast("long")).withColumn("part_words", F.when(full, 0).otherwise(F.col("_part")).cast("long"))
    taken = (F.col("copies") * F.col("size") + F.col("part_words")).alias("taken")
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", "part_words", taken, *extra)


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its ``n``-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(_SPACE), F.lit(0)), F.lit(1), n.cast("int")), "")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """The mixed corpus: the rows of ``docs`` as often as the mix takes them, with its columns.

    The one document of a source that is taken in part comes with its first words, and n_chars, if
    there is such a column, is theirs.
    """
    names = docs.columns
    # a repeated row is a row of its own here
    plan = mix_plan(docs.select(F.struct(*names).alias("_row"), "doc_id", "text", "source"), weights, epochs, seed, ("_row",))
    times = F.concat(F.array_repeat(F.lit(False), F.col("copies").cast("int")), F.when(F.col("part_words") > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    rows = plan.select("_row", "part_words", F.explode(times).alias("_cut"))
    text = F.when(F.col("_cut"), first_words(F.col("_row.text"), F.col("part_words"))).otherwise(F.col("_row.text"))
    out = rows.select("_row", "_cut", text.alias("_text"))
    one = {"text": F.col("_text")} | ({"n_chars": F.when(F.col("_cut"), F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))} if "n_chars" in names else {})
    return out.select(*(one.get(c, F.col("_row").getField(c)).alias(c) for c in names))


#: The same in DuckDB's SQL.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), r AS (
  SELECT source, source_size, weight, source_size * CAST(3.0 AS DOUBLE) AS cap, source_size * CAST(3.0 AS DOUBLE) / weight AS ratio FROM w
), f AS (
  SELECT *, greatest(CAST(0 AS DOUBLE), (CAST(sum(source_size) OVER () AS DOUBLE)
           - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)) AS lvl
  FROM r
), l AS (
  SELECT lvl FROM f WHERE lvl <= ratio ORDER BY ratio, lvl LIMIT 1
), t AS (
  SELECT f.source, f.source_size, least(f.cap, coalesce(f.weight * (SELECT lvl FROM l), f.cap)) AS target FROM f
), x AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(round(t.target) / t.source_size) AS BIGINT) ELSE 0 END AS whole,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS run
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - whole * source_size - run)) AS BIGINT) AS taken
FROM x
"""
