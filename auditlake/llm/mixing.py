"""Mixing sources to target weights.

Words are summed per source with partial sums before the shuffle; the targets come from one row per source.
Each document is then taken floor(rate) times, and once more where a hash of its id falls under the rate's
fraction: a decision that needs no other row, gives the same result in every run and has no order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.llm._tables import Scratch, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Words [^\x20\x09-\x0D]+: starts of words, counted without making a list of them."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, target, rate.

    Sharing out again what is over `most` times a source's size, until no source is above, ends at one level
    that all sources below their limit share by weight. Limits by weight, in rising order, give that level:
    a source is at its limit if the level that holds for it and all later ones is above its own. The windows
    without a partition run over one row per source, not over documents.
    """
    by = F.col("source").asc_nulls_last()
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(by)) - 1
    each = each.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    everyone = Window.partitionBy()
    order = Window.orderBy((F.col("source_size") * most / F.col("weight")), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    each = (
        each.withColumn("total", F.sum("source_size").over(everyone))
        .withColumn("weights_left", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("size_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("level", (F.col("total") * share - F.col("size_before") * most) / F.col("weights_left"))
        .withColumn("full", F.col("level") * F.col("weight") >= F.col("source_size") * most)
        .withColumn("shared", F.min(F.when(~F.col("full"), F.col("rank"))).over(everyone))
        .withColumn("level", F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.struct((F.col("source_size") * most / F.col("weight")).alias("a"), F.col("rank").alias("b")))).over(everyone))
    )
    target = F.when(F.col("full") | F.col("level").isNull(), (F.col("source_size") * most).cast("double")).otherwise(F.col("level") * F.col("weight"))
    return each.select("source", "source_size", target.alias("target")).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def uniform(doc_id: Column, text: Column) -> Column:
    """0 to 1 from the document's id, or from its text where it has none."""
    key = F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.md5(text.cast("binary")), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, copies, and the columns of `keep`, named
    with _kept_ before them.

    Null texts have no words; a null source is a source of its own, the last. Sources without words have
    target 0 and their documents no copies. Rows that share a doc_id share its draw. Empty in, empty out.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), uniform(F.col("doc_id"), F.col("text")).alias("draw"), *[F.col(k).alias(f"_kept_{k}") for k in keep])
    small = rows if keep else scratch.keep(rows)
    targets = scratch.keep(source_targets(small if not keep else docs.select(F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), weights, share, most))
    t = targets.withColumnRenamed("source", "_of")
    out = small.join(t, small["source"].eqNullSafe(t["_of"]))
    copies = F.floor("rate") + (F.col("draw") < F.col("rate") - F.floor("rate")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", copies.alias("copies"), *[F.col(f"_kept_{k}") for k in keep])


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns."""
    taken = plan_mix(docs, keep=tuple(docs.columns)).filter("copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*[F.col(f"_kept_{c}").alias(c) for c in docs.columns])


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, [3, 1, 2][rank % 3 + 1] AS weight FROM r),
l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5 - coalesce(sum(source_size) OVER b, 0)::DOUBLE * 2)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM w WINDOW b AS (ORDER BY source_size * 2 / weight::DOUBLE, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, level * weight >= source_size * 2 AS is_full FROM l),
v AS (SELECT arg_min(level, (source_size * 2 / weight::DOUBLE, rank)) FILTER (WHERE NOT is_full) AS level FROM f),
t AS (
  SELECT source, source_size, CASE WHEN is_full OR v.level IS NULL THEN (source_size * 2)::DOUBLE ELSE v.level * weight END AS target
  FROM f, v),
e AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), md5(d.text), '')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + (draw < rate - floor(rate))::BIGINT) AS taken FROM e
"""
