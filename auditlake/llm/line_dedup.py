"""Line dedup over windows of three consecutive lines, in DataFrame operations only.

Each text's lines are hashed in overlapping windows; counts and the first place of every window are gathered
with partial aggregation, so a window that a third of all documents share costs one row a task. Windows seen
once are dropped there and then. Places that repeat an earlier one mark their lines, marks of one document
are merged, and the marked lines leave the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm._tables import Scratch, table, text_key

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _windows(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, key, at (first line), and a 128-bit digest of each window; texts of fewer lines have none."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), text_key(F.col("text")).alias("key"), _lines(F.col("text").cast("string")).alias("lines")).filter(F.size("lines") >= n)
    each = rows.select("doc_id", "key", F.posexplode(F.expr(f"transform(sequence(0, size(lines) - {n}), i -> unhex(md5(array_join(slice(lines, i + 1, {n}), '\\n'))))")).alias("at", "window"))
    return each.withColumn("at", F.col("at").cast("long"))


def repeated_lines(docs: DataFrame, n: int = WINDOW, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, key, gone: the sorted numbers of the lines that windows repeated from an earlier place cover.

    The first place of a window is the smallest (doc_id, text, line number); a null doc_id comes last. Rows
    that agree in doc_id and text are one place and keep the same lines. Windows are judged on the input.
    """
    # merge joins at every size: a side that is small today is no promise for a larger corpus, and hot windows are split
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    w = scratch.keep(_windows(docs, n))
    place = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"), F.col("at").alias("at"))
    known = scratch.keep(w.groupBy("window").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("window", "first"))
    later = w.withColumn("place", place).join(known.hint("merge"), "window").filter("place > first").select("doc_id", "key", "at").distinct()
    cover = later.groupBy("doc_id", "key").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + (n - 1)))))).alias("gone"))
    return scratch.keep(cover)


def dedup_lines(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """`docs` with `text` rid of repeated lines, and with n_lines and n_removed.

    Lines are what newlines part; null text stays null (one empty line, none removed).
    """
    gone = repeated_lines(docs, n).withColumnsRenamed({"doc_id": "__doc", "key": "__key", "gone": "__gone"})
    keyed = docs.withColumn("__text_key", text_key(F.col("text")))
    both = keyed.join(gone.hint("merge"), keyed["doc_id"].eqNullSafe(gone["__doc"]) & (keyed["__text_key"] == gone["__key"]), "left")
    return (
        both.withColumn("n_lines", F.size(_lines(F.col("text").cast("string"))).cast("long"))
        .withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
        .withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(_without(F.col("text").cast("string"), F.col("__gone"))))
        .select(*docs.columns, "n_lines", "n_removed")
    )


def _without(text: Column, gone: Column) -> Column:
    """The text's other lines. array_except looks its numbers up in a hash set, and each line that stays is read by its number,
    so the work is in proportion to the lines. The outer transform, over one row's lines and numbers, splits the text once."""
    both = F.array(F.struct(_lines(text).alias("lines"), gone.alias("gone")))
    stay = lambda x: F.array_except(F.sequence(F.lit(0).cast("long"), F.size(x["lines"]).cast("long") - 1), x["gone"])
    return F.transform(both, lambda x: F.array_join(F.transform(stay(x), lambda i: F.get(x["lines"], i.cast("int"))), "\n"))[0]


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (
  SELECT doc_id, i AS line, array_to_string(l[i : i + 2], chr(10)) AS g
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d WHERE len(l) >= 3)),
r AS (SELECT doc_id, line, row_number() OVER (PARTITION BY g ORDER BY doc_id, line) AS k FROM w),
gone AS (SELECT DISTINCT doc_id, unnest([line, line + 1, line + 2]) AS p FROM r WHERE k > 1),
n AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY 1)
SELECT d.doc_id, len(l)::BIGINT AS n_lines, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(l, lambda x, i: NOT coalesce(list_contains(ps, i), false)), chr(10))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id)
"""
