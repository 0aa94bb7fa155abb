"""Mix sources to target weights: repetition rates, whole copies and one hash-seeded Bernoulli copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import c

# A side of at most this many rows is joined by broadcast, a longer one by a shuffle.
BROADCAST_SOURCES = 10_000
SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words (runs of anything but ASCII white space); 0 for NULL."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}|{SPACE}\z", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in the order of their code points, NULL last, take the weights in turn
    and share ``share`` times the sum of all sizes in proportion. No target exceeds
    ``most`` times its source's size; what is cut off is shared again by weight until
    none is above. That fixed point is ``min(weight * level, cap)`` for one level:
    with sources by ascending cap per weight, the largest of
    ``(budget - caps before) / (weights from here on)``.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source from here on
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turns = F.array(*[F.lit(float(w)) for w in weights])
    filled = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    return (
        totals
        .withColumn("_w", F.get(turns, place % len(weights)))
        .withColumn("_cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("_before", F.coalesce(
            F.sum("_cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_onward", F.sum("_w").over(filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_level", F.max(
            (F.sum("source_size").over(everything) * F.lit(float(share)) - F.col("_before")) / F.col("_onward")
        ).over(everything))
        .select("source", "source_size", F.least(F.col("_w") * F.col("_level"), F.col("_cap")).alias("target"))
    )


def mix_plan(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 42,
) -> DataFrame:
    """row (a struct of all columns of *docs*), size, source_size, target and copies of every document.

    A document is taken floor(rate) times, rate = target / size of its source, and
    once more if a hash of seed and id falls below the rest of the rate. Reruns agree
    because the hash is all that decides. NULL texts and texts without words have
    size 0; a source without words has target 0. Rows that share an id share their
    fate, rows with a NULL id as well. A NULL source is a source of its own.
    """
    sized = docs.select(
        F.struct(*[c(n) for n in docs.columns]).alias("row"), c(doc_id).alias("id"), c(source).alias("of"),
        word_count(c(text)).alias("size"))
    plan = source_targets(sized.select(F.col("of").alias("source"), "size"), weights, share, most)
    few = plan.limit(BROADCAST_SOURCES + 1).toArrow()
    if few.num_rows <= BROADCAST_SOURCES:
        plan = F.broadcast(docs.sparkSession.createDataFrame(few, schema=plan.schema))
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor("rate")
    return (
        sized.join(plan, F.col("of").eqNullSafe(F.col("source")), "left")
        .withColumn("rate", rate)
        .select("row", "size", "source_size", "target", (
            whole + (draw < F.col("rate") - whole).cast("bigint")).cast("bigint").alias("copies"))
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as many times as :func:`mix_plan` says, with the columns of *docs*."""
    return (
        mix_plan(docs, **options).filter("copies > 0")
        .select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select("row.*")
    )


OP9_SQL = r"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS cap,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS w
  FROM t),
p AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST
                      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward
  FROM w),
l AS (SELECT max(((SELECT sum(source_size) FROM t) * 1.5::DOUBLE - before) / onward) AS level FROM p),
g AS (SELECT source, source_size, least(w * level, cap) AS target FROM p, l),
r AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('42|' || coalesce(s.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) of every document."""
    return mix_plan(docs.select("doc_id", "text", "source")).select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
