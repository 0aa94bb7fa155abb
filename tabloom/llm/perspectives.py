"""Multi-party perspective rotation: the dialogue once for every speaker, that speaker as the assistant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import c

# Turns whose numbers share this block are rendered together; longer dialogues give several rows.
SEGMENT_TURNS = 64
SYSTEM, UNNAMED = "system", "unknown"


def _clean(text: Column) -> Column:
    """A text cannot open or close a turn: its own markers lose their form."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def _head(role: Column, speaker: Column) -> Column:
    return (
        F.when(role == SYSTEM, F.lit("<|system|>\n"))
        .when(role == speaker, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))
    )


TAIL = "<|end|>"


def rotate_perspectives(
    turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    segment_turns: int = SEGMENT_TURNS,
) -> DataFrame:
    """conv_id, perspective, segment, n_turns, rendered, n_chars, start_char, mask, n_masked_in.

    For every speaker of a conversation the dialogue is rendered with that speaker as
    the assistant and all others as users of their name; system turns stay system turns
    and are nobody's perspective. ``mask`` lists the spans ``start:end`` of ``rendered``
    (code points, end exclusive) that count in the loss: each assistant turn's text with
    its end marker. ``n_masked_in`` is their total length.

    A row holds the turns whose numbers fall into one block of *segment_turns*; the
    rows of one perspective in the order of ``segment`` (NULL turns last) give the whole
    dialogue, and ``start_char`` is where a row's text starts in it. So no task holds a
    whole long conversation.

    Turns are in the order of turn, role and text, NULL turns last; repeated rows are
    kept as turns of their own. A NULL or empty role speaks as "unknown", a NULL text is
    empty, markers inside texts are broken up. NULL ids form one conversation of their
    own. A conversation of system turns only has no perspective and gives no rows.
    """
    block = F.floor(F.col("_turn") / segment_turns).cast("bigint")
    said = turns.select(
        c(conv_id).alias("conv_id"), c(turn).cast("bigint").alias("_turn"),
        F.when(F.coalesce(c(role), F.lit("")) == "", F.lit(UNNAMED)).otherwise(_clean(c(role))).alias("_role"),
        _clean(c(text)).alias("_text"),
    )
    segments = (
        said.withColumn("segment", block)
        .groupBy("conv_id", "segment")
        .agg(F.sort_array(F.collect_list(F.struct(
            F.col("_turn").isNull().alias("last"), F.col("_turn").alias("turn"), F.col("_role").alias("role"),
            F.col("_text").alias("text")))).alias("_turns"))
    )
    speakers = said.filter(F.col("_role") != SYSTEM).select(
        F.col("conv_id").alias("_conv"), F.col("_role").alias("perspective")).distinct()
    joined = segments.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    tail = len(TAIL)
    parts = F.transform("_turns", lambda t: F.struct(
        _head(t["role"], F.col("perspective")).alias("head"), t["text"].alias("text"),
        ((t["role"] == F.col("perspective")) & (t["role"] != SYSTEM)).alias("own")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).alias("inside"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["text"]) + tail
        span = F.concat(begin.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct(
            (end + 1).alias("at"),
            F.when(p["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
            F.when(p["own"], acc["inside"] + end - begin).otherwise(acc["inside"]).alias("inside"))

    rendered = F.concat_ws("", F.transform(
        "_parts", lambda p: F.concat(p["head"], p["text"], F.lit(TAIL + "\n"))))
    done = (
        joined.withColumn("_parts", parts)
        .withColumn("_mask", F.aggregate("_parts", start, step))
        .select(
            "conv_id", "perspective", "segment", F.size("_parts").cast("bigint").alias("n_turns"),
            rendered.alias("rendered"), F.col("_mask.at").cast("bigint").alias("n_chars"),
            F.concat_ws(",", "_mask.spans").alias("mask"), F.col("_mask.inside").cast("bigint").alias("n_masked_in"))
    )
    # one row per segment, not per turn
    earlier = (
        Window.partitionBy("conv_id", "perspective").orderBy(F.col("segment").asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, -1))
    return done.withColumn("start_char", F.coalesce(F.sum("n_chars").over(earlier), F.lit(0)).cast("bigint"))


OP5_SQL = r"""
WITH said AS (
  SELECT conv_id, turn::BIGINT AS turn,
         CASE WHEN coalesce(role, '') = '' THEN 'unknown'
              ELSE replace(replace(role, '<|', '< |'), '|>', '| >') END AS role,
         replace(replace(coalesce(text, ''), '<|', '< |'), '|>', '| >') AS text
  FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM said WHERE role <> 'system'),
pieces AS (
  SELECT s.conv_id, p.perspective, floor(s.turn / 64.0)::BIGINT AS segment, s.turn, s.role, s.text,
         CASE WHEN s.role = 'system' THEN '<|system|>' WHEN s.role = p.perspective THEN '<|assistant|>'
              ELSE '<|user name=' || s.role || '|>' END || chr(10) AS head,
         s.role = p.perspective AS own
  FROM said s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(text) + 8) OVER (
           PARTITION BY conv_id, perspective, segment ORDER BY turn ASC NULLS LAST, role, text
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM pieces),
rows_ AS (
  SELECT conv_id, perspective, segment, count(*)::BIGINT AS n_turns,
         string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY pos, turn ASC NULLS LAST, role, text) AS rendered,
         sum(length(head) + length(text) + 8)::BIGINT AS n_chars,
         coalesce(string_agg((pos + length(head))::VARCHAR || ':' || (pos + length(head) + length(text) + 7)::VARCHAR,
                             ',' ORDER BY pos) FILTER (WHERE own), '') AS mask,
         coalesce(sum(length(text) + 7) FILTER (WHERE own), 0)::BIGINT AS n_masked_in
  FROM placed GROUP BY ALL)
SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY conv_id, perspective ORDER BY segment ASC NULLS LAST
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_char
FROM rows_
"""
