"""Reproducible train / validation / test membership.

``split_hash`` compares a hash of (seed, key) with fixed thresholds: a plain
projection, sizes right in expectation. ``split_exact`` gives exact sizes, per
stratum if wanted, by finding the hash at which each part ends: counting rows by
the leading hash bits narrows each cut to a few rows, and only those are ranked.
Neither form sorts or shuffles the table itself, and a key that fills a third of
the table only makes one of the counters large.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import c, require_columns
from ..functions.hashing import HASH_BITS, hash_rank_key, hash_word, word_below
from ..functions.ranking import numbered_rows
from ..session import local_frame, scratch_path, shared_dir

# Each pass over the hashes settles this many of their leading bits.
PASS_BITS = 12
# A group of candidate rows this small is ranked directly.
RANK_LIMIT = 1_000_000
# Up to this many classes the cut positions are kept as local rows.
LOCAL_CLASSES = 1000


def _key_list(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _check(df: DataFrame, key: list[str], target: str | None, test_size: float, val_size: float) -> None:
    require_columns(df, key, "Key column")
    if target is not None:
        require_columns(df, [target], "Target column")
    if not (0 <= test_size < 1 and 0 <= val_size < 1 and test_size + val_size < 1):
        raise ValueError("test_size and val_size must be fractions that leave rows for training")


def split_hash(
    df: DataFrame,
    key: str | Sequence[str],
    test_size: float = 0.2,
    val_size: float = 0.1,
    seed: int = 42,
    target: str | None = None,
    col: str = "split",
) -> DataFrame:
    """Add *col* = train / val / test; both sizes are fractions of the whole table."""
    names = _key_list(key)
    _check(df, names, target, test_size, val_size)
    word = hash_word(seed, names)
    # most rows are train: asked first, they need one comparison (and one hash in a filter)
    label = (
        F.when(~word_below(word, test_size + val_size), "train")
        .when(word_below(word, test_size), "test").otherwise("val")
    )
    return df.withColumn(col, label)


def _quotas(df: DataFrame, stratum: Column, test_size: float, val_size: float) -> DataFrame:
    """Rows per stratum and how many of them go to test and to validation.

    Totals are ceil(n * test) and ceil(rest * val / (1 - test)); a stratum gets
    its share rounded down and the leftovers go to the largest remainders.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "strata")
    df.groupBy(stratum.alias("_stratum")).agg(F.count(F.lit(1)).alias("_n")).write.parquet(path)
    sizes = spark.read.parquet(path)

    def allot(table: DataFrame, of: str, fraction: float, out: str) -> DataFrame:
        share = F.round(F.col(of) * F.lit(fraction), 9)
        sums = table.agg(F.sum(of).alias("rows"), F.sum(F.floor(share)).alias("given")).first()
        left = math.ceil(round((sums.rows or 0) * fraction, 9)) - (sums.given or 0)
        if left <= 0:
            return table.withColumn(out, F.floor(share).cast("bigint"))
        # the largest remainders, ties by stratum: places come from totals per range, not from one sorted task
        order = [(share - F.floor(share)).desc(), F.col("_stratum").asc_nulls_first()]
        placed = numbered_rows(table, order, "_pos")
        more = F.when(F.col("_pos") < left, 1).otherwise(0)
        return placed.withColumn(out, (F.floor(share) + more).cast("bigint")).drop("_pos")

    with_test = allot(sizes, "_n", test_size, "_test")
    rest = with_test.withColumn("_rest", F.col("_n") - F.col("_test"))
    return allot(rest, "_rest", val_size / (1.0 - test_size), "_val").drop("_rest")


def _whole(df: DataFrame, test_size: float, val_size: float) -> DataFrame:
    """The quotas of the table taken as one stratum."""
    n = df.count()
    test = math.ceil(round(n * test_size, 9))
    val = math.ceil(round((n - test) * val_size / (1.0 - test_size), 9))
    return local_frame(
        df.sparkSession, [("all", n, test, val)], "_stratum string, _n bigint, _test bigint, _val bigint")


def split_exact(
    df: DataFrame,
    key: str | Sequence[str],
    test_size: float = 0.2,
    val_size: float = 0.1,
    seed: int = 42,
    target: str | None = None,
    stratify: bool = False,
    col: str = "split",
    rank_limit: int = RANK_LIMIT,
) -> DataFrame:
    """Add *col* with exact part sizes; with *stratify*, exact in every target class.

    Rows are ordered by (hash, key); the first quota is test, the next is
    validation. *key* should identify a row: rows that share a key stay together.
    """
    names = _key_list(key)
    if stratify and target is None:
        raise ValueError("stratify needs the target column")
    _check(df, names, target, test_size, val_size)
    stratum = c(target).cast("string") if stratify else F.lit("all")
    order = F.struct(hash_rank_key(seed, names).alias("h"), *[c(k).alias(f"k{i}") for i, k in enumerate(names)])
    rows = df.select(stratum.alias("_s"), order.alias("_order"))

    quotas = _quotas(df, stratum, test_size, val_size) if stratify else _whole(df, test_size, val_size)
    cuts = quotas
    for name, wanted in (("test", F.col("_test")), ("val", F.col("_test") + F.col("_val"))):
        cuts = cuts.withColumn(f"{name}_k", wanted)
        for state in ("prefix", "before", "inside"):
            cuts = cuts.withColumn(f"{name}_{state}", F.lit(0).cast("bigint"))
    cuts, _ = _settle(cuts.drop("_n", "_test", "_val"))

    bits = 0
    while bits < HASH_BITS:
        cuts, competing = _settle(_descend(rows, cuts, stratify, bits))
        bits += PASS_BITS
        if competing <= rank_limit:
            break

    ends = _last_rows(rows, cuts, stratify, bits)
    out = _attach(df.withColumn("_s", stratum).withColumn("_order", order), ends, stratify, "left")
    label = (
        F.when(F.col("_order") <= F.col("test_end"), "test")
        .when(F.col("_order") <= F.col("val_end"), "val")
        .otherwise("train")
    )
    return out.select(*[c(n) for n in df.columns], label.alias(col))


def _settle(cuts: DataFrame) -> tuple[DataFrame, int]:
    """Cut the lineage of the per-class table: local rows if few, else a checkpoint.

    Also returns the largest number of rows that still compete for one cut.
    """
    spark = cuts.sparkSession
    rows = cuts.limit(LOCAL_CLASSES + 1).collect()
    if len(rows) <= LOCAL_CLASSES:
        worst = max((max(r["test_inside"], r["val_inside"]) for r in rows), default=0)
        return local_frame(spark, rows, cuts.schema), worst
    shared_dir(spark)
    settled = cuts.checkpoint()
    return settled, settled.agg(F.max(F.greatest("test_inside", "val_inside"))).first()[0]


def _attach(rows: DataFrame, table: DataFrame, stratify: bool, how: str = "inner") -> DataFrame:
    """Bring the per-class values to the rows; without classes they are literals."""
    if stratify:
        return rows.join(table, F.col("_s").eqNullSafe(F.col("_stratum")), how)
    found = table.first()
    values = {}
    for field in table.schema.fields:
        value = found[field.name] if found is not None else None
        if isinstance(field.dataType, T.StructType) and value is not None:
            values[field.name] = F.struct(*[F.lit(v).alias(k) for k, v in value.asDict().items()]).cast(field.dataType)
        else:
            values[field.name] = F.lit(value).cast(field.dataType)
    return rows.withColumns(values)


def _candidates(rows: DataFrame, cuts: DataFrame, stratify: bool, bits: int) -> DataFrame:
    """Per cut, the rows whose leading *bits* hash bits equal those of the cut."""
    h = F.col("_order.h")
    cells = F.array(*[
        F.struct(
            F.lit(name).alias("part"),
            *[F.col(f"{name}_{v}").alias(v) for v in ("k", "prefix", "before")],
        )
        for name in ("test", "val")
    ])
    long = _attach(rows, cuts, stratify).select("_stratum", "_order", F.explode(cells).alias("cut"))
    return long.filter(F.shiftright(h, HASH_BITS - bits) == F.col("cut.prefix")) if bits else long


def _first_reaching(groups: DataFrame, sort: str) -> DataFrame:
    """Per cut, the first group (in *sort* order) at which the running count reaches k."""
    running = Window.partitionBy("_stratum", "part").orderBy(sort).rowsBetween(Window.unboundedPreceding, 0)
    upto = groups.withColumn("upto", F.col("before") + F.sum("n").over(running))
    return upto.filter((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.greatest("k", F.lit(1))))


def _descend(rows: DataFrame, cuts: DataFrame, stratify: bool, bits: int) -> DataFrame:
    """Fix the next hash bits of every cut by counting rows per digit."""
    digit = F.shiftright(F.col("_order.h"), HASH_BITS - bits - PASS_BITS).bitwiseAND(F.lit((1 << PASS_BITS) - 1))
    groups = (
        _candidates(rows, cuts, stratify, bits)
        .groupBy("_stratum", F.col("cut.part").alias("part"), F.col("cut.k").alias("k"),
                 F.col("cut.prefix").alias("prefix"), F.col("cut.before").alias("before"), digit.alias("digit"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    hit = _first_reaching(groups, "digit")
    new = {
        "k": F.col("k"),
        "prefix": F.shiftleft(F.col("prefix"), PASS_BITS) + F.col("digit"),
        "before": F.col("upto") - F.col("n"),
        "inside": F.col("n"),
    }
    return hit.groupBy("_stratum").agg(*[
        F.max(F.when(F.col("part") == name, value)).alias(f"{name}_{field}")
        for name in ("test", "val") for field, value in new.items()
    ])


def _last_rows(rows: DataFrame, cuts: DataFrame, stratify: bool, bits: int) -> DataFrame:
    """Per class the (hash, key) of the last test row and of the last validation row."""
    groups = (
        _candidates(rows, cuts, stratify, bits)
        .groupBy("_stratum", F.col("cut.part").alias("part"), F.col("cut.k").alias("k"),
                 F.col("cut.before").alias("before"), F.col("_order").alias("pos"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    hit = _first_reaching(groups, "pos").filter(F.col("k") > 0)
    return hit.groupBy("_stratum").agg(*[
        F.max(F.when(F.col("part") == name, F.col("pos"))).alias(f"{name}_end") for name in ("test", "val")
    ])


def split_sizes(df: DataFrame, col: str = "split") -> DataFrame:
    return df.groupBy(c(col).alias("split")).agg(F.count(F.lit(1)).alias("n"))


def part(df: DataFrame, name: str, col: str = "split") -> DataFrame:
    """Rows of one part, without the membership column."""
    return df.filter(c(col) == name).drop(col)
