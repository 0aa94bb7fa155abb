"""Feature steps: each is fitted and applied on a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.quantiles import exact_quantiles
from tabloom.operators.derive import LogTransform, PolynomialFeatures, negative_counts
from tabloom.operators.encode import LabelEncode, OneHotEncode
from tabloom.operators.fill import MeanImpute, MedianImpute, ModeImpute
from tabloom.operators.project import DropColumns, RenameColumns, SelectColumns
from tabloom.operators.rescale import MinMaxScale, StandardScale
from tabloom.operators.split import split_hash
from tabloom.plans.features import FeaturePipeline, preview, shape_summary
from tabloom.session import local_frame

from .registry import query, rounded, table

KEY = ["l_orderkey", "l_linenumber"]
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with gaps: quantity missing without a discount, tax when zero,
    return flag for small quantities."""
    return table(spark, sf_dir, "lineitem").select(
        *KEY,
        F.when(F.col("l_discount") != 0, F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        "l_discount",
        F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
        F.when(F.col("l_quantity") > 5, F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus",
    )


ITEMS = """items AS (SELECT l_orderkey, l_linenumber,
    CASE WHEN l_discount <> 0 THEN l_quantity END AS l_quantity, l_extendedprice, l_discount,
    CASE WHEN l_tax <> 0 THEN l_tax END AS l_tax,
    CASE WHEN l_quantity > 5 THEN l_returnflag END AS l_returnflag, l_linestatus FROM lineitem)"""


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select(*KEY, *NUMERIC)


# --- projections -----------------------------------------------------------------------

@query("drop_columns", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return DropColumns(cols=["o_custkey", "o_orderdate"]).fit(df).transform(df)


@query("select_columns", "SELECT o_totalprice, o_orderkey, o_orderstatus FROM orders")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return SelectColumns(cols=["o_totalprice", "o_orderkey", "o_orderstatus"]).fit(df).transform(df)


@query("rename_columns", "SELECT p_partkey AS part_id, p_name, p_brand AS brand, p_type, p_size, p_retailprice FROM part")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    return RenameColumns(mapping={"p_partkey": "part_id", "p_brand": "brand"}).fit(df).transform(df)


# --- imputation ------------------------------------------------------------------------

@query("mean_impute", f"""WITH {ITEMS}, m AS (SELECT avg(l_quantity) AS q, avg(l_tax) AS t FROM items)
    SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, q), 6) AS l_quantity, l_extendedprice, l_discount,
    round(coalesce(l_tax, t), 6) AS l_tax FROM items, m""")
def _(spark, sf_dir):
    df = numbers(spark, sf_dir)
    return rounded(MeanImpute(cols="all_numeric", exclude=KEY).fit(df).transform(df))


@query("median_impute", f"""WITH {ITEMS}, m AS (SELECT median(l_quantity) AS q, median(l_tax) AS t FROM items)
    SELECT l_orderkey, l_linenumber, coalesce(l_quantity, q) AS l_quantity, l_extendedprice, l_discount,
    coalesce(l_tax, t) AS l_tax FROM items, m""")
def _(spark, sf_dir):
    df = numbers(spark, sf_dir)
    return MedianImpute(cols="all_numeric", exclude=KEY).fit(df).transform(df)


MIDDLE = [f"""SELECT '{c}' AS "column", count({c}) AS n, round(quantile_cont({c}, 0.499), 6) AS low, round(quantile_cont({c}, 0.501), 6) AS high,
    TRUE AS within FROM items""" for c in NUMERIC]


@query("median_approximate", f"WITH {ITEMS} {' UNION ALL '.join(MIDDLE)}")
def _(spark, sf_dir):
    # what one scan of sketches fills in, against the exact values a thousandth of the rows below and above the middle
    df = numbers(spark, sf_dir)
    model = MedianImpute(cols="all_numeric", exclude=KEY, exact=False).fit(df)
    exact = exact_quantiles(df, NUMERIC, [0.499, 0.501])
    counts = df.agg(*[F.count(n).alias(n) for n in NUMERIC]).first()
    rows = [(n, counts[n], *exact[n], exact[n][0] <= model.fitted["values"][n] <= exact[n][1]) for n in NUMERIC]
    return rounded(local_frame(spark, rows, "column string, n bigint, low double, high double, within boolean"))


@query("onehot_beside_text", """WITH m AS (SELECT
      (SELECT text FROM documents WHERE text IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, text LIMIT 1) AS t,
      (SELECT source FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 1) AS s,
      (SELECT lang FROM documents WHERE lang IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, lang LIMIT 1) AS l)
    SELECT doc_id, md5(coalesce(text, t)) AS text_md5, coalesce(source, s) AS source, 'lang_' || coalesce(lang, l) AS hot
    FROM documents, m""")
def _(spark, sf_dir):
    # all categories of one column reach the driver, and only the mode of the texts beside it
    df = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    steps = [{"type": "mode_impute", "cols": "all_categorical"}, {"type": "onehot_encode", "cols": ["lang"]}]
    out = FeaturePipeline(steps, exclude=["doc_id"]).fit(df).transform(df)
    hot = [n for n in out.columns if n.startswith("lang_")]
    named = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"`{n}`") == 1, F.lit(n)) for n in hot])), ",")
    return out.select("doc_id", F.md5("text").alias("text_md5"), "source", named.alias("hot"))


@query("mode_impute", f"""WITH {ITEMS},
    rf AS (SELECT l_returnflag AS v FROM items WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    tx AS (SELECT l_tax AS v FROM items WHERE l_tax IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT l_orderkey, l_linenumber, coalesce(l_returnflag, rf.v) AS l_returnflag, l_linestatus,
    coalesce(l_tax, tx.v) AS l_tax FROM items, rf, tx""")
def _(spark, sf_dir):
    df = items(spark, sf_dir).select(*KEY, "l_returnflag", "l_linestatus", "l_tax")
    return ModeImpute(cols=["l_returnflag", "l_linestatus", "l_tax"]).fit(df).transform(df)


# --- scaling ---------------------------------------------------------------------------

@query("standard_scale", f"""WITH {ITEMS}, m AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq,
    avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp, avg(l_discount) AS md, stddev_pop(l_discount) AS sd,
    avg(l_tax) AS mt, stddev_pop(l_tax) AS st FROM items)
    SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) AS l_quantity,
    round((l_extendedprice - mp) / sp, 6) AS l_extendedprice, round((l_discount - md) / sd, 6) AS l_discount,
    round((l_tax - mt) / st, 6) AS l_tax FROM items, m""")
def _(spark, sf_dir):
    df = numbers(spark, sf_dir)
    return rounded(StandardScale(cols="all_numeric", exclude=KEY).fit(df).transform(df))


@query("minmax_scale", f"""WITH {ITEMS}, m AS (SELECT min(l_quantity) AS q0, max(l_quantity) AS q1,
    min(l_extendedprice) AS p0, max(l_extendedprice) AS p1, min(l_discount) AS d0, max(l_discount) AS d1,
    min(l_tax) AS t0, max(l_tax) AS t1 FROM items)
    SELECT l_orderkey, l_linenumber, round((l_quantity - q0) / (q1 - q0), 6) AS l_quantity,
    round((l_extendedprice - p0) / (p1 - p0), 6) AS l_extendedprice,
    round((l_discount - d0) / (d1 - d0), 6) AS l_discount, round((l_tax - t0) / (t1 - t0), 6) AS l_tax FROM items, m""")
def _(spark, sf_dir):
    df = numbers(spark, sf_dir)
    return rounded(MinMaxScale(cols="all_numeric", exclude=KEY).fit(df).transform(df))


# --- encoding --------------------------------------------------------------------------

def _hot(col: str, values: list, quote: bool = True) -> str:
    return ", ".join(
        f"CAST({col} IS NOT DISTINCT FROM {repr(v) if quote else v} AS INTEGER) AS \"{col}_{v}\"" for v in values)


@query("onehot_encode", f"""WITH {ITEMS} SELECT l_orderkey, l_linenumber, {_hot('l_returnflag', ['A', 'N', 'R'])},
    {_hot('l_linestatus', ['F', 'O'])} FROM items""")
def _(spark, sf_dir):
    df = items(spark, sf_dir).select(*KEY, "l_returnflag", "l_linestatus")
    return OneHotEncode(cols=["l_returnflag", "l_linestatus"]).fit(df).transform(df)


@query("onehot_unseen", f"""SELECT p_partkey, {_hot('p_size', list(range(1, 26)), quote=False)} FROM part""")
def _(spark, sf_dir):
    # fitted on the smaller parts, so sizes above 25 are unseen
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return OneHotEncode(cols=["p_size"]).fit(df.filter("p_size <= 25")).transform(df)


def _codes(name: str, col: str, source: str) -> str:
    return (f"{name} AS (SELECT v, row_number() OVER (ORDER BY CAST(v AS VARCHAR)) - 1 AS code "
            f"FROM (SELECT DISTINCT {col} AS v FROM {source} WHERE {col} IS NOT NULL))")


@query("label_encode", f"""WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_type <> 'PROMO' THEN p_type END AS p_type,
    p_size FROM part), small AS (SELECT * FROM p WHERE p_size <= 25),
    {_codes('b', 'p_brand', 'small')}, {_codes('t', 'p_type', 'small')}, {_codes('s', 'p_size', 'small')}
    SELECT p_partkey, CAST(coalesce(b.code, -1) AS BIGINT) AS p_brand, CAST(coalesce(t.code, -1) AS BIGINT) AS p_type,
    CAST(coalesce(s.code, -1) AS BIGINT) AS p_size FROM p
    LEFT JOIN b ON p_brand = b.v LEFT JOIN t ON p_type = t.v LEFT JOIN s ON p_size = s.v""")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("p_type"), "p_size")
    cols = ["p_brand", "p_type", "p_size"]
    return LabelEncode(cols=cols).fit(df.filter("p_size <= 25")).transform(df)


@query("label_encode_join", f"""WITH seen AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'),
    {_codes('k', 'o_custkey', 'seen')}
    SELECT o_orderkey, CAST(coalesce(code, -1) AS BIGINT) AS o_custkey FROM orders LEFT JOIN k ON o_custkey = v""")
def _(spark, sf_dir):
    # a column with very many categories: codes come from a joined category table
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    early = df.filter(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
    return LabelEncode(cols=["o_custkey"], max_categories=64).fit(early).transform(df).drop("o_orderdate")


@query("label_encode_double", f"""WITH {_codes('k', 'l_quantity', 'lineitem')}
    SELECT form, l_orderkey, l_linenumber, CAST(code AS BIGINT) AS l_quantity
    FROM lineitem JOIN k ON l_quantity = v, (VALUES ('list'), ('table')) AS f(form)""")
def _(spark, sf_dir):
    # whether the codes are kept in the model or joined from a table, they are the same
    df = table(spark, sf_dir, "lineitem").select(*KEY, "l_quantity")
    out = [
        LabelEncode(cols=["l_quantity"], max_categories=n).fit(df).transform(df).select(F.lit(form).alias("form"), "*")
        for form, n in (("list", 1000), ("table", 8))]
    return out[0].unionAll(out[1])


@query("onehot_wide", """SELECT p_partkey, 'bucket_' || (p_partkey % 1500) AS "column", 1 AS ones FROM part""")
def _(spark, sf_dir):
    # up to 1,500 categories: still one int column each; shown as (key, column of the one)
    df = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 1500).alias("bucket"))
    out = OneHotEncode(cols=["bucket"]).fit(df).transform(df)
    hot = [n for n in out.columns if n != "p_partkey"]
    cells = F.array(*[F.col(n) for n in hot])
    return out.select(
        "p_partkey", F.element_at(F.array(*[F.lit(n) for n in hot]), F.array_position(cells, 1).cast("int")).alias("column"),
        F.aggregate(cells, F.lit(0), lambda a, x: a + x).alias("ones"))


@query("onehot_after_impute", """WITH p AS (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_size % 5 END AS x FROM part),
    f AS (SELECT p_partkey, coalesce(CAST(x AS DOUBLE), (SELECT median(x) FROM p)) AS x FROM p)
    SELECT p_partkey, """ + ", ".join(f'CAST(x = {v}.0 AS INTEGER) AS "x_{v}.0"' for v in range(5)) + " FROM f")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_size") % 7 != 0, F.col("p_size") % 5).alias("x"))
    steps = [{"type": "median_impute", "cols": ["x"]}, {"type": "onehot_encode", "cols": ["x"]}]
    return FeaturePipeline(steps, exclude=["p_partkey"]).fit(df).transform(df)


@query("mean_impute_int", """SELECT n_name, coalesce(CAST(CASE WHEN n_nationkey <> 12 THEN n_nationkey END AS DOUBLE),
    (SELECT avg(n_nationkey) FROM nation WHERE n_nationkey <> 12)) AS n_nationkey FROM nation""")
def _(spark, sf_dir):
    # the mean is a whole number; the column becomes double all the same
    df = table(spark, sf_dir, "nation").select(
        "n_name", F.when(F.col("n_nationkey") != 12, F.col("n_nationkey")).alias("n_nationkey"))
    return MeanImpute(cols=["n_nationkey"]).fit(df).transform(df)


# --- derived features --------------------------------------------------------------------

@query("log_transform", """SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS o_totalprice,
    CASE WHEN o_custkey > -1 THEN round(ln(1 + o_custkey), 6) END AS o_custkey FROM orders""")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return rounded(LogTransform(cols=["o_totalprice", "o_custkey"]).fit(df).transform(df))


@query("log_transform_negative", """SELECT c_custkey, c_acctbal AS balance,
    CASE WHEN c_acctbal / 1000 > -1 THEN round(ln(1 + c_acctbal / 1000), 6) END AS log_thousands FROM customer""")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("balance"), (F.col("c_acctbal") / 1000).alias("log_thousands"))
    return rounded(LogTransform(cols=["log_thousands"]).fit(df).transform(df), "log_thousands")


@query("polynomial_features", """SELECT l_orderkey, l_linenumber, l_quantity, l_discount,
    round(pow(l_quantity, 2), 6) AS "l_quantity^2", round(pow(l_quantity, 3), 6) AS "l_quantity^3",
    round(pow(l_discount, 2), 6) AS "l_discount^2", round(pow(l_discount, 3), 6) AS "l_discount^3",
    round(l_quantity * l_discount, 6) AS "l_quantity*l_discount" FROM lineitem""")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(*KEY, "l_quantity", "l_discount")
    return rounded(PolynomialFeatures(cols=["l_quantity", "l_discount"], degree=3).fit(df).transform(df))


@query("negative_counts", """SELECT count_if(c_acctbal < 0)::BIGINT AS c_acctbal, count_if(c_nationkey < 0)::BIGINT AS c_nationkey
    FROM customer""")
def _(spark, sf_dir):
    return negative_counts(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"])


# --- whole pipelines ------------------------------------------------------------------------

STEPS = [
    {"type": "mean_impute", "cols": "all_numeric"},
    {"type": "mode_impute", "cols": "all_categorical"},
    {"type": "onehot_encode", "cols": ["l_returnflag", "l_linestatus"]},
    {"type": "standard_scale", "cols": "all_numeric"},
]

HOTS = [("l_returnflag", v) for v in "ANR"] + [("l_linestatus", v) for v in "FO"]


def _hash_unit(seed: int, *key: str) -> str:
    text = ", ".join(f"{k}::VARCHAR" for k in key)
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {text})), 1, 8))::BIGINT / 4294967296.0"


def transform_sql(where: str = "") -> str:
    """The four steps above, fitted on the hash-split training rows."""
    numeric = ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in NUMERIC)
    hots = ", ".join(f"CAST({c} = '{v}' AS INTEGER) AS \"{c}_{v}\"" for c, v in HOTS)
    columns = NUMERIC + [f"{c}_{v}" for c, v in HOTS]
    stats = ", ".join(f'avg("{c}") AS "a_{c}", stddev_pop("{c}") AS "s_{c}"' for c in columns)
    scaled = ", ".join(f'round(("{c}" - "a_{c}") / "s_{c}", 6) AS "{c}"' for c in columns)
    return f"""WITH {ITEMS},
    f AS (SELECT *, {_hash_unit(42, *KEY)} AS u FROM items),
    p AS (SELECT *, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.2 + 0.1 THEN 'val' ELSE 'train' END AS split FROM f),
    m AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in NUMERIC)} FROM p WHERE split = 'train'),
    rf AS (SELECT l_returnflag AS v FROM p WHERE split = 'train' AND l_returnflag IS NOT NULL
           GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    i AS (SELECT l_orderkey, l_linenumber, split, {numeric}, coalesce(l_returnflag, rf.v) AS l_returnflag, l_linestatus
          FROM p, m, rf),
    h AS (SELECT l_orderkey, l_linenumber, split, {', '.join(NUMERIC)}, {hots} FROM i),
    z AS (SELECT {stats} FROM h WHERE split = 'train')
    SELECT l_orderkey, l_linenumber, split, {scaled} FROM h, z {where}"""


def feature_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split, fit the steps on the training rows, transform every row."""
    parts = split_hash(items(spark, sf_dir), KEY)
    model = FeaturePipeline(STEPS, exclude=[*KEY, "split"]).fit(parts.filter("split = 'train'"))
    return rounded(model.transform(parts))


query("feature_transform", transform_sql())(feature_transform)


@query("feature_no_leakage", transform_sql("WHERE split = 'test'"))
def _(spark, sf_dir):
    # spoiling every row outside train must not change what was learned
    parts = split_hash(items(spark, sf_dir), KEY)
    spoiled = parts.withColumn(
        "l_extendedprice",
        F.when(F.col("split") == "train", F.col("l_extendedprice")).otherwise(F.col("l_extendedprice") * 1000))
    model = FeaturePipeline(STEPS, exclude=[*KEY, "split"]).fit(spoiled.filter("split = 'train'"))
    return rounded(model.transform(parts.filter("split = 'test'")))


@query("feature_shapes", """SELECT * FROM (VALUES (0, 'FillModel', 9, 9), (1, 'FillModel', 9, 9),
    (2, 'OneHotModel', 9, 12), (3, 'RescaleModel', 12, 12)) AS t(step, name, columns_in, columns_out),
    (SELECT count(*) AS row_count FROM lineitem)""")
def _(spark, sf_dir):
    parts = split_hash(items(spark, sf_dir), KEY)
    model = FeaturePipeline(STEPS, exclude=[*KEY, "split"]).fit(parts.filter("split = 'train'"))
    return shape_summary(model, parts)


@query("feature_preview", """WITH h AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 50)
    SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 6) AS o_totalprice,
    CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS BIGINT) AS o_orderstatus FROM h""")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    steps = [{"type": "label_encode", "cols": ["o_orderstatus"]}, {"type": "standard_scale", "cols": ["o_totalprice"]}]
    return rounded(preview(steps, df, ["o_orderkey"], 50))
