"""Sources, cleaning, profiling, splits and metric aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.clean import (
    Cleaner,
    dedupe_rows,
    describe_numeric,
    duplicate_count,
    fix_dtypes,
    null_counts,
    value_counts,
)
from tabloom.operators.evaluate import classification_metrics, confusion_matrix, regression_metrics
from tabloom.operators.split import split_exact, split_hash, split_sizes
from tabloom.session import scratch_path
from tabloom.sources.catalog import list_datasets, preview
from tabloom.sources.readers import load

from .feature_queries import ITEMS, items
from .registry import query, rounded, table

# --- sources ------------------------------------------------------------------------------

TEXT_ORDERS = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS o_totalprice,
    strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority, o_totalprice > 200000 AS is_large FROM orders"""


def _text_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority",
        (F.col("o_totalprice") > 200000).alias("is_large"))


@query("load_csv", TEXT_ORDERS)
def _(spark, sf_dir):
    path = scratch_path(spark, "orders") + ".csv"
    _text_orders(spark, sf_dir).write.csv(path, header=True, nullValue="N/A")
    return load(spark, path)


@query("load_json", TEXT_ORDERS)
def _(spark, sf_dir):
    path = scratch_path(spark, "orders") + ".json"
    _text_orders(spark, sf_dir).write.json(path)
    return load(spark, path)


@query("load_parquet", "SELECT * FROM customer")
def _(spark, sf_dir):
    return load(spark, f"{sf_dir.rstrip('/')}/customer.parquet")


@query("load_csv_ids", """SELECT o_orderkey + 1000000000000000000 AS long_id,
    CAST(o_orderkey + 1 AS VARCHAR) || '0000000000000000000001' AS wide_id, o_custkey FROM orders""")
def _(spark, sf_dir):
    # 19 digits stay bigint; 20 and more become exact decimals, shown as text
    path = scratch_path(spark, "ids") + ".csv"
    table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + 1000000000000000000).alias("long_id"),
        F.concat((F.col("o_orderkey") + 1).cast("string"), F.lit("0000000000000000000001")).alias("wide_id"),
        "o_custkey").write.csv(path, header=True)
    return load(spark, path).withColumn("wide_id", F.col("wide_id").cast("string"))


@query("load_csv_text", "SELECT doc_id, text, lang FROM documents")
def _(spark, sf_dir):
    # whole texts with line breaks, quotes and commas
    path = scratch_path(spark, "texts") + ".csv"
    table(spark, sf_dir, "documents").select("doc_id", "text", "lang").write.csv(
        path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return load(spark, path, multiline=True)


LISTED = ["customer", "documents", "events", "lineitem", "orders", "part", "supplier"]


@query("dataset_listing", " UNION ALL ".join(
    f"SELECT '{n}.parquet' AS name, count(*) AS n_rows FROM {n}" for n in LISTED))
def _(spark, sf_dir):
    # the listed files and the rows in each
    names = [r["name"] for r in list_datasets(spark, sf_dir, "*.parquet").collect()]
    counted = [
        load(spark, f"{sf_dir.rstrip('/')}/{n}").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("name"), "n_rows")
        for n in names if n.removesuffix(".parquet") in LISTED]
    return reduce(DataFrame.unionAll, counted)


@query("preview_top_n", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20")
def _(spark, sf_dir):
    return preview(table(spark, sf_dir, "orders"), 20, "o_orderkey")


# --- profile ------------------------------------------------------------------------------

@query("null_counts", f"""WITH {ITEMS} SELECT """ + ", ".join(
    f"count_if({c} IS NULL)::BIGINT AS {c}" for c in [
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
        "l_linestatus"]) + " FROM items")
def _(spark, sf_dir):
    return null_counts(items(spark, sf_dir))


@query("null_counts_labels", """SELECT count_if(doc_id IS NULL)::BIGINT AS doc_id, count_if(lang IS NULL)::BIGINT AS lang,
    count_if(quality IS NULL)::BIGINT AS quality, count_if(toxic IS NULL)::BIGINT AS toxic
    FROM documents LEFT JOIN labels USING (doc_id)""")
def _(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return null_counts(joined.select("doc_id", "lang", "quality", "toxic"))


DESCRIBE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe_numeric", f"WITH {ITEMS} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS "count", count_if({c} IS NULL)::BIGINT AS nulls,
    round(avg({c}), 9) AS mean, round(stddev_samp({c}), 9) AS std, min({c}) AS min,
    round(quantile_cont({c}, 0.25), 9) AS q25, round(quantile_cont({c}, 0.5), 9) AS q50,
    round(quantile_cont({c}, 0.75), 9) AS q75, max({c}) AS max FROM items""" for c in DESCRIBE))
def _(spark, sf_dir):
    return rounded(describe_numeric(items(spark, sf_dir), DESCRIBE), "mean", "std", "q25", "q50", "q75", digits=9)


@query("value_counts", f"""WITH {ITEMS} SELECT l_returnflag AS value, count(*) AS n FROM items
    WHERE l_returnflag IS NOT NULL GROUP BY 1""")
def _(spark, sf_dir):
    return value_counts(items(spark, sf_dir), "l_returnflag")


# --- cleaning -----------------------------------------------------------------------------

def _repeated(spark, sf_dir):
    """Order attributes without the key: many rows are exact copies."""
    return table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_orderdate")


@query("dedupe_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority, o_orderdate FROM orders")
def _(spark, sf_dir):
    return dedupe_rows(_repeated(spark, sf_dir))


@query("duplicate_count", """SELECT CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM
    (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority, o_orderdate)""")
def _(spark, sf_dir):
    return duplicate_count(_repeated(spark, sf_dir))


TEXT_EVENTS = """t AS (SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 'n/a' WHEN event_type = 'view'
    THEN ' ' || CAST(user_id AS VARCHAR) || ' ' ELSE CAST(user_id AS VARCHAR) END AS user_text, props FROM events)"""


def _text_events(spark, sf_dir):
    user = F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").select(
        "event_id", "event_type",
        F.when(F.col("event_type") == "error", "n/a")
        .when(F.col("event_type") == "view", F.concat(F.lit(" "), user, F.lit(" "))).otherwise(user).alias("user_text"),
        "props")


@query("fix_dtypes", f"""WITH {TEXT_EVENTS} SELECT event_id, event_type, TRY_CAST(trim(user_text) AS DOUBLE) AS user_text,
    props FROM t""")
def _(spark, sf_dir):
    return fix_dtypes(_text_events(spark, sf_dir))


# rows of items without their key, so that there are copies to remove
CLEAN_COLS = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
DISTINCT_ITEMS = f"{ITEMS}, d AS (SELECT DISTINCT {', '.join(CLEAN_COLS)} FROM items)"


def _clean(spark, sf_dir, strategy):
    return Cleaner({"fill_nulls": strategy}).clean(items(spark, sf_dir).select(*CLEAN_COLS))


@query("clean_mean", f"""WITH {DISTINCT_ITEMS}, m AS (SELECT avg(l_quantity) AS q, avg(l_tax) AS t FROM d)
    SELECT round(coalesce(l_quantity, q), 6) AS l_quantity, l_discount, round(coalesce(l_tax, t), 6) AS l_tax,
    l_returnflag, l_linestatus FROM d, m""")
def _(spark, sf_dir):
    return rounded(_clean(spark, sf_dir, "mean"), "l_quantity", "l_tax")


@query("clean_median", f"""WITH {DISTINCT_ITEMS}, m AS (SELECT median(l_quantity) AS q, median(l_tax) AS t FROM d)
    SELECT coalesce(l_quantity, q) AS l_quantity, l_discount, coalesce(l_tax, t) AS l_tax, l_returnflag, l_linestatus
    FROM d, m""")
def _(spark, sf_dir):
    return _clean(spark, sf_dir, "median")


def _mode(col: str) -> str:
    return f"(SELECT {col} FROM d WHERE {col} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query("clean_mode", f"WITH {DISTINCT_ITEMS} SELECT " + ", ".join(
    f"coalesce({c}, {_mode(c)}) AS {c}" for c in CLEAN_COLS) + " FROM d")
def _(spark, sf_dir):
    return _clean(spark, sf_dir, "mode")


@query("clean_drop_nulls", f"WITH {ITEMS} SELECT * FROM items WHERE l_quantity IS NOT NULL AND l_tax IS NOT NULL "
                           "AND l_returnflag IS NOT NULL")
def _(spark, sf_dir):
    return Cleaner({"fill_nulls": "drop", "min_fraction": 0.5}).clean(items(spark, sf_dir))


# --- splits -------------------------------------------------------------------------------

UNIT = "('0x' || substr(md5(concat_ws('|', '42', o_orderkey::VARCHAR)), 1, 8))::BIGINT / 4294967296.0"
HASHED = f"h AS (SELECT *, CASE WHEN {UNIT} < 0.2 THEN 'test' WHEN {UNIT} < 0.2 + 0.1 THEN 'val' ELSE 'train' END AS split FROM orders)"
ORDER_KEY = "('0x' || substr(md5(concat_ws('|', '42', o_orderkey::VARCHAR)), 1, 15))::BIGINT"


@query("split_hash", f"WITH {HASHED} SELECT o_orderkey, o_orderstatus, split FROM h")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return split_hash(df, "o_orderkey", target="o_orderstatus")


@query("split_sizes", f"WITH {HASHED} SELECT split, count(*) AS n FROM h GROUP BY 1")
def _(spark, sf_dir):
    return split_sizes(split_hash(table(spark, sf_dir, "orders"), "o_orderkey"))


@query("split_disjoint", f"""WITH {HASHED} SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys,
    CAST(0 AS BIGINT) AS n_shared_keys FROM h""")
def _(spark, sf_dir):
    df = split_hash(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    per_key = df.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("parts"))
    return per_key.agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("parts") > 1).alias("n_shared_keys"))


@query("split_exact", f"""WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY {ORDER_KEY}, o_orderkey) AS pos,
    count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, o_orderstatus, CASE WHEN pos <= ceil(n * 0.2) THEN 'test'
    WHEN pos <= ceil(n * 0.2) + ceil((n - ceil(n * 0.2)) * 0.125) THEN 'val' ELSE 'train' END AS split FROM r""")
def _(spark, sf_dir):
    return split_exact(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")


def _allot(source: str, of: str, fraction: str, out: str) -> str:
    return f"""SELECT *, floor(round({of} * {fraction}, 9)) + CASE WHEN row_number() OVER (ORDER BY
    round({of} * {fraction}, 9) - floor(round({of} * {fraction}, 9)) DESC, s)
    <= ceil(round(sum({of}) OVER () * {fraction}, 9)) - sum(floor(round({of} * {fraction}, 9))) OVER () THEN 1 ELSE 0 END AS {out}
    FROM {source}"""


@query("split_stratified_exact", f"""WITH c AS (SELECT o_orderstatus AS s, count(*)::DOUBLE AS n FROM orders GROUP BY 1),
    t AS ({_allot('c', 'n', '0.2', 'n_test')}), t2 AS (SELECT *, n - n_test AS rest FROM t),
    v AS ({_allot('t2', 'rest', '0.125', 'n_val')}),
    r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {ORDER_KEY}, o_orderkey) AS pos
          FROM orders)
    SELECT o_orderkey, o_orderstatus, CASE WHEN pos <= n_test THEN 'test' WHEN pos <= n_test + n_val THEN 'val' ELSE 'train'
    END AS split FROM r JOIN v ON o_orderstatus = s""")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return split_exact(df, "o_orderkey", target="o_orderstatus", stratify=True)


@query("split_stratified_many", f"""WITH c AS (SELECT o_custkey::VARCHAR AS s, count(*)::DOUBLE AS n FROM orders GROUP BY 1),
    t AS ({_allot('c', 'n', '0.2', 'n_test')}), t2 AS (SELECT *, n - n_test AS rest FROM t),
    v AS ({_allot('t2', 'rest', '0.125', 'n_val')}),
    r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {ORDER_KEY}, o_orderkey) AS pos
          FROM orders)
    SELECT o_orderkey, o_custkey, CASE WHEN pos <= n_test THEN 'test' WHEN pos <= n_test + n_val THEN 'val' ELSE 'train'
    END AS split FROM r JOIN v ON o_custkey::VARCHAR = s""")
def _(spark, sf_dir):
    # a stratum for every customer
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return split_exact(df, "o_orderkey", target="o_custkey", stratify=True)


# --- metrics on a rule-based prediction ------------------------------------------------------

RULE = """p AS (SELECT l_returnflag AS label, CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END
    AS prediction FROM lineitem)"""


def _rule(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("label"), F.when(q < 17, "A").when(q < 34, "N").otherwise("R").alias("prediction"))


@query("confusion_matrix", f"WITH {RULE} SELECT label, prediction, count(*) AS n FROM p GROUP BY 1, 2")
def _(spark, sf_dir):
    return confusion_matrix(_rule(spark, sf_dir))


@query("classification_metrics", f"""WITH {RULE}, l AS (SELECT label AS c FROM p UNION SELECT prediction FROM p),
    g AS (SELECT label, prediction, count(*) AS n FROM p GROUP BY 1, 2),
    s AS (SELECT c, sum(CASE WHEN label = c AND prediction = c THEN n ELSE 0 END) AS tp,
          sum(CASE WHEN label = c THEN n ELSE 0 END) AS sup, sum(CASE WHEN prediction = c THEN n ELSE 0 END) AS pr
          FROM l, g GROUP BY c)
    SELECT round(sum(tp)::DOUBLE / sum(sup), 6) AS accuracy,
    round(sum(sup * coalesce(2.0 * tp / nullif(pr + sup, 0), 0)) / sum(sup), 6)::DOUBLE AS f1_weighted,
    round(sum(sup * coalesce(tp::DOUBLE / nullif(pr, 0), 0)) / sum(sup), 6)::DOUBLE AS precision_weighted,
    round(sum(sup * coalesce(tp::DOUBLE / nullif(sup, 0), 0)) / sum(sup), 6)::DOUBLE AS recall_weighted FROM s""")
def _(spark, sf_dir):
    return classification_metrics(_rule(spark, sf_dir))


@query("regression_metrics", """WITH p AS (SELECT l_extendedprice AS y, l_quantity * 2000.0::DOUBLE AS f FROM lineitem)
    SELECT round(avg(abs(y - f)), 6) AS mae, round(sqrt(avg((y - f) * (y - f))), 6) AS rmse,
    round(1 - sum((y - f) * (y - f)) / (var_pop(y) * count(*)), 6) AS r2 FROM p""")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 2000.0).alias("prediction"))
    return regression_metrics(df)
