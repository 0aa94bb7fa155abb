"""Drift between two parts of a table."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tabloom.operators.drift import category_alignment, chi2_statistics, detect_drift, ks_statistics
from tabloom.operators.split import part, split_hash
from tabloom.session import scratch_path
from tabloom.sources.sinks import append_drift, latest_drift

from .dataset_queries import HASHED
from .registry import query, rounded, table


def _halves(spark, sf_dir):
    """lineitem shipped before and after a day, with a price rise after it."""
    day = F.lit("1998-06-01").cast("timestamp_ntz")
    df = table(spark, sf_dir, "lineitem").select(
        "l_shipdate", "l_quantity", "l_tax", "l_returnflag", "l_linestatus",
        F.when(F.col("l_shipdate") >= day, F.col("l_extendedprice") * 1.25).otherwise(F.col("l_extendedprice"))
        .alias("l_extendedprice"))
    return df.filter(F.col("l_shipdate") < day).drop("l_shipdate"), df.filter(F.col("l_shipdate") >= day).drop("l_shipdate")


HALVES = """x AS (SELECT l_shipdate >= TIMESTAMP '1998-06-01' AS is_new, l_quantity, l_tax, l_returnflag, l_linestatus,
    CASE WHEN l_shipdate >= TIMESTAMP '1998-06-01' THEN l_extendedprice * 1.25::DOUBLE ELSE l_extendedprice END
    AS l_extendedprice FROM lineitem)"""


def ks_sql(col: str, source: str = "x") -> str:
    return f"""SELECT max(abs(d)) AS s, max(tr) AS n_ref, max(tn) AS n_new FROM (SELECT sum(r) OVER (ORDER BY v) / sum(r) OVER ()
    - sum(n) OVER (ORDER BY v) / sum(n) OVER () AS d, sum(r) OVER () AS tr, sum(n) OVER () AS tn FROM
    (SELECT {col} AS v, sum((NOT is_new)::INT)::DOUBLE AS r, sum(is_new::INT)::DOUBLE AS n FROM {source}
     WHERE {col} IS NOT NULL GROUP BY 1))"""


def chi2_sql(col: str, source: str = "x") -> str:
    return f"""SELECT sum(dr * dr / er + dn * dn / en) AS s, max(k) AS k, max(tr) AS n_ref, max(tn) AS n_new FROM (SELECT *,
    CASE WHEN k = 2 THEN abs(r - er) - least(0.5, abs(r - er)) ELSE abs(r - er) END AS dr,
    CASE WHEN k = 2 THEN abs(n - en) - least(0.5, abs(n - en)) ELSE abs(n - en) END AS dn FROM (SELECT *,
    (r + n) * tr / (tr + tn) AS er, (r + n) * tn / (tr + tn) AS en FROM (SELECT r, n, sum(r) OVER () AS tr,
    sum(n) OVER () AS tn, count(*) OVER () AS k FROM (SELECT {col} AS v, sum((NOT is_new)::INT)::DOUBLE AS r,
    sum(is_new::INT)::DOUBLE AS n FROM {source} WHERE {col} IS NOT NULL GROUP BY 1))))"""


NUMERIC = ["l_quantity", "l_tax", "l_extendedprice"]
TEXT = ["l_returnflag", "l_linestatus"]


@query("drift_ks", f"WITH {HALVES} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(s, 6) AS statistic, n_ref::BIGINT AS n_ref, n_new::BIGINT AS n_new
    FROM ({ks_sql(c)})""" for c in NUMERIC))
def _(spark, sf_dir):
    return rounded(ks_statistics(*_halves(spark, sf_dir), NUMERIC))


@query("drift_chi2", f"WITH {HALVES} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", k, round(s, 6) AS statistic, n_ref::BIGINT AS n_ref, n_new::BIGINT AS n_new
    FROM ({chi2_sql(c)})""" for c in TEXT))
def _(spark, sf_dir):
    return rounded(chi2_statistics(*_halves(spark, sf_dir), TEXT))


# chi-square upper 5 % points for 1 and 2 degrees of freedom
CRITICAL = {"l_returnflag": 5.991464547107979, "l_linestatus": 3.841458820694124}


# the alternating series, cut after 100 terms; 1 where there is hardly a gap
SERIES = """CASE WHEN l < 0.05 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 2 * list_sum(list_transform(
    generate_series(1, 100), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0::DOUBLE * k * k * l * l))))) END"""
CHI2_P = {"l_returnflag": "exp(-s / 2)", "l_linestatus": "CAST(NULL AS DOUBLE)"}  # one degree has no closed form in SQL


def scores_sql() -> str:
    ks = [f"""SELECT '{c}' AS "column", 'kolmogorov-smirnov' AS "method", s AS statistic, s > 0.1 AS drifted, {SERIES} AS p
          FROM (SELECT s, s * sqrt(n_ref * n_new / (n_ref + n_new)) AS l FROM ({ks_sql(c)}))""" for c in NUMERIC]
    chi = [f"""SELECT '{c}' AS "column", 'chi-square' AS "method", s AS statistic, s > {CRITICAL[c]} AS drifted, {CHI2_P[c]} AS p
           FROM ({chi2_sql(c)})""" for c in TEXT]
    return " UNION ALL ".join(ks + chi)


@query("drift_scores", f"""WITH {HALVES} SELECT "column", "method", round(statistic, 6) AS statistic, drifted,
    round(p, 6) AS p_value FROM ({scores_sql()})""")
def _(spark, sf_dir):
    p = F.when(F.col("column") != "l_linestatus", F.col("p_value")).alias("p_value")
    return rounded(detect_drift(*_halves(spark, sf_dir)).scores.select("column", "method", "statistic", "drifted", p))


# up to 10,000 rows a side the p-value is exact: the share of orders of both samples that reach the gap
@query("drift_small_sample", f"""WITH RECURSIVE x AS (SELECT s_nationkey >= 12 AS is_new, s_acctbal FROM supplier),
    k AS (SELECT s, n_ref::BIGINT AS n, n_new::BIGINT AS m, CAST(round(s * n_ref * n_new) AS BIGINT) AS h FROM ({ks_sql('s_acctbal')})),
    walk AS (SELECT 0::BIGINT AS step, list_transform(generate_series(0, n), lambda i: 0.0::DOUBLE) AS v, n, m, h, s FROM k
      UNION ALL SELECT step + 1, list_transform(generate_series(0, n), lambda i:
        CASE WHEN step + 1 - i < 0 OR step + 1 - i > m THEN 0.0::DOUBLE
             WHEN abs(i * m - (step + 1 - i) * n) >= h THEN 1.0::DOUBLE
             ELSE (CASE WHEN i > 0 THEN i * v[i] ELSE 0 END + CASE WHEN step + 1 - i > 0 THEN (step + 1 - i) * v[i + 1] ELSE 0 END)
               / CAST(step + 1 AS DOUBLE) END), n, m, h, s FROM walk WHERE step < n + m)
    SELECT 's_acctbal' AS "column", round(s, 6) AS statistic, round(v[n + 1], 9) AS p_value FROM walk WHERE step = n + m""")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "supplier")
    south = F.col("s_nationkey") >= 12
    scores = detect_drift(df.filter(~south).select("s_acctbal"), df.filter(south).select("s_acctbal")).scores
    return rounded(rounded(scores.select("column", "statistic", "p_value"), "statistic"), "p_value", digits=9)


@query("drift_report", f"""WITH {HALVES}, s AS ({scores_sql()}), t AS (SELECT count_if(drifted)::INTEGER AS n_drifted,
    count(*)::INTEGER AS n FROM s)
    SELECT CASE WHEN n_drifted = 0 THEN 'ok' WHEN n_drifted / n <= 0.3 THEN 'warning' ELSE 'alert' END AS status,
    n_drifted, n AS n_compared, n AS n_tested FROM t""")
def _(spark, sf_dir):
    return detect_drift(*_halves(spark, sf_dir)).summary().drop("features_drifted")


@query("category_alignment", f"""WITH {HALVES} SELECT l_returnflag AS category, count_if(NOT is_new)::BIGINT AS n_ref,
    count_if(is_new)::BIGINT AS n_new FROM x GROUP BY 1""")
def _(spark, sf_dir):
    return category_alignment(*_halves(spark, sf_dir), "l_returnflag")


TRAIN_TEST = f"""{HASHED}, y AS (SELECT split = 'test' AS is_new, o_totalprice, o_orderstatus, o_orderpriority FROM h
    WHERE split IN ('train', 'test'))"""


@query("drift_train_vs_test", f"""WITH {TRAIN_TEST},
    s AS (SELECT 'o_totalprice' AS "column", 'kolmogorov-smirnov' AS "method", s AS statistic, s > 0.1 AS drifted,
      CAST(NULL AS DOUBLE) AS p FROM ({ks_sql('o_totalprice', 'y')}) UNION ALL
    SELECT 'o_orderstatus', 'chi-square', s, exp(-s / 2) < 0.05, exp(-s / 2) FROM ({chi2_sql('o_orderstatus', 'y')}) UNION ALL
    SELECT 'o_orderpriority', 'chi-square', s, exp(-s / 2) * (1 + s / 2) < 0.05, exp(-s / 2) * (1 + s / 2)
      FROM ({chi2_sql('o_orderpriority', 'y')}))
    SELECT "column", "method", round(statistic, 6) AS statistic, round(p, 6) AS category_p_value, drifted FROM s""")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    parts = split_hash(df, "o_orderkey")
    report = detect_drift(part(parts, "train").drop("o_orderkey"), part(parts, "test").drop("o_orderkey"))
    p = F.when(F.col("method") == "chi-square", F.col("p_value")).alias("category_p_value")
    return rounded(report.scores.select("column", "method", "statistic", p, "drifted"))


@query("drift_latest", f"""WITH {HALVES}, s AS ({scores_sql()}) SELECT "column", round(statistic, 6) AS statistic, drifted,
    CASE WHEN (SELECT count_if(drifted) FROM s) = 0 THEN 'ok' WHEN (SELECT count_if(drifted) / count(*) FROM s) <= 0.3
    THEN 'warning' ELSE 'alert' END AS status FROM s""")
def _(spark, sf_dir):
    # an older check of the first half against itself, then the real one
    ref, new = _halves(spark, sf_dir)
    path = scratch_path(spark, "drift-log")
    append_drift(detect_drift(ref, ref), path, datetime.datetime(2024, 1, 1))
    append_drift(detect_drift(ref, new), path, datetime.datetime(2024, 1, 2))
    return rounded(latest_drift(spark.read.parquet(path)).select("column", "statistic", "drifted", "status"))
