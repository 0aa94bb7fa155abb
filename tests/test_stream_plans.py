import re

import pytest
from pyspark.sql import functions as F

from catalog.feature_queries import KEY, STEPS, items
from catalog.run_queries import run_events
from tabloom.operators.clean import describe_numeric
from tabloom.operators.drift import ks_statistics
from tabloom.operators.split import split_hash
from tabloom.plans.features import FeaturePipeline
from tabloom.plans.runlog import current_runs, leaderboard, telemetry
from tabloom.session import shared_dir

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- plans ------------------------------------------------------------------------------------

def test_feature_transform_is_one_narrow_stage(spark):
    parts = split_hash(items(spark, SF_DIR), KEY)
    model = FeaturePipeline(STEPS, exclude=[*KEY, "split"]).fit(parts.filter("split = 'train'"))
    text = plan(model.transform(parts))
    assert "Exchange" not in text and "Python" not in text
    assert len(re.findall(r"Project", text)) <= 2
    assert "l_shipdate" not in text and "l_partkey" not in text      # pruned at the scan


def test_no_row_data_meets_in_one_partition(spark):
    df = items(spark, SF_DIR)
    half = F.col("l_extendedprice") < 50000
    text = plan(ks_statistics(df.filter(half), df.filter(~half), ["l_quantity"]))
    assert "SinglePartition" not in text and "Cartesian" not in text and "NestedLoop" not in text


def test_run_view_prunes_fields_it_does_not_need(spark):
    runs = current_runs(run_events(spark, SF_DIR))
    assert "to_json" not in plan(telemetry(runs))
    assert "TakeOrderedAndProject" in plan(leaderboard(runs, "f1", 5))
    assert "confusion_matrix" in plan(leaderboard(runs, "f1", 5))


def test_results_do_not_depend_on_partitioning(spark):
    df = items(spark, SF_DIR)
    models = [FeaturePipeline(STEPS, exclude=KEY).fit(df.repartition(n)).stages[-1].fitted["params"] for n in (1, 8)]
    for name, (shift, scale) in models[0].items():
        assert models[1][name] == pytest.approx([shift, scale], rel=1e-12)
    a, b = (describe_numeric(df.repartition(n), ["l_tax"]).select("q25", "q50", "q75").first() for n in (1, 8))
    assert a == b


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == shared_dir(spark)
