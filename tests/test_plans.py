"""Plans: pushed filters, pruned columns, no single-task windows over rows."""

import re

import pytest

from tallywatch.operators import explore, filters as flt, tiers
from tallywatch.plans import frames as fr
from tallywatch.sinks.writers import write_parquet


@pytest.fixture(scope="module")
def stage(spark, data, tmp_path_factory):
    return write_parquet(fr.master(spark, data), str(tmp_path_factory.mktemp("stage") / "master"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_period_reaches_the_scan(stage):
    text = plan(flt.scoring_period(stage, 300, 400).select("transaction_id", "amount"))
    assert "GreaterThan(step,300)" in text and "LessThanOrEqual(step,400)" in text
    assert "In(type, [CASH_OUT,TRANSFER])" in text or "In(type, [TRANSFER,CASH_OUT])" in text
    assert re.search(r"ReadSchema: struct<transaction_id:bigint,step:int,type:string,amount:decimal\(20,2\)>", text)


def test_summaries_read_their_columns_only(stage):
    assert "ReadSchema: struct<type:string,amount:decimal(20,2),isFraud:tinyint>" in plan(explore.type_summary(stage))
    text = plan(explore.flag_lift(stage))
    assert "nameOrig" not in text and text.count("FileScan") == 1 and "Expand" not in text


def test_master_is_one_projection(spark, data):
    text = plan(fr.master(spark, data))
    assert "Exchange hashpartitioning" not in text and "Window" not in text


def test_exploration_shares_a_group_table(stage):
    groups = explore.group_table(stage)
    assert all("FileScan" not in plan(s(groups)) for s in (explore.type_summary, explore.hourly_summary))


def test_queue_rank_is_not_computed_in_one_task(spark, data):
    run = fr.ScoredRun(spark, data)
    queue = tiers.evaluation_queue(run.tiered(), partitions=4)
    # The only window left orders the per-partition counts.
    windows = [line for line in plan(queue).splitlines() if "Window" in line]
    assert all("part" in line for line in windows)
    assert "Scan ExistingRDD" in plan(queue)
