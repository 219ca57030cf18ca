"""Sums that must agree on any input."""

import pytest

from tallywatch.operators import evaluate as ev, explore, split as sp, tiers
from tallywatch.plans import frames as fr


@pytest.fixture(scope="module")
def run(spark, data):
    return fr.ScoredRun(spark, data)


@pytest.fixture(scope="module")
def master(spark, data):
    return fr.master(spark, data).cache()


def total(df, column):
    return df.selectExpr(f"SUM({column})").first()[0]


def test_groups_sum_to_rows(master):
    n, fraud = master.count(), total(master, "isFraud")
    for summary in (explore.type_summary, explore.hourly_summary, explore.daily_summary, explore.amount_band_summary):
        assert total(summary(master), "Transaction_Count") == n
        assert total(summary(master), "Fraud_Count") == fraud
    lift = explore.flag_lift(master)
    assert lift.where(f"Flag_True_Count + Flag_False_Count <> {n} OR Fraud_When_True + Fraud_When_False <> {fraud}").count() == 0


def test_bands_agree_with_flags(master):
    bands = {r["Amount_Bucket"]: r["Transaction_Count"] for r in explore.amount_band_summary(master).collect()}
    assert bands["0"] == total(master, "zero_amount_flag")
    assert sum(bands[b] for b in ("200K-500K", "500K-1M", "1M-5M", ">5M")) == total(master, "high_value_200k_flag")


def test_splits_do_not_overlap(spark, data):
    model = fr.population(spark, data)
    parts = sp.split_summary(model, sp.find_boundaries(model)).collect()
    assert sum(p["Rows"] for p in parts) == model.count()
    assert parts[0]["Maximum_Step"] < parts[1]["Minimum_Step"] <= parts[1]["Maximum_Step"] < parts[2]["Minimum_Step"]


def test_confusion_cells(run):
    m = run.metrics("champion", "champion").first()
    rows, fraud = run.rows("TEST").count(), total(run.rows("TEST"), "isFraud")
    assert m["True_Positive"] + m["False_Positive"] == m["Alerts"]
    assert m["True_Positive"] + m["False_Negative"] == fraud
    assert m["True_Positive"] + m["False_Positive"] + m["False_Negative"] + m["True_Negative"] == rows


def test_tiers_and_capacity_agree_with_model(run):
    tiered = run.tiered()
    summary = tiers.tier_summary(tiered)
    assert total(summary, "Transaction_Count") == tiered.count()
    assert total(summary, "Fraud_Capture_Pct") == pytest.approx(100)
    metric = run.metrics("champion", "champion").first()
    full = tiers.capacity_summary(tiered).where(f"Investigation_Capacity = {metric['Alerts']}").first()
    assert full["Precision_Pct"] == pytest.approx(metric["Precision"] * 100)
    assert full["Total_Test_Fraud_Captured_Pct"] == pytest.approx(metric["Recall"] * 100)


def test_alerts_are_critical_when_threshold_is_higher(run):
    cuts = tiers.fix_thresholds(tiers.threshold_row(run.curve("VALIDATION"), 0.9999))
    tiered = tiers.with_tiers(run.rows("TEST"), cuts)
    assert tiered.where("operational_alert = 1 AND risk_tier <> 'Critical'").count() == 0


def test_queue_ranks_are_dense_and_ordered(run):
    queue = tiers.evaluation_queue(run.tiered(), partitions=5).orderBy("investigation_rank").collect()
    assert [q["investigation_rank"] for q in queue] == list(range(1, len(queue) + 1))
    keys = [(-q["hgb_fraud_score"], -q["amount"], q["transaction_id"]) for q in queue]
    assert keys == sorted(keys)
    assert "isFraud" not in tiers.investigator_queue(tiers.evaluation_queue(run.tiered())).columns


def test_curve_ends_at_totals(run):
    last = run.curve("TEST").orderBy("score").first()
    assert last["alerts"] == run.rows("TEST").count()
    assert ev.pr_curve(run.curve("TEST")).selectExpr("MAX(Recall)").first()[0] == 1.0


def test_one_pass_and_group_table_give_the_same_reports(spark, data, master):
    from tallywatch.operators import profile, quality
    from tallywatch.operators.onepass import one_pass
    from tallywatch.sources import mapped

    raw = mapped.defective(spark, data)
    reports = [profile.missing_values, profile.numeric_summary, profile.rule_performance, quality.quality_audit,
               quality.balance_summary, quality.balance_consistency]
    together = one_pass(raw, {f"r{i}": r.summary(raw) for i, r in enumerate(reports)})
    for i, report in enumerate(reports):
        assert str(together[f"r{i}"].collect()) == str(report(raw).collect())
    groups = explore.group_table(master)
    for summary in (explore.type_summary, explore.hourly_summary, explore.daily_summary, explore.amount_band_summary):
        assert sorted(summary(groups).collect()) == sorted(summary(master).collect())
