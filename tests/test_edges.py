"""Small literal frames: nulls, band edges, ties, empty classes, short queues."""

import pytest

from tallywatch import schema as S
from tallywatch.functions import exprs as ex
from tallywatch.operators import compare, evaluate as ev, explore, filters as flt, profile, quality, split as sp, tiers
from tallywatch.operators.features import master_dataset

NAN, INF = float("nan"), float("inf")
SCHEMA = S.TRANSACTIONS


def rows(spark, *changes):
    base = dict(step=1, type="TRANSFER", amount=10.0, nameOrig="C1", oldbalanceOrg=100.0, newbalanceOrig=90.0,
                nameDest="C2", oldbalanceDest=0.0, newbalanceDest=10.0, isFraud=0, isFlaggedFraud=0)
    return spark.createDataFrame([tuple({**base, **c}[f] for f in S.SOURCE_COLUMNS) for c in changes], SCHEMA)


def long(df):
    return {r[0]: r[1] for r in df.collect()}


def test_null_label_is_not_fraud(spark):
    df = rows(spark, {"isFraud": None, "amount": 7.0}, {"isFraud": 1}, {"isFraud": 0})
    assert [df.where(flt.FRAUD).count(), df.where(f"NOT {flt.FRAUD}").count()] == [1, 2]
    overall = long(profile.overall_profile(df))
    assert overall["Total transaction value"] == 27.0
    assert overall["Fraud transactions"] == 1


def test_zero_amount_counters_skip_null_labels(spark):
    df = rows(spark, {"amount": 0.0, "isFraud": None}, {"amount": 0.0, "isFraud": 1}, {"amount": 0.0}, {"amount": -1.0})
    assert tuple(quality.zero_amounts(df).first()) == (3, 1, 1, 1)


def test_missing_and_non_finite_cells(spark):
    df = rows(spark, {"amount": NAN}, {"amount": None}, {"amount": INF, "step": None}, {})
    missing = {r["Column"]: r["Missing_Count"] for r in profile.missing_values(df).collect()}
    assert (missing["amount"], missing["step"], missing["type"]) == (2, 1, 0)
    assert quality.non_finite_count(df).first()[0] == 4
    clean = ex.nan_to_null(df)
    assert clean.where("amount IS NULL").count() == 2


def test_numeric_summary_drops_nan(spark):
    df = rows(spark, {"amount": NAN}, {"amount": 4.0}, {"amount": 0.0}, {"amount": -2.0})
    line = {r["Column"]: r for r in profile.numeric_summary(df).collect()}["amount"]
    assert (line["Minimum"], line["Maximum"], line["Zero_Count"], line["Negative_Count"]) == (-2.0, 4.0, 1, 1)
    assert line["Mean"] == pytest.approx(2 / 3)


def test_blank_identifiers(spark):
    df = rows(spark, {"nameOrig": ""}, {"nameOrig": " \t\n"}, {"nameOrig": None}, {"nameOrig": " C1 "})
    assert df.where(flt.blank_identifier("nameOrig")).count() == 3


def test_amount_band_edges(spark):
    values = [-5.0, -0.0005, 0.0, 0.01, 10_000.0, 10_000.01, 50_000.0, 100_000.0, 200_000.0, 200_000.01,
              500_000.0, 1_000_000.0, 5_000_000.0, 5_000_000.01, None, NAN]
    df = spark.createDataFrame([(v,) for v in values], "amount double")
    bands = [r[0] for r in df.selectExpr(ex.amount_band("amount")).collect()]
    assert bands == [None, "0", "0", "0-10K", "0-10K", "10K-50K", "10K-50K", "50K-100K", "100K-200K",
                     "200K-500K", "200K-500K", "500K-1M", "1M-5M", ">5M", None, None]


def test_engineered_columns(spark):
    df = rows(
        spark,
        {"step": 24, "amount": 200_000.0, "oldbalanceOrg": 0.0},
        {"step": 25, "amount": 200_000.01, "nameDest": "M9", "oldbalanceDest": 4.0},
        {"step": 743, "type": "CASH_IN", "amount": 5.0, "oldbalanceOrg": 5.0, "newbalanceOrig": 10.02},
        {"amount": None, "nameDest": None, "oldbalanceOrg": None},
    ).selectExpr("monotonically_increasing_id() AS transaction_id", "*")
    a, b, c, d = master_dataset(df).orderBy("transaction_id").collect()
    assert (a["transaction_day"], a["hour_of_day"], a["high_value_200k_flag"], a["origin_zero_before_flag"]) == (1, 23, 0, 1)
    assert a["amount_to_origin_balance_ratio"] is None and a["amount_to_destination_balance_ratio"] is None
    assert (b["transaction_day"], b["hour_of_day"], b["high_value_200k_flag"], b["destination_is_merchant"]) == (2, 0, 1, 1)
    assert c["origin_balance_mismatch_flag"] == 1 and c["origin_balance_error_abs"] == pytest.approx(0.02)
    assert (d["zero_amount_flag"], d["amount_exceeds_origin_balance_flag"], d["destination_is_merchant"]) == (0, 0, 0)


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_duplicates_exact_with_and_without_broadcast(spark, threshold):
    df = rows(spark, *[{"amount": float(i % 7)} for i in range(50)], {"type": None}, {"type": None})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        assert profile.duplicate_rows(df).first()[0] == 44
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert profile.duplicate_rows(df.dropDuplicates()).first()[0] == 0


def test_distinct_accounts_exact_and_approximate(spark):
    df = rows(spark, *[{"nameOrig": f"C{i % 5}", "nameDest": f"M{i}"} for i in range(20)], {"nameOrig": None})
    assert tuple(profile.distinct_accounts(df).first()) == (5, 21)
    assert profile.approx_distinct_accounts(df).first()[0] == 5


def test_prefix_summary_keeps_null_prefix(spark):
    df = rows(spark, {"nameOrig": None}, {"nameDest": "M1"})
    got = {r["Prefix"]: (r["Origin_Count"], r["Destination_Count"]) for r in quality.prefix_summary(df).collect()}
    assert got == {None: (1, 0), "C": (1, 1), "M": (0, 1)}


def test_cleaning_rules(spark):
    df = rows(spark, {}, {}, {"amount": -1.0, "type": "X"}, {"step": 744}, {"isFraud": 2}, {"nameDest": " "}, {"isFlaggedFraud": None})
    valid, broken = quality.apply_cleaning_rules(df)
    assert valid.count() == 1
    assert sorted(tuple(r["reason"]) for r in broken.collect()) == [
        ("blank_account",), ("invalid_existing_flag",), ("invalid_label",), ("invalid_step",),
        ("negative_amount", "invalid_type"),
    ]


def test_leakage_guard(spark):
    df = rows(spark, {})
    with pytest.raises(quality.LeakageError):
        quality.leakage_guard(df)
    assert quality.leakage_guard(df.select("step", "amount")).count() == 1


def test_flag_lift_undefined(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0)], "zero_amount_flag int, isFraud int")
    line = explore.flag_lift(df, ["zero_amount_flag"]).first()
    assert (line["Fraud_Rate_When_True_Pct"], line["Fraud_Rate_When_False_Pct"], line["Fraud_Rate_Lift"]) == (50.0, 0.0, None)
    assert explore.defined_lift(explore.flag_lift(df, ["zero_amount_flag"])).count() == 0


def test_class_summary_is_dense(spark):
    both = explore.class_summary(rows(spark, {}, {"amount": 20.0})).collect()
    assert [(r["Class"], r["Transaction_Count"], r["Average_Amount"]) for r in both] == [("Legitimate", 2, 15.0), ("Fraud", 0, None)]


def test_split_boundaries_first_on_ties(spark):
    steps = [1] * 6 + [2] * 2 + [3] * 2 + [4] * 2  # 6, 8, 10, 12: targets 8.4 and 9.6
    df = spark.createDataFrame([(s, 0) for s in steps], "step int, isFraud int")
    row = sp.split_boundaries(sp.step_profile(df)).first()
    assert (row["train_end"], row["validation_end"]) == (2, 3) == tuple(sp.find_boundaries(df))
    tied = spark.createDataFrame([(s, 0) for s in [1] * 6 + [2] * 2 + [3] * 2], "step int, isFraud int")
    assert sp.find_boundaries(tied).train_end == 1  # 6 and 8 are equally near 7


def curve_of(spark, pairs):
    return ev.score_curve(spark.createDataFrame(pairs, "score double, isFraud int"))


def test_metrics_without_positives_and_without_alerts(spark):
    none = ev.classification_metrics(curve_of(spark, [(0.1, 0), (0.9, 0)]), 0.5, "m").first()
    assert (none["ROC_AUC"], none["Average_Precision"], none["Recall"], none["F2"]) == (None, 0.0, 0.0, 0.0)
    quiet = ev.classification_metrics(curve_of(spark, [(0.1, 1), (0.2, 0)]), 0.5, "m").first()
    assert (quiet["Alerts"], quiet["Precision"], quiet["False_Negative"]) == (0, 0.0, 1)


def test_equal_scores_are_one_point(spark):
    curve = curve_of(spark, [(0.5, 1), (0.5, 0), (0.5, 0), (0.2, 1)])
    got = [(r["score"], r["alerts"], r["tp"], r["place"]) for r in curve.orderBy("place").collect()]
    assert got == [(0.5, 3, 1, 1), (0.2, 4, 2, 2)]
    assert ev.roc_auc(curve).first()[0] == pytest.approx(0.25)


def test_argmax_takes_lowest_threshold(spark):
    curve = curve_of(spark, [(0.9, 1), (0.8, 0), (0.1, 0)])
    assert ev.f2_threshold(curve).first()["Threshold"] == 0.9


def scored_frame(spark, n, fraud_every=3, alert_below=None):
    return spark.createDataFrame(
        [(i, 1.0 - (i // 2) / 1000, float(i % 5), int(i % fraud_every == 0), int(alert_below is None or i < alert_below)) for i in range(n)],
        "transaction_id long, hgb_fraud_score double, amount double, isFraud int, operational_alert int",
    )


def test_capacity_shorter_than_levels(spark):
    got = {r["Investigation_Capacity"]: (r["Alerts_Reviewed"], r["Fraud_Found"]) for r in
           tiers.capacity_summary(scored_frame(spark, 120)).collect()}
    assert got[100][0] == 100 and got[250] == got[2000] == got[120] == (120, 40)
    empty = tiers.capacity_summary(scored_frame(spark, 10, alert_below=0)).collect()
    assert {r["Investigation_Capacity"] for r in empty} == {0, 100, 250, 500, 1000, 2000}
    assert all(r["Alerts_Reviewed"] == 0 and r["Precision_Pct"] == 0 for r in empty)
    level = tiers.capacity_summary(scored_frame(spark, 250)).collect()
    assert [r["Investigation_Capacity"] for r in level] == [100, 250, 500, 1000, 2000]


def test_tier_edges_and_dense_tiers(spark):
    df = spark.createDataFrame([(0.5,), (0.499,), (0.3,), (0.1,)], "s double")
    assert [r[0] for r in df.selectExpr(ex.risk_tier("s", "0.5D", "0.3D", "0.1D")).collect()] == ["Critical", "High", "High", "Medium"]
    some = spark.createDataFrame([("Critical", 0.9, 5.0, 1, 1), ("Low", 0.1, 2.0, 0, 0)],
                                 "risk_tier string, hgb_fraud_score double, amount double, isFraud int, operational_alert int")
    out = tiers.tier_summary(some).collect()
    assert [(r["Risk_Tier"], r["Transaction_Count"], r["Average_Model_Score"]) for r in out] == [
        ("Critical", 1, 0.9), ("High", 0, None), ("Medium", 0, None), ("Low", 1, 0.1)]


def test_detection_multiple_undefined(spark):
    df = spark.createDataFrame([(1, 1, 0), (0, 0, 0)], "isFraud int, operational_alert int, isFlaggedFraud int")
    got = long(tiers.alert_summary(df))
    assert got["Detection multiple vs legacy rule"] is None and got["Additional fraud detected vs legacy rule"] == 1


def test_model_row_and_nulls_last(spark):
    df = spark.createDataFrame([("a", 0.5, None), ("b", None, 0.1), (None, 0.9, 0.2)], "Model string, Recall double, F2 double")
    assert flt.model_row(df, contains="a").count() == 1 and flt.model_row(df, equals="b").count() == 1
    assert [r["Recall"] for r in compare.sort_models_by_recall(df).collect()] == [0.9, 0.5, None]


def test_rounding_half_away_from_zero(spark):
    df = spark.createDataFrame([(1, 8), (1, 0)], "a long, b long")
    assert [r[0] for r in df.selectExpr(ex.rounded_percent("a", "b", 0)).collect()] == [13.0, None]
    assert spark.range(1).selectExpr(ex.rounded("0.00005D", 4)).first()[0] == 0.0001


def test_odds_ratio_is_clipped(spark):
    got = [r[0] for r in spark.createDataFrame([(50.0,), (-50.0,), (0.0,)], "c double").selectExpr(ex.odds_ratio("c")).collect()]
    assert got == pytest.approx([485165195.409790, 2.061153622438558e-09, 1.0])
