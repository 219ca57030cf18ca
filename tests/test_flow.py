"""Raw CSV to reporting views, end to end."""

from tallywatch.plans.flow import Flow
from tallywatch.report import contracts
from tallywatch.sinks.writers import write_csv
from tallywatch.sources import mapped


def test_whole_run(spark, data, tmp_path):
    csv = str(tmp_path / "transactions_csv")
    source = mapped.source_columns(spark, data)
    write_csv(source, csv)
    flow = Flow(spark, str(tmp_path / "out"))
    tables = flow.run(csv, trees=3)
    assert flow.stage("master").count() == source.count()
    assert len(tables) == 8
    fact = tables["fact_scored_transactions"]
    counted = contracts.fact_reconciliation(fact).first()
    assert counted["operational_alerts"] == tables["investigator_alert_queue"].count()
    assert counted["true_positives"] + counted["false_positives"] == counted["operational_alerts"]
    assert tables["hgb_feature_importance"].count() == 7
    kpi = spark.sql("SELECT * FROM vw_executive_fraud_kpis").first()
    assert kpi["total_transactions"] == fact.count()
    champion = tables["model_comparison"].where("model LIKE 'Hist%'").first()
    assert champion["alerts"] == counted["operational_alerts"]
    assert (tmp_path / "out" / "csv" / "risk" / "tiers").exists()
