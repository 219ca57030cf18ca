"""CSV landing, ids in file order, table schemas, catalog and the report contracts."""

import pytest

from tallywatch import schema as S
from tallywatch.plans import catalog, oracle
from tallywatch.report import contracts, tables as rt, views
from tallywatch.session import shared_dir
from tallywatch.sinks import writers
from tallywatch.sources import mapped, transactions as src
from tallywatch.models.stress import feature_register


def test_csv_landing_keeps_file_order(spark, tmp_path):
    path = tmp_path / "transactions.csv"
    lines = [",".join(S.SOURCE_COLUMNS)]
    lines += [f"{1 + i % 743},TRANSFER,{i}.5,C{i},1.0,2.0,M{i},3.0,4.0,0,0" for i in range(5000)]
    lines[3] = "3,TRANSFER,,C2,1.0,2.0,M2,3.0,4.0,0,0"
    path.write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert src.line_count(spark, str(path)).first()[0] == 5000
        landed = src.land_csv(spark, str(path), str(tmp_path / "raw"))
        assert len(landed.inputFiles()) > 3
        ids = src.with_transaction_id(landed.select("*", "_metadata"))
        assert ids.where("nameOrig <> concat('C', transaction_id - 1)").count() == 0
        assert ids.selectExpr("COUNT(DISTINCT transaction_id)", "MAX(transaction_id)").first() == (5000, 5000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    frame = src.read_csv(spark, str(path))
    assert frame.schema == S.TRANSACTIONS and frame.where("amount IS NULL").count() == 1
    assert src.read_csv_sample(spark, str(path), 10).count() == 10


def test_scan_reads_only_named_columns(spark, data):
    plan = src.read_parquet(spark, f"{data}/orders.parquet", ["o_orderkey"]).where("o_orderkey > 5")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint>" in text and "GreaterThan(o_orderkey,5)" in text


def test_schema_tables_and_catalog(spark, data):
    rt.create_schema(spark, "fraud_check")
    names = {r["table_name"] for r in rt.list_tables(spark, "fraud_check").collect()}
    assert names == set(rt.TABLE_COLUMNS)
    for table in rt.TABLE_COLUMNS:
        assert [f.dataType for f in spark.table(f"fraud_check.{table}").schema] == [f.dataType for f in rt.table_schema(table)]
    fact = rt.table_schema("fact_scored_transactions")
    assert (fact["amount"].dataType.simpleString(), fact["amount"].nullable) == ("decimal(20,2)", False)
    assert rt.key_column("investigator_alert_queue") == "investigation_rank"
    frame = spark.createDataFrame([("a", "b", 0.5)], "Threshold_Type string, Source string, Score_Threshold double")
    small = rt.small_table(frame, "risk_tier_thresholds")
    for _ in range(2):
        stored = writers.reload_tables({"risk_tier_thresholds": small}, "fraud_check")
    assert stored["risk_tier_thresholds"].collect() == small.collect()


def test_csv_summary_is_one_file(spark, tmp_path):
    writers.write_summary_csv(spark.createDataFrame([("a", None), ("b", 2)], "k string, v int").repartition(3), str(tmp_path / "s"))
    parts = list((tmp_path / "s").glob("part-*.csv"))
    assert len(parts) == 1 and parts[0].read_text().splitlines()[0] == "k,v"


def test_overwrite_replaces(spark, tmp_path):
    path = str(tmp_path / "stage")
    writers.write_parquet(spark.range(10), path)
    assert writers.write_parquet(spark.range(3), path).count() == 3


def test_feature_register(spark):
    assert feature_register(spark).count() == 34


def test_csv_order_over_several_files(spark, tmp_path):
    """Ids, sample and line count follow file names, however large the files are."""
    path = tmp_path / "csv"
    path.mkdir()
    line = "{},PAYMENT,1.0,C1,0.0,0.0,M1,0.0,0.0,0,0\n"
    head = ",".join(S.SOURCE_COLUMNS) + "\n"
    for name, steps in [("a", range(1, 4)), ("b", range(4, 60)), ("c", range(60, 64))]:
        (path / f"{name}.csv").write_text(head + "".join(line.format(s) for s in steps))
    (path / "d.csv").write_text("")
    source = str(path)
    assert [r["step"] for r in src.read_csv_sample(spark, source, 5).orderBy("step").collect()] == [1, 2, 3, 4, 5]
    assert src.line_count(spark, source).first()[0] == 63
    landed = src.land_csv(spark, source, str(tmp_path / "raw"))
    ids = src.with_transaction_id(landed.select("*", "_metadata")).orderBy("transaction_id").collect()
    assert [(r["transaction_id"], r["step"]) for r in ids] == [(s, s) for s in range(1, 64)]


def test_shared_folder_is_asked_for_on_a_cluster(monkeypatch):
    class Context:
        master = "yarn"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_split_contract_raises(spark):
    recorded = spark.createDataFrame([("TRAIN", 3), ("TEST", 2)], "Split string, Rows long")
    contracts.require_split_contract(contracts.split_contract(recorded, recorded))
    other = spark.createDataFrame([("TRAIN", 4)], "Split string, Rows long")
    with pytest.raises(contracts.ContractError, match="TEST: 0 rows, 2 recorded"):
        contracts.require_split_contract(contracts.split_contract(other, recorded).orderBy("Split"))


def test_views_cover_every_table(spark, data):
    from tallywatch.plans import frames as fr

    made = views.create_views(spark, {"fact_scored_transactions": fr.fact(spark, data)})
    assert len(made) == 6 and len(views.VIEWS) == 10
    assert spark.sql("SELECT SUM(transaction_count) FROM vw_confusion_matrix").first()[0] == fr.fact(spark, data).count()
    assert "vw_daily_fraud_trend" in {r["table_name"] for r in rt.list_tables(spark).collect()}


def test_defective_rows_do_have_defects(spark, data):
    bad = mapped.defective(spark, data)
    assert bad.where("amount < 0").count() > 0 and bad.where("isnan(amount)").count() > 0
    assert bad.count() > mapped.transactions(spark, data).count()


def _csv(folder, files):
    folder.mkdir()
    for name, lines in files.items():
        (folder / name).write_text("\n".join([",".join(S.SOURCE_COLUMNS), *lines]) + "\n")
    return str(folder)


def _line(i, amount="5.5"):
    return f"{1 + i % 743},TRANSFER,{amount},C{i},1.0,2.0,M{i},3.0,4.0,0,0"


def test_bad_rows_are_split_off_or_raise(spark, tmp_path):
    bad = [_line(1) + ",more", "2,TRANSFER,5", _line(3, "five")]
    path = _csv(tmp_path / "in", {"b.csv": [_line(4), *bad, _line(5)], "a.csv": [_line(0), _line(6, "")]})
    good, rest = src.split_rows(spark, path)
    assert sorted(r["nameOrig"] for r in good.collect()) == ["C0", "C4", "C5", "C6"] and good.schema == S.TRANSACTIONS
    assert sorted(r["line"] for r in rest.collect()) == sorted(bad) and all(r["file"].endswith("b.csv") for r in rest.collect())
    with pytest.raises(src.BadRows):
        src.land_csv(spark, path, str(tmp_path / "raw"))
    landed = src.land_csv(spark, path, str(tmp_path / "raw"), str(tmp_path / "rejected"))
    ids = src.with_transaction_id(landed.select("*", "_metadata")).orderBy("transaction_id").collect()
    assert [r["nameOrig"] for r in ids] == ["C0", "C6", "C4", "C5"]
    assert spark.read.parquet(str(tmp_path / "rejected")).count() == 3


def test_sample_opens_only_the_files_it_needs(spark, tmp_path):
    path = _csv(tmp_path / "in", {f"f{k}.csv": [_line(100 * k + i) for i in range(10)] for k in range(4)})
    (tmp_path / "in" / "f3.csv").chmod(0)
    got = [r["nameOrig"] for r in src.read_csv_sample(spark, path, 15).collect()]
    assert got == [f"C{i}" for i in range(10)] + [f"C{100 + i}" for i in range(5)]
    (tmp_path / "in" / "f3.csv").chmod(0o644)
    assert src.read_csv_sample(spark, path).count() == 40


def test_csv_sample_query_takes_the_first_transactions(spark, duck, data, monkeypatch):
    """The raw file stands in order of the id, so a sample shorter than the file holds the rows that the SQL takes."""
    monkeypatch.setattr(src.read_csv_sample, "__defaults__", (200, None))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables: rows come out by customer
    try:
        got = catalog.QUERIES["src_csv_sample"](spark, data)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = duck.sql(oracle.build()["src_csv_sample"].replace("LIMIT 100000", "LIMIT 200"))
    names = [c.lower() for c in got.columns]
    at = [[c.lower() for c in want.columns].index(n) for n in names]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


@pytest.fixture(scope="module")
def report(spark, data):
    from tallywatch.plans import frames as fr

    return {n: df.cache() for n, df in fr.report_frames(spark, data).items()}


def test_failed_load_leaves_the_old_tables(spark, report, tmp_path):
    from tallywatch.sinks.generations import Generations

    loads = Generations(spark, str(tmp_path / "reporting"))
    with pytest.raises(LookupError):
        loads.tables(list(report))
    loads.load(report, contracts.require_constraints)
    counts = {r["table_name"]: r["row_count"] for r in contracts.row_counts(loads.tables(list(report))).collect()}
    broken = report | {"model_comparison": report["model_comparison"].selectExpr("*", "1 AS x").drop("model")}
    with pytest.raises(Exception):  # a table that cannot be written, after others were
        loads.load(broken)
    twice = report | {"risk_tier_summary": report["risk_tier_summary"].unionByName(report["risk_tier_summary"])}
    with pytest.raises(contracts.ContractError, match="unique:risk_tier"):
        loads.load(twice, contracts.require_constraints)
    assert loads.published() == 1 and loads.written() == [1, 2, 3]
    again = {r["table_name"]: r["row_count"] for r in contracts.row_counts(loads.tables(list(report))).collect()}
    assert again == counts
    loads.load(report)
    loads.load(report)
    assert loads.published() == 5 and loads.written() == [4, 5]


def test_fact_layout_prunes_and_replaces_days(spark, report, tmp_path):
    table, path = "fact_scored_transactions", str(tmp_path / "fact")
    fact = writers.write_table(report[table], table, path)
    days = sorted(r[0] for r in fact.select("transaction_day").distinct().collect())
    plan = fact.where(f"transaction_day = {days[0]} AND hgb_fraud_score > 0.9")._jdf.queryExecution().executedPlan().toString()
    assert f"(transaction_day#" in plan and "PartitionFilters: [isnotnull(transaction_day" in plan and "GreaterThan(hgb_fraud_score,0.9)" in plan
    one = fact.where(f"transaction_day = {days[0]}").limit(1).cache()
    one.count()
    new = writers.write_table(one, table, path, days_only=True)
    assert new.where(f"transaction_day = {days[0]}").count() == 1
    assert new.where(f"transaction_day <> {days[0]}").count() == report[table].where(f"transaction_day <> {days[0]}").count()
    import pyarrow.parquet as pq

    queue = writers.write_table(report["investigator_alert_queue"], "investigator_alert_queue", str(tmp_path / "queue"))
    spans = []
    for file in (tmp_path / "queue").glob("part-*.parquet"):
        stats = pq.ParquetFile(file).metadata.row_group(0).column(0).statistics
        spans.append((stats.min, stats.max))
    spans.sort()
    assert queue.count() and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))  # ranks of files do not overlap


@pytest.mark.parametrize(
    "changes, rules",
    [
        (
            {
                "fact_scored_transactions": ["CAST(3 AS SMALLINT) AS actual_fraud", "'None' AS risk_tier", "CAST(NULL AS STRING) AS origin_account", "1L AS transaction_id"],
                "investigator_alert_queue": ["investigation_rank + 1 AS investigation_rank"],
                "risk_tier_summary": ["transaction_count + 1 AS transaction_count"],
                "risk_tier_thresholds": ["CAST(NULL AS DOUBLE) AS score_threshold"],
            },
            {"flag:actual_fraud", "domain:risk_tier", "not_null:origin_account", "unique:transaction_id", "gapless:investigation_rank",
             "counts:transaction_count", "not_null:score_threshold"},
        ),
        (
            {"fact_scored_transactions": ["CAST(1 AS SMALLINT) AS operational_alert"], "investigator_alert_queue": ["hgb_fraud_score / 2 AS hgb_fraud_score"]},
            {"in_queue:alerts", "agrees:score_and_tier"},
        ),
        ({"fact_scored_transactions": ["CAST(0 AS SMALLINT) AS operational_alert"]}, {"in_fact:transaction_id"}),
        ({}, set()),
    ],
)
def test_each_rule_over_the_tables_fails(report, changes, rules):
    tables = {}
    for table in ("fact_scored_transactions", "investigator_alert_queue", "risk_tier_summary", "risk_tier_thresholds"):
        new = {c.rpartition(" AS ")[2]: c for c in changes.get(table, [])}
        tables[table] = report[table].selectExpr(*[new.get(c, c) for c in report[table].columns])
    found = {r["constraint_name"] for r in contracts.table_constraints(tables).where("violations > 0").collect()}
    assert rules <= found and (rules or not found)


def test_a_lost_part_file_shows(spark, data, tmp_path):
    from tallywatch.operators import explore
    from tallywatch.operators.features import model_population
    from tallywatch.plans import frames as fr

    rows = fr.master(spark, data)
    master, counted = writers.write_observed(rows.repartition(4), str(tmp_path / "master"), explore.MASTER_MEASURES)
    model, modelled = writers.write_observed(model_population(master), str(tmp_path / "model"), explore.MODEL_MEASURES)
    source = {"source_rows": counted["rows"], "source_fraud": counted["fraud"]}
    read = lambda: {r["Metric"]: r["Value"] for r in explore.dataset_validation(source | counted | modelled, spark.read.parquet(str(tmp_path / "master")), model).collect()}
    whole = read()
    assert len(whole) == 16 and whole["Rows lost during processing"] == 0 and whole["Master file size (MB)"] > 0
    lost = next((tmp_path / "master").glob("part-*.parquet"))
    lost.rename(tmp_path / "lost.parquet")
    after = read()
    assert after["Rows lost during processing"] > 0 and after["Master analytical rows"] == whole["Master analytical rows"]
