"""Dataset validation, fraud exploration and model-population summaries.

Each summary is one pass with map-side partial aggregation down to a handful of
rows per task: flags and numeric features are measured side by side in one row
per group and turned into rows afterwards, instead of copying every input row
once per flag or feature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallywatch import schema as S
from tallywatch.functions.exprs import (
    amount_band, count_if, double, infinite, is_floating, is_one, listed, missing, non_finite,
    percent_or_zero, ratio, ratio_or_zero, stack, sum_if, text, to_long, to_rows, total,
)
from tallywatch.operators.filters import FRAUD, split_name
from tallywatch.operators.onepass import Summary, one_row
from tallywatch.operators.profile import missing_values
from tallywatch.session import materialise


_FRAUD_SUM = total("CAST(isFraud AS BIGINT)")
#: Counted while the source is read and while the tables are written.
SOURCE_MEASURES = {"source_rows": "COUNT(*)", "source_fraud": _FRAUD_SUM}
MASTER_MEASURES = {
    "rows": "COUNT(*)",
    "fraud": _FRAUD_SUM,
    "zero": count_if("zero_amount_flag = 1"),
    "zero_fraud": count_if(f"zero_amount_flag = 1 AND {FRAUD}"),
    "high": count_if("high_value_200k_flag = 1"),
}
MODEL_MEASURES = {"model_rows": "COUNT(*)", "model_fraud": _FRAUD_SUM}


def stored_megabytes(stored: DataFrame) -> DataFrame:
    """Size of the files of a written table, one row."""
    files = stored.select("_metadata.file_path", "_metadata.file_size").distinct()
    return files.selectExpr(f"COALESCE({double('SUM(file_size)')}, 0D) / 1048576D AS megabytes")


def dataset_validation(processed: dict, master_stored: DataFrame, model_stored: DataFrame) -> DataFrame:
    """Sixteen counts that must agree: what was processed against what is stored.

    ``processed`` holds the observed measures of source, master and model; rows
    stored are counted from the files, so a lost part file shows.
    """
    row = master_stored.sparkSession.range(1).selectExpr(*[f"{int(v or 0)}L AS {n}" for n, v in processed.items()])
    row = row.withColumns(
        {
            "master_stored": master_stored.selectExpr("COUNT(*)").scalar(),
            "model_stored": model_stored.selectExpr("COUNT(*)").scalar(),
            "master_mb": stored_megabytes(master_stored).scalar(),
            "model_mb": stored_megabytes(model_stored).scalar(),
        }
    )
    # Metric names of the validation report.
    return to_long(
        row,
        [
            ("Source rows processed", "source_rows"),
            ("Master analytical rows", "rows"),
            ("Master Parquet rows", "master_stored"),
            ("Rows lost during processing", "source_rows - master_stored"),
            ("Source fraud transactions", "source_fraud"),
            ("Master fraud transactions", "fraud"),
            ("Full dataset fraud rate (%)", percent_or_zero("fraud", "rows")),
            ("High-risk modelling rows", "model_rows"),
            ("High-risk Parquet rows", "model_stored"),
            ("High-risk modelling fraud", "model_fraud"),
            ("High-risk fraud rate (%)", percent_or_zero("model_fraud", "model_rows")),
            ("Zero-amount transactions", "zero"),
            ("Zero-amount fraud transactions", "zero_fraud"),
            ("Transactions above 200k", "high"),
            ("Master file size (MB)", "master_mb"),
            ("High-risk model file size (MB)", "model_mb"),
        ],
        "Metric",
        "Value",
    )


# Class labels.
CLASSES = {"Legitimate": 0, "Fraud": 1}


@one_row
def class_summary(df: DataFrame) -> Summary:
    """Fraud against legitimate; both classes always appear."""
    measures: dict[str, str] = {}
    for name, label in CLASSES.items():
        member = f"isFraud = {label}"
        measures |= {
            f"{name}__n": count_if(member),
            f"{name}__value": sum_if(member, "amount"),
            f"{name}__min": f"MIN(amount) FILTER (WHERE {member})",
            f"{name}__max": f"MAX(amount) FILTER (WHERE {member})",
            f"{name}__origin": sum_if(member, "oldbalanceOrg"),
            f"{name}__dest": sum_if(member, "oldbalanceDest"),
        }
    fields = {
        "Transaction_Count": "{}__n",
        "Transaction_Value": double("{}__value"),
        "Average_Amount": ratio("{}__value", "{}__n"),
        "Minimum_Amount": double("{}__min"),
        "Maximum_Amount": double("{}__max"),
        "Average_Origin_Balance_Before": ratio("{}__origin", "{}__n"),
        "Average_Destination_Balance_Before": ratio("{}__dest", "{}__n"),
    }
    return Summary(measures, lambda row: to_rows(row, CLASSES, "Class", fields))


#: Measures of a group, from rows and from an already grouped frame.
_FROM_ROWS = {
    "n": "COUNT(*)",
    "value": total("amount"),
    "fraud": count_if(FRAUD),
    "fraud_value": sum_if(FRAUD, "amount"),
}
_FROM_GROUPS = {name: f"SUM({name})" for name in _FROM_ROWS}


def _measured(df: DataFrame, groups: list[str]) -> DataFrame:
    source = _FROM_GROUPS if set(_FROM_ROWS) <= set(df.columns) else _FROM_ROWS
    return df.groupBy(*[F.expr(g) for g in groups]).agg(*[F.expr(f"{e} AS {n}") for n, e in source.items()])


def group_table(master: DataFrame) -> DataFrame:
    """Counts and values per type, day, hour and amount band, in one scan.

    A few thousand rows per month of data whatever the number of transactions.
    The type, hourly, daily and band summaries accept it in place of the master
    table, so that together they scan the master table once.
    """
    keys = ["type", "transaction_day", "hour_of_day", f"{amount_band('amount')} AS amount_band"]
    return materialise(_measured(master, keys))


def by_group(df: DataFrame, group: str, name: str) -> DataFrame:
    """Count, value, fraud and fraud rate per group; null forms its own group."""
    return _measured(df, [f"{group} AS {name}"]).selectExpr(
        name,
        "n AS Transaction_Count",
        f"{double('value')} AS Transaction_Value",
        "fraud AS Fraud_Count",
        f"{double('fraud_value')} AS Fraud_Value",
        f"{percent_or_zero('fraud', 'n')} AS Fraud_Rate_Pct",
    )


def by_column(df: DataFrame, column: str, name: str) -> DataFrame:
    """The same per value of a column; null rows are left out."""
    return by_group(df.where(f"{column} IS NOT NULL"), column, name)


def type_summary(df: DataFrame) -> DataFrame:
    return by_column(df, "type", "Transaction_Type").selectExpr(
        "Transaction_Type",
        "Transaction_Count",
        "Transaction_Value",
        f"{ratio_or_zero('Transaction_Value', 'Transaction_Count')} AS Average_Transaction_Amount",
        "Fraud_Count",
        "Fraud_Value",
        f"{ratio_or_zero('Fraud_Value', 'Fraud_Count')} AS Average_Fraud_Amount",
        "Fraud_Rate_Pct",
        f"{percent_or_zero('Fraud_Value', 'Transaction_Value')} AS Fraud_Value_Share_Pct",
    )


def hourly_summary(df: DataFrame) -> DataFrame:
    return by_column(df, "hour_of_day", "Hour_of_Day").orderBy("Hour_of_Day")


def daily_summary(df: DataFrame) -> DataFrame:
    return by_column(df, "transaction_day", "Transaction_Day").orderBy("Transaction_Day")


def high_risk_type_summary(model: DataFrame) -> DataFrame:
    return by_column(model, "type", "Transaction_Type").orderBy("Transaction_Type")


def dense(df: DataFrame, values: list[str], key: str) -> DataFrame:
    """Every listed value in list order, missing rows as nulls.

    ``df`` is grouped by a key made by a CASE over the same list, so the
    broadcast side has a row per listed value, and one more for null, at most.
    """
    rows = [[str(i), text(v)] for i, v in enumerate(values, start=1)]
    every = listed(df, rows, ["position", key])
    return every.join(F.broadcast(df), key, "left").orderBy("position")


def amount_band_summary(df: DataFrame) -> DataFrame:
    """All nine bands in order, empty ones as zero; rows without a band find no
    partner in the list of bands."""
    band = "amount_band" if "amount_band" in df.columns else amount_band("amount")
    observed = by_group(df, band, "Amount_Bucket")
    return dense(observed, [label for label, _ in S.AMOUNT_BANDS], "Amount_Bucket").selectExpr(
        "Amount_Bucket",
        "COALESCE(Transaction_Count, 0) AS Transaction_Count",
        "COALESCE(Transaction_Value, 0D) AS Transaction_Value",
        "COALESCE(Fraud_Count, 0) AS Fraud_Count",
        "COALESCE(Fraud_Value, 0D) AS Fraud_Value",
        "COALESCE(Fraud_Rate_Pct, 0D) AS Fraud_Rate_Pct",
    )


@one_row
def flag_lift(
    df: DataFrame, flags: list[str] = S.RISK_FLAGS, key: str = "Risk_Flag", when: str = "When_"
) -> Summary:
    """Fraud rate with and without each flag, and their ratio (null over zero)."""
    measures = {"rows": "COUNT(*)", "frauds": count_if(FRAUD)}
    for name in flags:
        measures |= {
            f"{name}__n": count_if(is_one(name)),
            f"{name}__f": count_if(f"{is_one(name)} AND {FRAUD}"),
        }
    with_flag = percent_or_zero("{}__f", "{}__n")
    without = percent_or_zero("frauds - {}__f", "rows - {}__n")
    fields = {
        "Flag_True_Count": "{}__n",
        "Fraud_When_True": "{}__f",
        f"Fraud_Rate_{when}True_Pct": with_flag,
        "Flag_False_Count": "rows - {}__n",
        "Fraud_When_False": "frauds - {}__f",
        f"Fraud_Rate_{when}False_Pct": without,
        "Fraud_Rate_Lift": f"{with_flag} / NULLIF({without}, 0D)",
    }
    return Summary(measures, lambda row: to_rows(row, flags, key, fields))


def binary_flag_lift(model: DataFrame) -> DataFrame:
    return flag_lift(model, key="Feature", when="")


def defined_lift(lift: DataFrame) -> DataFrame:
    """Flags with a defined lift, highest first."""
    return lift.where("Fraud_Rate_Lift IS NOT NULL").orderBy(F.desc("Fraud_Rate_Lift"))


# ---- model population ------------------------------------------------------
@one_row
def population_summary(model: DataFrame, stored_rows: int | None = None) -> Summary:
    """``stored_rows``: rows of the stored table by its files, counted apart from the rows processed."""
    stored = model.count() if stored_rows is None else stored_rows
    measures = {
        "rows": "COUNT(*)",
        "fraud": total("CAST(isFraud AS BIGINT)"),
        "first_step": "MIN(step)",
        "last_step": "MAX(step)",
    }
    metrics = [
        ("Parquet rows", f"{stored}L"),
        ("Rows processed", "rows"),
        ("Total fraud", "fraud"),
        ("Legitimate transactions", "rows - fraud"),
        ("Fraud rate (%)", percent_or_zero("fraud", "rows")),
        ("Minimum step", "first_step"),
        ("Maximum step", "last_step"),
    ]
    return Summary(measures, lambda row: to_long(row, metrics, "Metric", "Value"))


def feature_missing(model: DataFrame) -> DataFrame:
    return missing_values(model, S.MODEL_COLUMNS, "Feature", "Missing_Pct")


@one_row
def feature_infinite(model: DataFrame) -> Summary:
    measures = {f"{c}__n": count_if(infinite(c)) for c in S.NUMERIC_FEATURES}
    fields = {"Infinite_Count": "{}__n"}
    return Summary(measures, lambda row: to_rows(row, S.NUMERIC_FEATURES, "Feature", fields))


def numeric_by_class(model: DataFrame) -> DataFrame:
    """Valid and missing counts, mean and range of each feature per class."""
    measures: list[str] = []
    for name in S.NUMERIC_FEATURES:
        value = f"CASE WHEN NOT {non_finite(name)} THEN {name} END" if is_floating(model, name) else name
        measures += [
            f"COUNT({value}) AS {name}__n",
            f"{count_if(missing(model, name))} AS {name}__missing",
            f"SUM({value}) AS {name}__sum",
            f"MIN({value}) AS {name}__min",
            f"MAX({value}) AS {name}__max",
        ]
    by_class = model.where("isFraud IN (0, 1)").groupBy(
        F.expr("CASE isFraud WHEN 1 THEN 'Fraud' ELSE 'Legitimate' END AS Class")
    )
    wide = dense(by_class.agg(*[F.expr(m) for m in measures]), list(CLASSES), "Class")
    return to_rows(
        wide,
        S.NUMERIC_FEATURES,
        "Feature",
        {
            "Valid_Count": "COALESCE({}__n, 0)",
            "Missing_Count": "COALESCE({}__missing, 0)",
            "Mean": ratio("{}__sum", "{}__n"),
            "Minimum": double("{}__min"),
            "Maximum": double("{}__max"),
        },
        keep=["Class"],
    )


@one_row
def fixed_split_summary(model: DataFrame, train_end: int = 520, validation_end: int = 594) -> Summary:
    """Rows, share and fraud per split for fixed boundaries, all three dense."""
    ranges = {
        "TRAIN": f"{S.FIRST_STEP}-{train_end}",
        "VALIDATION": f"{train_end + 1}-{validation_end}",
        "TEST": f"{validation_end + 1}-{S.LAST_STEP}",
    }
    split = split_name(train_end, validation_end)
    measures = {"rows": "COUNT(*)"}
    for name in ranges:
        member = f"{split} = {text(name)}"
        measures |= {
            f"{name}__n": count_if(member),
            f"{name}__f": count_if(f"{member} AND {FRAUD}"),
        }
    fields = {
        "Step_Range": "CASE '{}' " + " ".join(f"WHEN {text(n)} THEN {text(v)}" for n, v in ranges.items()) + " END",
        "Rows": "{}__n",
        "Population_Pct": percent_or_zero("{}__n", "rows"),
        "Fraud_Count": "{}__f",
        "Fraud_Rate_Pct": percent_or_zero("{}__f", "{}__n"),
    }
    return Summary(measures, lambda row: to_rows(row, ranges, "Split", fields))


def feature_variation(model: DataFrame) -> DataFrame:
    """Distinct values and their counts as text, for type and the flags.

    The joint counts of the seven low-cardinality columns come first: one pass,
    a few hundred rows at most. Only those are turned to rows and summed.
    """
    features = ["type"] + S.RISK_FLAGS
    joint = model.groupBy(*features).agg(F.expr("COUNT(*) AS n"))
    rows = [[text(c), f"COALESCE(CAST({c} AS STRING), 'nan')"] for c in features]
    values = joint.selectExpr("n", stack(rows, ["Feature", "value"]))
    counted = values.groupBy("Feature", "value").agg(F.expr("SUM(n) AS n"))
    entries = "sort_array(collect_list(struct(value, concat(value, ': ', format_number(n, 0)) AS shown)))"
    return counted.groupBy("Feature").agg(
        F.expr("COUNT(*) AS Unique_Values"),
        F.expr(f"array_join(transform({entries}, e -> e.shown), '; ') AS Value_Distribution"),
    )
