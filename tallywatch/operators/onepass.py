"""One-row summaries, alone or many over a single scan.

Most reports are one global aggregate reshaped to rows. An operator declares the
two parts as a ``Summary``; ``one_row`` makes it callable on a frame. Where
several are wanted from the same large table, ``one_pass`` computes all their
measures in one aggregate, keeps that single row, and reshapes each from it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from typing import NamedTuple

from pyspark.sql import DataFrame

from tallywatch.session import materialise


class Summary(NamedTuple):
    #: Aggregate expressions by name.
    measures: dict[str, str]
    #: From the one row of measures to the report.
    shape: Callable[[DataFrame], DataFrame]


def one_row(build: Callable[..., Summary]) -> Callable[..., DataFrame]:
    """Turn a summary builder into an operator; the builder stays as ``.summary``."""

    @wraps(build)
    def operator(df: DataFrame, *args, **kwargs) -> DataFrame:
        summary = build(df, *args, **kwargs)
        return summary.shape(df.selectExpr(*[f"{e} AS {n}" for n, e in summary.measures.items()]))

    operator.summary = build
    return operator


def one_pass(df: DataFrame, summaries: dict[str, Summary]) -> dict[str, DataFrame]:
    """All the summaries from one scan and one aggregate."""
    expressions = [
        f"{e} AS {key}__{n}" for key, s in summaries.items() for n, e in s.measures.items()
    ]
    row = materialise(df.selectExpr(*expressions))
    return {
        key: s.shape(row.selectExpr(*[f"{key}__{n} AS {n}" for n in s.measures]))
        for key, s in summaries.items()
    }
