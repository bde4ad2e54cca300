"""The whole way from raw bars to clean ones: check, clean, check again, gate, reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidemark.operators import quality
from tidemark.operators.clean import OHLCV, Recipe, clean
from tidemark.plans.series import BARS, Axis
from tidemark.session import stage


@dataclass(frozen=True)
class Processed:
    """``passed``: clean rows of the series that pass the gate; ``cleaned``: of all; ``flow``: a row for each series, before and
    after; ``summary``: one row; ``issues``: of the clean rows; ``failing``: the series that don't pass."""

    passed: DataFrame
    cleaned: DataFrame
    flow: DataFrame
    summary: DataFrame
    issues: DataFrame
    failing: DataFrame


def process(bars: DataFrame, mode: str | Recipe = "standard", threshold: str = "warning", axis: Axis = BARS) -> Processed:
    """All series at once; raw and clean rows are written once and read by the checks.

    The staged tables go with ``session.scratch``: write the results before leaving it.
    """
    raw = stage(bars.select(*axis.id, *OHLCV), "raw")
    cleaned = stage(clean(raw, mode, axis), "cleaned")
    flow = stage(quality.flow_report(raw, cleaned, axis), "flow")
    report = flow.withColumnRenamed("final_status", "status")
    return Processed(
        passed=quality.quality_gate(cleaned, report.filter("status is not null"), threshold, axis),
        cleaned=cleaned,
        flow=flow,
        summary=quality.batch_summary(flow, threshold),
        issues=quality.all_issues(cleaned, axis),
        failing=quality.failing_symbols(flow, threshold),
    )
