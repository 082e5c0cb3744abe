"""Reports of evaluation runs and their history.

A run has a row for each fixture, a handful; the functions that format text
take such small DataFrames to the driver.
"""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores

COLUMNS = tuple(scores.CRITERIA)


def with_overall(results: DataFrame) -> DataFrame:
    """`results` (name, one column for each criterion) with the weighted overall score."""
    return results.withColumn("overall", scores.overall({c: F.col(c) for c in COLUMNS}))


def summary(results: DataFrame, least: float) -> DataFrame:
    """(avg_overall, passed, fixture_count) of a run."""
    mean = F.coalesce(F.avg("overall"), F.lit(0.0))
    return with_overall(results).agg(mean.alias("avg_overall"), (mean >= least).alias("passed"), F.count(F.lit(1)).alias("fixture_count"))


def history_row(results: DataFrame, least: float, timestamp: str) -> DataFrame:
    """One row for the history, with each fixture's score."""
    every = with_overall(results)
    fixtures = F.array_sort(F.collect_list(F.struct("name", "overall")))
    mean = F.coalesce(F.avg("overall"), F.lit(0.0))
    return every.agg(F.lit(timestamp).alias("timestamp"), mean.alias("avg_overall"), (mean >= least).alias("passed"), F.count(F.lit(1)).alias("fixture_count"), fixtures.alias("fixtures"))


def regression(history: DataFrame, now: float, threshold: float = 0.05) -> DataFrame:
    """(previous, drop) if the last row of the history is better by more than the threshold."""
    last = history.agg(F.max_by("avg_overall", "timestamp").alias("previous"))
    return last.select("previous", (F.col("previous") - now).alias("drop")).where(F.col("drop") > threshold)


def text_report(results: DataFrame, least: float) -> str:
    rows = with_overall(results).orderBy("name").collect()
    head = f"{'fixture':<28}" + "".join(f"{c[:12]:>14}" for c in (*COLUMNS, "overall"))
    lines = [head, "-" * len(head)]
    lines += [f"{r['name'][:27]:<28}" + "".join(f"{r[c]:>14.3f}" for c in (*COLUMNS, "overall")) for r in rows]
    mean = sum(r["overall"] for r in rows) / len(rows) if rows else 0.0
    return "\n".join([*lines, "-" * len(head), f"average {mean:.3f}, {'passed' if mean >= least else 'failed'} (least {least:.2f})"]) + "\n"


def html_report(results: DataFrame, history: DataFrame, least: float) -> str:
    """A page with a bar for each fixture and the history as a line."""
    rows = with_overall(results).orderBy("name").collect()
    past = [r["avg_overall"] for r in history.orderBy("timestamp").select("avg_overall").collect()][-100:]
    bars = "".join(
        f'<text x="0" y="{20 * i + 14}">{html.escape(r["name"])}</text><rect x="220" y="{20 * i + 3}" width="{300 * r["overall"]:.1f}" height="14" fill="{"#40a02b" if r["overall"] >= least else "#d20f39"}"/>'
        for i, r in enumerate(rows)
    )
    points = " ".join(f"{i * 10},{100 - 100 * v:.1f}" for i, v in enumerate(past))
    return (
        "<!DOCTYPE html><html><head><meta charset='utf-8'><title>Evaluation</title></head><body><h1>Evaluation</h1>"
        f"<svg width='560' height='{20 * len(rows) + 10}'>{bars}</svg><h2>History</h2><svg width='1010' height='110'><polyline fill='none' stroke='#1e66f5' points='{points}'/></svg></body></html>"
    )


def coverage_gaps(goldens: DataFrame, least: float) -> DataFrame:
    """(target, coverage): targets whose expectations mention too small a share of their files.

    `goldens` is (target, path, mentioned).
    """
    share = F.avg(F.when(F.col("mentioned"), 1.0).otherwise(0.0))
    return goldens.groupBy("target").agg(share.alias("coverage")).where(F.col("coverage") < least)
