"""Ranking of review groups and other order-sensitive operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, scores
from .graph import cut

PARTS = ("risk", "centrality", "surface_area", "uncertainty")


def in_order(df: DataFrame, by: list, name: str, within: list[str] | None = None) -> DataFrame:
    """`df` with 1-based positions in a total order.

    Without `within` the order spans the whole table. It is then made by a
    range partitioning, places inside partitions and the sizes of the
    partitions before, so that no task sees more than its range.
    """
    if within:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*by)))
    # Both uses of `placed` must see the same ranges.
    placed = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))  # a row for each partition
    out = placed.join(F.broadcast(before), part == F.col("__p"))
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn(name, (F.col("__before") + place + 1).cast("int")).drop("__at", "__p", "__before")


def rank_groups(groups: DataFrame, weights: dict[str, float] = scores.WEIGHTS) -> DataFrame:
    """(group_id, composite_score, review_order): by score from the top, then by id."""
    scored = groups.select("group_id", scores.composite_score({p: F.col(p) for p in PARTS}, weights).alias("composite_score"))
    return in_order(scored, [F.desc("composite_score"), F.asc("group_id")], "review_order")


def group_risk_flags(files: DataFrame) -> DataFrame:
    """Per group: schema, api and auth if any file shows them, test if all do."""
    flags = paths.risk_flags(F.col("path"))
    return files.groupBy("group_id").agg(
        F.coalesce(F.bool_or(flags["is_schema"]), F.lit(False)).alias("has_schema"),
        F.coalesce(F.bool_or(flags["is_api"]), F.lit(False)).alias("has_api"),
        F.coalesce(F.bool_or(flags["is_auth"]), F.lit(False)).alias("has_auth"),
        F.coalesce(F.bool_and(flags["is_test"]), F.lit(False)).alias("is_test_only"),
    )


def rank_inputs(files: DataFrame, centrality: float = 0.5, most_lines: int = scores.SURFACE_LINES) -> DataFrame:
    """Rank parts of each group of `files` (group_id, path, additions, deletions).

    Uncertainty is 0.3 for test-only groups and 0.5 for others.
    """
    flags = group_risk_flags(files)
    size = files.groupBy("group_id").agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    return flags.join(size, "group_id").select(
        "group_id",
        scores.risk_score(F.col("has_schema"), F.col("has_api"), F.col("has_auth"), F.lit(False)).alias("risk"),
        F.lit(centrality).alias("centrality"),
        scores.surface_area(F.col("additions"), F.col("deletions"), most_lines).alias("surface_area"),
        F.when(F.col("is_test_only"), 0.3).otherwise(0.5).alias("uncertainty"),
    )


def first_detections(found: DataFrame) -> DataFrame:
    """Of the detections of one (file, symbol) that of the first detector, sorted by both."""
    order = F.struct("detector", "pos")
    return found.groupBy("file", "symbol").agg(F.min_by("entrypoint_type", order).alias("entrypoint_type"))


def regressions(history: DataFrame, key: str, order: str, value: str, threshold: float = 0.05) -> DataFrame:
    """Rows whose value falls from the one before by more than the threshold."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return history.withColumn("previous", before).where(F.col("previous") - F.col(value) > threshold)


def evict_oldest(entries: DataFrame, limit: int, key: list[str], modified: str = "modified", size: str = "size") -> DataFrame:
    """Entries that stay in each cache: the newest whose sizes add up to the limit at most."""
    newest = Window.partitionBy(*key).orderBy(F.desc(modified), F.desc("entry")).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("total", F.sum(size).over(newest)).where(F.col("total") <= limit)
