"""Scores of a grouping against expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores


def group_metrics(group_files: DataFrame, infrastructure: DataFrame, total: int | None = None) -> DataFrame:
    """One row of counts and ratios of a grouping.

    `group_files` is (group_id, path), `infrastructure` (path). `total` is the
    number of changed files, by default the distinct files met.
    """
    sizes = group_files.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    per_group = sizes.agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("grouped_files"),
        F.count_if(F.col("n") == 1).alias("singletons"),
        F.coalesce(F.max("n"), F.lit(0)).alias("largest"),
        F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean_size"),
    )
    every = group_files.select("path", F.lit(0).alias("infra")).unionByName(infrastructure.select("path", F.lit(1).alias("infra")))
    per_file = every.groupBy("path").agg(F.count(F.lit(1)).alias("times"), F.max("infra").alias("infra"))
    files = per_file.agg(F.count(F.lit(1)).alias("accounted_files"), F.coalesce(F.sum(F.col("times") - 1), F.lit(0)).alias("duplicates"), F.coalesce(F.sum("infra"), F.lit(0)).cast("bigint").alias("infra_files"))
    whole = F.col("accounted_files") if total is None else F.lit(total)
    return per_group.join(files).select(
        "groups", "grouped_files", "singletons", "largest", "mean_size", "accounted_files", "duplicates", "infra_files",
        scores.ratio(F.col("infra_files"), whole).alias("infra_ratio"),
        scores.ratio(F.col("singletons"), F.col("groups")).alias("singleton_ratio"),
        scores.ratio(F.col("largest"), whole).alias("largest_ratio"),
        scores.ratio(F.col("accounted_files"), whole).alias("accounted_ratio"),
    )


def coherence(expected: DataFrame, group_files: DataFrame, infrastructure: DataFrame) -> DataFrame:
    """(score): how well expected groups are found together.

    `expected` is (expected_id, must_contain, must_not_contain), arrays of
    path pieces. Each expected group takes its best group: the share of pieces
    found there less half the share of forbidden ones, capped by the share
    that did not end in infrastructure; groups weigh by their pieces.
    """
    sizes = expected.select("expected_id", F.size("must_contain").alias("n_must"), F.size("must_not_contain").alias("n_not"))
    pieces = expected.select("expected_id", F.explode("must_contain").alias("piece"), F.lit(True).alias("must")).unionByName(expected.select("expected_id", F.explode("must_not_contain").alias("piece"), F.lit(False).alias("must")))
    # The expectations are a stated set of a few rows, compared with every file.
    hits = group_files.join(F.broadcast(pieces), F.col("path").contains(F.col("piece"))).select("expected_id", "group_id", "piece", "must").distinct()
    found = hits.groupBy("expected_id", "group_id").agg(F.count_if("must").alias("yes"), F.count_if(~F.col("must")).alias("no"))
    scored = found.join(sizes, "expected_id").withColumn("s", F.greatest(F.lit(0.0), scores.ratio(F.col("yes"), F.col("n_must")) - 0.5 * scores.ratio(F.col("no"), F.col("n_not"))))
    best = scored.groupBy("expected_id").agg(F.max("s").alias("best"))
    lost = infrastructure.join(F.broadcast(pieces.where("must")), F.col("path").contains(F.col("piece"))).select("expected_id", "piece").distinct().groupBy("expected_id").agg(F.count(F.lit(1)).alias("lost"))
    every = sizes.join(best, "expected_id", "left").join(lost, "expected_id", "left")
    kept = F.when(F.col("lost") > 0, F.least(F.coalesce("best", F.lit(0.0)), F.lit(1.0) - scores.ratio(F.col("lost"), F.col("n_must")))).otherwise(F.coalesce("best", F.lit(0.0)))
    weight = F.greatest(F.col("n_must"), F.lit(1))
    return every.agg(F.coalesce(F.try_divide(F.sum(kept * weight), F.sum(weight)), F.lit(1.0)).alias("score"))


def ordering(constraints: DataFrame, group_files: DataFrame, orders: DataFrame) -> DataFrame:
    """(score): share of (higher, lower) path pieces whose first groups are in that review order.

    A pair also counts where only the higher piece is found.
    """

    def first(piece: str, name: str) -> DataFrame:
        met = group_files.join(orders, "group_id").join(F.broadcast(constraints.select("constraint_id", piece)), F.col("path").contains(F.col(piece)))
        return met.groupBy("constraint_id").agg(F.min_by("review_order", "group_no").alias(name))

    met = constraints.join(first("higher", "h"), "constraint_id", "left").join(first("lower", "l"), "constraint_id", "left")
    good = F.col("h").isNotNull() & (F.col("l").isNull() | (F.col("h") <= F.col("l")))
    return met.agg(F.coalesce(F.try_divide(F.count_if(good), F.count(F.lit(1))), F.lit(1.0)).alias("score"))


def reasonableness(groups: DataFrame) -> DataFrame:
    """(score): 1 less a quarter for each risk out of range, order below 1 or empty group, and a tenth for equal orders."""
    bad = lambda c: F.count_if(c).cast("double")
    row = groups.agg(bad((F.col("risk") < 0) | (F.col("risk") > 1)).alias("a"), bad(F.col("review_order") < 1).alias("b"), bad(F.col("n_files") == 0).alias("c"), F.countDistinct("review_order").alias("d"), F.count(F.lit(1)).alias("n"))
    return row.select(F.greatest(F.lit(0.0), F.lit(1.0) - 0.25 * (F.col("a") + F.col("b") + F.col("c")) - F.when(F.col("d") != F.col("n"), 0.1).otherwise(0.0)).alias("score"))


def recall(expected: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """(score): share of expected rows that are found; 1 without expectations."""
    met = expected.select(*on).distinct().join(found.select(*on).distinct().withColumn("hit", F.lit(True)), on, "left")
    return met.agg(F.coalesce(F.try_divide(F.count_if(F.col("hit")), F.count(F.lit(1))), F.lit(1.0)).alias("score"))


def constraint_results(sets: DataFrame, locations: DataFrame) -> DataFrame:
    """(set_id, kind, satisfied): whether the files of each set share a place, or have places of their own.

    `sets` is (set_id, kind, path) with kind same or separate; `locations`
    (path, location). A place named infra is shared by nobody.
    """
    met = sets.join(locations, "path", "left")
    places = met.groupBy("set_id", "kind").agg(F.countDistinct("location").alias("d"), F.count("location").alias("n"), F.count(F.lit(1)).alias("m"), F.coalesce(F.bool_or(F.col("location") == "infra"), F.lit(False)).alias("infra"))
    same = (F.col("d") == 1) & (F.col("n") == F.col("m")) & ~F.col("infra")
    apart = (F.col("d") == F.col("m")) & (F.col("n") == F.col("m"))
    return places.select("set_id", "kind", F.when(F.col("kind") == "same", same).otherwise(apart).alias("satisfied"))


def judged(scores_by_criterion: DataFrame) -> DataFrame:
    """(target, mean): judge scores from 1 to 5 brought to 0 to 1."""
    return scores_by_criterion.groupBy("target").agg(F.avg((F.col("score") - 1) / 4.0).alias("mean"))


def repository_scores(metrics: DataFrame) -> DataFrame:
    """`metrics` with a score for each measure and their weighted sum `overall`.

    Reads groups, groups_per_1000, infra_ratio, singleton_ratio, accounted,
    golden_checks and golden, and the limits max_groups, max_groups_per_1000
    (null where there is none), max_infra_ratio and max_singleton_ratio.
    Without checks the golden score has no weight.
    """
    limited = F.col("max_groups_per_1000").isNotNull()
    made = metrics.select(
        *[F.col(c).alias(c) for c in metrics.columns if c not in ("infra_ratio", "singleton_ratio")],
        F.when(F.col("groups") <= F.col("max_groups"), 1.0).otherwise(scores.clamp(scores.ratio(F.col("max_groups"), F.col("groups")))).alias("group_count"),
        F.when(limited, scores.threshold_score(F.col("groups_per_1000"), F.col("max_groups_per_1000"))).alias("group_density"),
        scores.threshold_score(F.col("infra_ratio"), F.col("max_infra_ratio")).alias("infra_ratio"),
        scores.threshold_score(F.col("singleton_ratio"), F.col("max_singleton_ratio")).alias("singleton_ratio"),
        F.when(F.col("accounted"), 1.0).otherwise(0.0).alias("file_accounting"),
    )
    return made.withColumn("overall", scores.repository_overall(limited, F.col("golden_checks") > 0))


def entrypoint_accuracy(expected: DataFrame, detected: DataFrame) -> DataFrame:
    """One row with the share of `expected` (piece, type) that some detected entrypoint
    (file, type) has: the same type, and a file whose path holds the piece. 1 where nothing is expected."""
    wanted = expected.select(F.col("piece").alias("w_piece"), F.col("type").alias("w_type"), F.monotonically_increasing_id().alias("w"))
    known = detected.select("file", "type").distinct()
    met = wanted.join(known, (F.col("w_type") == F.col("type")) & F.col("file").contains(F.col("w_piece"))).select("w").distinct().agg(F.count(F.lit(1)).alias("met"))
    total = expected.agg(F.count(F.lit(1)).alias("total"))
    return total.join(met).select(F.when(F.col("total") == 0, 1.0).otherwise(scores.ratio(F.col("met"), F.col("total"))).alias("score"))
