"""Operations on groups: moves, splits, merges, new orders; manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, scores


def reclassified(group_files: DataFrame, moves: DataFrame) -> DataFrame:
    """`group_files` (group_id, path, ...) after `moves` (path, from_group, to_group); the last move of a file counts."""
    last = moves.groupBy("path", "from_group").agg(F.max_by("to_group", "pos").alias("to_group"))
    met = group_files.join(last.select(F.col("path").alias("m_path"), "from_group", "to_group"), (F.col("path") == F.col("m_path")) & (F.col("group_id") == F.col("from_group")), "left")
    return met.select(F.coalesce("to_group", "group_id").alias("group_id"), *[c for c in group_files.columns if c != "group_id"])


def split(group_files: DataFrame, parts: DataFrame) -> DataFrame:
    """Files of split groups under new ids; `parts` is (source_group, part, path), numbered over all splits.

    Files of a split group that no part names leave the grouping with it.
    """
    gone = parts.select(F.col("source_group").alias("group_id")).distinct()
    kept = group_files.join(gone, "group_id", "left_anti")
    numbered = parts.withColumn("new_id", F.concat(F.lit("group_refined_"), F.col("part").cast("string")))
    met = group_files.join(numbered.select(F.col("source_group").alias("group_id"), "path", "new_id"), ["group_id", "path"])
    return kept.unionByName(met.withColumn("group_id", F.col("new_id")).select(*group_files.columns))


def merged(group_files: DataFrame, merges: DataFrame) -> DataFrame:
    """Files of merged groups under the id of the first one; `merges` is (merge, pos, group_id)."""
    first = merges.groupBy("merge").agg(F.min_by("group_id", "pos").alias("into"))
    to = merges.join(first, "merge").select(F.col("group_id").alias("m_group"), "into")
    met = group_files.join(to, F.col("group_id") == F.col("m_group"), "left")
    return met.select(F.coalesce("into", "group_id").alias("group_id"), *[c for c in group_files.columns if c != "group_id"])


def reordered(groups: DataFrame, ranks: DataFrame) -> DataFrame:
    """Groups with the given review orders, renumbered from 1 by order, then id; (group_id, new_position) in `ranks`."""
    from .ranking import in_order

    met = groups.join(ranks.groupBy("group_id").agg(F.max_by("new_position", "pos").alias("new_position")), "group_id", "left")
    placed = met.withColumn("wanted", F.coalesce("new_position", "review_order")).drop("new_position", "review_order")
    return in_order(placed, [F.asc("wanted"), F.asc("group_id")], "review_order").drop("wanted")


def repaired(operations: DataFrame, groups: DataFrame) -> DataFrame:
    """`operations` whose `group_id` is no id but a group's name get that group's id; `repaired` tells which.

    Names are compared without case and extra spaces; of equal names the first group counts.
    """
    ids = groups.select(F.col("group_id").alias("known"))
    names = groups.groupBy(scores.normalized_name(F.col("name")).alias("n_name")).agg(F.min("group_id").alias("by_name"))
    met = operations.join(ids, F.col("group_id") == F.col("known"), "left").join(names, scores.normalized_name(F.col("group_id")) == F.col("n_name"), "left")
    fixed = F.col("known").isNull() & F.col("by_name").isNotNull()
    return met.select(F.when(fixed, F.col("by_name")).otherwise(F.col("group_id")).alias("group_id"), fixed.alias("repaired"), *[c for c in operations.columns if c != "group_id"])


def sanitized(operations: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Operations on known groups, and the others as warnings."""
    ids = groups.select("group_id").distinct()
    valid = operations.join(ids, "group_id", "left_semi")
    return valid, operations.join(ids, "group_id", "left_anti").select("group_id", F.lit("unknown group").alias("warning"))


def export_manifest(groups: DataFrame, group_files: DataFrame, every: DataFrame) -> DataFrame:
    """(name, review_order, files) by group, and last the files that no group has."""
    files = group_files.groupBy("group_id").agg(F.array_sort(F.collect_list("path")).alias("files"))
    named = groups.join(files, "group_id", "left").select("name", "review_order", F.coalesce("files", F.array().cast("array<string>")).alias("files"))
    rest = every.select("path").join(group_files.select("path"), "path", "left_anti").agg(F.array_sort(F.collect_list("path")).alias("files"))
    return named.unionByName(rest.select(F.lit("unassigned").alias("name"), F.lit(None).cast("int").alias("review_order"), "files"))


def import_manifest(manifest: DataFrame, analysed: DataFrame) -> DataFrame:
    """(name, path, role, additions, deletions, risk): manifest files with what the analysis knew.

    `manifest` is (name, path), `analysed` (path, role, additions, deletions,
    risk). Files that the analysis does not know get role Utility and no
    lines; a group's risk is the mean over its files, unknown ones counting 0.
    """
    met = manifest.join(analysed, "path", "left")
    mean = met.groupBy("name").agg((F.sum(F.coalesce("risk", F.lit(0.0))) / F.count(F.lit(1))).alias("group_risk"))
    return met.join(mean, "name").select("name", "path", F.coalesce("role", F.lit("Utility")).alias("role"), F.coalesce("additions", F.lit(0)).alias("additions"), F.coalesce("deletions", F.lit(0)).alias("deletions"), "group_risk")


def added(group_files: DataFrame, infrastructure: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Group files and (path, category) infrastructure after files move between them; `infrastructure` is a group id too."""
    every = group_files.select("group_id", "path").unionByName(infrastructure.select(F.lit("infrastructure").alias("group_id"), "path"))
    after = reclassified(every, moves)
    infra = after.where("group_id = 'infrastructure'").select("path", paths.category(F.col("path")).alias("category"))
    return after.where("group_id != 'infrastructure'"), infra
