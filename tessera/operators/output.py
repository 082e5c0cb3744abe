"""Documents and diagrams of an analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

# Edge labels of diagrams.
EDGE_LABELS = {"Imports": "imports", "Calls": "calls", "Extends": "extends", "Instantiates": "new", "Reads": "reads", "Writes": "writes", "Emits": "emits", "Handles": "handles"}


def edge_label(edge_type: Column) -> Column:
    return paths.lookup(edge_type, EDGE_LABELS)


def file_edges(edges: DataFrame) -> DataFrame:
    """(group_id, from_file, to_file, types): symbol edges between files with their distinct types."""
    ends = edges.select("group_id", F.substring_index("src", "::", 1).alias("from_file"), F.substring_index("dst", "::", 1).alias("to_file"), "edge_type").where("from_file != to_file")
    return ends.groupBy("group_id", "from_file", "to_file").agg(F.array_sort(F.collect_set("edge_type")).alias("types"))


def mermaid(group_files: DataFrame, edges: DataFrame) -> DataFrame:
    """(group_id, diagram): a top-down graph of each group's files.

    `group_files` is (group_id, path, flow_position), `edges` (group_id, pos,
    src, dst, edge_type). Between two files the first edge gives the label.
    """
    nodes = group_files.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("flow_position", "path"))).alias("f"))
    nodes = nodes.withColumn("lines", F.transform("f", lambda x, i: F.concat(F.lit("    "), paths.node_label(i), F.lit('["'), paths.short_label(x["path"]), F.lit('"]'))))
    place = group_files.join(nodes.select("group_id", F.posexplode("f").alias("i", "x")).select("group_id", "i", F.col("x.path").alias("path")), ["group_id", "path"])
    ends = edges.select("group_id", "pos", F.substring_index("src", "::", 1).alias("a"), F.substring_index("dst", "::", 1).alias("b"), "edge_type").where("a != b")
    first = ends.groupBy("group_id", "a", "b").agg(F.min(F.struct("pos", "edge_type")).alias("e"))
    at = place.select("group_id", F.col("path").alias("a"), F.col("i").alias("ia")), place.select("group_id", F.col("path").alias("b"), F.col("i").alias("ib"))
    drawn = first.join(at[0], ["group_id", "a"]).join(at[1], ["group_id", "b"])
    line = F.concat(F.lit("    "), paths.node_label(F.col("ia")), F.lit(" -->|"), edge_label(F.col("e.edge_type")), F.lit("| "), paths.node_label(F.col("ib")))
    links = drawn.select("group_id", F.struct(F.col("e.pos").alias("pos"), line.alias("line")).alias("l")).groupBy("group_id").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    links = links.select("group_id", F.transform("ls", lambda x: x["line"]).alias("arrows"))
    every = F.concat(F.array(F.lit("graph TD")), F.col("lines"), F.coalesce("arrows", F.array().cast("array<string>")))
    return nodes.join(links, "group_id", "left").select("group_id", F.array_join(every, "\n").alias("diagram"))


def as_json(df: DataFrame, name: str = "json", pretty: bool = False) -> DataFrame:
    """One JSON text for each row; nulls are written."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": str(pretty).lower()}).alias(name))


def analysis_document(groups: DataFrame, group_files: DataFrame, infrastructure: DataFrame, languages: DataFrame, frameworks: DataFrame) -> DataFrame:
    """(json): the whole analysis as one nested document.

    Only here are the tables nested; a change set's document is one value by
    its nature.
    """
    files = group_files.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("flow_position", "path", "role", "additions", "deletions"))).alias("files"))
    nested = groups.join(files, "group_id", "left").agg(F.array_sort(F.collect_list(F.struct("review_order", "group_id", "name", "risk_score", "files"))).alias("groups"))
    infra = infrastructure.agg(F.array_sort(F.collect_list("path")).alias("infrastructure"))
    spoken = languages.agg(F.array_sort(F.collect_set("language")).alias("languages"))
    used = frameworks.agg(F.array_sort(F.collect_set("framework")).alias("frameworks"))
    total = F.aggregate("groups", F.lit(0), lambda s, g: s + F.coalesce(F.size(g["files"]), F.lit(0))) + F.size("infrastructure")
    document = nested.join(infra).join(spoken).join(used)
    summary = F.struct(total.alias("total_files_changed"), F.size("groups").alias("total_groups"), F.col("languages"), F.col("frameworks"))
    return document.select(F.to_json(F.struct(summary.alias("summary"), "groups", "infrastructure"), {"ignoreNullFields": "false"}).alias("json"))
