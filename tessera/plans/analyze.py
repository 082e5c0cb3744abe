"""End to end: a change set to ranked review groups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.files import parse, rows
from ..functions import paths
from ..operators import dataflow, entrypoints, graph, grouping, output, ranking


@dataclass
class Analysis:
    groups: DataFrame
    group_files: DataFrame
    infrastructure: DataFrame
    nodes: DataFrame
    edges: DataFrame
    entrypoints: DataFrame
    frameworks: DataFrame
    languages: DataFrame

    def document(self) -> DataFrame:
        return output.analysis_document(self.groups, self.group_files, self.infrastructure, self.languages, self.frameworks)


# How a group is named after its entrypoint's kind.
NAMES = {"HttpRoute": "route", "CliCommand": "CLI", "QueueConsumer": "consumer", "CronJob": "scheduled", "ReactPage": "page", "TestFile": "test", "EventHandler": "event", "EffectService": "Effect service"}


def build_graph(parsed: DataFrame, workspace: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of parsed files."""
    files = parsed.select("path")
    definitions, imports, exports, calls = (rows(parsed, k) for k in ("definitions", "imports", "exports", "calls"))
    nodes = graph.cut(graph.build_nodes(files, definitions))
    resolved = graph.resolve_imports(imports, files, workspace)
    named = resolved.select("path", "pos", "resolved", "is_default", "is_namespace", F.posexplode_outer("names").alias("name_pos", "n")).select("path", "pos", "name_pos", "resolved", "is_default", "is_namespace", "n.name", "n.alias")
    passed = graph.resolve_imports(exports.where("is_reexport").select("path", "pos", "source", "name"), files, workspace).select("path", "name", "resolved")
    edges = graph.import_edges(named, nodes, passed).unionByName(graph.call_edges(calls, graph.import_bindings(named, definitions), nodes))
    edges = edges.unionByName(dataflow.graph_edges(dataflow.heuristic_edges(calls), nodes))
    return nodes, graph.cut(edges)


def group_name():
    """Symbol and file of an entrypoint with the word for its kind."""
    base = paths.file_stem(F.col("file"))
    label = F.when((F.col("symbol") == base) | F.col("symbol").isin("default", "module"), base).otherwise(F.concat(F.col("symbol"), F.lit(" ("), base, F.lit(")")))
    return F.concat(label, F.lit(" "), paths.lookup(F.col("entrypoint_type"), NAMES))


def analyze(files: DataFrame, workspace: DataFrame | None = None, large: int = grouping.LARGE_CHANGE) -> Analysis:
    """Review groups of changed `files` (path, content, additions, deletions).

    Files reach the group of their nearest entrypoint; tests follow what they
    test; source files out of reach join the nearest group by directory, then
    by topic; the rest is infrastructure. Without entrypoints, connected files
    and then directories make the groups. From `large` files on, a file only
    reaches entrypoints of its own coarse bucket, and buckets of infrastructure
    are reached by none.
    """
    changed = graph.cut(files.select("path", "content", "additions", "deletions"))
    parsed = graph.cut(parse(changed))
    nodes, edges = build_graph(parsed, workspace)
    definitions, imports, exports, calls = (rows(parsed, k) for k in ("definitions", "imports", "exports", "calls"))
    sources = imports.select("path", "source", F.transform("names", lambda n: n["name"]).alias("names"))
    found = entrypoints.detect(parsed.select("path"), sources, definitions, calls, exports)
    starts = graph.cut(ranking.in_order(found, [F.asc("file"), F.asc("symbol")], "entrypoint"))
    every = parsed.select("path")
    distance = every.select("path", F.lit(0).alias("dist"))
    if starts.isEmpty():
        group_files, infra, groups = _without_entrypoints(every, nodes, edges)
    else:
        reach = graph.file_reachability(edges, nodes, starts)
        many = every.count() >= large
        if many:
            reach = _inside_buckets(reach, starts)
        near = graph.cut(graph.nearest_entrypoint(reach, every))
        own = near.where("entrypoint IS NOT NULL").select("path", F.col("entrypoint").alias("group_no"))
        assigned = graph.cut(grouping.tests_with_their_subjects(own))
        left = every.join(assigned, "path", "left_anti")
        rescued = graph.cut(_rescued_in_buckets(left, assigned) if many else _rescued(left, assigned))
        group_files = grouping.merged_by_stem(assigned.unionByName(rescued))
        infra = left.join(rescued, "path", "left_anti")
        # Files out of reach come last.
        distance = near.select("path", F.coalesce("dist", F.lit(1 << 30)).alias("dist"))
        groups = starts.select(F.col("entrypoint").alias("group_no"), group_name().alias("name")).join(group_files.select("group_no").distinct(), "group_no")
        if many:
            # Buckets without an entrypoint make groups of their own.
            bucket = paths.partition_key(F.col("path")).alias("bucket")
            reached = assigned.select(bucket).distinct()
            rest = infra.withColumn("bucket", bucket).where(~F.col("bucket").startswith("infra:")).join(reached, "bucket", "left_anti").select("path")
            more_files, _, more_groups = _without_entrypoints(graph.cut(rest), nodes, edges)
            top = starts.agg(F.max("entrypoint")).first()[0]
            more_files = graph.cut(more_files.withColumn("group_no", F.col("group_no") + top))
            group_files = group_files.unionByName(more_files.select("path", "group_no"))
            groups = groups.unionByName(more_groups.withColumn("group_no", F.col("group_no") + top).select("group_no", "name"))
            infra = infra.join(more_files, "path", "left_anti")
    numbered = ranking.in_order(groups, [F.asc("name"), F.asc("group_no")], "n").select("group_no", "name", F.concat(F.lit("group_"), F.col("n").cast("string")).alias("group_id"))
    listed = group_files.join(numbered, "group_no").join(changed.select("path", "additions", "deletions"), "path").join(distance, "path")
    heads = starts.select(F.col("file").alias("path"), F.col("entrypoint").alias("group_no"), F.lit(True).alias("head")).distinct()
    role = F.when(F.col("head"), "Entrypoint").otherwise(paths.role(F.col("path")))
    listed = listed.join(heads, ["path", "group_no"], "left").select("group_id", "path", "additions", "deletions", role.alias("role"), "dist")
    listed = ranking.in_order(graph.cut(listed), [F.asc("dist"), F.asc("path")], "flow_position", ["group_id"]).withColumn("flow_position", F.col("flow_position") - 1).drop("dist")
    inputs = ranking.rank_inputs(listed)
    ranked = ranking.rank_groups(inputs).join(inputs.select("group_id", "risk"), "group_id").join(numbered, "group_id")
    final = ranked.select("group_id", "name", F.col("composite_score").alias("risk_score"), "review_order")
    languages = every.select(paths.language(F.col("path")).alias("language")).where("language != 'Unknown'")
    return Analysis(final, listed, infra, nodes, edges, starts, dataflow.frameworks(imports, every), languages)


def _inside_buckets(reach: DataFrame, starts: DataFrame) -> DataFrame:
    """What entrypoints reach inside their own coarse bucket."""
    bucket = paths.partition_key(F.col("file"))
    own = starts.select("entrypoint", bucket.alias("bucket")).where(~F.col("bucket").startswith("infra:"))
    return reach.withColumn("bucket", bucket).join(own, ["entrypoint", "bucket"], "left_semi").select("entrypoint", "file", "dist")


def _rescued(left: DataFrame, assigned: DataFrame) -> DataFrame:
    """(path, group_no) of files out of reach that are not infrastructure."""
    p = F.col("path")
    category = paths.category(p)
    source = (category == "Unclassified") & ~paths.is_config_like(p)
    near = grouping.nearest_by_directory(left.where(source), assigned)
    topical = left.where(source | category.isin("Documentation", "Schema", "Generated"))
    about = grouping.nearest_by_topic(topical, assigned).select("path", F.col("group_no").alias("topic_group"))
    met = left.join(near, "path", "left").join(about, "path", "left")
    return met.select("path", F.coalesce("group_no", "topic_group").alias("group_no")).where("group_no IS NOT NULL")


def _rescued_in_buckets(left: DataFrame, assigned: DataFrame) -> DataFrame:
    """The same, by groups with files in the file's own bucket only."""
    bucket = paths.partition_key(F.col("path"))
    at = assigned.select("group_no", bucket.alias("bucket")).distinct()
    return _rescued(left, assigned).withColumn("bucket", bucket).join(at, ["group_no", "bucket"], "left_semi").select("path", "group_no")


def _without_entrypoints(every: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = F.col("path")
    category = paths.category(p)
    soft = (category != "Infrastructure") & ~paths.is_config_like(p) & ((category == "Unclassified") | (paths.has_source_extension(p) & ~paths.is_top_level_doc(p)))
    source = graph.cut(every.where(paths.is_fixture_source(p) | soft))
    infra = every.join(source, "path", "left_anti")
    of = nodes.select("id", "file")
    ends = edges.join(of.select(F.col("id").alias("src"), F.col("file").alias("a")), "src").join(of.select(F.col("id").alias("dst"), F.col("file").alias("b")), "dst").where("a != b")
    inner = ends.join(source.select(F.col("path").alias("a")), "a", "left_semi").join(source.select(F.col("path").alias("b")), "b", "left_semi")
    linked = graph.components(inner.select("a", "b"))
    connected = linked.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("files"))
    folder = F.coalesce(paths.parent_directory(F.col("files")[0]), F.lit("root"))
    connected = connected.select(F.concat(F.substring_index(folder, "/", -1), F.lit(" (connected)")).alias("name"), F.lit(None).cast("string").alias("entrypoint"), "files")
    alone = grouping.by_directory(source.join(linked.select(F.col("node").alias("path")), "path", "left_anti"))
    merged = grouping.consolidated(alone.select("name", F.lit(None).cast("string").alias("entrypoint"), "files")).select("name", "entrypoint", "files")
    numbered = grouping.renumbered(connected.unionByName(merged)).select(F.col("number").alias("group_no"), "name", "files")
    numbered = graph.cut(numbered)
    return numbered.select(F.explode("files").alias("path"), "group_no"), infra, numbered.select("group_no", "name")


def analyze_repository(spark: SparkSession, repo: str, mode: str = "branch_worktree", base: str = "HEAD", head: str = "HEAD") -> Analysis:
    """Analysis of a git change set; deleted files have no content and no facts."""
    from ..sources.documents import workspace_map
    from ..sources.git_changes import changes

    found = changes(spark, repo, mode, base, head)
    files = found.select(F.coalesce("new_path", "old_path", F.lit("<unknown>")).alias("path"), F.col("new_content").alias("content"), "additions", "deletions")
    return analyze(files, workspace_map(spark, repo))
