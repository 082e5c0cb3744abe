"""One query for each operator family, over whole driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import callsites, paths, scores
from ..operators import dataflow, evaluation, graph, grouping, output, ranking, refinement, similarity
from . import adapters as ad


def rank_review_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: changed files to risk parts, composite score and review order of each group."""
    ranked = ranking.rank_groups(ranking.rank_inputs(ad.group_files(spark, sf_dir)))
    return ranked.select("group_id", F.round("composite_score", 9).alias("composite_score"), "review_order")


def group_risk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.group_risk_flags(ad.group_files(spark, sf_dir))


def path_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    flags = paths.risk_flags(p)
    return ad.paths(spark, sf_dir).select(
        "doc_id", "path", paths.category(p).alias("category"), paths.lookup(paths.category(p), paths.CATEGORY_LABELS).alias("label"),
        paths.is_true_infrastructure(p).alias("infrastructure"), paths.is_config_like(p).alias("config_like"), paths.is_top_level_doc(p).alias("top_level_doc"),
        paths.role(p).alias("role"), paths.is_test_file(p).alias("test_file"), paths.language(p).alias("language"),
        paths.has_source_extension(p).alias("source_extension"), paths.is_native_source(p).alias("native_source"), *[c.alias(n) for n, c in flags.items()],
    )


def path_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return ad.paths(spark, sf_dir).select(
        "doc_id", paths.bare_stem(p).alias("bare_stem"), paths.contextual_stem(p).alias("contextual_stem"), paths.parent_directory(p, ".").alias("parent"),
        paths.file_stem(p).alias("file_stem"), paths.directory_prefix(p, 2).alias("prefix_2"), paths.short_label(p).alias("short_label"),
        paths.fixture_root(p).alias("fixture_root"), paths.is_fixture_source(p).alias("fixture_source"), paths.is_fixture_config(p).alias("fixture_config"),
        paths.node_label(F.col("doc_id") % 702).alias("node_label"),
    )


def documentation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, batch = F.col("path"), F.lit(3)
    return ad.paths(spark, sf_dir).select(
        "doc_id", paths.is_semantic_doc(p, batch).alias("candidate"), paths.is_fallback_doc(p, batch).alias("fallback"),
        paths.is_localized_docs(p).alias("localized"), paths.is_root_docs_page(p).alias("root_page"),
    )


def large_change_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.large_partitions(ad.paths(spark, sf_dir)).select("bucket", "is_infra", F.size("files").alias("n_files"), F.array_join("files", ",").alias("files"))


def directory_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.by_directory(ad.paths(spark, sf_dir)).select("directory", "name", F.array_join("files", ",").alias("files"))


def topic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.paths(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(paths.topic_tokens(F.col("path"))), ",").alias("tokens"))


def import_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative imports normalised against the importing file."""
    source = ad.picked(("./user.service", "../../db/schema", ".models", "..core.users", "...", "react", "./index"), F.col("doc_id"))
    base = ad.paths(spark, sf_dir).select("doc_id", "path", source.alias("source"))
    dotted = paths.dotted_to_path(F.col("source"))
    joined = F.concat(paths.parent_directory(F.col("path"), "."), F.lit("/"), dotted)
    return base.select("doc_id", "source", dotted.alias("dotted"), paths.normalize(joined).alias("target"))


def call_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataflow.heuristic_edges(ad.calls(spark, sf_dir))


def data_flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a call returned flows into later calls of the scope: events of a user and type."""
    base = ad.calls(spark, sf_dir).withColumn("variable", F.concat(F.lit("v"), (F.col("pos") % 40).cast("string")))
    made = base.where("pos % 2 = 0").select("path", "variable", "callee", "containing_function")
    used = base.where("pos % 2 = 1").select("path", "callee", F.array(F.concat(F.lit("v"), ((F.col("pos") - 1) % 40).cast("string"))).alias("arguments"), "containing_function", "line")
    return dataflow.flows(made, used)


def symbol_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against line items as the symbols of two versions."""
    o = ad.table(spark, sf_dir, "orders").where("o_orderstatus != 'P'")
    old = o.select(F.col("o_orderpriority").alias("path"), F.col("o_orderkey").cast("string").alias("name"), F.lit("Function").alias("kind"), (F.col("o_orderkey") % 50).alias("start_line"), (F.col("o_orderkey") % 50 + 5).alias("end_line"))
    n = ad.table(spark, sf_dir, "orders").where("o_orderpriority != '1-URGENT'")
    new = n.select(F.col("o_orderpriority").alias("path"), F.col("o_orderkey").cast("string").alias("name"), F.lit("Function").alias("kind"), (F.col("o_orderkey") % 50).alias("start_line"), (F.col("o_orderkey") % 50 + F.when(F.col("o_orderkey") % 5 == 0, 6).otherwise(5)).alias("end_line"))
    return dataflow.symbol_changes(old, new)


def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first distances from every order divisible by 50."""
    edges = ad.chain_edges(spark, sf_dir)
    seeds = edges.where("src % 50 = 0").select(F.col("src").alias("seed"), F.col("src").alias("node")).distinct()
    return graph.distances(edges, seeds)


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(ad.chain_edges(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b")))


def nearest_entrypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's nearest of all orders divisible by 50, forward hops at 1, backward at 2."""
    edges = ad.chain_edges(spark, sf_dir).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    ids = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"))
    nodes = ids.select("id", F.col("id").alias("file"))
    starts = ad.table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("entrypoint"), F.col("o_orderkey").cast("string").alias("file"), F.lit("main").alias("symbol"))
    reach = graph.file_reachability(edges, nodes, starts)
    return graph.nearest_entrypoint(reach, ids.select(F.col("id").alias("path")))


def nearest_group_by_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = ad.paths(spark, sf_dir).select("path").distinct()
    return grouping.nearest_by_directory(files, ad.group_files(spark, sf_dir).select("group_no", "path").distinct())


def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ad.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return similarity.pairs(v, 0.3).select("a", "b", F.round("similarity", 6).alias("similarity"))


def top_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ad.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return similarity.top_pairs(v, 20, 0.3).select("a", "b", F.round("similarity", 6).alias("similarity"))


def similarity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ad.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return similarity.clusters(v, 0.4)


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = similarity.centroids(ad.table(spark, sf_dir, "embeddings"), "label", "embedding")
    return c.select(F.col("group").alias("label"), F.posexplode("vector").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("mean"))


def regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ad.table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return ranking.regressions(e, "user_id", "event_id", "value", 50.0).select("user_id", "event_id", "value", "previous")


def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ad.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cache"), F.col("o_orderkey").alias("entry"), F.col("o_orderdate").alias("modified"), F.floor("o_totalprice").cast("bigint").alias("size"))
    return ranking.evict_oldest(o, 500_000, ["cache"]).select("cache", "entry", "total")


def first_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ad.calls(spark, sf_dir)
    found = e.select(F.col("path").alias("file"), F.coalesce("containing_function", "callee").alias("symbol"), (F.col("pos") % 9).alias("detector"), "pos", F.element_at(F.array(*[F.lit(x) for x in ("TestFile", "HttpRoute", "CliCommand")]), (F.col("pos") % 3 + 1).cast("int")).alias("entrypoint_type"))
    return ranking.first_detections(found)


def grouping_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = ad.group_files(spark, sf_dir).select("group_id", F.concat_ws("/", "path", F.col("pos").cast("string")).alias("path"))
    infra = ad.paths(spark, sf_dir).where(paths.is_true_infrastructure(F.col("path"))).select(F.concat_ws("/", "path", F.col("doc_id").cast("string")).alias("path"))
    m = evaluation.group_metrics(files, infra)
    return m.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes])


def label_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = ad.table(spark, sf_dir, "labels").select("doc_id")
    found = ad.table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return evaluation.recall(expected, found, ["doc_id"]).select(F.round("score", 9).alias("score"))


def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token estimate, content key and normalised head of every text."""
    t = F.col("text")
    return ad.table(spark, sf_dir, "documents").select(
        "doc_id", scores.estimated_tokens(t).alias("tokens"), scores.content_key(F.concat(F.lit("d/"), F.col("doc_id").cast("string")), t).alias("content_key"),
        scores.normalized_name(F.substring(t, 1, 40)).alias("name"),
    )


def text_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut to a budget of 300 tokens, with provider keys redacted from its head."""
    t = F.col("text")
    return ad.table(spark, sf_dir, "documents").select("doc_id", F.sha2(scores.truncated(t, 300), 256).alias("truncated_sha256"), scores.redacted_keys(t).alias("redacted"))


def merged_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as refinement: user turns move files, assistant turns merge groups."""
    c = ad.table(spark, sf_dir, "conversations")
    files = c.select(F.concat(F.lit("g"), (F.col("conv_id") % 30).cast("string")).alias("group_id"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"))
    moves = c.where("role = 'user'").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), F.concat(F.lit("g"), (F.col("conv_id") % 30).cast("string")).alias("from_group"), F.concat(F.lit("g"), (F.col("turn") % 7).cast("string")).alias("to_group"), F.col("turn").alias("pos"))
    merges = spark.createDataFrame([(0, 0, "g3"), (0, 1, "g9"), (1, 0, "g11"), (1, 1, "g5")], "merge int, pos int, group_id string")
    return refinement.merged(refinement.reclassified(files, moves), merges)


def file_level_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol edges folded to files with their distinct kinds."""
    h = dataflow.heuristic_edges(ad.calls(spark, sf_dir))
    edges = h.select(F.lit("all").alias("group_id"), F.col("from_symbol").alias("src"), F.concat_ws("::", F.concat(F.lit("ext/"), "pattern"), "evidence").alias("dst"), F.col("pattern").alias("edge_type"))
    return output.file_edges(edges).select("from_file", "to_file", F.array_join("types", ",").alias("types"))


def call_receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callees with method, receiver and whether the receiver names a database."""
    c = F.col("callee")
    base = ad.calls(spark, sf_dir)
    return base.groupBy("callee").agg(F.count(F.lit(1)).alias("n")).select("callee", "n", callsites.method(c).alias("method"), callsites.receiver(c).alias("receiver"), callsites.has_database_receiver(c).alias("database"))


def group_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, risk level and colour of each group."""
    g = ranking.rank_inputs(ad.group_files(spark, sf_dir))
    w = ad.group_files(spark, sf_dir).groupBy("group_id").agg(F.greatest(F.sum(F.col("additions") + F.col("deletions")), F.lit(1)).alias("weight"))
    return g.join(w, "group_id").select("group_id", "weight", F.round("risk", 9).alias("risk"), scores.risk_level(F.col("risk")).alias("level"), scores.heat_colour(F.col("risk")).alias("colour"))


QUERIES = {
    f.__name__: f
    for f in (
        rank_review_groups, group_risk_flags, path_categories, path_stems, documentation_candidates, large_change_partitions,
        directory_groups, topic_tokens, import_paths, call_patterns, data_flow_edges, symbol_changes, reachability,
        connected_components, nearest_entrypoints, nearest_group_by_directory, similar_pairs, top_similar_pairs,
        similarity_clusters, label_centroids, regressions, cache_eviction, first_detections, grouping_metrics, label_recall,
        text_keys, text_budgets, merged_groups, file_level_edges, call_receivers, group_summaries,
    )
}
