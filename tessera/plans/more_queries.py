"""Queries of the remaining families: matching, evaluation, refinement, jobs, facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.files import parse, rows
from ..functions import paths, scores
from ..operators import dataflow, entrypoints, evaluation, graph, grouping, output, ranking, refinement
from ..streaming import jobs
from . import adapters as ad

SOURCES = ("express", "react/jsx", "reactive", "django.db.models", "@effect/io", "./local", "fastapi", "os", "prisma", "graphql/type")
KINDS = ("JobStarted", "ActivityUpdate", "JobCompleted", "JobFailed", "ActivityUpdate")


def framework_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    imports = ad.calls(spark, sf_dir).select(ad.picked(SOURCES, F.col("pos")).alias("source"))
    return dataflow.frameworks(imports, ad.paths(spark, sf_dir).select("path").distinct())


def one_group_for_each_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.group_files(spark, sf_dir).groupBy("path").agg(F.min("group_no").alias("group_no"))


def topic_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.nearest_by_topic(ad.paths(spark, sf_dir).select("path").distinct(), one_group_for_each_path(spark, sf_dir))


def test_subject_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.tests_with_their_subjects(one_group_for_each_path(spark, sf_dir))


def exact_directory_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = ad.group_files(spark, sf_dir).select("group_no", "path").distinct()
    return grouping.unique_most(ad.paths(spark, sf_dir).select("path").distinct(), files, paths.parent_directory)


def consolidated_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory groups of all paths, small ones merged."""
    groups = grouping.by_directory(ad.paths(spark, sf_dir)).select("name", F.lit(None).cast("string").alias("entrypoint"), "files")
    return grouping.consolidated(groups).select("group_id", "name", F.array_join("files", ",").alias("files"))


def infrastructure_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = ad.paths(spark, sf_dir).select("path").distinct()
    edges = files.select(F.col("path").alias("from_file"), F.concat(paths.parent_directory(F.col("path"), "."), F.lit("/models.py")).alias("to_file"))
    found = grouping.infrastructure_groups(files, edges)
    return found.select("name", "category", F.array_join("files", ",").alias("files"))


def threshold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ad.table(spark, sf_dir, "orders")
    actual, limit = (F.col("o_custkey") % 100) / 100.0, (F.col("o_orderkey") % 90) / 100.0
    return o.select("o_orderkey", F.round(scores.threshold_score(actual, limit), 9).alias("score"), F.round(scores.ratio(F.col("o_custkey"), F.col("o_orderkey") % 7), 9).alias("ratio"))


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_events(ad.table(spark, sf_dir, "events"))


def job_events(e: DataFrame) -> DataFrame:
    kind = ad.picked(KINDS, F.col("event_id") + F.col("user_id"))
    return e.select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.col("props").alias("payload"), (F.unix_timestamp(F.col("ts").cast("timestamp")) * 1000).alias("timestamp_ms"))


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.job_states(job_log(spark, sf_dir))


def streamed_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same states by a stream over the event files, drained to its end."""
    import uuid

    still = ad.table(spark, sf_dir, "events")
    name = f"job_states_{uuid.uuid4().hex}"
    events = spark.readStream.schema(still.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir.rstrip("/"))
    states = jobs.job_states(job_events(events), "3650 days")
    folder = spark.conf.get("spark.checkpoint.dir", None)
    writer = states.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True)
    query = (writer.option("checkpointLocation", f"{folder.rstrip('/')}/{name}") if folder else writer).start()
    query.awaitTermination()
    return spark.table(name)


def job_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.timeline(job_log(spark, sf_dir))


def job_activity_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = jobs.activity_windows(job_log(spark, sf_dir), "1 hour")
    return w.select(F.unix_timestamp("window.start").alias("hour_start"), "type", "n")


def exported_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ad.table(spark, sf_dir, "conversations")
    scope = F.element_at(F.create_map(F.lit("user"), F.lit("code"), F.lit("assistant"), F.lit("file"), F.lit("system"), F.lit("group")), F.col("role"))
    comments = c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("id"), F.lit("h").alias("analysis_hash"), scope.alias("type"),
        F.concat(F.lit("g"), F.col("conv_id").cast("string")).alias("group_id"), F.concat(F.lit("f"), F.col("turn").cast("string")).alias("file_path"), F.col("turn").alias("start_line"),
        (F.col("turn") + 2).alias("end_line"), F.lit("code").alias("selected_code"), "text", F.lpad(F.col("turn").cast("string"), 4, "0").alias("created_at"),
    )
    return jobs.exported(comments).select("group_id", F.sha2("text", 256).alias("text_sha256"))


def manifest_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = ad.group_files(spark, sf_dir)
    manifest = files.select(F.col("group_id").alias("name"), F.concat_ws("/", "path", F.col("pos").cast("string")).alias("path"))
    known = files.where(~paths.is_test_file(F.col("path"))).select(F.concat_ws("/", "path", F.col("pos").cast("string")).alias("path"), paths.role(F.col("path")).alias("role"), "additions", "deletions", F.when(paths.risk_flags(F.col("path"))["is_auth"], 0.35).otherwise(0.0).alias("risk"))
    got = refinement.import_manifest(manifest, known)
    return got.select("name", "path", "role", "additions", "deletions", F.round("group_risk", 9).alias("group_risk"))


def manifest_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = one_group_for_each_path(spark, sf_dir).select(F.concat(F.lit("group_"), F.col("group_no").cast("string")).alias("group_id"), "path")
    groups = files.select("group_id").distinct().select("group_id", F.concat(F.lit("Group "), "group_id").alias("name"), F.length("group_id").alias("review_order"))
    out = refinement.export_manifest(groups, files, ad.paths(spark, sf_dir).select("path").distinct())
    return out.select("name", "review_order", F.array_join("files", ",").alias("files"))


def repaired_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations that name a nation by key, by its name in other case, or wrongly."""
    groups = ad.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("group_id"), F.col("n_name").alias("name"))
    n = ad.table(spark, sf_dir, "customer").join(ad.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    said = F.when(F.col("c_custkey") % 3 == 0, F.col("n_nationkey").cast("string")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("  "), F.lower("n_name"))).otherwise("nobody")
    return refinement.repaired(n.select(said.alias("group_id"), F.col("c_custkey").alias("op")), groups)


def review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in the order of their balance, some moved by hand."""
    c = ad.table(spark, sf_dir, "customer")
    groups = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("group_id"), (F.floor(F.col("c_acctbal")) + 2000).cast("int").alias("review_order"))
    ranks = c.where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("group_id"), (F.col("c_custkey") % 50).cast("int").alias("new_position"), F.lit(0).alias("pos"))
    return refinement.reordered(groups, ranks)


def expected_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = spark.createDataFrame([(1, ["auth/user.service.ts", "auth/README.md"], ["docs/index"]), (2, ["scripts/build.sh", "nowhere"], []), (3, ["Dockerfile"], ["zz"])], "expected_id int, must_contain array<string>, must_not_contain array<string>")
    infra = ad.paths(spark, sf_dir).where(paths.is_true_infrastructure(F.col("path"))).select("path")
    got = evaluation.coherence(expected, one_group_for_each_path(spark, sf_dir).select(F.col("group_no").alias("group_id"), "path"), infra)
    return got.select(F.round("score", 9).alias("score"))


def constraint_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each part's suppliers lie in one nation, and whether an order's parts have places of their own."""
    li = ad.table(spark, sf_dir, "lineitem")
    supplier = ad.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("path"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("location"))
    pairs = li.select(F.col("l_orderkey").alias("set_id"), F.when(F.col("l_orderkey") % 2 == 0, "same").otherwise("separate").alias("kind"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("path")).distinct()
    return evaluation.constraint_results(pairs, supplier)


def symbol_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of orders' files resolved against all of them."""
    files = ad.table(spark, sf_dir, "orders").select(F.concat(F.lit("src/m"), (F.col("o_orderkey") % 400).cast("string"), ad.picked((".ts", ".py", "/index.ts"), F.col("o_orderkey"))).alias("path")).distinct()
    imports = files.select("path", F.lit(0).alias("pos"), F.concat(F.lit("./m"), ((F.length("path") * 37 + F.regexp_extract("path", "[0-9]+", 0).cast("int")) % 400).cast("string")).alias("source"))
    return graph.resolve_imports(imports, files).select("path", "source", "resolved")


def group_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = ad.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("group_id"), F.concat(F.lit("src/p"), F.col("l_partkey").cast("string"), F.lit(".ts")).alias("path"), F.col("l_linenumber").alias("flow_position"))
    first = files.groupBy("group_id", "path").agg(F.min("flow_position").alias("flow_position"))
    a = first.select("group_id", F.col("path").alias("src"), F.col("flow_position").alias("pos"))
    b = first.select("group_id", F.col("path").alias("dst"), (F.col("flow_position") - 1).alias("pos"))
    edges = a.join(b, ["group_id", "pos"]).select("group_id", "pos", "src", "dst", F.when(F.col("pos") % 2 == 0, "Calls").otherwise("Instantiates").alias("edge_type"))
    return output.mermaid(first, edges)


def source_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions and calls of a Python file made for each document."""
    n = F.col("doc_id").cast("string")
    files = ad.table(spark, sf_dir, "documents").select(F.concat(F.lit("src/d"), n, F.lit(".py")).alias("path"), F.concat(F.lit("from .m import load\n\ndef f"), n, F.lit("(a):\n    x = load(a)\n    return save(x)\n")).alias("content"))
    parsed = parse(files)
    calls = rows(parsed, "calls")
    return calls.select("path", "pos", "callee", "line", "containing_function", F.array_join("arguments", ",").alias("arguments"))


def entrypoint_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entrypoints of all adapter paths with imports, definitions, exports and calls given by rule."""
    p = ad.paths(spark, sf_dir)
    files = p.select("path").distinct()
    imports = p.select("path", ad.picked(("express", "celery", "flask", "node-cron", "events", "clap", "net/http", "os"), F.col("doc_id")).alias("source"), F.array(F.lit("x")).alias("names"))
    definitions = p.select("path", F.col("doc_id").alias("pos"), ad.picked(("main", "handle_job", "test_it", "_hidden", "UserHandler", "list_users"), F.col("doc_id")).alias("name"), F.lit("Function").alias("kind"))
    exports = p.select("path", F.col("doc_id").alias("pos"), ad.picked(("GET", "default", "helper"), F.col("doc_id")).alias("name"), (F.col("doc_id") % 3 == 1).alias("is_default"))
    calls = p.select("path", F.col("doc_id").alias("pos"), ad.picked(("app.get", "http.HandleFunc", "queue.process", "cron.schedule", "emitter.on", "render"), F.col("doc_id")).alias("callee"), F.when(F.col("doc_id") % 4 != 0, F.lit("setup")).alias("containing_function"))
    return entrypoints.detect(files, imports, definitions, calls, exports)


def renumbered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = grouping.by_directory(ad.paths(spark, sf_dir)).select("name", "files")
    return grouping.renumbered(groups).select("group_id", "name", F.get("files", F.lit(0)).alias("first_file"))


def global_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all orders by price, made without a single-partition window."""
    o = ad.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ranking.in_order(o, [F.desc("o_totalprice"), F.asc("o_orderkey")], "place").select("o_orderkey", "place")


def text_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as a normalised name: its digest and its code points."""
    name = scores.normalized_name(F.coalesce("text", F.lit("")))
    return ad.table(spark, sf_dir, "documents").select("doc_id", F.sha2(name, 256).alias("name_sha256"), F.length(name).cast("bigint").alias("name_chars"))


def repository_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of one set of measures for each supplier."""
    k = F.col("s_suppkey")
    metrics = ad.table(spark, sf_dir, "supplier").select(
        k.alias("repo"), (k % 40).alias("groups"), ((k % 17) / 10).alias("groups_per_1000"), ((k % 11) / 10).alias("infra_ratio"),
        ((k % 7) / 6).alias("singleton_ratio"), (k % 3 != 0).alias("accounted"), (k % 4).alias("golden_checks"), ((k % 5) / 4).alias("golden"),
        F.lit(20).alias("max_groups"), F.when(k % 2 == 0, F.lit(0.6)).alias("max_groups_per_1000"),
        F.lit(0.5).alias("max_infra_ratio"), F.lit(0.4).alias("max_singleton_ratio"),
    )
    shown = ("group_count", "group_density", "infra_ratio", "singleton_ratio", "file_accounting", "overall")
    return evaluation.repository_scores(metrics).select("repo", *[F.round(c, 9).alias(c) for c in shown])


def accounting_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File accounting of one grouping for each supplier."""
    k = F.col("s_suppkey")
    score = scores.file_accounting(k % 5 + 10, k % 3 + 10, k % 5 + 10 - k % 2, k % 12, F.lit(2), F.lit(8))
    return ad.table(spark, sf_dir, "supplier").select(k.alias("repo"), score.alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        framework_detection, topic_affinity, test_subject_groups, exact_directory_groups, consolidated_groups, infrastructure_groups,
        threshold_scores, job_states, streamed_job_states, job_timeline, job_activity_by_hour, exported_comments, manifest_import, manifest_export,
        repaired_references, review_order, expected_coherence, constraint_results, symbol_bindings, group_diagrams, source_facts,
        entrypoint_detection, renumbered_groups, global_order, text_names, repository_scores,
        accounting_scores,
    )
}
