import pytest
from pyspark.sql import functions as F

from tessera.operators import dataflow, entrypoints, evaluation, graph, grouping, output, ranking, refinement, similarity


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


@pytest.fixture(params=["one process", "joins"])
def size(request, monkeypatch):
    """Both ways of searching graphs."""
    if request.param == "joins":
        monkeypatch.setattr(graph, "SMALL_EDGES", -1)
    return request.param


def test_a_wide_search_leaves_the_process(spark, monkeypatch):
    monkeypatch.setattr(graph, "SMALL_REACH", 3)
    edges = frame(spark, "src int, dst int", *[(i, i + 1) for i in range(6)])
    assert graph.distances(edges, frame(spark, "seed int, node int", (0, 0))).count() == 7


def test_distances_end_on_cycles_and_chains(spark, size):
    edges = frame(spark, "src int, dst int", (1, 2), (2, 3), (3, 1), (3, 4))
    seeds = frame(spark, "seed int, node int", (1, 1))
    assert {(r.node, r.dist) for r in graph.distances(edges, seeds).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert {r.node for r in graph.distances(edges, seeds, 1).collect()} == {1, 2}


def test_components(spark, size):
    edges = frame(spark, "a int, b int", *[(i, i + 1) for i in range(40)], (100, 101), (7, 7), (101, 100))
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert {got[i] for i in range(41)} == {0} and got[100] == got[101] == 100
    assert graph.components(edges.limit(0)).count() == 0


def test_imports_resolve_with_suffixes_and_workspaces(spark):
    files = frame(spark, "path string", ("src/a.ts",), ("src/b/index.ts",), ("src/m.py",), ("packages/ui/src/index.ts",), ("packages/ui/button.tsx",))
    imports = frame(spark, "path string, pos int, source string", ("src/a.ts", 0, "./b"), ("src/a.ts", 1, "react"), ("src/m2.py", 0, ".m"), ("src/a.ts", 2, "@x/ui"), ("src/a.ts", 3, "@x/ui/button"), ("src/a.ts", 4, "./none"))
    workspace = frame(spark, "package string, entry string", ("@x/ui", "packages/ui/src/index.ts"), ("@x", "packages/none/src/index.ts"))
    got = {(r.path, r.pos): r.resolved for r in graph.resolve_imports(imports, files, workspace).collect()}
    assert got == {("src/a.ts", 0): "src/b/index.ts", ("src/a.ts", 1): None, ("src/m2.py", 0): "src/m.py", ("src/a.ts", 2): "packages/ui/src/index.ts", ("src/a.ts", 3): "packages/ui/button.tsx", ("src/a.ts", 4): None}


def test_flows_respect_scopes(spark):
    made = frame(spark, "path string, variable string, callee string, containing_function string", ("f", "x", "a", "g"), ("f", "y", "a", None), ("f", "x", "b", "h"))
    used = frame(spark, "path string, callee string, arguments array<string>, containing_function string, line int", ("f", "b", ["x", "1"], "g", 3), ("f", "c", ["y"], None, 4), ("f", "b", ["x"], "h", 5))
    assert {(r.producer, r.consumer, r.via, r.containing_function) for r in dataflow.flows(made, used).collect()} == {("a", "b", "x", "f::g"), ("a", "c", "y", "f")}


def test_frameworks(spark):
    imports = frame(spark, "source string", ("express",), ("react/jsx",), ("reactive",), ("django.db",), ("@effect/io",))
    files = frame(spark, "path string", ("app/x/page.tsx",), ("src/a.ts",))
    assert {r.framework for r in dataflow.frameworks(imports, files).collect()} == {"Express", "React", "Django", "Next.js"}


def test_entrypoints(spark):
    files = frame(spark, "path string", ("src/routes/u.ts",), ("cmd/main.go",), ("tests/test_a.py",), ("app/api/x/route.ts",), ("svc/workers/w.py",), ("src/lib.rs",), ("src/view.kt",))
    imports = frame(spark, "path string, source string, names array<string>", ("svc/workers/w.py", "celery", ["Celery"]), ("src/view.kt", "io.ktor.server", []))
    definitions = frame(spark, "path string, pos bigint, name string, kind string", ("src/routes/u.ts", 0, "list", "Function"), ("cmd/main.go", 0, "main", "Function"), ("tests/test_a.py", 0, "test_one", "Function"), ("svc/workers/w.py", 0, "process_job", "Function"), ("src/lib.rs", 0, "x", "Function"))
    calls = frame(spark, "path string, pos bigint, callee string, containing_function string", ("src/routes/u.ts", 0, "app.get", None), ("src/view.kt", 0, "get", "routes"))
    exports = frame(spark, "path string, pos bigint, name string, is_default boolean", ("app/api/x/route.ts", 0, "GET", False), ("app/api/x/route.ts", 1, "helper", False))
    got = {(r.file, r.symbol): r.entrypoint_type for r in entrypoints.detect(files, imports, definitions, calls, exports).collect()}
    assert got == {
        ("src/routes/u.ts", "app.get"): "HttpRoute", ("src/routes/u.ts", "list"): "HttpRoute", ("cmd/main.go", "main"): "CliCommand", ("tests/test_a.py", "test_one"): "TestFile",
        ("app/api/x/route.ts", "GET"): "HttpRoute", ("svc/workers/w.py", "process_job"): "QueueConsumer", ("src/lib.rs", "lib"): "CliCommand", ("src/view.kt", "routes"): "HttpRoute",
    }


def test_small_groups_merge_by_directory(spark):
    rows = [(f"n{i}", None, [f"a/b/{i}.ts"]) for i in range(3)] + [("route", "e", ["a/b/r.ts"]), ("big", None, [f"a/c/{i}.ts" for i in range(6)]), ("root", None, ["x.ts"])]
    got = grouping.consolidated(frame(spark, "name string, entrypoint string, files array<string>", *rows)).collect()
    assert sorted(tuple(r.files) for r in got) == sorted([("a/b/0.ts", "a/b/1.ts", "a/b/2.ts"), ("a/b/r.ts",), tuple(f"a/c/{i}.ts" for i in range(6)), ("x.ts",)])
    assert sorted(r.group_id for r in got) == ["group_1", "group_2", "group_3", "group_4"]


def test_infrastructure_groups(spark):
    files = frame(spark, "path string", ("Dockerfile",), ("docs/a.md",), ("src/x/a.c",), ("src/x/b.c",), ("lib/q.c",), ("lib/r.c",), ("one/z.c",))
    edges = frame(spark, "from_file string, to_file string", ("src/x/a.c", "src/x/b.c"), ("one/z.c", "gone.c"))
    got = {(r["name"], r.category): r.files for r in grouping.infrastructure_groups(files, edges).collect()}
    assert got == {("Infrastructure", "Infrastructure"): ["Dockerfile"], ("Documentation", "Documentation"): ["docs/a.md"], ("src/x/", "DirectoryGroup"): ["src/x/a.c", "src/x/b.c"], ("lib/", "DirectoryGroup"): ["lib/q.c", "lib/r.c"], ("Unclassified", "Unclassified"): ["one/z.c"]}


def test_tests_follow_their_subjects(spark):
    assigned = frame(spark, "path string, group_no int", ("src/a.ts", 1), ("src/a.test.ts", 2), ("spec/b.spec.ts", 3), ("lib/b.ts", 4), ("spec/none.spec.ts", 5))
    got = {r.path: r.group_no for r in grouping.tests_with_their_subjects(assigned).collect()}
    assert got == {"src/a.ts": 1, "src/a.test.ts": 1, "spec/b.spec.ts": 4, "lib/b.ts": 4, "spec/none.spec.ts": 5}


def test_groups_merge_by_stem(spark, size):
    rows = [("src/a.ts", 1), ("t/a.test.ts", 2), ("x/b.ts", 2), ("y/b.spec.ts", 3), ("p/c.ts", 4), ("q/c.ts", 5), ("r/c.test.ts", 6), ("z/index.ts", 7), ("z/index.test.ts", 8)]
    got = {r.path: r.group_no for r in grouping.merged_by_stem(frame(spark, "path string, group_no int", *rows)).collect()}
    # a links 1 and 2, b links 2 and 3; c is in three groups, index is a name that many packages share.
    assert got == {p: 2 if g in (1, 2, 3) else g for p, g in rows}


def test_topic_affinity(spark):
    groups = frame(spark, "group_no int, path string", (0, "docs_src/tutorial/where/tutorial006b_py310.py"), (1, "src/other.py"))
    got = grouping.nearest_by_topic(frame(spark, "path string", ("docs/tutorial/where.md",), ("zzz.md",)), groups).collect()
    assert [(r.path, r.group_no) for r in got] == [("docs/tutorial/where.md", 0)]


def test_common_prefix(spark):
    df = frame(spark, "f array<string>", (["a/b/c.ts", "a/b/d/e.ts"],), (["a/b.ts", "c/d.ts"],), (["a/b.ts"],), ([],), (["x.ts", "y.ts"],))
    assert [r.p for r in df.select(grouping.common_prefix(F.col("f")).alias("p")).collect()] == ["a/b/", "Mixed", "a/", "Unknown", "Mixed"]


def test_total_order_spans_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert all(r.n == r.k + 1 for r in ranking.in_order(df, [F.asc("k")], "n").collect())


def test_similarity(spark):
    v = frame(spark, "id int, vector array<float>", (1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]))
    assert {(r.a, r.b) for r in similarity.pairs(v, 0.9).collect()} == {(1, 2)}
    assert {(r.id, r.cluster, r.size) for r in similarity.clusters(v, 0.9).collect()} == {(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 1)}
    files = frame(spark, "path string, group_no int", ("a", 1), ("b", 2), ("c", 3))
    vectors = frame(spark, "path string, vector array<double>", ("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0]))
    assert {r.path: r.group_no for r in similarity.refine(files, vectors).collect()} == {"a": 1, "b": 1, "c": 3}


def test_blocks_cover_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 10)
    v = spark.range(45).select("id", F.array(F.lit(1.0), F.col("id").cast("double") / 1000).alias("vector"))
    assert similarity.pairs(v, 0.9).count() == 45 * 44 // 2


def test_evaluation(spark):
    files = frame(spark, "group_id string, path string", ("g1", "src/a.ts"), ("g1", "src/b.ts"), ("g2", "src/c.ts"))
    expected = frame(spark, "expected_id int, must_contain array<string>, must_not_contain array<string>", (1, ["a.ts", "b.ts"], ["c.ts"]), (2, ["c.ts", "d.ts"], []))
    infra = frame(spark, "path string", ("d.ts",))
    assert evaluation.coherence(expected, files, infra).first().score == pytest.approx((1.0 * 2 + 0.5 * 2) / 4)
    sets = frame(spark, "set_id int, kind string, path string", (1, "same", "src/a.ts"), (1, "same", "src/b.ts"), (2, "separate", "src/a.ts"), (2, "separate", "src/c.ts"), (3, "same", "src/a.ts"), (3, "same", "gone"))
    places = files.select("path", F.col("group_id").alias("location"))
    assert {r.set_id: r.satisfied for r in evaluation.constraint_results(sets, places).collect()} == {1: True, 2: True, 3: False}
    groups = frame(spark, "risk double, review_order int, n_files int", (0.5, 1, 1), (1.5, 1, 0))
    assert evaluation.reasonableness(groups).first().score == pytest.approx(1 - 0.5 - 0.1)
    assert evaluation.recall(files.limit(0), files, ["path"]).first().score == 1.0


def test_refinement(spark):
    files = frame(spark, "group_id string, path string", ("g1", "a"), ("g1", "b"), ("g2", "c"))
    parts = frame(spark, "source_group string, part int, path string", ("g1", 1, "a"), ("g1", 2, "b"))
    assert {(r.group_id, r.path) for r in refinement.split(files, parts).collect()} == {("group_refined_1", "a"), ("group_refined_2", "b"), ("g2", "c")}
    groups = frame(spark, "group_id string, name string, review_order int", ("g1", "User Login", 1), ("g2", "Pay", 2))
    ranks = frame(spark, "group_id string, new_position int, pos int", ("g2", 0, 0))
    assert [(r.group_id, r.review_order) for r in refinement.reordered(groups, ranks).orderBy("review_order").collect()] == [("g2", 1), ("g1", 2)]
    operations = frame(spark, "group_id string, op string", ("g1", "x"), ("user  login", "y"), ("none", "z"))
    fixed = refinement.repaired(operations, groups)
    assert {(r.op, r.group_id, r.repaired) for r in fixed.collect()} == {("x", "g1", False), ("y", "g1", True), ("z", "none", False)}
    valid, dropped = refinement.sanitized(fixed, groups)
    assert valid.count() == 2 and dropped.first().group_id == "none"
    known = frame(spark, "path string, role string, additions int, deletions int, risk double", ("a", "Model", 3, 1, 0.4))
    manifest = frame(spark, "name string, path string", ("G", "a"), ("G", "new"))
    assert {(r.path, r.role, r.additions, r.group_risk) for r in refinement.import_manifest(manifest, known).collect()} == {("a", "Model", 3, 0.2), ("new", "Utility", 0, 0.2)}
    last = refinement.export_manifest(groups, files, frame(spark, "path string", ("a",), ("zz",))).where("name = 'unassigned'").first()
    assert last.files == ["zz"]


def test_mermaid(spark):
    files = frame(spark, "group_id string, path string, flow_position int", ("g", "src/a.ts", 0), ("g", "src/x/b.ts", 1))
    edges = frame(spark, "group_id string, pos int, src string, dst string, edge_type string", ("g", 0, "src/a.ts", "src/x/b.ts::f", "Imports"), ("g", 1, "src/a.ts::g", "src/x/b.ts::f", "Calls"), ("g", 2, "src/a.ts", "src/a.ts::g", "Calls"))
    assert output.mermaid(files, edges).first().diagram == 'graph TD\n    A["src/a.ts"]\n    B["x/b.ts"]\n    A -->|imports| B'


def test_eviction_keeps_the_newest(spark):
    entries = frame(spark, "cache int, entry int, modified int, size int", (1, 1, 1, 5), (1, 2, 2, 5), (1, 3, 3, 5), (2, 9, 1, 100))
    assert {r.entry for r in ranking.evict_oldest(entries, 10, ["cache"]).collect()} == {2, 3}


def test_frameworks_of_many_languages(spark):
    sources = ["github.com/gin-gonic/gin", "axum::Router", "org.springframework.boot.SpringApplication", "Illuminate\\\\Database\\\\Eloquent", "rails/all", "io.ktor.server", "SwiftUI", "cats.effect.IO", "Microsoft.AspNetCore.Mvc", "axumish"]
    imports = spark.createDataFrame([(s.replace("\\\\", "\\"),) for s in sources], "source string")
    found = {r.framework for r in dataflow.frameworks(imports, spark.createDataFrame([("a.go",)], "path string")).collect()}
    assert found == {"Gin", "Axum", "Spring Boot", "Laravel", "Laravel Eloquent", "Rails", "Ktor", "SwiftUI", "Cats", "Cats Effect", "ASP.NET Core", "ASP.NET Core MVC"}


def test_entrypoint_accuracy(spark):
    detected = spark.createDataFrame([("src/api/users.ts", "HttpRoute"), ("src/cli.ts", "CliCommand")], "file string, type string")
    expected = [("api/users", "HttpRoute"), ("cli", "HttpRoute"), ("users", "HttpRoute"), ("none", "CliCommand")]
    rows = lambda some: spark.createDataFrame(some, "piece string, type string")
    assert evaluation.entrypoint_accuracy(rows(expected), detected).first().score == 0.5
    assert evaluation.entrypoint_accuracy(rows([]), detected).first().score == 1.0
    assert evaluation.entrypoint_accuracy(rows(expected), detected.limit(0)).first().score == 0.0
