import pytest
from pyspark.sql import functions as F

from tessera.functions import callsites, paths, scores


def evaluate(spark, column, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_categories(spark):
    cases = {
        ".github/workflows/ci.yml": "Infrastructure", "src/resources/db/seed.sql": "Migration", "src/types/user.ts": "Schema", "migrate/001.py": "Migration",
        "tools/run.sh": "Script", "deploy/prod/app.ts": "Deployment", "docs/intro.md": "Documentation", "docs/content/post.md": "Unclassified",
        "axum/src/docs/routing/state.md": "Unclassified", ".eslintrc": "Lint", "src/test-utils/x.ts": "TestUtil", "src/generated/a.ts": "Generated", "src/a.ts": "Unclassified",
    }
    assert evaluate(spark, paths.category, list(cases)) == list(cases.values())


def test_stems_and_prefixes(spark):
    files = ["src/user.service.test.ts", "a/b/test_models.py", "x/FooTests.java", "pkg/index.ts", "Makefile"]
    assert evaluate(spark, paths.bare_stem, files) == ["user.service", "models", "foo", "", "makefile"]
    assert evaluate(spark, paths.contextual_stem, files) == ["src:user.service", "a/b:models", "x:Foo", "pkg:index", ":Makefile"]
    assert evaluate(spark, lambda c: paths.directory_prefix(c, 0), files) == [None, None, None, None, ""]
    assert evaluate(spark, lambda c: paths.directory_prefix(c, 1), files) == ["src", "a", "x", "pkg", None]
    assert evaluate(spark, paths.normalize, ["a/./b/../c", "../x", "a//b"]) == ["a/c", "x", "a/b"]
    assert evaluate(spark, paths.dotted_to_path, [".models", "..a.b", "...", "os.path"]) == ["./models", "../a/b", "../..", "os.path"]
    assert evaluate(spark, paths.topic_tokens, ["docs_src/tutorial/where/tutorial006b_py310.py"]) == [["tutorial006b", "py310", "where"]]
    assert evaluate(spark, paths.node_label, [0, 25, 26, 51, 52, 701], "int") == ["A", "Z", "AA", "AZ", "BA", "ZZ"]


def test_documentation_rules(spark):
    pages = ["docs/quickstart.md", "docs/zh-hant/docs/tutorial/a.md", "documentation/docs/02-runes/03.md", "docs/user/advanced.rst"]
    assert evaluate(spark, lambda c: paths.is_semantic_doc(c, F.lit(1)), pages) == [False, False, True, False]
    assert evaluate(spark, lambda c: paths.is_semantic_doc(c, F.lit(3)), pages) == [True, False, True, False]


def test_call_patterns(spark):
    cases = {
        "console.log": "Logging", "process.env.HOME": "ConfigRead", "axios.get": "HttpCall", "fetch": "HttpCall", "items.map": None, "bus.emit": "EventEmission",
        "socket.on": "EventHandling", "userRepo.save": "Persistence", "db.query": "DatabaseRead", "x.save": None, "cache.get": None, "orders.find": None, "render": None,
    }
    assert evaluate(spark, callsites.pattern, list(cases)) == list(cases.values())
    told = evaluate(spark, lambda c: callsites.confidence(c, callsites.pattern(c)), ["prisma.user.update", "userRepo.save", "sessionPool.run", "render"])
    assert told == [0.95, 0.9, 0.7, None]


def test_budgets_and_keys(spark):
    text = "ü" * 5 + "\n" + "x" * 20
    assert evaluate(spark, lambda c: scores.truncated(c, 3), [text, "short", None]) == ["ü" * 5 + "\n\n... [truncated: input exceeded 3 token budget]", "short", None]
    assert evaluate(spark, lambda c: scores.first_bytes(c, 4), ["aüüü", "日本", "abcd", ""]) == ["aü", "日", "abcd", ""]
    assert evaluate(spark, scores.redacted_keys, ["key sk-ant-abcdefgh, sk-12345678 AIzaSyABCDEFG sk-1"]) == ["key [REDACTED_ANTHROPIC_KEY], [REDACTED_API_KEY] [REDACTED_GEMINI_KEY] sk-1"]
    assert evaluate(spark, scores.estimated_tokens, ["", "abcd", "abcde"]) == [0, 1, 2]


def test_scores(spark):
    row = spark.range(1).select(
        scores.composite_score({p: F.lit(x) for p, x in zip(scores.WEIGHTS, (0.25, 0.5, 0.0, 0.5))}).alias("c"),
        scores.composite_score({p: F.lit(1.0) for p in scores.WEIGHTS}, dict.fromkeys(scores.WEIGHTS, 0.0)).alias("z"),
        scores.risk_score(F.lit(True), F.lit(True), F.lit(True), F.lit(True)).alias("r"),
        scores.threshold_score(F.lit(0.6), F.lit(0.3)).alias("t"),
        scores.ratio(F.lit(1), F.lit(0)).alias("q"),
    ).first()
    assert row.c == pytest.approx(0.3125) and row.z == 0.0 and row.r == 1.0 and row.t == pytest.approx(1 - 0.3 / 0.7) and row.q == 0.0
