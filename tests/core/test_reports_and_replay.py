from pyspark.sql import functions as F

from tessera.functions import scores
from tessera.operators import replay, reports
from tessera.sources import documents


def results(spark, *rows):
    return spark.createDataFrame([(n, *[v] * 6) for n, v in rows], "name string, " + ", ".join(f"{c} double" for c in scores.CRITERIA))


def test_reports(spark, tmp_path):
    run = results(spark, ("a <b>", 1.0), ("c", 0.5))
    one = reports.summary(run, 0.7).first()
    assert (round(one.avg_overall, 9), one.passed, one.fixture_count) == (0.75, True, 2)
    path = str(tmp_path / "history")
    for stamp in ("2024-01-01", "2024-01-02"):
        documents.append_history(reports.history_row(run, 0.7, stamp), path)
    with open(f"{path}/bad.json", "w") as f:
        f.write("{broken\n\n")
    history = documents.read_history(spark, path)
    assert history.count() == 2 and history.first().fixtures[0].name == "a <b>"
    assert reports.regression(history, 0.5).count() == 1 and reports.regression(history, 0.72).count() == 0
    assert "average 0.750, passed" in reports.text_report(run, 0.7)
    page = reports.html_report(run, history, 0.7)
    assert "a &lt;b&gt;" in page and page.count("<rect") == 2
    assert "average 0.000, failed" in reports.text_report(run.limit(0), 0.7)
    gaps = reports.coverage_gaps(spark.createDataFrame([("t", "a", True), ("t", "b", False), ("u", "c", True)], "target string, path string, mentioned boolean"), 0.8)
    assert [r.target for r in gaps.collect()] == ["t"]


def test_cache(spark):
    files = spark.createDataFrame([("a.py", "def f(): pass"), ("b.py", "def g(): pass"), ("n.py", None)], "path string, content string")
    from tessera.extract.files import parse

    cache = parse(files.where("path = 'a.py'")).join(replay.cache_keys(files).select("path", "key"), "path")
    facts, new = replay.parsed_through_cache(files, cache)
    assert {r.path for r in new.collect()} == {"b.py", "n.py"}
    assert {r.path: len(r.definitions) for r in facts.collect()} == {"a.py": 1, "b.py": 1, "n.py": 0}
    key = replay.change_key(files, "x", "y", []).first().key
    assert key == replay.change_key(files.orderBy(F.desc("path")), "x", "y", []).first().key != replay.change_key(files.limit(2), "x", "y", []).first().key


def test_recorded_answers(spark):
    requests = replay.request_keys(spark.createDataFrame([("1", "body"), ("2", "other")], "id string, body string"), "p", "m", "template")
    recorded = requests.where("id = '1'").select("key", "template_hash", F.lit("yes").alias("answer"))
    known, unknown = replay.replayed(requests, recorded)
    assert known.first().answer == "yes" and [r.id for r in unknown.collect()] == ["2"]
    changed = replay.request_keys(requests.select("id", "body"), "p", "m", "another template")
    assert replay.replayed(changed, recorded)[0].count() == 0


def test_judge(spark):
    good = [("t", c, 4, "because", 4.0) for c in replay.JUDGE_CRITERIA]
    bad = [("u", "naming", 6, "", 2.0)]
    got = {(r.target, r.violation) for r in replay.judge_violations(spark.createDataFrame(good + bad, "target string, criterion string, score int, explanation string, overall double")).collect()}
    assert {t for t, _ in got} == {"u"} and len(got) == 3 + len(replay.JUDGE_CRITERIA) - 1


def test_documents(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("one\ntwo")
    (tmp_path / "src/x.png").write_text("no")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden/b.ts").write_text("no")
    assert [(r.path, r.content) for r in documents.source_files(spark, str(tmp_path)).collect()] == [("src/a.ts", "one\ntwo")]
    (tmp_path / ".tessera.toml").write_text("[rank]\nrisk = 0.5\n")
    assert documents.load_config(str(tmp_path), defaults={"rank": {"risk": 0.1, "x": 1}}) == {"rank": {"risk": 0.5, "x": 1}}
    (tmp_path / "m.json").write_text('{"version": "1", "groups": [{"name": "G", "files": ["a", "b"], "review_order": 1}], "unassigned_files": []}')
    assert [(r.name, r.path) for r in documents.manifest_files(documents.read_manifest(spark, str(tmp_path / "m.json"))).collect()] == [("G", "a"), ("G", "b")]
    (tmp_path / "package.json").write_text('{"workspaces": {"packages": ["packages/*"]}}')
    (tmp_path / "packages/ui/src").mkdir(parents=True)
    (tmp_path / "packages/ui/package.json").write_text('{"name": "@x/ui"}')
    (tmp_path / "packages/ui/src/index.ts").write_text("")
    assert [tuple(r) for r in documents.workspace_map(spark, str(tmp_path)).collect()] == [("@x/ui", "packages/ui/src/index.ts")]
    paths = spark.createDataFrame([("vendor/a.js",), ("src/a.js",), (".tessera/x",), ("src/gen/b.ts",)], "path string")
    kept = paths.where(~documents.ignored(F.col("path"), ["vendor/*", "*/gen/*"]))
    assert [r.path for r in kept.collect()] == ["src/a.js"]
