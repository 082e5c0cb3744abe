import json

from tessera.streaming import jobs


def write(folder, name, events):
    (folder / name).write_text("".join(json.dumps(e) + "\n" for e in events))


def event(job, seq, kind):
    return {"job_id": job, "seq": seq, "type": kind, "payload": "{}", "timestamp_ms": 1_700_000_000_000 + seq * 1000}


def test_states_follow_the_log_and_count_replayed_events_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    write(log, "1.json", [event("a", 0, "JobStarted"), event("a", 1, "ActivityUpdate"), event("b", 0, "JobStarted")])
    write(log, "2.json", [event("a", 1, "ActivityUpdate"), event("a", 2, "JobCompleted"), event("a", 3, "ActivityUpdate")])
    states = jobs.job_states(jobs.read_events(spark, str(log)))
    query = states.writeStream.format("memory").queryName("states").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    live = {r.job_id: (r.events, r.last_seq, r.ended_at, r.outcome) for r in spark.table("states").collect()}
    assert live == {"a": (4, 3, 2, "JobCompleted"), "b": (1, 0, None, None)}
    batch = spark.read.schema(jobs.EVENTS).json(str(log))
    assert {r.job_id: (r.events, r.last_seq, r.ended_at, r.outcome) for r in jobs.job_states(batch).collect()} == live
    assert [r.seq for r in jobs.replay(batch, "a", 0).collect()] == [1, 2]


def test_append_once(spark, tmp_path):
    log, out = tmp_path / "log", tmp_path / "out"
    log.mkdir()
    write(log, "1.json", [event("a", 0, "JobStarted")])
    for _ in range(2):
        q = jobs.append_to(jobs.read_events(spark, str(log)), str(out), str(tmp_path / "ck"))
        q.processAllAvailable()
        q.stop()
    assert spark.read.schema(jobs.EVENTS).json(str(out)).count() == 1


def test_comments(spark):
    schema = "id string, analysis_hash string, type string, group_id string, file_path string, start_line bigint, end_line bigint, selected_code string, text string, created_at string"
    old = spark.createDataFrame([("1", "h", "file", "g", "a.ts", None, None, None, "one", "1"), ("2", "other", "group", "g", None, None, None, None, "two", "2")], schema)
    new = spark.createDataFrame([("3", "h", "code", "g", "a.ts", 1, 2, "x", "three", "3"), ("4", "h", "odd", "g", None, None, None, None, "four", "4")], schema)
    kept = jobs.saved(old, new)
    assert {r.id for r in kept.collect()} == {"1", "3", "4"}
    changed = jobs.updated(kept, spark.createDataFrame([("1", "uno")], "id string, text string"))
    assert {r.text for r in changed.collect()} == {"uno", "three", "four"}
    assert jobs.deleted(kept, spark.createDataFrame([("3",)], "id string")).count() == 2
    assert jobs.exported(changed).first().text == "a.ts\n> uno\n\na.ts:1-2\nx\n> three"
