import hashlib

from pyspark.sql import functions as F

from tessera.llm.warc_audit import FILE_RECORDS, audit, corpus_root_of, levels, records, tree

SCHEMA = "page_id bigint, url string, html string, hash string"


def pages(spark, n=1200):
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>", "own") for i in range(n)]
    rows += [(3, "http://x/3", "<p>3</p>", "own")] * 2 + [(None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_levels_cover_a_file():
    assert levels() == 3 and levels(1) == 1 and levels(9, 8) == 2


def test_leaves(spark):
    leaf = {r.page_id: r for r in records(pages(spark, 5)).collect()}
    raw = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: http://x/1\r\nContent-Type: text/html\r\nContent-Length: 8\r\n\r\n<p>1</p>\r\n\r\n"
    assert leaf[1].hash == hashlib.sha256(raw).hexdigest() and (leaf[1].begin, leaf[1].end) == (len(raw), 2 * len(raw))
    assert leaf[3].copies == 3 and leaf[3].end - leaf[3].begin == 3 * len(raw)
    assert leaf[None].file == "none-0"


def test_damage_is_located(spark):
    left = pages(spark)
    broken = F.when(F.col("page_id") == 700, "<p>x</p>").otherwise(F.col("html"))
    right = left.withColumn("html", broken).where("page_id IS NULL OR page_id != 40").unionByName(spark.createDataFrame([(5000, "u", "new", "h"), (1, "http://x/1", "<p>1</p>", "again")], SCHEMA))
    a, b = tree(records(left)), tree(records(right))
    found = {(r.page_id, r.state) for r in audit(a, b).collect()}
    assert found == {(700, "corrupt"), (40, "missing"), (5000, "extra"), (1, "corrupt")}
    assert corpus_root_of(a).first() != corpus_root_of(b).first()


def test_equal_and_empty_replicas(spark):
    left = pages(spark, 600)
    assert audit(tree(records(left)), tree(records(left.repartition(5)))).count() == 0
    assert corpus_root_of(tree(records(left))).first() == corpus_root_of(tree(records(left.repartition(3)))).first()
    none = tree(records(left.limit(0)))
    assert audit(none, none).count() == 0
    assert audit(tree(records(left)), none).where("state = 'missing'").count() == 601


def test_overfull_files_are_split(spark):
    hot = spark.range(3 * FILE_RECORDS).select(F.lit(7).cast("bigint").alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html"))
    files = records(hot).groupBy("file").count().collect()
    assert len(files) > 3 and max(r["count"] for r in files) < FILE_RECORDS
    assert audit(tree(records(hot)), tree(records(hot.where("html != '9'")))).count() == 1


def test_one_missing_record_changes_one_node_a_level(spark):
    left = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>", "own") for i in range(2 * FILE_RECORDS)], SCHEMA)
    a, b = tree(records(left)), tree(records(left.where("page_id != 3")))
    for level in range(1, len(a)):
        rows = [{(r.file, r.slot): r.hash for r in side[level].collect()} for side in (a, b)]
        assert len([k for k in rows[0].keys() | rows[1].keys() if rows[0].get(k) != rows[1].get(k)]) == 1
    assert [(r.page_id, r.place, r.state) for r in audit(a, b).collect()] == [(3, 3, "missing")]
