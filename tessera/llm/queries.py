"""The queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in each document."""
    from .decontaminate import find

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = find(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, compared with its edited text and with the next document."""
    from .fingerprint import compare_neighbours, measured_rarity

    docs = table(spark, sf_dir, "documents")
    return compare_neighbours(docs, ranked=measured_rarity(spread(docs.select("text"))))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, with linked credential parts."""
    from .secret_scan import scan

    return scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's WARC record, and what an audit against a damaged replica says of it.

    The tables hold one copy of the pages, so the other replica is that copy
    with damage: a changed first character where the SHA-256 of the html
    begins with 00, no record where it begins with 01.
    """
    from .warc_audit import audit, records, tree

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    mark = F.substring(F.sha2(F.col("html").cast("binary"), 256), 1, 2)
    damaged = F.when(mark == "00", F.concat(F.lit("?"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    other = pages.where(F.coalesce(mark != "01", F.lit(True))).withColumn("html", damaged)
    own = tree(records(pages))
    found = audit(own, tree(records(other))).select(*[F.col(c).alias(f"f_{c}") for c in ("file", "place", "state")])
    met = own[0].join(found, (F.col("file") == F.col("f_file")) & (F.col("place") == F.col("f_place")), "left")
    return met.select("page_id", "file", "place", "copies", F.col("hash").alias("record_sha256"), F.col("begin").alias("begin_offset"), F.col("end").alias("end_offset"), F.coalesce("f_state", F.lit("ok")).alias("state"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels outside the held-out third."""
    from .toxicity import classify, fit, held_out

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(spread(docs), fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document, learned from six sevenths of them."""
    from .lm_trie import score
    from .toxicity import held_out

    out = held_out(F.col("doc_id"), 7, 2)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", out.alias("held_out"))
    scored = score(spread(docs), ~F.col("held_out"), keep=["doc_id", "held_out"], order=3)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt to 16 shards by jump hashing of doc_id."""
    from .jump_shards import assign_shards, assign_slots

    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    dealt = assign_slots(assign_shards(docs, "doc_id", 16, grown="grown_shard"), "shard", ["doc_id", "text_crc32", "size"])
    return dealt.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    from .simhash import near_duplicates

    groups = near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document."""
    from .license_scan import scan

    return scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public tokenizer files lie."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to token ids and decoded again."""
    from .bpe import round_trip

    return round_trip(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), vocabulary_path())
