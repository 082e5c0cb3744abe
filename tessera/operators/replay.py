"""Cached facts and recorded answers: lookups, misses, requests, checks of replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores

JUDGE_CRITERIA = ("group_coherence", "naming", "ordering", "risk", "completeness")


def cache_keys(files: DataFrame) -> DataFrame:
    """`files` (path, content) with the key of their facts."""
    return files.withColumn("key", scores.content_key(F.col("path"), F.coalesce("content", F.lit(""))))


def looked_up(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the cache for known keys, and the files that it lacks."""
    keyed = cache_keys(files)
    hits = keyed.select("path", "key").join(cache.drop("path"), "key")
    return hits, keyed.join(cache.select("key"), "key", "left_anti")


def parsed_through_cache(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts of all files, and the new rows for the cache; only misses are parsed."""
    from ..extract.files import parse

    hits, misses = looked_up(files, cache)
    new = parse(misses.select("path", "content")).join(misses.select(F.col("path").alias("m_path"), "key"), F.col("path") == F.col("m_path")).drop("m_path")
    columns = [c for c in new.columns if c != "key"]
    return hits.select(*columns).unionByName(new.select(*columns)), new


def change_key(files: DataFrame, base: str, head: str, ignored: list[str]) -> DataFrame:
    """(key): one key of a change set from its ends, sorted paths with their contents, and ignore rules."""
    each = F.concat_ws("\0", "path", F.sha2(F.coalesce("content", F.lit("")), 256))
    body = F.array_join(F.array_sort(F.collect_list(each)), "\n")
    return files.agg(F.sha2(F.concat_ws("\n", F.lit(base), F.lit(head), body, F.lit("\n".join(sorted(ignored)))), 256).alias("key"))


def request_keys(requests: DataFrame, provider: str, model: str, template: str) -> DataFrame:
    """`requests` (id, body) with the key under which an answer is recorded."""
    hashed = F.sha2(F.lit(template), 256)
    return requests.withColumn("template_hash", hashed).withColumn("key", F.sha2(F.concat_ws("\n", F.lit(provider), F.lit(model), "body", "template_hash"), 256))


def replayed(requests: DataFrame, recorded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recorded answers of the same key and template, and the requests without one."""
    known = recorded.select("key", "template_hash", "answer")
    return requests.join(known, ["key", "template_hash"]), requests.join(known, ["key", "template_hash"], "left_anti")


def refinement_requests(groups: DataFrame, group_files: DataFrame) -> DataFrame:
    """(id, body): one request text that lists all groups with their files."""
    files = group_files.groupBy("group_id").agg(F.array_sort(F.collect_list("path")).alias("files"))
    one = groups.join(files, "group_id", "left").select(F.struct("review_order", "group_id", "name", F.coalesce("files", F.array().cast("array<string>")).alias("files")).alias("g"))
    return one.agg(F.array_sort(F.collect_list("g")).alias("groups")).select(F.lit("refinement").alias("id"), F.to_json(F.struct("groups")).alias("body"))


def judge_violations(replies: DataFrame) -> DataFrame:
    """(target, violation) of replies (target, criterion, score, explanation, overall).

    A reply has each criterion with a score from 1 to 5 and an explanation, and
    an overall score within half a point of the mean.
    """
    wrong = replies.where(~F.col("score").between(1, 5)).select("target", F.concat(F.lit("score out of range: "), "criterion").alias("violation"))
    silent = replies.where(F.coalesce(F.trim("explanation"), F.lit("")) == "").select("target", F.concat(F.lit("no explanation: "), "criterion").alias("violation"))
    every = replies.groupBy("target").agg(F.collect_set("criterion").alias("met"), F.avg("score").alias("mean"), F.max("overall").alias("overall"))
    gaps = every.select("target", F.explode(F.array_except(F.array(*[F.lit(c) for c in JUDGE_CRITERIA]), F.col("met"))).alias("c"))
    missing = gaps.select("target", F.concat(F.lit("missing: "), "c").alias("violation"))
    off = every.where(F.abs(F.col("overall") - F.col("mean")) > 0.5).select("target", F.lit("overall is far from the mean").alias("violation"))
    return wrong.unionByName(silent).unionByName(missing).unionByName(off)
