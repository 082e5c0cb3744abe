"""JSON, JSON lines and TOML documents: configurations, manifests, histories, caches."""

from __future__ import annotations

import fnmatch
import glob
import json
import os
import re
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version string, groups array<struct<name:string,files:array<string>,review_order:bigint,description:string>>, unassigned_files array<string>"
HISTORY = "timestamp string, avg_overall double, passed boolean, fixture_count bigint, fixtures array<struct<name:string,overall:double>>"
# File name endings that are not read as text.
BINARY = ("png", "jpg", "jpeg", "gif", "ico", "woff", "woff2", "ttf", "eot", "pdf", "zip", "gz", "lock")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path, multiLine=True)


def manifest_files(manifest: DataFrame) -> DataFrame:
    """(name, review_order, path): a row for each file of each group."""
    groups = manifest.select(F.explode("groups").alias("g"))
    return groups.select("g.name", "g.review_order", F.explode("g.files").alias("path"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON lines file; lines that cannot be read are dropped."""
    return spark.read.schema(HISTORY).option("mode", "DROPMALFORMED").json(path).where("timestamp IS NOT NULL")


def append_history(history: DataFrame, path: str) -> None:
    history.write.mode("append").json(path)


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content): text files below a directory, without hidden and binary ones."""
    read = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("at"), F.col("value").alias("content"))
    inside = F.regexp_replace(F.expr("try_url_decode(at)"), "^file:/+", "/")
    path = F.regexp_replace(inside, "^" + os.path.abspath(root).replace(".", r"\.") + "/", "")
    hidden = path.rlike(r"(^|/)\.")
    return read.select(path.alias("path"), "content").where(~hidden & ~F.lower(F.substring_index("path", ".", -1)).isin(*BINARY))


def load_config(directory: str, name: str = ".tessera.toml", defaults: dict | None = None) -> dict:
    """Settings of a repository over the defaults."""
    path = os.path.join(directory, name)
    own = {}
    if os.path.exists(path):
        with open(path, "rb") as f:
            own = tomllib.load(f)
    return overlaid(defaults or {}, own)


def overlaid(base: dict, over: dict) -> dict:
    """Nested settings: those of `over` first."""
    out = dict(base)
    for key, value in over.items():
        out[key] = overlaid(base[key], value) if isinstance(value, dict) and isinstance(base.get(key), dict) else value
    return out


def workspace_map(spark: SparkSession, root: str) -> DataFrame:
    """(package, entry): packages of a monorepo's workspaces with their entry files."""
    rows = []
    try:
        with open(os.path.join(root, "package.json"), encoding="utf-8") as f:
            declared = json.load(f).get("workspaces", [])
    except (OSError, ValueError):
        declared = []
    for pattern in declared.get("packages", []) if isinstance(declared, dict) else declared:
        for folder in sorted(glob.glob(os.path.join(root, pattern))):
            try:
                with open(os.path.join(folder, "package.json"), encoding="utf-8") as f:
                    package = json.load(f)
            except (OSError, ValueError):
                continue
            inside = os.path.relpath(folder, root)
            entries = [package.get("source"), "src/index.ts", "src/index.tsx", "src/index.js", "index.ts", "index.js", package.get("main")]
            entry = next((e for e in entries if e and os.path.exists(os.path.join(folder, e))), None)
            if package.get("name") and entry:
                rows.append((package["name"], f"{inside}/{entry}"))
    return spark.createDataFrame(rows, "package string, entry string")


def ignored(path, globs: list[str], own: str = ".tessera/"):
    """Whether a path is the tool's own or matches a glob; `**` spans directories."""
    out = path.startswith(own)
    for g in globs:
        out = out | path.rlike("^" + re.sub(r"\\[zZ]$", "", fnmatch.translate(g)) + "$")
    return out
