"""Change sets made from the driver's tables, in Spark and in SQL.

The operators work on repository paths, call sites, groups and graphs. Each
adapter derives such a table from whole driver tables by the same rule on
both sides, so an operator's result can be compared with SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIRECTORIES = (
    "src/api/routes", "src/auth", "src/db/migrations", "packages/core/ui/src", "apps/web/pages", "docs", "docs/user", "docs/tutorial",
    "scripts", "deploy/prod", "internal/schema", "tests/unit", "services/billing/src/handlers", "lib/generated", "www/docs/guide",
    "fixtures/demo", "crates/engine/src", "vendor/acme", "docs/zh-hant/docs", "cmd/tool/commands", "src/docs/api", "config",
    "test/fixtures/sample", "src/workers",
)
NAMES = (
    "index.ts", "user.service.ts", "user.service.test.ts", "README.md", "Dockerfile", "schema.sql", "test_models.py", "models.py",
    "UserTest.java", "User.java", "config.ts", "handler_test.go", "handler.go", "quickstart.md", "build.sh", "api.pb.go",
    "package.json", "order.dto.ts", "Permission.kt", "main.rs", ".eslintrc.json", "guide.rst", "theme-dark.css", "page.tsx",
    "2024-notes-list.txt", "ClusterSpec.scala", "stream.h",
)
CALLEES = (
    "console.log", "process.env.HOME", "axios.get", "items.map", "bus.emit", "socket.on", "userRepo.save", "prisma.user.findMany",
    "db.query", "fetch", "JSON.parse", "x.save", "cache.get", "client.execute", "SELECT * FROM t", "logger.warn", "os.environ",
    "orders.find", "queue.publish", "sessionPool.run", "config.get", "requests.get.json", "model.update", "render",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def picked(values: tuple[str, ...], place):
    """The value at a place counted from 0, around the end."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (place % len(values) + 1).cast("int"))


def picked_sql(values: tuple[str, ...], place: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][CAST(({place}) % {len(values)} + 1 AS INTEGER)]"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path): a repository path for each document."""
    id = F.col("doc_id")
    path = F.concat_ws("/", picked(DIRECTORIES, id), picked(NAMES, F.floor(id / len(DIRECTORIES))))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))


PATHS_SQL = f"""paths AS (
  SELECT doc_id, {picked_sql(DIRECTORIES, 'doc_id')} || '/' || {picked_sql(NAMES, f'doc_id // {len(DIRECTORIES)}')} AS path FROM documents
)"""


def group_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_no, group_id, path, additions, deletions): orders as changed files of a customer's group."""
    key = F.col("o_orderkey")
    path = F.concat_ws("/", picked(DIRECTORIES, F.col("o_custkey")), picked(NAMES, key))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("group_no"),
        F.concat(F.lit("group_"), F.col("o_custkey").cast("string")).alias("group_id"),
        path.alias("path"),
        F.floor(F.col("o_totalprice") % 97).cast("bigint").alias("additions"),
        F.floor(F.col("o_totalprice") % 31).cast("bigint").alias("deletions"),
        key.alias("pos"),
    )


GROUP_FILES_SQL = f"""group_files AS (
  SELECT o_custkey AS group_no, 'group_' || CAST(o_custkey AS VARCHAR) AS group_id,
    {picked_sql(DIRECTORIES, 'o_custkey')} || '/' || {picked_sql(NAMES, 'o_orderkey')} AS path,
    CAST(floor(o_totalprice % 97) AS BIGINT) AS additions, CAST(floor(o_totalprice % 31) AS BIGINT) AS deletions, o_orderkey AS pos
  FROM orders
)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, pos, callee, containing_function, line): events as call sites of a user's file."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit(".ts")).alias("path"),
        F.col("event_id").alias("pos"),
        picked(CALLEES, F.col("event_id")).alias("callee"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("containing_function"),
        (F.col("event_id") % 500).alias("line"),
    )


CALLS_SQL = f"""calls AS (
  SELECT 'src/u' || CAST(user_id AS VARCHAR) || '.ts' AS path, event_id AS pos, {picked_sql(CALLEES, 'event_id')} AS callee,
    CASE WHEN event_id % 3 <> 0 THEN event_type END AS containing_function, event_id % 500 AS line
  FROM events
)"""


def chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): a sparse directed graph over order numbers with chains, trees and cycles."""
    key = F.col("o_orderkey")
    to = F.when(key % 5 == 0, F.floor(key / 3)).when(key % 7 == 0, key - 7).when(key % 11 == 0, key + 4)
    return table(spark, sf_dir, "orders").select(key.alias("src"), to.cast("bigint").alias("dst")).where("dst IS NOT NULL AND dst != src")


CHAIN_EDGES_SQL = """chain_edges AS (
  SELECT o_orderkey AS src, CAST(CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey // 3 WHEN o_orderkey % 7 = 0 THEN o_orderkey - 7
    WHEN o_orderkey % 11 = 0 THEN o_orderkey + 4 END AS BIGINT) AS dst FROM orders
), chain AS (SELECT DISTINCT src, dst FROM chain_edges WHERE dst IS NOT NULL AND dst <> src)"""
