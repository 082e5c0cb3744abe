"""What a call does, judged by the text of its callee."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import either

# Names that mark what a call does.
WRITE_METHODS = (
    "save", "insert", "create", "update", "delete", "remove", "upsert", "bulkCreate", "bulkInsert", "insertMany", "updateMany",
    "deleteMany", "findAndUpdate", "findOneAndUpdate", "findOneAndDelete", "findOneAndRemove", "persist", "flush", "execute", "run",
)
WRITE_WORDS = ("insert into", "update ", "delete from", "drop table", "alter table", "create table", "truncate")
READ_METHODS = (
    "find", "findOne", "findById", "findAll", "findMany", "findFirst", "findUnique", "query", "select", "get", "fetch", "count",
    "aggregate", "groupBy", "where",
)
READ_WORDS = ("select ", "select\n")
EMIT_METHODS = ("emit", "publish", "send", "dispatch", "fire", "trigger", "broadcast", "notify", "produce", "enqueue")
HANDLE_METHODS = ("on", "subscribe", "listen", "addEventListener", "addListener", "handle", "consume", "onMessage", "onEvent")
CONFIG_READS = ("process.env", "os.environ", "os.getenv", "config.get", "config.set", "dotenv", "Deno.env")
HTTP_CALLS = (
    "fetch", "axios.get", "axios.post", "axios.put", "axios.delete", "axios.patch", "axios.request", "requests.get", "requests.post",
    "requests.put", "requests.delete", "requests.patch", "http.get", "http.post", "http.request", "urllib.request", "httpx.get", "httpx.post",
)
LOG_CALLS = (
    "console.log", "console.error", "console.warn", "console.info", "console.debug", "console.trace", "logger.info", "logger.error",
    "logger.warn", "logger.debug", "logger.trace", "logger.fatal", "logging.info", "logging.error", "logging.warning",
    "logging.debug", "logging.critical", "log.info", "log.error", "log.warn", "log.debug",
)
COLLECTION_METHODS = (
    "push", "pop", "shift", "unshift", "splice", "slice", "concat", "join", "reverse", "sort", "fill", "copyWithin", "flat", "flatMap",
    "map", "filter", "reduce", "forEach", "some", "every", "includes", "indexOf", "find", "findIndex", "append", "extend", "clear",
    "copy", "items", "len", "keys", "values", "entries", "toString", "toLocaleString", "has", "add", "parse", "stringify", "assign",
    "from", "resolve", "reject", "now", "round", "floor", "ceil", "abs", "min", "max", "charAt", "charCodeAt", "trim", "split",
    "replace", "match", "startsWith", "endsWith", "padStart", "padEnd", "repeat", "toLowerCase", "toUpperCase",
)
LIBRARY_CALLS = (
    "JSON.parse", "JSON.stringify", "Object.create", "Object.assign", "Array.from", "Promise.resolve", "Promise.reject", "Date.now",
    "Math.round", "Math.floor", "Math.ceil", "Math.abs", "Math.min", "Math.max",
)
OTHER_RECEIVERS = (
    "array", "map", "set", "object", "string", "number", "promise", "json", "math", "date", "regexp", "cache", "localstorage",
    "sessionstorage", "window", "document", "navigator", "console", "process", "os", "path", "fs", "http", "https", "url", "buffer",
    "stream", "crypto", "util", "events", "child_process", "cluster", "net", "tls", "dns", "axios", "requests", "fetch", "httpx",
    "urllib", "list", "dict", "tuple", "frozenset", "deque", "defaultdict", "items", "result", "results", "data", "response",
    "request", "config", "env", "settings", "options", "args", "params", "logger", "log", "logging",
)
DATABASE_WORDS = (
    "db", "database", "repo", "repository", "model", "store", "dao", "collection", "prisma", "sequelize", "typeorm", "mongoose",
    "drizzle", "session", "connection", "pool", "client", "table", "entity", "schema", "migration", "knex", "query", "sql",
)
MAPPER_WORDS = ("prisma", "sequelize", "typeorm", "mongoose", "sqlalchemy", "drizzle")
SURE_RECEIVERS = ("db", "repo", "model", "store", "dao", "collection")


def _any_of(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w).replace("\\\n", "\n") for w in words)


def method(callee: Column) -> Column:
    return F.substring_index(callee, ".", -1)


def receiver(callee: Column) -> Column:
    """What precedes the last dot; null without a dot."""
    return F.when(callee.contains("."), F.regexp_replace(callee, r"\.[^.]*$", ""))


def has_database_receiver(callee: Column) -> Column:
    """A receiver of two characters or more that names a database and is none of the common others."""
    own = F.lower(receiver(callee))
    return F.coalesce((F.octet_length(receiver(callee)) > 1) & ~own.isin(*OTHER_RECEIVERS) & own.rlike(_any_of(DATABASE_WORDS)), F.lit(False))


def _begins(callee: Column, name: str, following: tuple[str, ...]) -> Column:
    return (callee == name) | either(*[callee.startswith(name + f) for f in following])


def pattern(callee: Column) -> Column:
    """Kind of call, null for calls of no interest. Specific names are tried before general ones."""
    member = callee.contains(".")
    lower = F.lower(callee)
    config = callee.startswith("process.env") | callee.startswith("os.environ") | either(*[_begins(callee, c, (".", "[")) for c in CONFIG_READS])
    writes = (member & method(callee).isin(*WRITE_METHODS) & has_database_receiver(callee)) | lower.rlike(_any_of(WRITE_WORDS))
    reads = (member & method(callee).isin(*READ_METHODS) & has_database_receiver(callee)) | lower.rlike(_any_of(READ_WORDS))
    return (
        F.when(callee.isin(*LOG_CALLS), "Logging")
        .when(config, "ConfigRead")
        .when(either(*[_begins(callee, c, (".",)) for c in HTTP_CALLS]), "HttpCall")
        .when(method(callee).isin(*COLLECTION_METHODS) | callee.isin(*LIBRARY_CALLS), F.lit(None).cast("string"))
        .when(member & method(callee).isin(*EMIT_METHODS), "EventEmission")
        .when(member & method(callee).isin(*HANDLE_METHODS), "EventHandling")
        .when(writes, "Persistence")
        .when(reads, "DatabaseRead")
    )


def confidence(callee: Column, kind: Column) -> Column:
    """How sure the kind is; for database calls by how plainly the receiver names one."""
    lower = F.lower(callee)
    first = F.substring_index(lower, ".", 1)
    database = (
        F.when(lower.rlike(_any_of(MAPPER_WORDS)), 0.95)
        .when(first.rlike(_any_of(SURE_RECEIVERS)), 0.9)
        .when(lower.rlike(_any_of(WRITE_WORDS + READ_WORDS)), 0.95)
        .otherwise(0.7)
    )
    return F.when(kind == "Logging", 0.95).when(kind == "ConfigRead", 0.9).when(kind == "HttpCall", 0.85).when(kind.isin("EventEmission", "EventHandling"), 0.8).when(kind.isNotNull(), database)


#: The graph edge that a call of each kind adds; logging adds none.
EDGE_TYPES = {"Persistence": "Writes", "DatabaseRead": "Reads", "EventEmission": "Emits", "EventHandling": "Handles", "ConfigRead": "Reads", "HttpCall": "Reads"}
