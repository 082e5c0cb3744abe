"""Entrypoints of files, by rules over imports, calls, definitions, exports and paths.

A rule says for which languages and files it holds, on which facts it looks,
and what symbol it reports. All rules of one kind of fact are evaluated in a
single projection over the facts joined once with their files.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.rules import either
from .ranking import first_detections

JS = ("TypeScript", "JavaScript")
VERBS = ("get", "post", "put", "delete", "patch")
MORE_VERBS = (*VERBS, "head", "options")


@dataclass(frozen=True)
class Rule:
    """`on` is call, definition, export or file; `when` tests a fact, `gate` its file."""

    kind: str
    on: str
    languages: tuple[str, ...] | None = None
    gate: Callable[[], Column] | None = None
    when: Callable[[], Column] | None = None
    symbol: str = "scope"


def source(*exact: str, starts: tuple[str, ...] = (), has: tuple[str, ...] = (), under: str = "") -> Column:
    """Whether a file imports one of these sources; `under` lists separators that may follow an exact one."""

    def one(s: Column) -> Column:
        tests = [s.isin(*exact)] if exact else []
        tests += [s.startswith(x) for x in starts] + [s.contains(x) for x in has]
        tests += [s.startswith(x + mark) for x in exact for mark in under]
        return either(*tests)

    return F.exists("sources", one)


def imported(*names: str, ends: str = "") -> Column:
    def one(n: Column) -> Column:
        return n.isin(*names) | n.endswith(ends) if ends else n.isin(*names)

    return F.exists("imported", one)


def imported_from(origin: str, *names: str) -> Column:
    return F.exists("origins", lambda o: (o["source"] == origin) & F.exists(o["names"], lambda n: n.isin(*names)))


def path_has(*parts: str) -> Column:
    return either(*[F.col("path").contains(p) for p in parts])


def path_ends(*parts: str) -> Column:
    return either(*[F.col("path").endswith(p) for p in parts])


def lower_has(*parts: str) -> Column:
    return either(*[F.lower("path").contains(p) for p in parts])


def name_has(*parts: str) -> Column:
    """`.part.` in the lower-case file name."""
    name = paths.filename(F.lower("path"))
    return either(*[name.contains(f".{p}.") for p in parts])


def called(*exact: str) -> Column:
    return F.col("callee").isin(*exact)


def callee_has(*parts: str) -> Column:
    return either(*[F.col("callee").contains(p) for p in parts])


def method() -> Column:
    return F.when(F.col("callee").contains("."), F.substring_index("callee", ".", -1))


def is_function() -> Column:
    return F.col("kind") == "Function"


def public_function(*but: str) -> Column:
    return is_function() & ~F.col("name").startswith("_") & (~F.col("name").isin(*but) if but else F.lit(True))


def next_route() -> Column:
    return (lower_has("/app/") | F.lower("path").startswith("app/")) & paths.filename(F.col("path")).startswith("route.")


def next_page() -> Column:
    inside = lower_has("/pages/") | F.lower("path").startswith("pages/")
    return inside & ~paths.filename(F.col("path")).startswith("_") & ~lower_has("/api/")


def react_page() -> Column:
    return ~next_route() & (paths.filename(F.col("path")).startswith("page.") | next_page())


# Imports that tell a web or command-line framework, by language.
WEB: dict[tuple[str, ...], Callable[[], Column]] = {
    JS: lambda: source("express", "fastify", "@hapi/hapi", "koa", "@trpc/server", "hono", "@nestjs/common", "@nestjs/core", "next", "nuxt", "sveltekit", "restify", "polka", "@effect/platform", starts=("@remix-run/",)),
    ("Python",): lambda: source("flask", "fastapi", "django", "starlette", "sanic", "aiohttp", "tornado", "bottle", "falcon", "pyramid", starts=("django.", "starlette.", "aiohttp.", "tornado.", "pyramid.")),
    ("Go",): lambda: source("net/http", "github.com/gin-gonic/gin", starts=("github.com/labstack/echo", "github.com/go-chi/chi", "github.com/gofiber/fiber", "github.com/gorilla/mux")),
    ("Rust",): lambda: source("actix_web", "actix-web", "axum", "rocket", "warp", "hyper", "tower", starts=("actix_web::", "actix-web::", "axum::", "rocket::", "warp::", "hyper::", "tower::")),
    ("Java",): lambda: source(starts=("org.springframework.web", "javax.ws.rs", "jakarta.ws.rs", "io.javalin", "io.micronaut.http", "io.quarkus")),
    ("CSharp",): lambda: source(starts=("Microsoft.AspNetCore", "System.Web.Http", "Carter", "ServiceStack")),
    ("Php",): lambda: source(starts=("Illuminate\\Routing", "Symfony\\Component\\Routing", "Slim\\App")),
    ("Ruby",): lambda: source("sinatra", "rails", "grape", "hanami", "roda"),
    ("Kotlin",): lambda: source(starts=("org.springframework.web", "io.ktor", "io.javalin", "io.micronaut.http")),
    ("Swift",): lambda: source("Vapor", "Kitura", "Hummingbird"),
    ("Scala",): lambda: source(starts=("akka.http", "http4s", "play.api", "zio.http", "cask")),
}
COMMAND_LINE: dict[tuple[str, ...], Callable[[], Column]] = {
    JS: lambda: source("commander", "yargs", "meow", "cac", "oclif", "@effect/cli", "inquirer", "vorpal", "caporal", "clipanion"),
    ("Python",): lambda: source("argparse", "click", "typer", "fire", "docopt", "plac"),
    ("Go",): lambda: source("flag", starts=("github.com/spf13/cobra", "github.com/urfave/cli")),
    ("Rust",): lambda: source(starts=("clap", "structopt", "argh", "gumdrop")),
}


def framework(table: dict[tuple[str, ...], Callable[[], Column]]) -> Column:
    return either(*[F.col("language").isin(*languages) & test() for languages, test in table.items()])


def strong_route_path() -> Column:
    return lower_has("/routes/", "/handlers/", "/controllers/", "/endpoints/", "entrypoint") | name_has("controller", "controllers")


def route_path() -> Column:
    return lower_has("/routes/", "/route/", "/handlers/", "/handler/", "/controllers/", "/controller/", "/endpoints/", "/endpoint/") | name_has("routes", "route", "handler", "handlers", "controller", "controllers", "endpoint", "endpoints")


def command_path() -> Column:
    return lower_has("/commands/", "/command/", "/cmd/", "/cli/") | name_has("command", "commands", "cli")


def worker_path() -> Column:
    return path_has("/workers/", "/jobs/", "/consumers/", "/tasks/") | path_ends("_worker.py", "_worker.ts", "_worker.js", "Worker.ts", "Worker.js")


def cron_path() -> Column:
    return path_has("/cron/", "/scheduler/", "/scheduled/") | path_ends("_cron.py", "_scheduler.py")


def command_file() -> Column:
    return path_has("/cli/", "/cmd/", "/bin/") | path_ends("/main.ts", "/main.js", "/cli.ts", "/cli.js", "/cli.py", "/main.go")


def test_path() -> Column:
    name = paths.filename(F.col("path"))
    lower = F.lower("path")
    by_language = {
        ".java": name.rlike(r"(Test|Tests)\.java$|^Test"), ".cs": name.rlike(r"(Tests|Test)\.cs$"), ".php": name.rlike(r"(Test|Tests)\.php$"),
        ".rb": name.rlike(r"(_spec|_test)\.rb$") | lower.contains("/spec/"), ".kt": name.rlike(r"(Test|Tests)\.kt$|^Test"), ".swift": name.rlike(r"(Tests|Test)\.swift$"),
        ".c": name.endswith("_tests.c"), ".h": name.endswith("_tests.c"), ".cpp": name.rlike(r"(_tests|Test)\.(cpp|cc)$"), ".cc": name.rlike(r"(_tests|Test)\.(cpp|cc)$"),
        ".cxx": name.rlike(r"(_tests|Test)\.(cpp|cc)$"), ".scala": name.rlike(r"(Test|Tests|Spec|Suite)\.scala$|^Test"),
    }
    general = lower_has(".test.", ".spec.", "_test.", "__tests__/", "/tests/", "/test/") | lower.startswith("tests/") | lower.startswith("test/") | name.startswith("test_") | lower.endswith("_tests.rs")
    return general | either(*[lower.endswith(ext) & rule for ext, rule in by_language.items()])


def test_name() -> Column:
    return F.col("name").rlike("^(test_|it_|Test|Benchmark|Example)") | F.col("name").isin("describe", "it", "test", "TEST", "TEST_F", "TEST_P", "TEST_CASE", "SCENARIO")


def go_web() -> Column:
    return WEB[("Go",)]()


def rust_web() -> Column:
    return source(starts=("actix_web", "actix-web", "axum", "rocket", "warp", "hyper", "tower"))


def spring() -> Column:
    return source(starts=("org.springframework.web", "org.springframework.boot", "org.springframework.stereotype"))


def jaxrs() -> Column:
    return source(starts=("jakarta.ws.rs", "javax.ws.rs"))


def servlet() -> Column:
    return source(starts=("jakarta.servlet", "javax.servlet"))


def aspnet() -> Column:
    return source(starts=("Microsoft.AspNetCore", "Microsoft.AspNet", "System.Web"))


def php_web() -> Column:
    return source(starts=("Illuminate\\", "Laravel\\", "Symfony\\"))


def small_ruby() -> Column:
    return source("sinatra", "sinatra/base", "grape")


def rails() -> Column:
    return source("action_controller", "rails", "active_record")


def ktor() -> Column:
    return source(starts=("io.ktor",))


def kotlin_spring() -> Column:
    return source(starts=("org.springframework",))


def c_web() -> Column:
    return source(has=("crow", "httplib", "pistache", "drogon", "cpprest", "beast", "mongoose"))


def akka() -> Column:
    return source(starts=("akka.http",))


def play() -> Column:
    return source(starts=("play.api.mvc", "play.mvc"))


def http4s() -> Column:
    return source(starts=("org.http4s",))


def in_file(*folders: str, ends: str = "") -> Column:
    return path_has(*folders) | (paths.filename(F.col("path")).endswith(ends) if ends else F.lit(False))


HANDLER_FOLDERS = ("/handler", "/handlers/", "/routes/", "/api/")
MAIN_LANGUAGES = ("Python", "Go", "Rust", "Java", "CSharp", "Php", "Ruby", "Kotlin", "Swift", "C", "Cpp")
QUEUES = ("amqplib", "bull", "bullmq", "bee-queue", "sqs-consumer", "kafkajs", "celery", "kombu", "pika", "aio_pika", "rq")
CRONS = ("node-cron", "cron", "node-schedule", "agenda", "apscheduler", "schedule", "celery", "celery.schedules")
EVENT_SOURCES = ("events", "eventemitter3", "mitt", "rxjs", "socket.io", "ws")
HTTP_API = ("HttpApi", "HttpApiEndpoint", "HttpApiGroup", "HttpRouter", "HttpServer", "HttpApiBuilder")


def effect_http() -> Column:
    last = F.exists("sources", lambda s: F.substring_index(s, "/", -1).isin(*HTTP_API))
    return source("@effect/platform", "@effect/platform-node", "@effect/platform-bun", starts=("@effect/platform/Http",)) | last | imported(*HTTP_API)


#: In the order in which detectors are tried; of one (file, symbol) the first counts.
RULES: list[Rule] = [
    Rule("TestFile", "definition", None, test_path, test_name, "name"),
    Rule("TestFile", "file", None, lambda: test_path() & ~F.col("has_test_name"), None, "stem"),
    Rule("HttpRoute", "export", JS, next_route, lambda: F.upper("name").isin("GET", "POST", "PUT", "DELETE", "PATCH", "OPTIONS", "HEAD", "ALL"), "name"),
    Rule("HttpRoute", "export", JS, next_page, lambda: F.col("is_default") & (F.col("pos") == F.col("first_default")), "name"),
    Rule("HttpRoute", "call", JS, None, lambda: F.substring_index("callee", ".", 1).isin("app", "router", "server") & F.expr("substring(callee, instr(callee, '.') + 1)").isin(*MORE_VERBS, "all") & F.col("callee").contains(".")),
    Rule("HttpRoute", "call", ("Python",), None, lambda: called(*[f"{o}.{m}" for o in ("app", "router") for m in ("route", *VERBS)], "api_view"), "scope_only"),
    Rule("HttpRoute", "definition", ("Python",), lambda: (path_has("/views/", "/routes/", "/endpoints/") | path_ends("views.py", "routes.py", "endpoints.py")) & WEB[("Python",)](), public_function, "name"),
    Rule("HttpRoute", "call", ("Go",), go_web, lambda: called("http.HandleFunc", "http.Handle", "http.ListenAndServe") | F.lower(method()).isin(*MORE_VERBS, "any", "group") | method().isin("HandleFunc", "Handle")),
    Rule("HttpRoute", "definition", ("Go",), lambda: go_web() & path_has(*HANDLER_FOLDERS), lambda: is_function() & F.col("name").rlike(r"^\p{Lu}") & F.col("name").rlike("Handler|Handle$|^Handle"), "name"),
    Rule("HttpRoute", "call", ("Rust",), rust_web, lambda: callee_has("Router::new", ".route", "routing::get", "routing::post", "routing::put", "routing::delete", "web::resource", "web::scope", "App::new", ".service", "HttpServer::new", "routes!", ".mount", "rocket::build") | called("get", "post", "put", "delete")),
    Rule("HttpRoute", "definition", ("Rust",), lambda: rust_web() & path_has(*HANDLER_FOLDERS), is_function, "name"),
    Rule("HttpRoute", "definition", ("Java",), lambda: spring() & imported("RestController", "Controller", "RequestMapping", ends="Mapping"), lambda: is_function() & (F.col("name") != "<init>"), "name"),
    Rule("HttpRoute", "definition", ("Java",), lambda: jaxrs() & imported("Path", "GET", "POST", "PUT", "DELETE"), is_function, "name"),
    Rule("HttpRoute", "definition", ("Java",), servlet, lambda: is_function() & F.col("name").isin("doGet", "doPost", "doPut", "doDelete", "doHead", "doOptions"), "name"),
    Rule("HttpRoute", "definition", ("Java",), lambda: servlet() & ~spring() & ~jaxrs() & path_has("/controller", "/controllers/", "/resource/", "/resources/", "/endpoint/", "/endpoints/", "/api/"), is_function, "name"),
    Rule("HttpRoute", "definition", ("CSharp",), lambda: ~aspnet() & in_file("/Controllers/", "/controllers/", "/Endpoints/", "/endpoints/", "/Api/", "/api/", ends="Controller.cs"), is_function, "name"),
    Rule("HttpRoute", "definition", ("CSharp",), lambda: source(starts=("Microsoft.AspNetCore.Mvc", "Microsoft.AspNetCore.Http", "Microsoft.AspNetCore.Routing")), lambda: is_function() & (F.col("name") != F.regexp_replace(paths.filename(F.col("path")), r"(\.cs)+$", "")), "name"),
    Rule("HttpRoute", "call", ("CSharp",), aspnet, lambda: F.substring_index("callee", ".", -1).isin("MapGet", "MapPost", "MapPut", "MapDelete", "MapPatch")),
    Rule("HttpRoute", "definition", ("Php",), lambda: php_web() | in_file("/Controllers/", "/controllers/", "/routes/", "/Routes/", "/api/", "/Api/", ends="Controller.php"), public_function, "name"),
    Rule("HttpRoute", "call", ("Ruby",), small_ruby, lambda: called(*MORE_VERBS)),
    Rule("HttpRoute", "definition", ("Ruby",), lambda: ~small_ruby() & (rails() | in_file("/controllers/", "/Controllers/", "/routes/", ends="_controller.rb")), lambda: public_function("initialize"), "name"),
    Rule("HttpRoute", "call", ("Kotlin",), ktor, lambda: called(*MORE_VERBS, "route")),
    Rule("HttpRoute", "definition", ("Kotlin",), lambda: ~ktor() & (kotlin_spring() | in_file("/controllers/", "/controller/", "/routes/", ends="Controller.kt")), public_function, "name"),
    Rule("HttpRoute", "call", ("Swift",), lambda: source("Vapor"), lambda: called(*MORE_VERBS, "route")),
    Rule("HttpRoute", "definition", ("Swift",), lambda: ~source("Vapor") & in_file("/Controllers/", "/controllers/", "/Routes/", "/routes/", ends="Controller.swift"), public_function, "name"),
    Rule("HttpRoute", "call", ("C", "Cpp"), c_web, lambda: F.lower("callee").isin(*MORE_VERBS, "crow_route") | F.lower("callee").contains("route") | F.lower("callee").contains("handler")),
    Rule("HttpRoute", "definition", ("C", "Cpp"), lambda: ~c_web() & path_has("/handlers/", "/controllers/", "/routes/", "/endpoints/"), public_function, "name"),
    Rule("HttpRoute", "call", ("Scala",), akka, lambda: called(*MORE_VERBS, "path", "pathPrefix", "complete")),
    Rule("HttpRoute", "definition", ("Scala",), lambda: ~akka() & play(), public_function, "name"),
    Rule("HttpRoute", "call", ("Scala",), lambda: ~akka() & ~play() & http4s(), lambda: F.lower("callee").isin(*VERBS)),
    Rule("HttpRoute", "definition", ("Scala",), lambda: ~akka() & ~play() & ~http4s() & in_file("/controllers/", "/controller/", "/routes/", ends="Controller.scala"), public_function, "name"),
    *[
        Rule("HttpRoute", on, JS if on == "export" else None, lambda: strong_route_path() | ((route_path() | (lower_has("/views/") & F.col("language").isin("Python", "Ruby", "Php"))) & framework(WEB)), public_function if on == "definition" else None, "name")
        for on in ("definition", "export")
    ],
    Rule("CliCommand", "file", None, lambda: F.col("has_main") & (command_file() | F.col("language").isin(*MAIN_LANGUAGES)), None, "=main"),
    Rule("CliCommand", "call", ("Python",), lambda: source("argparse", "click", "typer"), lambda: called("click.command", "click.group", "app.command", "typer.command"), "scope_only"),
    Rule("CliCommand", "call", ("Go",), lambda: source(starts=("github.com/spf13/cobra",)), lambda: callee_has("cobra.Command", "AddCommand"), "scope_only"),
    Rule("CliCommand", "call", ("Rust",), lambda: source(starts=("clap",)), lambda: callee_has("Command::new", "Parser::parse", "clap::Command"), "scope_only"),
    Rule("CliCommand", "file", JS, lambda: source("commander", "yargs", "meow", "cac"), None, "stem"),
    Rule("CliCommand", "file", None, lambda: (path_has("/bin/") | F.col("path").startswith("bin/")) & ~F.col("has_main"), None, "stem"),
    *[
        Rule("CliCommand", on, JS if on == "export" else None, lambda: command_path() & (framework(COMMAND_LINE) | lower_has("/commands/", "/command/")), public_function if on == "definition" else None, "name")
        for on in ("definition", "export")
    ],
    Rule("QueueConsumer", "call", None, lambda: source(*QUEUES, under="/"), lambda: F.lower("callee").rlike("subscribe|consume|onmessage|on_message|process|handle_message|handlemessage")),
    Rule("QueueConsumer", "definition", None, lambda: source(*QUEUES, under="/") & worker_path(), lambda: is_function() & (F.col("name").rlike("process|handle|consume") | F.col("name").isin("run", "execute")), "name"),
    Rule("CronJob", "call", None, lambda: source(*CRONS, under=".") | cron_path(), lambda: callee_has("schedule", "cron", "every", "interval", "addJob", "add_job")),
    Rule("ReactPage", "export", JS, react_page, lambda: F.col("is_default") & (F.col("pos") == F.col("first_default")), "name"),
    Rule("EventHandler", "call", None, lambda: source(*EVENT_SOURCES, under="/"), lambda: method().isin("addEventListener", "on", "addListener", "once", "subscribe")),
    Rule("HttpRoute", "call", JS, effect_http, lambda: called(*[f"HttpApiEndpoint.{m}" for m in (*MORE_VERBS, "del", "make")], "HttpApi.make", "HttpApi.empty", "HttpApiGroup.make", *[f"HttpRouter.{m}" for m in (*VERBS, "del", "all", "mount", "route")])),
    Rule("HttpRoute", "definition", JS, effect_http, lambda: F.col("name").rlike("HttpApi|HttpRouter"), "name"),
    Rule("CliCommand", "call", JS, lambda: source("@effect/cli", starts=("@effect/cli/",)), lambda: called("Command.make", "Command.run", "Command.provide", "Command.withHandler")),
    Rule("QueueConsumer", "call", JS, lambda: source("effect/Queue", "effect/PubSub") | imported_from("effect", "Queue", "PubSub"), lambda: called("Queue.take", "Queue.poll", "Queue.dequeue", "Queue.takeBetween", "Queue.takeAll", "Queue.takeUpTo", "PubSub.subscribe", "PubSub.subscribeScopedWith")),
    Rule("CronJob", "call", JS, lambda: source("@effect/cron", "effect/Schedule", starts=("@effect/cron/",)) | imported_from("effect", "Schedule"), lambda: called(*[f"Schedule.{m}" for m in ("cron", "fixed", "spaced", "recurring", "forever", "once", "dayOfWeek", "hourOfDay")], "Cron.make", "Cron.parse", "Cron.match")),
    Rule("TestFile", "call", JS, lambda: source("@effect/vitest", under="/"), lambda: called("it.effect", "it.scoped", "it.live", "it.flakyTest")),
    Rule("EventHandler", "call", JS, lambda: source("effect/Stream", "effect/Hub") | imported_from("effect", "Stream", "Hub"), lambda: called(*[f"Stream.{m}" for m in ("run", "runForEach", "runCollect", "runDrain", "runFold", "runScoped")], "Hub.subscribe", "Hub.publishAll")),
    Rule("EffectService", "call", JS, lambda: source("effect/Effect", "effect/Context", "effect/Layer") | imported_from("effect", "Effect", "Context", "Layer"), lambda: called("Effect.Service", "Context.Tag", "Context.GenericTag", *[f"Layer.{m}" for m in ("effect", "succeed", "scoped", "sync", "fail", "provide", "merge")])),
    Rule("CliCommand", "file", ("Rust",), lambda: lower_has("/modules/", "/commands/", "/plugins/", "/handlers/", "/subcommands/", "/cmds/", "/configs/") & ~F.lower("path").endswith("/mod.rs"), None, "stem"),
    Rule("CliCommand", "file", ("Rust",), lambda: F.col("has_definitions") & (F.lower("path").isin("src/main.rs", "src/lib.rs") | F.lower("path").rlike(r"/(main|lib)\.rs$")), None, "stem"),
]


def file_facts(files: DataFrame, imports: DataFrame, definitions: DataFrame) -> DataFrame:
    """One row for each file with what the gates ask: language, imported sources and names, definitions."""
    by_file = imports.groupBy("path").agg(
        F.collect_set("source").alias("sources"),
        F.array_distinct(F.flatten(F.collect_list("names"))).alias("imported"),
        F.collect_set(F.struct("source", "names")).alias("origins"),
    )
    defined = definitions.groupBy("path").agg(F.bool_or(F.col("name") == "main").alias("has_main"), F.bool_or(test_name()).alias("has_test_name"))
    every = files.select("path").distinct().join(by_file, "path", "left").join(defined, "path", "left")
    none = F.array().cast("array<string>")
    return every.select(
        "path", paths.language(F.col("path")).alias("language"), F.coalesce("sources", none).alias("sources"), F.coalesce("imported", none).alias("imported"),
        F.coalesce("origins", F.array().cast("array<struct<source:string,names:array<string>>>")).alias("origins"), F.coalesce("has_main", F.lit(False)).alias("has_main"),
        F.coalesce("has_test_name", F.lit(False)).alias("has_test_name"), F.col("has_main").isNotNull().alias("has_definitions"),
    )


def detections(files: DataFrame, imports: DataFrame, definitions: DataFrame, calls: DataFrame, exports: DataFrame) -> DataFrame:
    """(file, symbol, detector, pos, entrypoint_type) of every rule that holds."""
    facts = file_facts(files, imports, definitions)
    first = exports.where("is_default").groupBy("path").agg(F.min("pos").alias("first_default"))
    tables = {
        "call": calls.select("path", "pos", "callee", "containing_function"),
        "definition": definitions.select("path", "pos", "name", "kind"),
        "export": exports.join(first, "path", "left").select("path", "pos", "name", "is_default", "first_default"),
    }
    symbols = {"scope": lambda: F.coalesce("containing_function", "callee"), "scope_only": lambda: F.col("containing_function"), "name": lambda: F.col("name"), "stem": lambda: paths.file_stem(F.col("path")), "=main": lambda: F.lit("main")}
    out = None
    for on in ("call", "definition", "export", "file"):
        own = [(i, r) for i, r in enumerate(RULES) if r.on == on]
        # Gates are decided once for each file; facts then carry only the numbers of open rules.
        gates = []
        for i, r in own:
            holds = F.lit(True)
            if r.languages:
                holds = holds & F.col("language").isin(*r.languages)
            if r.gate:
                holds = holds & r.gate()
            gates.append(F.when(holds, F.lit(i)))
        opened = facts.select("path", F.array_compact(F.array(*gates)).alias("open")).where(F.size("open") > 0)
        rows = opened if on == "file" else tables[on].join(opened, "path")
        rows = rows if on != "file" else rows.withColumn("pos", F.lit(0).cast("bigint"))
        hits = []
        for i, r in own:
            holds = F.array_contains("open", F.lit(i))
            if r.when:
                holds = holds & F.coalesce(r.when(), F.lit(False))
            hits.append(F.when(holds, F.struct(F.lit(i).alias("detector"), symbols[r.symbol]().alias("symbol"), F.lit(r.kind).alias("entrypoint_type"))))
        each = rows.select(F.col("path").alias("file"), "pos", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("file", "h.symbol", "h.detector", "pos", "h.entrypoint_type").where("symbol IS NOT NULL")
        out = each if out is None else out.unionByName(each)
    return out


def detect(files: DataFrame, imports: DataFrame, definitions: DataFrame, calls: DataFrame, exports: DataFrame) -> DataFrame:
    """(file, symbol, entrypoint_type): entrypoints, of one (file, symbol) the first detector's."""
    return first_detections(detections(files, imports, definitions, calls, exports))
