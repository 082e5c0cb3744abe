"""Data flow through variables, heuristic edges and frameworks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import callsites, paths

# What an import says about the framework in use, matched whole
# or up to a separator. A longer table can be passed in.
FRAMEWORKS = {
    "express": "Express", "fastify": "Fastify", "next": "Next.js", "react": "React", "react-dom": "React", "vue": "Vue",
    "@angular/core": "Angular", "svelte": "Svelte", "@nestjs/common": "NestJS", "@nestjs/core": "NestJS", "hono": "Hono", "koa": "Koa",
    "@effect/": "Effect.ts", "effect": "Effect.ts", "prisma": "Prisma", "@prisma/client": "Prisma", "typeorm": "TypeORM",
    "sequelize": "Sequelize", "mongoose": "Mongoose", "drizzle-orm": "Drizzle", "@trpc/server": "tRPC", "@trpc/client": "tRPC",
    "graphql": "GraphQL", "@apollo/server": "Apollo", "@apollo/client": "Apollo", "tailwindcss": "Tailwind CSS", "redux": "Redux",
    "@reduxjs/toolkit": "Redux", "zustand": "Zustand", "zod": "Zod", "vitest": "Vitest", "jest": "Jest", "@effect/vitest": "Effect.ts",
    "fastapi": "FastAPI", "flask": "Flask", "django": "Django", "sqlalchemy": "SQLAlchemy", "pydantic": "Pydantic", "celery": "Celery",
    "pytest": "pytest", "alembic": "Alembic", "tortoise": "Tortoise ORM", "starlette": "Starlette", "aiohttp": "aiohttp",
    "httpx": "httpx", "uvicorn": "Uvicorn", "net/http": "Go net/http", "github.com/gin-gonic/gin": "Gin", "github.com/labstack/echo": "Echo",
    "github.com/go-chi/chi": "Chi", "github.com/gofiber/fiber": "Fiber", "github.com/gorilla/mux": "Gorilla Mux",
    "google.golang.org/grpc": "gRPC", "github.com/spf13/cobra": "Cobra", "github.com/spf13/viper": "Viper", "gorm.io/gorm": "GORM",
    "github.com/jmoiron/sqlx": "sqlx", "database/sql": "Go database/sql", "github.com/go-playground/validator": "Go Validator",
    "github.com/stretchr/testify": "Testify", "actix_web": "Actix-web", "actix-web": "Actix-web", "axum": "Axum", "rocket": "Rocket",
    "warp": "Warp", "hyper": "Hyper", "tokio": "Tokio", "diesel": "Diesel", "sqlx": "SQLx", "sea_orm": "SeaORM", "sea-orm": "SeaORM",
    "clap": "Clap", "tauri": "Tauri", "serde": "Serde", "tower": "Tower", "tonic": "Tonic", "tracing": "Tracing",
    "org.springframework.boot": "Spring Boot", "org.springframework.web": "Spring MVC", "org.springframework.data": "Spring Data",
    "org.springframework.security": "Spring Security", "org.springframework": "Spring Boot", "jakarta.persistence": "JPA",
    "javax.persistence": "JPA", "jakarta.ws.rs": "JAX-RS", "javax.ws.rs": "JAX-RS", "jakarta.servlet": "Servlet", "javax.servlet": "Servlet",
    "org.hibernate": "Hibernate", "org.junit": "JUnit", "org.junit.jupiter": "JUnit 5", "org.mockito": "Mockito",
    "com.google.inject": "Guice", "io.micronaut": "Micronaut", "io.quarkus": "Quarkus", "org.apache.maven": "Maven",
    "Microsoft.AspNetCore": "ASP.NET Core", "Microsoft.AspNetCore.Mvc": "ASP.NET Core MVC", "Microsoft.AspNetCore.Identity": "ASP.NET Identity",
    "Microsoft.AspNetCore.SignalR": "SignalR", "Microsoft.EntityFrameworkCore": "Entity Framework Core",
    "Microsoft.Extensions.DependencyInjection": "ASP.NET Core", "Microsoft.Extensions.Logging": "ASP.NET Core",
    "Microsoft.Extensions.Configuration": "ASP.NET Core", "System.Linq": "LINQ", "Xunit": "xUnit", "NUnit": "NUnit",
    "Microsoft.VisualStudio.TestTools": "MSTest", "Moq": "Moq", "FluentAssertions": "FluentAssertions", "MediatR": "MediatR",
    "AutoMapper": "AutoMapper", "Newtonsoft.Json": "Newtonsoft.Json", "System.Text.Json": "System.Text.Json", "Dapper": "Dapper",
    "Microsoft.AspNetCore.Components": "Blazor", "Illuminate": "Laravel", "Illuminate\\Database": "Laravel Eloquent",
    "Illuminate\\Queue": "Laravel Queue", "Illuminate\\Console": "Laravel Artisan", "Laravel": "Laravel", "Symfony": "Symfony",
    "Symfony\\Component\\Console": "Symfony Console", "Doctrine\\ORM": "Doctrine ORM", "Doctrine\\DBAL": "Doctrine DBAL", "Slim": "Slim",
    "GuzzleHttp": "Guzzle", "Monolog": "Monolog", "PHPUnit": "PHPUnit", "Livewire": "Livewire", "Inertia": "Inertia", "rails": "Rails",
    "action_controller": "Rails", "active_record": "Rails ActiveRecord", "active_support": "Rails", "active_job": "Rails ActiveJob",
    "action_cable": "Rails ActionCable", "sinatra": "Sinatra", "rack": "Rack", "grape": "Grape", "hanami": "Hanami", "rspec": "RSpec",
    "minitest": "Minitest", "sidekiq": "Sidekiq", "devise": "Devise", "pundit": "Pundit", "sequel": "Sequel", "mongoid": "Mongoid",
    "puma": "Puma", "faraday": "Faraday", "httparty": "HTTParty", "factory_bot": "FactoryBot", "io.ktor": "Ktor",
    "io.ktor.client": "Ktor Client", "org.jetbrains.exposed": "Exposed", "androidx.compose": "Jetpack Compose",
    "kotlinx.coroutines": "Kotlin Coroutines", "kotlinx.serialization": "Kotlin Serialization", "kotlin.test": "Kotlin Test",
    "io.kotest": "Kotest", "io.mockk": "MockK", "org.koin": "Koin", "SwiftUI": "SwiftUI", "UIKit": "UIKit", "Vapor": "Vapor",
    "XCTest": "XCTest", "Combine": "Combine", "Alamofire": "Alamofire", "play.api.mvc": "Play Framework", "akka.actor": "Akka",
    "akka.stream": "Akka Streams", "akka.http": "Akka HTTP", "org.scalatest": "ScalaTest", "slick": "Slick", "doobie": "Doobie",
    "circe": "Circe", "org.http4s": "http4s", "cats": "Cats", "cats.effect": "Cats Effect", "zio": "ZIO", "io.getquill": "Quill",
    "sttp": "sttp", "tapir": "Tapir",
}
# File names of one framework's routing convention.
NEXT_ENDS = ("page.tsx", "page.ts", "page.jsx", "page.js", "route.ts", "route.js", "layout.tsx", "layout.ts")


def flows(assignments: DataFrame, calls: DataFrame) -> DataFrame:
    """(producer, consumer, via, containing_function, file, line).

    `assignments` is (path, variable, callee, containing_function), `calls`
    (path, callee, arguments, containing_function, line). What a call
    returned flows into another call of the same file and function that takes
    the variable; null functions are the module's scope and equal each other.
    """
    used = calls.select(
        F.col("path").alias("c_path"), F.col("callee").alias("consumer"), F.col("containing_function").alias("c_scope"), "line", F.explode("arguments").alias("via")
    )
    same = (F.col("path") == F.col("c_path")) & F.col("containing_function").eqNullSafe(F.col("c_scope")) & (F.col("variable") == F.col("via"))
    met = assignments.join(used, same & (F.col("callee") != F.col("consumer")))
    scope = F.when(F.col("c_scope").isNull(), F.col("c_path")).otherwise(F.concat_ws("::", "c_path", "c_scope"))
    return met.select(F.col("callee").alias("producer"), "consumer", "via", scope.alias("containing_function"), F.col("c_path").alias("file"), "line")


def heuristic_edges(calls: DataFrame) -> DataFrame:
    """(from_symbol, file, pattern, confidence, evidence, line) of calls whose callee tells what they do."""
    kind = callsites.pattern(F.col("callee"))
    symbol = F.when(F.col("containing_function").isNull(), F.col("path")).otherwise(F.concat_ws("::", "path", "containing_function"))
    told = calls.withColumn("pattern", kind).where("pattern IS NOT NULL")
    return told.select(symbol.alias("from_symbol"), F.col("path").alias("file"), "pattern", callsites.confidence(F.col("callee"), F.col("pattern")).alias("confidence"), F.col("callee").alias("evidence"), "line")


def graph_edges(heuristic: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from the calling symbol, or its module, to the file's module; logging and self edges give none."""
    from .graph import with_known_ends

    ids = nodes.select(F.col("id").alias("known"))
    kind = paths.lookup(F.col("pattern"), callsites.EDGE_TYPES)
    met = heuristic.withColumn("edge_type", kind).where("edge_type IS NOT NULL").join(ids, F.col("from_symbol") == F.col("known"), "left")
    edges = met.select(F.when(F.col("known").isNotNull(), F.col("from_symbol")).otherwise(F.col("file")).alias("src"), F.col("file").alias("dst"), "edge_type")
    return with_known_ends(edges.where("src != dst"), nodes)


def frameworks(imports: DataFrame, files: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    """(framework): distinct frameworks of the imports, and of routing files by their names."""
    known = table or FRAMEWORKS
    spark = imports.sparkSession
    # Prefixes of a source up to a separator, by equality with the table.
    names = spark.createDataFrame(sorted(known.items()), "pattern string, framework string")
    lengths = sorted({len(p) for p in known})
    heads = F.filter(
        F.array(*[F.struct(F.lit(n).alias("n"), F.substring(F.col("source"), 1, n).alias("head"), F.substring(F.col("source"), n + 1, 1).alias("next")) for n in lengths]),
        lambda h: (F.length(h["head"]) == h["n"]) & h["next"].isin("", "/", ".", ":", "\\"),
    )
    sources = imports.select("source").distinct().select(F.explode(heads).alias("h")).select(F.col("h.head").alias("pattern"))
    by_import = sources.join(F.broadcast(names), "pattern").select("framework")  # the table is a parameter of a few hundred rows
    path = F.col("path")
    routing = (path.contains("pages/") | path.contains("app/")) & F.array_contains(F.array(*[path.endswith(e) for e in NEXT_ENDS]), True)
    by_name = files.where(routing).select(F.lit("Next.js").alias("framework"))
    return by_import.unionByName(by_name).distinct()


def symbol_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, name, kind, change): symbols added, removed, or modified in their span of lines."""
    keys = ["path", "name", "kind"]
    a = old.select(*keys, F.struct("start_line", "end_line").alias("a"))
    b = new.select(*keys, F.struct("start_line", "end_line").alias("b"))
    change = F.when(F.col("a").isNull(), "Added").when(F.col("b").isNull(), "Removed").when(F.col("a") != F.col("b"), "Modified")
    return a.join(b, keys, "full").select(*keys, change.alias("change")).where("change IS NOT NULL")
