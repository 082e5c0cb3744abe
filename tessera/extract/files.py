"""Extraction over DataFrames of files."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .facts import KINDS, SCHEMA


def extractors() -> dict:
    from . import brace_source, go_source, python_source, script_source

    others = {name: partial(brace_source.extract, name) for name in brace_source.LANGUAGES}
    return others | {"Python": python_source.extract, "Go": go_source.extract, "TypeScript": script_source.extract, "JavaScript": script_source.extract}


def parse(files: DataFrame) -> DataFrame:
    """One row of facts for each file of `files` (path, content).

    Files of other languages and null contents have no facts; a file that
    cannot be parsed has none and its error. Parsing never fails the query.
    """
    spark = files.sparkSession
    kinds = spark.createDataFrame([], SCHEMA).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = extractors()
        for batch in batches:
            rows = []
            for path, language, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                row = {"path": path, "language": language, "error": None, **{k: [] for k in KINDS}}
                if content is not None and language in known:
                    try:
                        row |= known[language](content).rows
                    except (SyntaxError, ValueError, RecursionError, IndexError) as e:
                        row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", paths.language(F.col("path")).alias("language"), "content").mapInArrow(run, kinds)


def rows(parsed: DataFrame, kind: str) -> DataFrame:
    """The facts of one kind, a row each, with their file's path."""
    return parsed.select("path", F.explode(kind).alias("f")).select("path", "f.*")
