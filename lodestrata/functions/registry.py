"""Extension points: SQL functions, table functions and hooks."""

from __future__ import annotations

import inspect
import json
from collections import defaultdict
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import pandas_udf, udtf

#: What hooks may be called for.
HOOKS = ("on_commit", "on_commit_streaming", "on_query", "on_schedule", "on_agent_session_start", "on_agent_operation", "on_review_request", "on_perf_sample", "on_benchmark_complete")


class Extensions:
    """Functions and hooks of a session."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.hooks: dict[str, list[Callable]] = defaultdict(list)
        self.schemas: dict[str, dict] = {}

    def function(self, name: str, returns: str, f: Callable) -> None:
        """Register a vectorised function (pandas Series to Series) for SQL and DataFrames."""
        self.spark.udf.register(name, pandas_udf(f, returns))
        parameters = {p: {"type": "string"} for p in inspect.signature(f).parameters}
        self.schemas[name] = {"name": name, "description": inspect.getdoc(f) or "", "parameters": {"type": "object", "properties": parameters, "required": list(parameters)}, "returns": returns}

    def table_function(self, name: str, returns: str, handler: type) -> None:
        """Register a table function: a class whose ``eval`` yields rows."""
        self.spark.udtf.register(name, udtf(handler, returnType=returns))

    def schema_json(self, name: str) -> str:
        """The JSON schema of a registered function."""
        return json.dumps(self.schemas[name], sort_keys=True)

    def hook(self, event: str, f: Callable[[DataFrame, dict[str, Any]], Any]) -> None:
        if event not in HOOKS:
            raise ValueError(f"unknown hook {event}; there are {', '.join(HOOKS)}")
        self.hooks[event].append(f)

    def fire(self, event: str, rows: DataFrame, context: dict[str, Any] | None = None) -> list[tuple[str, Any]]:
        """Call the hooks of an event in order. One that fails is reported with its error and stops neither the others nor the caller."""
        out: list[tuple[str, Any]] = []
        for f in self.hooks[event]:
            try:
                out.append((f.__name__, f(rows, context or {})))
            except Exception as error:  # noqa: BLE001
                out.append((f.__name__, error))
        return out

    def on_stream(self, stream: DataFrame, event: str = "on_commit_streaming") -> None:
        """Fire an event for each batch of what a stream has available."""
        from lodestrata.streaming.run import run_available

        run_available(stream, lambda batch, number: self.fire(event, batch, {"batch": number}) and None)
