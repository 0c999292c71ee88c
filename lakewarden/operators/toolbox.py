"""Four read-only tools behind one call, each call with its audit row."""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import gate
from ..plans.router import route
from ..sources.catalog import table_stats
from ..streaming import audit
from . import retrieval
from .knowledge import Embedder


def clip(value: object, most: int = 300) -> object:
    """Long texts end in an ellipsis."""
    return value[:most] + "…" if isinstance(value, str) and len(value) > most else value


def human_bytes(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TB"


@dataclass
class Outcome:
    """decision: ok, blocked, unknown-tool, bad-arguments or tool-error."""

    tool: str
    ok: bool
    data: dict = field(default_factory=dict)
    ms: float = 0.0
    decision: str = "ok"
    layer: str = ""

    def brief(self) -> str:
        if self.layer:
            return f"stopped at {self.layer}: {self.data.get('reason')}"
        if not self.ok:
            return f"not done: {self.data.get('error')}"
        for key, unit in (("hits", "passages"), ("rows", "rows"), ("plan", "lines of plan"), ("tables", "tables")):
            if key in self.data:
                return f"{len(self.data[key])} {unit}"
        return "done"


class Toolbox:
    """search_docs, run_sql, explain_sql and get_table_stats over a session and a store of
    chunks (source, section, content, vector). Results that reach the driver are capped."""

    def __init__(self, spark: SparkSession, chunks: DataFrame | None = None, embedder: Embedder | None = None, tables: dict[str, DataFrame] | None = None, allowed: list[str] | None = None, max_rows: int = 100, floor: float = 0.0, cell: int = 300) -> None:
        self.spark, self.chunks, self.embedder, self.tables = spark, chunks, embedder or Embedder(), tables or {}
        self.allowed, self.max_rows, self.floor, self.cell = allowed, max_rows, floor, cell
        self.entries: list[dict] = []
        self.tools: dict[str, Callable[..., dict]] = {f.__name__: f for f in (self.search_docs, self.run_sql, self.explain_sql, self.get_table_stats)}
        if chunks is not None:
            self.embedder.check(chunks)

    def register(self, name: str, tool: Callable[..., dict]) -> None:
        """A further tool: keyword arguments to a dict; ``ok`` and ``layer`` in it are heeded."""
        if name in self.tools:
            raise ValueError(f"there is a tool {name}")
        self.tools[name] = tool

    def call(self, name: str, args: dict | None = None) -> Outcome:
        """Never raises: what goes wrong is the outcome's decision. Every call is recorded."""
        args, began = args or {}, time.perf_counter()
        tool = self.tools.get(name)
        if tool is None:
            out = Outcome(name, False, {"error": f"no tool {name}"}, decision="unknown-tool")
        else:
            try:
                inspect.signature(tool).bind(**args)
            except TypeError as e:
                out = Outcome(name, False, {"error": str(e)}, decision="bad-arguments")
            else:
                try:
                    data = tool(**args)
                    layer = data.get("layer") or ""
                    out = Outcome(name, data.get("ok", True), data, decision="blocked" if layer else "ok", layer=layer)
                except Exception as e:  # noqa: BLE001  the caller goes on whatever a tool does
                    out = Outcome(name, False, {"error": f"{type(e).__name__}: {clip(str(e))}"}, decision="tool-error")
        out.ms = round((time.perf_counter() - began) * 1000, 2)
        said = {k: v if k == "sql" else clip(v) for k, v in args.items()}
        self.entries.append({"ts": datetime.now(timezone.utc), "tool": name, "args": repr(said), "decision": out.decision, "layer": out.layer or "none", "ok": out.ok, "ms": out.ms})
        return out

    def audit_rows(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(e.values()) for e in self.entries], audit.SCHEMA)

    # tools

    def search_docs(self, query: str, k: int | None = 5) -> dict:
        if self.chunks is None:
            return {"ok": False, "error": "there is no store; ingest a corpus first"}
        best, report = retrieval.search_docs(self.chunks, self.embedder.one(query), k, self.floor, "vector", "chunk_id")
        return report | {"hits": [{"source": r["source"], "section": r["section"], "score": r["score"], "snippet": clip(r["content"], self.cell)} for r in best.collect()]}

    def run_sql(self, sql: str) -> dict:
        verdict, rows = gate.run(self.spark, sql, self.max_rows, self.allowed)
        if rows is None:
            return {"ok": False, "layer": verdict.layer, "reason": verdict.reason}
        found = [[clip(v, self.cell) for v in r] for r in rows.collect()]  # at most max_rows
        return {"sql": verdict.sql, "rewritten": verdict.rewritten, "tables": verdict.tables, "columns": rows.columns, "rows": found, "limit": self.max_rows}

    def explain_sql(self, sql: str) -> dict:
        """The plan, without running anything; the gate's other layers hold."""
        body = sql.strip().rstrip(";")
        probe = body if body.upper().startswith("EXPLAIN") else f"EXPLAIN FORMATTED {body}"
        verdict = gate.guard(probe, self.max_rows)
        if not verdict.ok:
            return {"ok": False, "layer": verdict.layer, "reason": verdict.reason}
        return {"plan": self.spark.sql(probe).first()[0].splitlines()}

    def get_table_stats(self) -> dict:
        return {"tables": [r.asDict() for r in table_stats(self.spark, self.tables).collect()] if self.tables else []}

    def answer(self, question: str, sql: str | None = None) -> dict:
        """The rule-driven round: route the question, call what the route names, and give the
        route, the steps' outcomes and whether it was refused. ``sql`` is the planned statement of
        questions about data or speed; without one they go to the documents."""
        to = self.spark.createDataFrame([(question,)], "q string").select(route(F.col("q"))).first()[0]
        if to in ("refuse", "clarify"):
            return {"route": to, "refused": to == "refuse", "steps": []}
        name, args = {"stats": ("get_table_stats", {}), "plan": ("explain_sql", {"sql": sql}), "query": ("run_sql", {"sql": sql})}.get(to, ("search_docs", {"query": question}))
        if args.get("sql", "") is None:
            name, args = "search_docs", {"query": question}
        return {"route": to, "refused": False, "steps": [self.call(name, args)]}
