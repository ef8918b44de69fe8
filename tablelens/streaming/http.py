"""A small HTTP layer over background jobs, on the standard library.

POST /insights/start   {"table" | "path" | "query", "tableName"?, "sampleAbove"?, "sampleSize"?} -> {"jobId"}
GET  /insights/status?jobId=...   -> status, progress, logs, result
POST /insights/cancel  {"jobId"} -> {"cancelled"}
GET  /health           -> {"status": "ok"}
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame, SparkSession

from tablelens.plans.types import ProfilingConfig
from tablelens.sources.readers import read_csv, run_query
from tablelens.streaming.jobs import Jobs


def load(spark: SparkSession, request: dict[str, Any]) -> DataFrame:
    """The DataFrame that a request names: a table, a file (CSV or Parquet), or a query."""
    if "table" in request:
        return spark.table(request["table"])
    if "query" in request:
        return run_query(spark, request["query"])
    path = request["path"]
    return read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)


def serve(spark: SparkSession, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server, not yet running; ``serve_forever`` runs it, ``server_port`` tells a port chosen freely."""
    jobs = Jobs(spark)

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body: dict[str, Any]) -> None:
            data = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            url = urlparse(self.path)
            if url.path == "/health":
                return self._send(200, {"status": "ok"})
            if url.path == "/insights/status":
                found = jobs.status(parse_qs(url.query).get("jobId", [""])[0])
                return self._send(404 if found["status"] == "not_found" else 200, found)
            return self._send(404, {"error": "not found"})

        def do_POST(self) -> None:
            try:
                request = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            except ValueError:
                return self._send(400, {"error": "the body is not JSON"})
            if self.path == "/insights/start":
                if not {"table", "path", "query"} & set(request):
                    return self._send(400, {"error": "name a table, path or query"})
                config = ProfilingConfig(sampling_threshold=request.get("sampleAbove"), sample_size=request.get("sampleSize", 10000))
                name = request.get("tableName") or request.get("table") or ""
                return self._send(202, {"jobId": jobs.start(lambda: load(spark, request), name, config)})
            if self.path == "/insights/cancel":
                return self._send(200, {"cancelled": jobs.cancel(request.get("jobId", ""))})
            return self._send(404, {"error": "not found"})

        def log_message(self, *_: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
