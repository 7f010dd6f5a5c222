"""HTTP service on the standard library: GET /health, POST /ask."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import functions as F

from lutrin import answers
from lutrin.functions.text import plain_markdown
from lutrin.operators import reports


def reply(engine, request: dict) -> tuple[int, dict]:
    """Status and body for an /ask request: question, and optionally backend and expand_query."""
    question = request.get("question")
    if not isinstance(question, str):
        return 422, {"detail": "question is missing"}
    settings = engine.settings
    backend = request.get("backend") or settings.llm_backend
    expansion = engine.expansions([("q", question)], backend)["q"] if request.get("expand_query") else []
    hits = engine.hits(question, expansion=" ".join(expansion)).persist()
    cited = reports.citations(hits).collect()
    if not cited:
        return 404, {"detail": "no passage found"}
    q = engine.spark.createDataFrame([("q", question)], "query_id string, text string")
    try:
        said = answers.answerer(backend, settings)(answers.SYSTEM, reports.prompts(hits, q).first()["user"])
    except RuntimeError as e:
        return 502, {"detail": str(e)}
    answer = engine.spark.createDataFrame([(said,)], "t string").select(plain_markdown(F.col("t"))).first()[0]
    return 200, {"answer": answer, "citations": [{k: v for k, v in c.asDict().items() if k != "rank"} for c in cited[0]["citations"]]}


def handler(engine) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def send(self, status: int, body: dict) -> None:
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            for k, v in (("Content-Type", "application/json"), ("Content-Length", str(len(data))), ("Access-Control-Allow-Origin", "*")):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            self.send(200, {"status": "ok"}) if self.path == "/health" else self.send(404, {"detail": "not found"})

        def do_POST(self) -> None:  # noqa: N802
            if self.path != "/ask":
                return self.send(404, {"detail": "not found"})
            try:
                request = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
            except ValueError:
                return self.send(422, {"detail": "not JSON"})
            self.send(*reply(engine, request))

        def log_message(self, *_) -> None:
            pass

    return Handler


def serve(engine, port: int = 8000) -> None:
    ThreadingHTTPServer(("0.0.0.0", port), handler(engine)).serve_forever()
