import json
import sys
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from lutrin import answers, cli, config, service
from lutrin.operators import reports
from lutrin.sources import files
from lutrin.sources.store import Store
from pyspark.sql import functions as F


@pytest.fixture
def stub():
    """A local server that answers like the three services, and keeps what it was asked."""
    asked: list[tuple[str, dict, dict]] = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, body, dict(self.headers)))
            user = body.get("prompt") or str(body)
            status = 500 if "panne" in user else 200
            said = "" if "vide" in user else '["UG.3.1", "haie"]' if body.get("system") == answers.EXPANSION_SYSTEM else "**Le mur** est en pierre"
            reply = {
                "/api/generate": {"response": said},
                "/v1/responses": {"output": [{"type": "reasoning"}, {"content": [{"type": "output_text", "text": said}]}]},
                "/v1/messages": {"content": [{"type": "text", "text": said}]},
            }[self.path]
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(reply).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def settings(host, **more):
    return config.Settings(llm_host=host, openai_host=host, claude_host=host, openai_key="k1", claude_key="k2", **more)


@pytest.mark.parametrize("backend,path,header", [("ollama", "/api/generate", None), ("OpenAI", "/v1/responses", ("Authorization", "Bearer k1")), ("claude", "/v1/messages", ("X-api-key", "k2"))])
def test_backends(stub, backend, path, header):
    host, asked = stub
    say = answers.answerer(backend, settings(host), 5)
    assert say(answers.SYSTEM, "Question: mur ?") == "**Le mur** est en pierre"
    where, body, headers = asked[-1]
    assert where == path and answers.SYSTEM in json.dumps(body) and (header is None or {k.lower(): v for k, v in headers.items()}[header[0].lower()] == header[1])
    for bad in ("panne", "vide"):
        with pytest.raises(RuntimeError):
            say(answers.SYSTEM, bad)


def test_keys_and_names(stub):
    for backend in ("openai", "claude"):
        with pytest.raises(RuntimeError, match="API_KEY"):
            answers.answerer(backend, config.Settings(openai_host=stub[0], claude_host=stub[0]))("", "")
    with pytest.raises(RuntimeError, match="unknown"):
        answers.answerer("nobody")
    assert "k1" not in repr(settings(""))


def test_pdf_pages_and_heartbeat(spark, monkeypatch, capsys):
    class Reader:
        def __init__(self, stream):
            words = stream.read().decode().split("|")
            self.pages = [type("Page", (), {"extract_text": lambda self, w=w: w or None})() for w in words]

    monkeypatch.setitem(sys.modules, "pypdf", type(sys)("pypdf"))
    sys.modules["pypdf"].PdfReader = Reader
    assert files.pdf_pages(b"one||three") == ["one", "", "three"]
    with cli.heartbeat(spark, 0.05):
        time.sleep(0.3)
    assert "working:" in capsys.readouterr().out


def test_expansion(spark, stub):
    q = spark.createDataFrame([("a", "mur ?"), ("b", "panne"), ("c", "vide")], "query_id string, text string")
    got = {r["query_id"]: (r["codes"], r["expansion"]) for r in answers.expanded(q, answers.expander("ollama", settings(stub[0]), 5)).collect()}
    assert got == {"a": (["UG.3.1", "haie"], "UG.3.1 haie"), "b": ([], ""), "c": ([], "")}
    assert {r["expansion"] for r in answers.expanded(q, answers.expander("claude")).collect()} == {""}


def test_ingest_ask_eval_serve(spark, stub, tmp_path, monkeypatch, capsys):
    host, asked = stub
    for name, value in (("LUTRIN_LLM_HOST", host), ("LUTRIN_LLM_BACKEND", "ollama")):
        monkeypatch.setenv(name, value)
    docs = tmp_path / "docs"
    (docs / "PADD").mkdir(parents=True)
    (docs / "PADD" / "a.txt").write_text("Le mur en pierre longe la rue UG.3.1 du village", encoding="utf-8")
    (docs / "b.txt").write_text("Une haie borde le parc communal", encoding="utf-8")
    (docs / "bad.txt").write_bytes(b"\xff\xfe\xff")
    run = lambda *a: cli.main(["--docs", str(docs), "--index", str(tmp_path / "ix"), "--kind", ".txt", *a], spark)
    run("ingest", "--workers", "2")
    out = capsys.readouterr()
    assert "1 files could not be read" in out.err and "bad.txt" in out.err and "processed" in out.out and "3 files, 2 chunks" in out.out
    run("ask", "quel mur", "--expand-query", "--top-k", "1")
    raw = capsys.readouterr().out
    parts = spark.createDataFrame([(raw,), ("only text",), (reports.PASSAGES_MARK + " a",)], "t string").select(reports.output_parts(F.col("t")).alias("p")).select("p.*").collect()
    assert parts[0]["codes"] == ["UG.3.1", "haie"] and parts[0]["expansion"] == "UG.3.1 haie" and parts[0]["answer"] == "**Le mur** est en pierre" and parts[0]["passages"].startswith("[score=")
    assert [tuple(p)[:2] for p in parts[1:]] == [("only text", ""), ("a", "")]
    assert asked[-1][1]["system"] == answers.SYSTEM
    golden = [
        {"id": "1", "question": "quel mur ?", "expected_articles": ["UG.3.1"], "expected_keywords": ["pierre"], "family": "padd"},
        {"id": "2", "question": "panne de haie ?", "expected_articles": ["haie"], "expected_keywords": ["haie"]},
        {"id": "3", "question": "parc ?", "expected_articles": [], "expected_keywords": [], "family": "oap"},
    ]
    (tmp_path / "g.json").write_text(json.dumps(golden), encoding="utf-8")
    run("eval", "--dataset", str(tmp_path / "g.json"), "--multi-alpha", "--output", str(tmp_path / "out"), "--top-k", "2")
    text = capsys.readouterr().out
    assert "error:" in text and "alpha=0.7" in text and "id  plain  alpha=0.7  alpha=0.5" in text
    files = sorted((tmp_path / "out").glob("results_*.json"))
    assert len(files) == 3
    first = {r["id"]: r for r in json.loads(files[0].read_text(encoding="utf-8"))}
    assert (first["1"]["retrieval_score"], first["1"]["answer_score"]) == (1.0, 1.0)
    assert (first["2"]["retrieval_score"], first["2"]["answer_score"]) == (0.0, 0.0) and first["2"]["missing_articles"] == ["haie"] and "no answer" in first["2"]["error"]
    assert first["3"]["retrieval_score"] == 1.0 and first["3"]["passages"] == "No relevant passages found."
    engine = cli.Engine(spark, Store(spark, str(tmp_path / "ix")), config.load())
    status, body = service.reply(engine, {"question": "mur", "expand_query": True})
    assert status == 200 and body["answer"] == "Le mur est en pierre" and {c["source"] for c in body["citations"]} == {"a.txt", "b.txt"}
    assert service.reply(engine, {"question": "panne"})[0] == 502
