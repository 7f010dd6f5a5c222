"""Language-model extension points: query expansion and answers. Nothing here is part of a Spark plan.

The backends speak plain HTTP by the standard library; host, model and key are the caller's.
"""

from __future__ import annotations

import json
import logging
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lutrin.config import Settings
from lutrin.operators.reports import bracketed_strings

logger = logging.getLogger(__name__)
#: prompt (system, user) to answer
Answerer = Callable[[str, str], str]
#: question to the raw reply that lists codes
Expander = Callable[[str], str]

SYSTEM = (
    "Answer in the language of the question and from the given context only. If the context does not hold the answer, say so and name the "
    "sources that come closest. Name a source by its file name or by what it is, never by a path."
)
EXPANSION_SYSTEM = (
    "You know the rulebook that the question is about. Name the codes of the articles that most likely answer it. Reply with nothing but a "
    'JSON list of at most four codes, such as ["UG.3.1", "UG.3.2"], or [] if none is likely.'
)
EXPANSION_SECONDS = 15.0


def extractive(system: str, user: str) -> str:
    """Offline stand-in: the first source of the context."""
    return user.partition("Context:\n")[2].split("\n\n")[0]


def _post(url: str, body: dict, timeout: float, headers: dict[str, str] | None = None) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.load(reply)
    except (OSError, ValueError) as e:
        raise RuntimeError(f"no answer from {url}: {e}") from e


def _said(text: str | None) -> str:
    if not (text or "").strip():
        raise RuntimeError("empty answer")
    return text.strip()


def _key(name: str, value: str) -> str:
    if not value:
        raise RuntimeError(f"{name} is not set")
    return value


def ollama(s: Settings, timeout: float) -> Answerer:
    def ask(system: str, user: str) -> str:
        body = {"model": s.llm_model, "system": system, "prompt": user, "stream": False, "keep_alive": "10m", "options": {"temperature": 0}}
        return _said(_post(f"{s.llm_host.rstrip('/')}/api/generate", body, timeout).get("response"))

    return ask


def openai(s: Settings, timeout: float) -> Answerer:
    def ask(system: str, user: str) -> str:
        body = {"model": s.openai_model, "input": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        got = _post(f"{s.openai_host.rstrip('/')}/v1/responses", body, timeout, {"Authorization": f"Bearer {_key('OPENAI_API_KEY', s.openai_key)}"})
        parts = [c.get("text", "") for o in got.get("output", []) for c in o.get("content") or [] if c.get("type") == "output_text"]
        return _said("".join(parts))

    return ask


def claude(s: Settings, timeout: float) -> Answerer:
    def ask(system: str, user: str) -> str:
        # The system prompt is the same for all questions and marked as such.
        body = {"model": s.claude_model, "max_tokens": 4096, "system": [{"type": "text", "text": system, "cache_control": {"type": "ephemeral"}}], "messages": [{"role": "user", "content": user}]}
        got = _post(f"{s.claude_host.rstrip('/')}/v1/messages", body, timeout, {"x-api-key": _key("ANTHROPIC_API_KEY", s.claude_key), "anthropic-version": "2023-06-01"})
        return _said("".join(c.get("text", "") for c in got.get("content", []) if c.get("type") == "text"))

    return ask


BACKENDS: dict[str, Callable[[Settings, float], Answerer]] = {"none": lambda *_: extractive, "ollama": ollama, "openai": openai, "claude": claude}


def answerer(backend: str, settings: Settings = Settings(), timeout: float = 300) -> Answerer:
    """The backend of a name, without regard to case; more are added to BACKENDS."""
    try:
        return BACKENDS[backend.lower()](settings, timeout)
    except KeyError:
        raise RuntimeError(f"unknown backend {backend!r}; known: {', '.join(sorted(BACKENDS))}") from None


def expander(backend: str, settings: Settings = Settings(), timeout: float = EXPANSION_SECONDS) -> Expander:
    """Replies that name codes for a question; only `ollama` expands, the other backends name none."""
    if backend.lower() != "ollama":
        logger.debug("no query expansion by %s", backend)
        return lambda _: "[]"
    ask = ollama(settings, timeout)
    return lambda question: ask(EXPANSION_SYSTEM, question)


def expanded(questions: DataFrame, expander: Expander) -> DataFrame:
    """questions (query_id, text) with codes and expansion, by one call a question of a stated set; an error or
    an unreadable reply is an empty expansion."""

    def run(batches: Iterable):
        for pdf in batches:
            def safe(t):
                try:
                    return expander(t)
                except Exception as e:  # noqa: BLE001 - expansion is optional
                    logger.warning("query expansion failed, the question is searched alone: %s", e)
                    return ""

            yield pdf.assign(raw=[safe(t) for t in pdf["text"]])

    raw = questions.select("query_id", "text").mapInPandas(run, f"query_id {questions.schema['query_id'].dataType.simpleString()}, text string, raw string")
    return raw.withColumn("codes", bracketed_strings(F.col("raw"))).withColumn("expansion", F.array_join("codes", " ")).drop("raw")
