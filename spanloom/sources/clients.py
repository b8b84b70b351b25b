"""Clients of HTTP services with the common ``/embeddings`` and ``/chat/completions`` interface.

``post(url, headers, body) -> dict`` is injected, so tests and other transports
need no network. A key is given or read once, on the driver, from an environment
variable of the caller's choice.
"""

from __future__ import annotations

import json
import os
import re
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

Post = Callable[[str, dict[str, str], dict], dict]


class ServiceError(RuntimeError):
    """A service failed, or answered what cannot be used."""


@dataclass(frozen=True)
class HttpPost:
    timeout: float = 60.0

    def __call__(self, url: str, headers: dict[str, str], body: dict) -> dict:
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.loads(answer.read())
        except (urllib.error.URLError, TimeoutError, ValueError) as error:
            raise ServiceError(f"{url}: {error}") from error


def key_from(given: str | None, variable: str | None) -> str:
    key = given or (os.environ.get(variable, "") if variable else "")
    if not key:
        raise ValueError(f"no key: give one, or set {variable}")
    return key


@dataclass(frozen=True)
class EmbeddingClient:
    """``client(texts)`` gives one vector per text, in order; ``extra`` fields go with every request."""

    endpoint: str
    model: str
    key: str
    batch_size: int = 16
    post: Post = HttpPost()
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        for name in ("endpoint", "model", "key"):
            if not getattr(self, name):
                raise ValueError(f"{name} must not be empty")
        if self.batch_size < 1:
            raise ValueError(f"batch_size must be 1 or more, not {self.batch_size}")
        if clash := {"model", "input"} & set(self.extra):
            raise ValueError(f"extra must not set {', '.join(sorted(clash))}")

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for s in range(0, len(texts), self.batch_size):
            part = texts[s : s + self.batch_size]
            answer = self.post(f"{self.endpoint.rstrip('/')}/embeddings", {"Authorization": f"Bearer {self.key}"}, {**self.extra, "model": self.model, "input": part})
            try:
                rows = sorted(answer["data"], key=lambda r: r["index"])
                vectors = [[float(x) for x in r["embedding"]] for r in rows]
            except (KeyError, TypeError, ValueError) as error:
                raise ServiceError(f"no embeddings in the answer: {error!r}") from error
            if len(vectors) != len(part):
                raise ServiceError(f"{len(vectors)} embeddings for {len(part)} texts")
            out += vectors
        return out


@dataclass(frozen=True)
class ChatClient:
    endpoint: str
    model: str
    key: str
    post: Post = HttpPost()

    def ask(self, prompt: str, temperature: float) -> str:
        body = {"model": self.model, "temperature": temperature, "messages": [{"role": "user", "content": prompt}]}
        answer = self.post(f"{self.endpoint.rstrip('/')}/chat/completions", {"Authorization": f"Bearer {self.key}"}, body)
        try:
            return str(answer["choices"][0]["message"]["content"])
        except (KeyError, IndexError, TypeError) as error:
            raise ServiceError(f"no reply in the answer: {error!r}") from error


JUDGE_PROMPT = "Can the question be answered from the passage alone? Reply with JSON: {{\"score\": 1 to 5, \"reason\": \"...\"}}.\nQuestion: {question}\nPassage: {chunk}"
QA_PROMPT = "Write {n} questions that the text answers. Reply with a JSON list of {{\"question\": \"...\", \"gold\": \"verbatim answer from the text\"}}.\nText: {text}"


def first_json(reply: str, kind: type):
    """The first JSON object or list in a reply, else None."""
    opener = "[" if kind is list else "{"
    for m in re.finditer(re.escape(opener), reply):
        try:
            value, _ = json.JSONDecoder().raw_decode(reply, m.start())
        except ValueError:
            continue
        if isinstance(value, kind):
            return value
    return None


@dataclass(frozen=True)
class ChatJudge:
    """``judge(question, chunk)`` gives (score, reason); -1 for a reply that cannot be read. Chunks are cut to ``most``."""

    client: ChatClient
    most: int = 2000

    def __call__(self, question: str, chunk: str) -> tuple[int, str]:
        reply = self.client.ask(JUDGE_PROMPT.format(question=question, chunk=chunk[: self.most]), 0.0)
        found = first_json(reply, dict)
        try:
            return int(found["score"]), str(found.get("reason", ""))
        except (TypeError, KeyError, ValueError):
            return -1, f"unreadable reply: {reply[:200]}"


@dataclass(frozen=True)
class ChatQuestions:
    """``generate(text, n)`` gives (question, gold) pairs. Texts are cut to ``most``."""

    client: ChatClient
    most: int = 6000

    def __call__(self, text: str, n: int) -> list[tuple[str, str]]:
        found = first_json(self.client.ask(QA_PROMPT.format(n=n, text=text[: self.most]), 0.3), list)
        return [(str(x.get("question", "")), str(x.get("gold", ""))) for x in found or [] if isinstance(x, dict)]
