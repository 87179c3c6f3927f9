"""Language-model calls over rows: JSON by schema or instruction, and summaries, with a chain of completers.

A completer takes a request and gives a text, or raises CompletionError. It is called within tasks, so it has to be
picklable; offline it is a stub or a lookup. One failed row is an error row, never a failed job.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemill import schemas
from tidemill.functions.structured import dumps, loads
from tidemill.operators.batches import map_rows, spread

REPLY_CEILING = 10 << 20


class CompletionError(Exception):
    """A call that gave no usable text."""


@dataclass(frozen=True)
class Request:
    system: str
    user: str
    temperature: float | None = None
    max_tokens: int | None = None
    json_mode: bool = False
    model: str = ""


Completer = Callable[[Request], str]


@dataclass(frozen=True)
class Chain:
    """The first completer that succeeds; if none does, an error that names all their errors."""

    completers: Sequence[tuple[str, Completer]]

    def __call__(self, request: Request) -> str:
        if not self.completers:
            raise CompletionError("no completers")
        errors = []
        for name, complete in self.completers:
            try:
                return complete(request)
            except CompletionError as failed:
                errors.append(f"{name}: {failed}")
        raise CompletionError("all completers failed: " + "; ".join(errors))


# answers


def without_thinking(text: str) -> str:
    """The text without <think> parts; one left open takes the rest, and stray /think marks go."""
    kept, rest = "", text
    while "<think>" in rest:
        head, _, rest = rest.partition("<think>")
        kept += head
        rest = rest.partition("</think>")[2]
    return (kept + rest).replace("</think>", "").replace("/think", "").strip()


def json_answer(text: str) -> Any:
    """The JSON of an answer, with or without a code fence."""
    body = without_thinking(text)
    if body.startswith("```"):
        body = body.removeprefix("```json").removeprefix("```").removesuffix("```").strip()
    try:
        return loads(body)
    except ValueError as bad:
        raise CompletionError(f"the answer is not JSON ({bad}): {text}") from bad


# requests


def schema_request(text: str, schema: Any, model: str = "") -> Request:
    wanted = json.dumps(schema, indent=2, sort_keys=True)
    return Request(f"Fill this JSON schema from the user's text and reply with that JSON alone, without fences or comments.\n\n{wanted}", text, 0.0, None, True, model)


def instruction_request(text: str, instruction: str, model: str = "") -> Request:
    return Request(f"Reply with JSON alone, without fences or comments, holding what is asked of the user's text: {instruction}", text, 0.0, None, True, model)


def summary_request(text: str, sentences: int = 3, model: str = "") -> Request:
    return Request(f"Reply with a summary of the user's text and nothing else, in {sentences} sentences.", text, 0.3, None, False, model)


def _run(df: DataFrame, column: str, complete: Completer, request: Callable[[str], Request], read: Callable[[str], str], out: str) -> DataFrame:
    def one(text: str | None) -> dict[str, Any]:
        try:
            return {out: read(complete(request(text or "")))}
        except CompletionError as failed:
            return {"error": str(failed)}

    df = spread(df)
    rows = df.withColumn("_text", df[column])
    return map_rows(rows, ["_text"], one, schemas.fields(**{out: T.StringType(), "error": T.StringType()}))


def extract_by_schema(df: DataFrame, column: str, schema: Any, complete: Completer, model: str = "") -> DataFrame:
    """df with json, what the completer found for the schema in each text, and error."""
    return _run(df, column, complete, lambda t: schema_request(t, schema, model), lambda a: dumps(json_answer(a)), "json")


def extract_by_instruction(df: DataFrame, column: str, instruction: str, complete: Completer, model: str = "") -> DataFrame:
    return _run(df, column, complete, lambda t: instruction_request(t, instruction, model), lambda a: dumps(json_answer(a)), "json")


def summarize(df: DataFrame, column: str, complete: Completer, sentences: int = 3, model: str = "") -> DataFrame:
    """df with summary, the completer's plain text, and error."""
    return _run(df, column, complete, lambda t: summary_request(t, sentences, model), without_thinking, "summary")


# services


@dataclass(frozen=True)
class Service:
    """A completion service over HTTP; style names how it wants requests: chat, messages, generate or local."""

    style: str
    address: str
    model: str
    key: str = field(default="", repr=False)
    timeout: float = 120.0

    def shaped(self, r: Request) -> tuple[str, dict[str, str], dict[str, Any]]:
        """Address, headers and body of a request."""
        model, turns = r.model or self.model, [{"role": "system", "content": r.system}, {"role": "user", "content": r.user}]
        limits = {k: v for k, v in (("temperature", r.temperature), ("max_tokens", r.max_tokens)) if v is not None}
        if self.style == "chat":
            body = {"model": model, "messages": turns} | limits | ({"response_format": {"type": "json_object"}} if r.json_mode else {})
            return f"{self.address}/chat/completions", {"Authorization": f"Bearer {self.key}"}, body
        if self.style == "messages":
            body = {"model": model, "system": r.system, "messages": turns[1:], "max_tokens": r.max_tokens or 4096} | limits
            return f"{self.address}/v1/messages", {"x-api-key": self.key, "anthropic-version": "2023-06-01"}, body
        if self.style == "generate":
            names = {"temperature": "temperature", "max_tokens": "maxOutputTokens"}
            config = {names[k]: v for k, v in limits.items()} | ({"responseMimeType": "application/json"} if r.json_mode else {})
            body = {"systemInstruction": {"parts": [{"text": r.system}]}, "contents": [{"role": "user", "parts": [{"text": r.user}]}], "generationConfig": config}
            return f"{self.address}/v1beta/models/{model}:generateContent", {"x-goog-api-key": self.key}, body
        if self.style == "local":
            options = {{"max_tokens": "num_predict"}.get(k, k): v for k, v in limits.items()}
            return f"{self.address}/api/chat", {}, {"model": model, "messages": turns, "stream": False, "options": options} | ({"format": "json"} if r.json_mode else {})
        raise ValueError(f"unknown style: {self.style}")

    def answer(self, reply: bytes) -> str:
        if len(reply) > REPLY_CEILING:
            raise CompletionError("the reply is over the ceiling")
        try:
            got: Any = loads(reply.decode("utf-8", "replace"))
            for step in {"chat": ("choices", 0, "message", "content"), "messages": ("content", 0, "text"),
                         "generate": ("candidates", 0, "content", "parts", 0, "text"), "local": ("message", "content")}[self.style]:
                got = got[step]
        except (ValueError, LookupError, TypeError) as bad:
            raise CompletionError("no text in the reply") from bad
        if not isinstance(got, str):
            raise CompletionError("no text in the reply")
        return without_thinking(got)

    def __call__(self, request: Request) -> str:
        address, headers, body = self.shaped(request)
        call = urllib.request.Request(address, json.dumps(body).encode(), headers | {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(call, timeout=self.timeout) as reply:  # noqa: S310
                return self.answer(reply.read(REPLY_CEILING + 1))
        except (urllib.error.URLError, OSError) as failed:
            raise CompletionError(str(failed)) from failed
