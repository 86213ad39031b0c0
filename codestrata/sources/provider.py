"""The review service as seen from a task: send a payload, get status and body."""

from __future__ import annotations

import http.client
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from codestrata.operators.answers import RETRYABLE

Transport = Callable[[str], tuple[int, str]]
DEFAULT_ENDPOINT = "https://openrouter.ai/api/v1/chat/completions"
KNOWN_PROVIDERS = ("openrouter",)
RETRY_WAITS = (2.0, 5.0)


@dataclass(frozen=True)
class HttpTransport:
    """Posts a payload. Created on the driver, used in tasks; holds no open connection."""

    api_key: str
    endpoint: str = DEFAULT_ENDPOINT
    timeout: float = 120.0

    def __call__(self, payload: str) -> tuple[int, str]:
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"}
        request = urllib.request.Request(self.endpoint.rstrip("/"), payload.encode("utf-8"), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return answer.status, answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as exc:
            return exc.code, exc.read().decode("utf-8", "replace")


def checked_transport(settings: dict, environment: dict[str, str]) -> HttpTransport:
    """A transport from the configuration's section, after the checks that need no network."""
    provider = settings.get("provider", "openrouter")
    if provider not in KNOWN_PROVIDERS:
        raise ValueError(f"unknown provider '{provider}'")
    key = settings.get("api_key") or environment.get("OPENROUTER_API_KEY")
    if not key:
        raise ValueError("the review service needs an API key")
    return HttpTransport(key, settings.get("endpoint") or DEFAULT_ENDPOINT)


def send_all(requests: DataFrame, transport: Transport, waits: tuple[float, ...] = RETRY_WAITS) -> DataFrame:
    """``(key, payload)`` -> ``(key, http_status, body, attempts, failure)``, one service call per row.

    Calls happen at least once: a task that Spark repeats sends, and pays, again.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(key, *send(payload, transport, waits)) for key, payload in zip(part["key"], part["payload"])]
            frame = pd.DataFrame(rows, columns=["key", "http_status", "body", "attempts", "failure"])
            frame["http_status"] = frame["http_status"].astype("Int32")
            yield frame

    return requests.select("key", "payload").mapInPandas(run, "key string, http_status int, body string, attempts int, failure string")


def send(payload: str, transport: Transport, waits: tuple[float, ...] = RETRY_WAITS) -> tuple[int | None, str | None, int, str | None]:
    """One call with another try after each wait while the failure looks passing."""
    status, body, failure = None, None, None
    for attempt in range(len(waits) + 1):
        try:
            status, body = transport(payload)
            failure = None
        except (OSError, http.client.HTTPException) as exc:
            status, body, failure = None, None, f"{type(exc).__name__}: {exc}"
        if status is not None and status not in RETRYABLE:
            break
        if attempt < len(waits):
            time.sleep(waits[attempt])
    return status, body, attempt + 1, failure


def echo_transport(payload: str) -> tuple[int, str]:
    """A stand-in service: no findings, and as many tokens as the user text has characters."""
    text = json.loads(payload)["messages"][1]["content"]
    answer = {"choices": [{"finish_reason": "stop", "message": {"content": '{"findings": []}'}}], "usage": {"total_tokens": len(text)}, "model": "echo"}
    return 200, json.dumps(answer)
