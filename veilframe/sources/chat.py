"""A chat-completion service over HTTP as a provider of answers."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd

MOVED = (301, 302, 307, 308)
SHOWN = 400


class ChatError(RuntimeError):
    """A request that gave no completion."""


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


def clean_key(raw: str | None) -> str:
    """A key without quotes, white space and a leading ``Bearer``; its case stays."""
    key = (raw or "").strip().strip("\"'").strip()
    return key[7:].strip() if key.lower().startswith("bearer ") else key


def clean_base(raw: str | None) -> str:
    """A service's address without quotes, a closing slash and the path of completions."""
    base = (raw or "").strip().strip("\"'").strip().rstrip("/")
    return base[: -len("/chat/completions")].rstrip("/") if base.lower().endswith("/chat/completions") else base


@dataclass(frozen=True)
class ChatService:
    """Where and how to ask. One redirect is followed, with the key only if it stays on the host."""

    base: str
    key: str
    model: str
    max_tokens: int = 1200
    temperature: float = 0.0
    timeout: float = 60.0

    def complete(self, messages: list[dict]) -> str:
        """The body of a completion; anything else raises ChatError."""
        url = clean_base(self.base) + "/chat/completions"
        status, headers, body = self._post(url, messages, True)
        if status in MOVED and headers.get("Location"):
            there = urllib.parse.urljoin(url, headers["Location"].strip())
            status, headers, body = self._post(there, messages, urllib.parse.urlsplit(there)[:2] == urllib.parse.urlsplit(url)[:2])
        if status >= 300:
            text = body.strip()
            hint = " (is the key set?)" if status == 401 else ""
            raise ChatError(f"status {status}{hint}: {text[:SHOWN]}{'...' if len(text) > SHOWN else ''}")
        try:
            answer = json.loads(body)
        except ValueError as e:
            raise ChatError("the answer is no JSON") from e
        if not isinstance(answer, dict):
            raise ChatError("the answer is no object")
        if "error" in answer:
            error = answer["error"]
            raise ChatError(str(error.get("message", error) if isinstance(error, dict) else error)[:SHOWN])
        return body

    def _post(self, url: str, messages: list[dict], with_key: bool):
        headers = {"Content-Type": "application/json", "Accept": "application/json"} | ({"Authorization": f"Bearer {clean_key(self.key)}"} if with_key else {})
        data = json.dumps({"model": self.model, "messages": messages, "temperature": self.temperature, "max_tokens": self.max_tokens}).encode()
        try:
            with urllib.request.build_opener(_Stay).open(urllib.request.Request(url, data, headers), timeout=self.timeout) as r:
                return r.status, r.headers, r.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            return e.code, e.headers, e.read().decode("utf-8", "replace")
        except OSError as e:
            raise ChatError(str(e)[:SHOWN]) from e


def provider(service: ChatService) -> Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]:
    """A provider of kind ``chat``: asks for each row's messages; a failure is the row's error, not the task's."""

    def factory():
        def ask(rows: pd.DataFrame) -> pd.DataFrame:
            raw, errors = [], []
            for messages in rows["messages"]:
                try:
                    raw.append(service.complete([dict(m) for m in messages]))
                    errors.append(None)
                except ChatError as e:
                    raw.append(None)
                    errors.append(str(e))
            return rows.assign(raw=raw, error=errors)

        return ask

    return factory
