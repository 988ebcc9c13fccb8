"""Model clients: a protocol, a scripted one, retries and a cache. No provider is built in."""

from __future__ import annotations

import hashlib
import json
import sqlite3
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

from tessera.errors import ClientError
from tessera.settings import RetrySettings
from tessera.spec import strip_fences

Messages = Sequence[dict[str, str]]


class Client(Protocol):
    def complete(self, messages: Messages, **options: Any) -> str: ...


@dataclass
class ScriptedClient:
    """Gives its replies in turn, over and over; keeps what it was asked."""

    replies: Sequence[str]
    asked: list[list[dict[str, str]]] = field(default_factory=list)

    def complete(self, messages: Messages, **options: Any) -> str:
        self.asked.append(list(messages))
        return self.replies[(len(self.asked) - 1) % len(self.replies)]


def cache_key(**parts: Any) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


class ResponseCache:
    """Answers by the hash of everything that was asked, in memory or in a SQLite file."""

    def __init__(self, path: str = ":memory:"):
        self._db = sqlite3.connect(path, check_same_thread=False)
        self._db.execute("CREATE TABLE IF NOT EXISTS answers (key TEXT PRIMARY KEY, answer TEXT)")

    def get(self, key: str) -> str | None:
        found = self._db.execute("SELECT answer FROM answers WHERE key = ?", (key,)).fetchone()
        return found[0] if found else None

    def set(self, key: str, answer: str) -> None:
        with self._db:
            self._db.execute("INSERT OR REPLACE INTO answers VALUES (?, ?)", (key, answer))


def with_retries(call: Callable[[], Any], retry: RetrySettings, sleep: Callable[[float], None] = time.sleep) -> Any:
    for attempt in range(retry.max_retries + 1):
        try:
            return call()
        except Exception as err:  # noqa: BLE001  any failure may pass
            if attempt == retry.max_retries:
                raise ClientError(f"failed {attempt + 1} times: {err}") from err
            sleep(min(retry.max_delay_s, retry.base_delay_s * retry.exponent**attempt))
    raise ClientError("no attempt was made")


@dataclass
class CachedClient:
    """A client behind a cache and retries, for texts and for JSON."""

    inner: Client
    cache: ResponseCache = field(default_factory=ResponseCache)
    retry: RetrySettings = field(default_factory=RetrySettings)
    model: str = ""
    sleep: Callable[[float], None] = time.sleep

    def complete(self, messages: Messages, **options: Any) -> str:
        key = cache_key(model=self.model, messages=list(messages), options=options)
        answer = self.cache.get(key)
        if answer is None:
            answer = with_retries(lambda: self.inner.complete(messages, **options), self.retry, self.sleep)
            self.cache.set(key, answer)
        return answer

    def complete_json(self, messages: Messages, shape: str = "", **options: Any) -> Any:
        hint = {"role": "system", "content": f"Answer with JSON only. {shape}".strip()}
        text = self.complete([hint, *messages], **options)
        try:
            return json.loads(strip_fences(text))
        except ValueError as err:
            raise ClientError(f"the answer isn't JSON: {err}") from err
