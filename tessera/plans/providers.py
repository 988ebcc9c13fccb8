"""Clients of chat services that speak JSON over HTTP, and calls between plain and asynchronous code."""

from __future__ import annotations

import asyncio
import json
import os
import urllib.error
import urllib.request
from collections.abc import Coroutine
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any, TypeVar

from tessera.errors import ClientError, ConfigurationError
from tessera.plans.client import Client, Messages
from tessera.settings import ClientSettings

T = TypeVar("T")


@dataclass(frozen=True)
class Service:
    """Where a service is, how it is signed in to, and which of two ways of messages it takes."""

    url: str
    key_variable: str
    way: str = "choices"


# Public addresses of services, and the variables that hold their keys.
SERVICES = {
    "openai": Service("https://api.openai.com/v1/chat/completions", "OPENAI_API_KEY"),
    "deepseek": Service("https://api.deepseek.com/chat/completions", "DEEPSEEK_API_KEY"),
    "anthropic": Service("https://api.anthropic.com/v1/messages", "ANTHROPIC_API_KEY", "content"),
}
PREFIXES = {"gpt": "openai", "o1": "openai", "o3": "openai", "deepseek": "deepseek", "claude": "anthropic"}


def provider_of(model: str) -> str:
    """The service that a model's name belongs to: before a slash, or by how it begins."""
    named = model.split("/")[0]
    found = named if named in SERVICES else next((p for begin, p in PREFIXES.items() if model.startswith(begin)), None)
    if found is None:
        raise ConfigurationError(f"no service is known for {model}")
    return found


@dataclass
class HttpClient:
    """One request for each call; retries and the cache are ``CachedClient``'s."""

    settings: ClientSettings
    service: Service | None = None
    key: str | None = None
    timeout_s: float = 60.0

    def _service(self) -> Service:
        if self.service is not None:
            return self.service
        name = self.settings.provider if self.settings.provider in SERVICES else provider_of(self.settings.model)
        return SERVICES[name]

    def request(self, messages: Messages, **options: Any) -> urllib.request.Request:
        service = self._service()
        key = self.key or os.environ.get(service.key_variable)
        if not key:
            raise ConfigurationError(f"{service.key_variable} is not set")
        model = self.settings.model.split("/", 1)[-1]
        body: dict[str, Any] = {"model": model, "temperature": self.settings.temperature, "max_tokens": self.settings.max_tokens} | options
        if service.way == "content":
            told = [m["content"] for m in messages if m["role"] == "system"]
            body |= {"messages": [dict(m) for m in messages if m["role"] != "system"]} | ({"system": "\n".join(told)} if told else {})
            headers = {"x-api-key": key, "anthropic-version": "2023-06-01"}
        else:
            body["messages"], headers = [dict(m) for m in messages], {"Authorization": f"Bearer {key}"}
        return urllib.request.Request(service.url, json.dumps(body).encode(), headers | {"Content-Type": "application/json"})

    def complete(self, messages: Messages, **options: Any) -> str:
        try:
            with urllib.request.urlopen(self.request(messages, **options), timeout=self.timeout_s) as answer:  # noqa: S310  addresses of services only
                found = json.load(answer)
            return found["content"][0]["text"] if self._service().way == "content" else found["choices"][0]["message"]["content"]
        except urllib.error.HTTPError as err:
            raise ClientError(f"{err.code}: {err.read(500).decode(errors='replace')}") from err
        except (OSError, ValueError, KeyError, IndexError) as err:
            raise ClientError(f"no usable answer: {err}") from err


async def complete_all(client: Client, asked: list[Messages], at_once: int = 3, **options: Any) -> list[str]:
    """Answers in the order of what was asked, ``at_once`` calls at a time."""
    gate = asyncio.Semaphore(at_once)

    async def one(messages: Messages) -> str:
        async with gate:
            return await asyncio.to_thread(client.complete, messages, **options)

    return list(await asyncio.gather(*(one(m) for m in asked)))


def wait_for(work: Coroutine[Any, Any, T]) -> T:
    """The result of asynchronous work, also where a loop is running already."""
    try:
        asyncio.get_running_loop()
    except RuntimeError:
        return asyncio.run(work)
    with ThreadPoolExecutor(1) as pool:
        return pool.submit(asyncio.run, work).result()
