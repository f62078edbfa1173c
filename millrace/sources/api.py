"""Paged web sources behind a transport that the caller gives, so nothing here opens a connection."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: (path, parameters) -> (status, headers, body)
Transport = Callable[[str, dict[str, Any]], tuple[int, dict[str, str], Any]]


def at_path(data: Any, path: str | None) -> Any:
    for part in (path or "").split(".") if path else []:
        data = data.get(part) if isinstance(data, dict) else None
    return data


@dataclass
class Offset:
    items: str | None = "items"
    total: str | None = None
    size: int = 100
    offset_name: str = "offset"
    limit_name: str = "limit"

    def first(self) -> dict[str, Any]:
        return {self.offset_name: 0, self.limit_name: self.size}

    def following(self, params: dict, headers: dict, body: Any, got: int) -> dict[str, Any] | None:
        done = params[self.offset_name] + got
        total = at_path(body, self.total) if self.total else None
        over = got == 0 or (done >= total if total is not None else got < self.size)
        return None if over else params | {self.offset_name: done}


@dataclass
class Cursor:
    items: str | None = "items"
    cursor: str = "next"
    name: str = "cursor"

    def first(self) -> dict[str, Any]:
        return {}

    def following(self, params: dict, headers: dict, body: Any, got: int) -> dict[str, Any] | None:
        value = at_path(body, self.cursor)
        return params | {self.name: value} if value else None


@dataclass
class LinkHeader:
    items: str | None = None

    def first(self) -> dict[str, Any]:
        return {}

    def following(self, params: dict, headers: dict, body: Any, got: int) -> dict[str, Any] | None:
        for link in {k.lower(): v for k, v in headers.items()}.get("link", "").split(","):
            url, _, rel = link.partition(";")
            if 'rel="next"' in rel:
                return params | dict(parse_qsl(urlsplit(url.strip(" <>")).query))
        return None


def pages(transport: Transport, path: str, paging: Offset | Cursor | LinkHeader, params: dict[str, Any] | None = None, retries: int = 3, wait: Callable[[float], None] = time.sleep, retry_on: tuple[int, ...] = (429, 500, 502, 503, 504)) -> Iterator[list]:
    """Items page by page; the initial parameters go with every page."""
    now: dict[str, Any] | None = dict(params or {}) | paging.first()
    while now is not None:
        for attempt in range(retries + 1):
            status, headers, body = transport(path, now)
            if status < 400:
                break
            if status not in retry_on or attempt == retries:
                raise OSError(f"{path}: status {status}")
            wait(2.0**attempt)
        items = at_path(body, paging.items) if paging.items else body
        items = items if isinstance(items, list) else []
        yield items
        now = paging.following(now, headers, body, len(items))


def read_api(spark: SparkSession, transport: Transport, path: str, paging: Offset | Cursor | LinkHeader, schema: T.StructType | str, params: dict[str, Any] | None = None) -> DataFrame:
    """All items as a table of the given schema.  Pages follow one another, so they are fetched by the driver."""
    lines = [(json.dumps(x),) for page in pages(transport, path, paging, params) for x in page]
    from pyspark.sql import functions as F

    text = spark.createDataFrame(lines, "value string")
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    return text.select(F.from_json("value", schema if not isinstance(schema, str) else ddl).alias("r")).select("r.*")


# what goes round a transport.  A request's headers are its parameter ``headers``.


def with_headers(transport: Transport, headers: Callable[[], dict[str, str]]) -> Transport:
    def call(path: str, params: dict[str, Any]) -> tuple[int, dict[str, str], Any]:
        return transport(path, params | {"headers": params.get("headers", {}) | headers()})

    return call


def api_key(transport: Transport, key: str, name: str = "X-API-Key", in_query: bool = False) -> Transport:
    if in_query:
        return lambda path, params: transport(path, params | {name: key})
    return with_headers(transport, lambda: {name: key})


def bearer(transport: Transport, token: str) -> Transport:
    return with_headers(transport, lambda: {"Authorization": f"Bearer {token}"})


def basic(transport: Transport, user: str, password: str) -> Transport:
    text = base64.b64encode(f"{user}:{password}".encode()).decode()
    return with_headers(transport, lambda: {"Authorization": f"Basic {text}"})


@dataclass
class ClientCredentials:
    """Tokens by OAuth 2's client credentials, asked for anew shortly before they expire."""

    transport: Transport
    path: str
    client: str
    secret: str = field(repr=False)
    early: float = 30.0
    clock: Callable[[], float] = time.time
    _token: str = field(default="", repr=False)
    _until: float = 0.0

    def token(self) -> str:
        if self.clock() >= self._until - self.early:
            status, _, body = self.transport(self.path, {"grant_type": "client_credentials", "client_id": self.client, "client_secret": self.secret})
            if status >= 400:
                raise PermissionError(f"{self.path}: status {status}")
            self._token, self._until = body["access_token"], self.clock() + float(body.get("expires_in", 3600))
        return self._token

    def around(self, transport: Transport) -> Transport:
        return with_headers(transport, lambda: {"Authorization": f"Bearer {self.token()}"})


@dataclass
class RateLimit:
    """At most ``calls`` in any ``seconds``; further ones wait."""

    calls: int
    seconds: float
    clock: Callable[[], float] = time.monotonic
    wait: Callable[[float], None] = time.sleep
    made: list[float] = field(default_factory=list)

    def around(self, transport: Transport) -> Transport:
        def call(path: str, params: dict[str, Any]) -> tuple[int, dict[str, str], Any]:
            now = self.clock()
            self.made = [t for t in self.made if now - t < self.seconds]
            if len(self.made) >= self.calls:
                self.wait(self.seconds - (now - self.made[0]))
                now = self.clock()
                self.made = self.made[1:]
            self.made.append(now)
            return transport(path, params)

        return call


def graphql(transport: Transport, path: str, query: str, variables: dict[str, Any] | None = None) -> Any:
    """The data of an answer; its errors are raised."""
    status, _, body = transport(path, {"query": query, "variables": variables or {}})
    if status >= 400 or body.get("errors"):
        raise OSError(f"{path}: status {status}, {'; '.join(e.get('message', '') for e in body.get('errors') or [])}")
    return body["data"]


def read_validated(spark: SparkSession, transport: Transport, path: str, paging: Offset | Cursor | LinkHeader, schema: T.StructType | str, constraints: dict[str, dict[str, Any]]) -> tuple[DataFrame, DataFrame]:
    """Items that keep the constraints, and those that don't with what is wrong; one vocabulary with ``quality.checks``."""
    from millrace.quality.checks import split_valid

    return split_valid(read_api(spark, transport, path, paging, schema), constraints)


def signed_event(body: bytes, signature: str, secret: str) -> dict[str, Any]:
    """The event of a webhook whose body is signed by HMAC-SHA256 (hex, with or without ``sha256=``)."""
    want = hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()
    if not hmac.compare_digest(want, signature.removeprefix("sha256=")):
        raise PermissionError("the signature doesn't fit")
    return json.loads(body)
