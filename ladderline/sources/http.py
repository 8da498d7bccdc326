"""JSON over HTTP with retries and a rate limit. The transport is passed in: (url, params, timeout) ->
(status, headers, body); it raises OSError where a connection fails. Runs on the driver."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from functools import partial
from http.client import HTTPException


class TransientHttpError(RuntimeError):
    pass


class PermanentHttpError(RuntimeError):
    def __init__(self, status_code: int):
        super().__init__(f"HTTP {status_code}")
        self.status_code = status_code


class RateLimiter:
    """At least 60 / per_minute seconds between calls."""

    def __init__(self, per_minute: float, clock=time.monotonic, sleep=time.sleep):
        if per_minute <= 0:
            raise ValueError("the rate must be positive")
        self.interval, self.clock, self.sleep = 60.0 / per_minute, clock, sleep
        self.lock, self.next = threading.Lock(), None

    def wait(self) -> None:
        with self.lock:
            now = self.clock()
            if self.next is not None and self.next > now:
                self.sleep(self.next - now)
                now = self.next
            self.next = now + self.interval


def retry_after(text: str | None) -> float | None:
    """Seconds, given as a number or as a date."""
    if not text:
        return None
    try:
        return max(0.0, float(text))
    except ValueError:
        try:
            return max(0.0, (parsedate_to_datetime(text) - datetime.now(UTC)).total_seconds())
        except (TypeError, ValueError):
            return None


def urllib_transport(url: str, params: dict, timeout: float, contact: str = "") -> tuple[int, dict, bytes]:
    """(status, headers, body) of a GET by the standard library; it says who asks."""
    from urllib.error import HTTPError
    from urllib.parse import urlencode
    from urllib.request import Request, urlopen

    agent = {"User-Agent": f"ladderline ({contact})" if contact else "ladderline"}
    try:
        with urlopen(Request(url + ("?" + urlencode(params) if params else ""), headers=agent), timeout=timeout) as r:
            return r.status, dict(r.headers), r.read()
    except HTTPError as e:
        return e.code, dict(e.headers), b""


def live_feed(settings, transport: Callable = urllib_transport, sleep=time.sleep) -> Callable[[str, dict], object]:
    """A ``get(path, params)`` over the service that the settings name, within its rate."""
    if not settings.feed_base_url:
        raise ValueError("FEED_BASE_URL is not set")
    if transport is urllib_transport:
        transport = partial(urllib_transport, contact=settings.contact_email)
    limiter = RateLimiter(settings.rate_limit_per_min, sleep=sleep)
    client = HttpClient(transport, limiter, settings.max_retries, timeout=settings.request_timeout, sleep=sleep)
    key = {"api_key": settings.feed_api_key} if settings.feed_api_key else {}
    return lambda path, params: client.get_json(f"{settings.feed_base_url.rstrip('/')}/{path}", {**params, **key})


class HttpClient:
    def __init__(self, transport: Callable, limiter: RateLimiter | None = None, max_retries: int = 4, backoff: float = 1.0, timeout: float = 20.0, sleep=time.sleep):
        self.transport, self.limiter, self.max_retries = transport, limiter, max_retries
        self.backoff, self.timeout, self.sleep = backoff, timeout, sleep

    def get_json(self, url: str, params: dict | None = None):
        for attempt in range(1, self.max_retries + 1):
            if self.limiter:
                self.limiter.wait()
            pause = self.backoff * 2 ** (attempt - 1)
            try:
                status, headers, body = self.transport(url, params or {}, self.timeout)
            except (OSError, HTTPException):  # no connection, or a body that ends too early
                status = None
            if status is not None and status < 400:
                try:
                    return json.loads(body)
                except ValueError as e:
                    raise ValueError(f"{url} gave no JSON") from e
            if status == 429:
                asked = retry_after(headers.get("Retry-After"))
                pause = pause if asked is None else asked
            elif status is not None and status < 500:
                raise PermanentHttpError(status)
            if attempt < self.max_retries:
                self.sleep(pause)
        raise TransientHttpError(f"{url} failed {self.max_retries} times")
