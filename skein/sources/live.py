"""A live web: GET requests by the executors, spaced by origin.

URLs are dealt by origin, so that one task sends all requests of an origin in a generation and can
keep its gap and its number of open requests. A task that is run again asks again; what it got is staged once it ends.
"""

from __future__ import annotations

import http.client
import socket
import ssl
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from email.utils import parsedate_to_datetime
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import http as rules
from skein.functions import url
from skein.plans.config import CrawlConfig
from skein.sources import site
from skein.sources.staging import staged

ANSWER = "url string, status_code int, content_type string, location string, body string, error_code string, too_large boolean, attempts int, tries array<struct<status int, kind string, wait bigint, duration bigint>>"
_NAMES = "url status_code content_type location body error_code too_large attempts tries".split()
ACCEPT = "text/html,application/xhtml+xml"


def error_code(error: BaseException) -> str:
    """The code by which an error's kind is known."""
    if isinstance(error, TimeoutError):
        return "TimeoutError"
    if isinstance(error, socket.gaierror):
        return "ENOTFOUND"
    if isinstance(error, ssl.SSLError):
        return "CERT_INVALID" if isinstance(error, ssl.SSLCertVerificationError) else "ERR_TLS_FAILED"
    if isinstance(error, ConnectionRefusedError):
        return "ECONNREFUSED"
    if isinstance(error, (ConnectionResetError, BrokenPipeError, http.client.HTTPException)):
        return "ECONNRESET"
    return type(error).__name__


def _html(kind: str | None) -> bool:
    return (kind or "").split(";")[0].strip().lower() in ("text/html", "application/xhtml+xml")


def once(address: str, config: CrawlConfig, any_type: bool = False, most: int | None = None) -> tuple[dict, str | None]:
    """One attempt: its answer and Retry-After. The body is read only of a 2xx HTML answer, or of any type's."""
    most = config.max_response_bytes if most is None else most
    got = dict.fromkeys(_NAMES) | {"url": address, "too_large": False}
    parts = urlsplit(address)
    kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
    ends = time.monotonic() + config.timeout_ms / 1000
    connection = kind(parts.hostname, parts.port, timeout=config.timeout_ms / 1000)
    try:
        connection.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers={"User-Agent": config.user_agent, "Accept": ACCEPT})
        answer = connection.getresponse()
        got |= {"status_code": answer.status, "content_type": answer.getheader("Content-Type"), "location": answer.getheader("Location")}
        if 200 <= answer.status < 300 and (any_type or _html(got["content_type"])):
            length, data = answer.getheader("Content-Length"), bytearray()
            got["too_large"] = bool(length and length.isdigit() and int(length) > most)
            while not got["too_large"] and (piece := answer.read1(65536)):
                data += piece
                got["too_large"] = len(data) > most
                if time.monotonic() > ends:
                    raise TimeoutError
            got["body"] = None if got["too_large"] else data.decode("utf-8", "replace")
        return got, answer.getheader("Retry-After")
    except (OSError, http.client.HTTPException) as error:
        got["error_code"] = error_code(error)
        return got, None
    finally:
        connection.close()


def wait_ms(status: int | None, retry_after: str | None, attempt: int, base_ms: int, now: float) -> int | None:
    """The wait before the next attempt; None if it is over the cap."""
    wait = min(rules.WAIT_CAP, base_ms * 2 ** (attempt - 1))
    if status in (429, 503) and retry_after:
        if retry_after.strip().isdecimal():
            wait = max(wait, int(retry_after) * 1000)
        else:
            try:
                wait = max(wait, int((parsedate_to_datetime(retry_after).timestamp() - now) * 1000))
            except ValueError:
                pass
    return wait if wait <= rules.WAIT_CAP else None


_AGAIN = {"TimeoutError", "ECONNREFUSED", "ECONNRESET"}


KINDS = {"TimeoutError": "timeout", "ENOTFOUND": "dns", "ECONNREFUSED": "connect", "ECONNRESET": "reset"}


def error_kind(code: str | None) -> str | None:
    if code is None:
        return None
    return "tls" if code.startswith(("CERT_", "ERR_TLS_")) else KINDS.get(code, "connect")


def get(address: str, config: CrawlConfig, pace: Callable[[], None] = lambda: None, **body) -> dict:
    """A GET with its retries."""
    tries: list[dict] = []
    for attempt in range(1, config.retry_count + 2):
        pace()
        began = time.monotonic()
        got, after = once(address, config, **body)
        got |= {"attempts": attempt, "tries": tries}
        tries.append({"status": got["status_code"], "kind": error_kind(got["error_code"]), "wait": None, "duration": int((time.monotonic() - began) * 1000)})
        again = not got["too_large"] and (got["status_code"] in rules.RETRY_STATUSES if got["error_code"] is None else got["error_code"] in _AGAIN)
        wait = wait_ms(got["status_code"], after, attempt, config.retry_base_delay_ms, time.time())
        if not again or wait is None or attempt > config.retry_count:
            break
        tries[-1]["wait"] = wait
        time.sleep(wait / 1000)
    return got


def answers(config: CrawlConfig, gap_ms: int) -> Callable[[DataFrame], DataFrame]:
    """The live web of a crawl: a function from a table of URLs to the rows that the engine reads."""

    def asked(frames):
        import pandas as pd

        starts: dict[str, float] = {}
        turn = threading.Lock()

        def pace(origin: str) -> None:
            """Waits for the origin's next start; starts keep the gap whatever the order in which they are asked for."""
            with turn:
                at = max(time.monotonic(), starts.get(origin, 0.0) + gap_ms / 1000)
                starts[origin] = at
            time.sleep(max(0.0, at - time.monotonic()))

        # As many open requests as an origin has leases; a task has all of an origin's URLs.
        with ThreadPoolExecutor(min(config.concurrency, config.per_origin_limit)) as pool:
            for frame in frames:
                rows = list(pool.map(lambda u, o: get(u, config, lambda: pace(o)), frame["url"], frame["origin"]))
                yield pd.DataFrame(rows, columns=_NAMES).astype({"status_code": "Int32", "attempts": "Int32"})

    def web(urls: DataFrame) -> DataFrame:
        each = urls.distinct().withColumn("origin", url.origin(F.col("url"))).repartition("origin")
        got = staged(each.mapInPandas(asked, ANSWER), "answers")
        kind = F.when(F.col("too_large"), "too-large").when(F.col("error_code").isNotNull(), rules.error_kind(F.col("error_code")))
        return site.parsed(got.withColumn("error_kind", kind), config.max_response_bytes)

    return web


def robots_file(config: CrawlConfig) -> Callable[[str], dict]:
    """Fetches a robots.txt for the driver: one file a crawl, of capped size."""
    from skein.operators.robots import ROBOTS_BYTES

    def fetch(address: str) -> dict:
        got = get(address, config, any_type=True, most=ROBOTS_BYTES)
        code = got.pop("error_code")
        return got | {"error_kind": "too-large" if got["too_large"] else error_kind(code)}

    return fetch
