"""Requests to registries: a polite client, and a table of answers that later runs read first."""

from __future__ import annotations

import hashlib
import http.client
import json
import os
import shutil
import sys
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
import warnings
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BACKOFF, LONGEST_WAIT, JITTER = (1.0, 2.0, 4.0, 8.0), 60.0, 0.5
VERSION = "0.2"
#: (status, headers, body) of a GET; raises OSError or HTTPException where there is no answer
Transport = Callable[[str, Mapping[str, str], float], tuple[int, Mapping[str, str], bytes]]


class Transient(Exception):
    """A registry could not be asked: ignorance, not absence."""


def jitter(url: str) -> float:
    """The same part of ``JITTER`` for the same address, so that a run can be repeated."""
    return JITTER * int.from_bytes(hashlib.sha256(url.encode()).digest()[:2], "big") / 0xFFFF


def retry_after(headers: Mapping[str, str]) -> float | None:
    """Seconds that an answer asks to wait, if it gives a number."""
    given = (headers.get("Retry-After") or "").strip()
    return min(float(given), LONGEST_WAIT) if given.isdecimal() else None


def get(url: str, headers: Mapping[str, str], timeout: float) -> tuple[int, Mapping[str, str], bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=dict(headers)), timeout=timeout) as answer:
            return answer.status, answer.headers, answer.read()
    except urllib.error.HTTPError as refused:
        return refused.code, refused.headers, b""


@dataclass
class Client:
    """GETs with a pause between requests to one host and repeated tries.

    It is sent to executors: a lookup keeps the requests to one host in one task, so that the
    pause holds for the whole cluster.
    """

    mailto: str | None = None
    timeout: float = 30.0
    pause: float = 0.2
    transport: Transport = get
    wait: Callable[[float], None] = time.sleep
    asked: dict[str, float] = field(default_factory=dict)

    def headers(self) -> dict[str, str]:
        return {"User-Agent": f"citeledger/{VERSION}" + (f"; mailto={self.mailto}" if self.mailto else "")}

    def _hold(self, host: str, pause: float) -> None:
        now = time.monotonic()
        begin = max(now, self.asked.get(host, now - pause) + pause)
        self.asked[host] = begin
        if begin > now:
            self.wait(begin - now)

    def body(self, url: str, pause: float | None = None) -> bytes | None:
        """The answer's body, None where the registry says that there is nothing; Transient after the last try."""
        parts = urllib.parse.urlparse(url)
        if parts.scheme.lower() not in ("http", "https"):
            raise ValueError(f"no web address: {url!r}")
        why: object = None
        for n, delay in enumerate([*BACKOFF, None]):
            self._hold(parts.netloc.lower(), self.pause if pause is None else pause)
            asked = None
            try:
                status, headers, body = self.transport(url, self.headers(), self.timeout)
                if status == 404:
                    return None
                if status < 400:
                    return body
                why, asked = f"status {status}", retry_after(headers)
            except (OSError, http.client.HTTPException) as failed:
                why = failed
            if delay is not None:
                self.wait(delay + jitter(url) if asked is None else asked)
        raise Transient(f"{url}: no answer in {n + 1} tries ({why})")

    def text(self, url: str, pause: float | None = None) -> str | None:
        body = self.body(url, pause)
        return None if body is None else body.decode("utf-8", "replace")

    def json(self, url: str, pause: float | None = None) -> dict | None:
        body = self.body(url, pause)
        return None if body is None else json.loads(body)


def default_cache() -> Path:
    home = Path.home()
    base = os.environ.get("XDG_CACHE_HOME") or (home / "Library" / "Caches" if sys.platform == "darwin" else home / ".cache")
    return Path(base) / "citeledger"


ANSWER = "source string, key string, payload string, fetched_at timestamp"


class Answers:
    """What registries answered, as an append-only table: source, key, payload (null: not there), time.

    One row answers one key, whatever request it came with, so another batch finds it too.  Of
    several the latest counts.  A folder that can't be made turns the table off with a warning.
    """

    def __init__(self, spark: SparkSession, root: Path | str, days: int = 90):
        self.spark, self.root, self.days = spark, Path(root), days
        self.usable = True
        try:
            self.root.mkdir(parents=True, exist_ok=True)
        except OSError as bad:
            self.usable = False
            warnings.warn(f"{self.root} can't hold answers ({bad}): all lookups go to the network and none can be repeated offline", RuntimeWarning, stacklevel=2)

    def parts(self) -> list[str]:
        return sorted(str(p) for p in self.root.glob("*.answers")) if self.usable else []

    def rows(self) -> DataFrame:
        parts = self.parts()
        return self.spark.read.schema(ANSWER).parquet(*parts) if parts else self.spark.createDataFrame([], ANSWER)

    def known(self, source: str, keys: DataFrame) -> DataFrame:
        """(key, payload) of keys that were answered not too long ago."""
        fresh = self.rows().where((F.col("source") == source) & (F.col("fetched_at") >= F.current_timestamp() - F.make_interval(days=F.lit(self.days))))
        latest = fresh.join(keys, "key", "left_semi").groupBy("key").agg(F.max_by(F.struct("payload"), "fetched_at").alias("a"))
        return latest.select("key", "a.payload")

    def add(self, source: str, answers: DataFrame) -> None:
        """Keep (key, payload)."""
        if not self.usable:
            return
        rows = answers.select(F.lit(source).alias("source"), "key", "payload", F.current_timestamp().alias("fetched_at"))
        try:
            rows.coalesce(1).write.parquet(str(self.root / f"{uuid.uuid4().hex}.answers"))
        except Exception as bad:
            if not isinstance(bad.__cause__ or bad, OSError) and "Exception" not in type(bad).__name__:
                raise
            warnings.warn(f"answers could not be kept in {self.root} ({str(bad)[:200]}); verdicts are the same", RuntimeWarning, stacklevel=2)

    def clear(self) -> None:
        for part in self.parts():
            shutil.rmtree(part, ignore_errors=True)

    def info(self) -> tuple[int, int]:
        """(answers, bytes)."""
        parts = self.parts()
        return (self.rows().count() if parts else 0), sum(f.stat().st_size for p in parts for f in Path(p).rglob("*.parquet"))
