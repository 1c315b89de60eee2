"""Extraction over HTTP into a landing zone of immutable snapshots."""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession

from starloom import storage


class ExtractError(Exception):
    """A source could not be read."""


@dataclass
class Extracted:
    source: str
    path: str
    rows: int
    bytes: int
    sha256: str
    from_fallback: bool = False
    at: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())


def snapshot_name(when: datetime | None = None) -> str:
    return (when or datetime.now(timezone.utc)).strftime("%Y-%m-%d-%H%M%S")


def latest_snapshot(folder: str | Path) -> Path | None:
    """The last snapshot by name; names sort by time."""
    found = sorted(p for p in Path(folder).iterdir() if p.is_dir()) if Path(folder).is_dir() else []
    return found[-1] if found else None


def http_get(url: str, timeout: float = 30) -> bytes:
    with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
        return answer.read()


def with_retry(get: Callable[[], bytes], attempts: int = 3, first_wait: float = 1, most_wait: float = 4, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """Tries again after network errors and 5xx, with doubling waits. 4xx ends it at once."""
    for k in range(attempts):
        try:
            return get()
        except urllib.error.HTTPError as e:
            if e.code < 500 or k == attempts - 1:
                raise ExtractError(f"HTTP {e.code}") from e
        except (urllib.error.URLError, OSError) as e:
            if k == attempts - 1:
                raise ExtractError(str(e)) from e
        sleep(min(most_wait, first_wait * 2**k))
    raise ExtractError("no attempt")


@dataclass
class Extractor:
    """Base of extractors. A snapshot is a folder; files appear in it complete, under their own name. With a session they land
    through Hadoop's file systems, wherever Spark reads; without one on local disk."""

    source: str
    target: str
    get: Callable[[str], bytes] = http_get
    sleep: Callable[[float], None] = time.sleep
    spark: SparkSession | None = None

    def check(self, content: bytes) -> int:
        """Rows of valid content; raises ExtractError if it is not valid."""
        raise NotImplementedError

    def _write(self, path: str, content: bytes) -> None:
        if self.spark is not None:
            storage.write_bytes(self.spark, path, content)
            return
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        part = Path(f"{path}.tmp")
        part.write_bytes(content)
        part.replace(path)

    def _read(self, path: str) -> str | None:
        if self.spark is not None:
            return storage.read_text(self.spark, path) if storage.exists(self.spark, path) else None
        return Path(path).read_text() if Path(path).exists() else None

    def land(self, url: str, name: str, snapshot: str | None = None, fallback: str | None = None) -> Extracted:
        used = False
        try:
            content = with_retry(lambda: self.get(url), sleep=self.sleep)
            rows = self.check(content)
        except ExtractError:
            if not fallback or not os.path.exists(fallback):
                raise
            content, used = Path(fallback).read_bytes(), True
            rows = self.check(content)
        folder = f"{str(self.target).rstrip('/')}/{snapshot or snapshot_name()}"
        self._write(f"{folder}/{name}", content)
        out = Extracted(self.source, f"{folder}/{name}", rows, len(content), hashlib.sha256(content).hexdigest(), used)
        known = json.loads(self._read(f"{folder}/_manifest.json") or json.dumps({"source": self.source, "files": {}}))
        known["files"][name] = {k: v for k, v in asdict(out).items() if k != "source"}
        self._write(f"{folder}/_manifest.json", json.dumps(known, indent=1, sort_keys=True).encode())
        return out


class CsvExtractor(Extractor):
    def check(self, content: bytes) -> int:
        if not content.strip():
            raise ExtractError("empty answer")
        return max(0, len(content.splitlines()) - 1)


class JsonExtractor(Extractor):
    def check(self, content: bytes) -> int:
        try:
            value = json.loads(content)
        except ValueError as e:
            raise ExtractError(f"not JSON: {e}") from e
        return len(value) if isinstance(value, list) else 1
