"""Connectors: ordered routing, typed outcomes and boundaries for fetchers, embedders and language models.

Nothing here opens a connection. A fetcher, embedder or model is a callable
that is given; a stub serves tests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.runtime import ship


class NotApplicable(Exception):
    """Raised by a specialist that disclaims an address; the generic reader may then try."""


@dataclass
class Registry:
    """Readers by route, in order of priority; `web` is the generic one."""

    readers: dict[str, Callable[[str], str]] = field(default_factory=dict)

    def register(self, route: str):
        def keep(fn):
            self.readers[route] = fn
            return fn

        return keep

    def read(self, route: str, url: str) -> tuple[str | None, str | None, str | None]:
        """(content, failure kind, message): exactly one of content and failure. A specialist that fails is final."""
        last: tuple = (None, "unsupported", f"no reader for {route}")
        for name in dict.fromkeys((route, "web")):
            fn = self.readers.get(name)
            if fn is None:
                continue
            try:
                content = fn(url)
            except NotApplicable as e:
                last = (None, "not_applicable", str(e)[:240])
                continue
            except TimeoutError as e:
                return None, "timeout", str(e)[:240]
            except Exception as e:
                return None, "error", str(e)[:240]
            return (content, None, None) if content and content.strip() else (None, "empty", "no content")
        return last


def fetch(addresses: DataFrame, registry: Registry) -> DataFrame:
    """addresses (url) with route, content, failure, message. Addresses that aren't public are refused unread."""
    ship(addresses.sparkSession)
    rows = addresses.select("url", F.when(T.is_public_url(F.col("url")), T.url_route(F.col("url"))).otherwise(F.lit("refused")).alias("route"))

    def run(batches):
        for batch in batches:
            urls, routes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            got = [(None, "refused", "address not public") if r == "refused" else registry.read(r, u) for u, r in zip(urls, routes)]
            columns = [pa.array([g[k] for g in got], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["url", "route", "content", "failure", "message"])

    return rows.mapInArrow(run, "url string, route string, content string, failure string, message string")


def embed(rows: DataFrame, key: str, text: str, embedder: Callable[[list[str]], Iterable], batch: int = 8, most: int = 2_000) -> DataFrame:
    """key, embedding of the first `most` characters; null for what the embedder fails on, item by item."""
    ship(rows.sparkSession)
    kind = dict(rows.dtypes)[key]

    def one(texts: list[str]) -> list:
        try:
            return [list(map(float, v)) for v in embedder(texts)]
        except Exception:
            return [None] if len(texts) == 1 else [v for t in texts for v in one([t])]

    def run(batches):
        for b in batches:
            texts = [(t or "")[:most] for t in b.column(1).to_pylist()]
            vectors = [v for k in range(0, len(texts), batch) for v in one(texts[k : k + batch])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.list_(pa.float64()))], names=[key, "embedding"])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, embedding array<double>")


def complete(rows: DataFrame, key: str, prompt: str, model: Callable[[str], str], ladder: tuple[int | None, ...] = (None, 50_000, 20_000)) -> DataFrame:
    """key, answer, error: the model's answer; timeouts and empty answers are tried again with shorter prompts."""
    ship(rows.sparkSession)
    kind = dict(rows.dtypes)[key]

    def ask(text: str) -> tuple[str | None, str | None]:
        error = "empty"
        for size in ladder:
            try:
                answer = model(text[:size])
            except TimeoutError:
                error = "timeout"
                continue
            except Exception as e:
                return None, f"{type(e).__name__}: {e}"[:240]
            if answer:
                return answer, None
        return None, error

    def run(batches):
        for b in batches:
            got = [ask(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=[key, "answer", "error"])

    return rows.select(key, prompt).mapInArrow(run, f"{key} {kind}, answer string, error string")
