"""Pages from the web as rows (SRC-1, SRC-2, SRC-4): each task fetches the urls of its own partitions.

The rows are what the rest takes as a snapshot: url as it was asked for, also after a redirect, status, the charset that the server
names, and the body's bytes. Nothing is raised for an url that can't be had; error says why.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.config import DEFAULT, Settings
from siteloom.functions import text
from siteloom.functions.urls import iri_to_uri, parse_base

FETCHED = "url string, status int, charset string, body binary, error string"
_NAMES = [c.split()[0] for c in FETCHED.split(", ")]
_TYPES = pa.schema([("url", pa.string()), ("status", pa.int32()), ("charset", pa.string()), ("body", pa.binary()), ("error", pa.string())])


def _one(address: str, headers: dict[str, str], timeout: float) -> tuple[int | None, str | None, bytes | None, str | None]:
    try:
        with urlopen(Request(address, headers=headers), timeout=timeout) as answer:
            return answer.status, answer.headers.get_content_charset(), answer.read(), None
    except HTTPError as e:
        return e.code, None, None, str(e.reason)
    except (OSError, ValueError) as e:
        return None, None, None, str(e)


def _fetch(headers: dict[str, str], timeout: float, delay: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str | None, float] = {}
        for batch in it:
            for url, address, base in zip(*(batch.column(c).to_pylist() for c in ("url", "address", "base")), strict=True):
                if delay and base in last:
                    time.sleep(max(0.0, last[base] + delay - time.monotonic()))
                got = _one(address, headers, timeout)
                last[base] = time.monotonic()
                # A page is handed on as soon as it is there, so a task holds one.
                yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, (url, *got), strict=True))], schema=_TYPES)

    return run


def fetch(urls: DataFrame, settings: Settings = DEFAULT, timeout: float = 30.0, delay: float | None = None) -> DataFrame:
    """Rows of FETCHED for each url of urls, FN-4 encoded where it is one of the web. delay: seconds between two fetches of a site
    (settings' own by default, DF-12); a site's urls are then in one task."""
    wait = settings.crawl_delay if delay is None else delay
    web = F.col("url").rlike("(?i)^(https?|ftps?)://")
    rows = urls.select("url", F.when(web, iri_to_uri(F.col("url"))).otherwise(F.col("url")).alias("address"), parse_base(F.col("url")).alias("base")).filter("url is not null")
    rows = rows.repartition("base") if wait else rows
    return rows.mapInArrow(_fetch(settings.request_headers(), timeout, wait), FETCHED)


def html() -> Column:
    """SRC-2: the text of a fetched row's body."""
    return text.decode(F.col("body"), F.col("charset"))
